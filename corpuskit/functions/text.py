"""Small text and label expressions used by sources, search results and listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.config import DEFAULT_SNIPPET_CHARS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_slug(url) -> Column:
    """Last path segment after dropping trailing ``/``, every ``.html`` removed."""
    trimmed = F.regexp_replace(_col(url), "/+$", "")
    last = F.element_at(F.split(trimmed, "/"), -1)
    return F.replace(last, F.lit(".html"), F.lit(""))


def render_mail_text(subject, from_raw, to_raw, date, folder, body) -> Column:
    """Header lines, a blank line, then the body."""
    return F.concat(F.lit("Subject: "), _col(subject), F.lit("\nFrom: "), _col(from_raw),
                    F.lit("\nTo: "), _col(to_raw), F.lit("\nDate: "), _col(date),
                    F.lit("\nFolder: "), _col(folder), F.lit("\n\n"), _col(body))


def render_web_text(title, text) -> Column:
    """T13."""
    return F.concat(F.lit("Title: "), _col(title), F.lit("\n\n"), _col(text))


def clip_snippet(text, n: int = DEFAULT_SNIPPET_CHARS) -> Column:
    """First ``n`` characters."""
    return F.substring(_col(text), 1, n)


def default_score(score) -> Column:
    """A missing score reads as 0.0 in listings."""
    return F.coalesce(_col(score), F.lit(0.0))


def scalar_metadata(meta) -> Column:
    """Drop entries whose value is null."""
    return F.map_filter(_col(meta), lambda k, v: v.isNotNull())


def source_label(meta, score=None, use_url: bool = True) -> Column:
    """One-line label of a retrieved chunk.

    Mail: ``subject — from_addr — date`` (subject defaults to ``(no subject)``); else the
    file path, else the message id, else (``use_url``) the page url, else ``unknown``.
    A non-null score is prefixed as ``(score=0.123) ``.
    """
    m = _col(meta)

    def get(k):
        return F.nullif(m.getItem(k), F.lit(""))

    mail = F.concat_ws(" — ", F.coalesce(m.getItem("subject"), F.lit("(no subject)")),
                       F.coalesce(m.getItem("from_addr"), F.lit("")),
                       F.coalesce(m.getItem("date"), F.lit("")))
    chain = [get("file_path"), get("message_id")] + ([get("url")] if use_url else []) + [F.lit("unknown")]
    label = F.when(m.getItem("source_type") == "email", mail).otherwise(F.coalesce(*chain))
    if score is None:
        return label
    s = _col(score)
    return F.when(s.isNull(), label).otherwise(
        F.concat(F.lit("(score="), F.format_string("%.3f", s), F.lit(") "), label))


# Collection aliases (lower case) -> canonical collection.
COLLECTION_ALIASES = {
    "emails": "emails", "email": "emails",
    "paulgraham": "paulgraham", "paul_graham": "paulgraham", "pg": "paulgraham",
}


def canonical_collection(name) -> Column:
    """Canonical collection for a user-given name (aliases folded, others as given)."""
    n = F.lower(_col(name))
    out = _col(name)
    for alias in reversed(list(COLLECTION_ALIASES)):
        out = F.when(n == alias, F.lit(COLLECTION_ALIASES[alias])).otherwise(out)
    return out


def source_kind(name) -> Column:
    """Which loader serves a collection name: email, web or text."""
    n = F.lower(_col(name))
    return (F.when(n.isin("emails", "email"), F.lit("email"))
            .when(n.isin("paulgraham", "paul_graham", "pg"), F.lit("web"))
            .otherwise(F.lit("text")))


def size_gb(size_bytes) -> Column:
    """Bytes / 1e9 rounded half-even to one decimal."""
    return F.bround(_col(size_bytes) / F.lit(1e9), 1)
