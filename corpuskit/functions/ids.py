"""Stable document ids as native expressions (sha1 hex, same as Python's hashlib)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def web_doc_id(url) -> Column:
    """sha1 of the url."""
    return F.sha1(_col(url))


def page_label(page) -> Column:
    """Page as text; empty when null, empty or the number 0."""
    p = _col(page).cast("string")
    return F.when(p.isNull() | (p == "") | (p == "0"), F.lit("")).otherwise(p)


def file_doc_id(path, page, text) -> Column:
    """sha1(path | page | sha1(text))."""
    return F.sha1(F.concat_ws("|", F.coalesce(_col(path), F.lit("")),
                              F.coalesce(_col(page), F.lit("")), F.sha1(_col(text))))


def mail_fallback_id(subject, from_raw, date) -> Column:
    """T11 fallback: ``fallback-`` + sha1(subject|from|date)."""
    return F.concat(F.lit("fallback-"),
                    F.sha1(F.concat_ws("|", _col(subject), _col(from_raw), _col(date))))


def mail_doc_id(message_id, subject, from_raw, date) -> Column:
    """The Message-Id when present, else the fallback id."""
    mid = _col(message_id)
    return F.when(mid.isNull() | (mid == ""), mail_fallback_id(subject, from_raw, date)).otherwise(mid)


def chunk_id(doc_id, index) -> Column:
    return F.concat(_col(doc_id).cast("string"), F.lit("#"), _col(index).cast("string"))
