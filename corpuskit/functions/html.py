"""HTML to text as column expressions; only character references are decoded in Arrow batches.

Each run of tags becomes one newline, which is what joining an html parser's text nodes with a
newline gives: adjacent tags yield one separator. Comments, scripts, styles and tags are matched in
one pass over the text, so markup inside one of them is part of it: a comment's opening inside a
script opens nothing, and a ``>`` inside a quoted attribute closes nothing.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_TAG_END = r"""[^'">]*+(?:(?:"[^"]*+"|'[^']*+')[^'">]*+)*+>"""  # a ``>`` inside a quoted attribute ends no tag
_COMMENT = r"<!--.*?(?:-->|\z)"
_HIDDEN = r"<{0}\b" + _TAG_END + r".*?(?:</{0}\s*>|\z)"  # an element that is not closed hides the rest
_TAG = r"<[a-z/!]" + _TAG_END
_TITLE = r"(?is)<title[^>]*>(.*?)</title\s*>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


def decode_entities(c) -> Column:
    """Named and numeric character references as characters, by the HTML5 rules of the standard library
    (names that browsers know without a semicolon included)."""
    return _unescape(_col(c))


def strip_text(c) -> Column:
    """Strip leading/trailing whitespace of any kind (``trim`` only removes spaces)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def collapse_newlines(c) -> Column:
    """Three or more newlines become two, then strip."""
    return strip_text(F.regexp_replace(_col(c), r"\n{3,}", "\n\n"))


def html_title(c) -> Column:
    """T5: text of the first ``<title>``, entity-decoded and stripped; ``""`` if none."""
    raw = F.regexp_extract(_col(c), _TITLE, 1)
    return strip_text(decode_entities(raw))


def html_text(c, drop_head: bool = True) -> Column:
    """Readable text. ``drop_head=False`` is the mail variant (title text stays)."""
    hidden = ["script", "style"] + (["head"] if drop_head else [])
    # one pass from left to right: what opens first decides how the text behind it is read
    markup = "|".join([_COMMENT, *[_HIDDEN.replace("{0}", name) for name in hidden], _TAG])
    out = F.regexp_replace(_col(c), "(?is)(?:" + markup + ")+", "\n")
    out = decode_entities(out)
    return collapse_newlines(out)


def html_links(c) -> Column:
    """All href values of anchor tags in document order (array<string>)."""
    return F.regexp_extract_all(
        _col(c), F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), 1)
