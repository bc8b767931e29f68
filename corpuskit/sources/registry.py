"""Sources by name. A source is a callable ``(spark, **kwargs) -> DataFrame`` whose
result has the documents columns (``doc_id`` and ``text`` strings, ``source_type``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit import schemas
from corpuskit.sources.files import read_text_files
from corpuskit.sources.mail import parse_mail, read_mbox, select_mail
from corpuskit.sources.web import read_pages

REQUIRED = ["doc_id", "text", "source_type"]
_SOURCES: dict = {}


def check_documents(df: DataFrame) -> DataFrame:
    """Raise unless ``df`` has the documents columns (string id, text, source type)."""
    return schemas.check(df, schemas.DOCUMENTS, REQUIRED)


def register(name: str, fn) -> None:
    _SOURCES[name] = fn


def load(spark: SparkSession, name: str, **kwargs) -> DataFrame:
    """Run the source ``name`` and check its output."""
    if name not in _SOURCES:
        raise ValueError(f"unknown source {name!r}; known: {sorted(_SOURCES)}")
    return check_documents(_SOURCES[name](spark, **kwargs))


def _mail(spark: SparkSession, mbox: str | None = None, raw: DataFrame | None = None, folders=None,
          limit: int | None = None, existing: DataFrame | None = None) -> DataFrame:
    """F8: exactly one of ``mbox`` (path) or ``raw`` (landed (folder, seq, raw) table)."""
    if mbox and raw is not None:
        raise ValueError("pass either mbox or raw, not both")
    if mbox:
        place = ("source_file", "file_pos", "seq")
        docs = parse_mail(read_mbox(spark, mbox), keep=place)
        if existing is not None:
            docs = docs.join(existing.select(F.col("doc_id").cast("string")).distinct(), "doc_id", "left_anti")
        first = F.min(F.struct(*place, *[c for c in docs.columns if c not in ("doc_id", *place)]))
        return docs.groupBy("doc_id").agg(first.alias("_f")).select("doc_id", "_f.*").drop("source_file", "file_pos")
    if raw is not None:
        return select_mail(raw, folders, limit, existing)
    raise ValueError("the mail source needs mbox=... or raw=...")


def _text(spark: SparkSession, path: str | None = None) -> DataFrame:
    return read_text_files(spark, path)


def _web(spark: SparkSession, pages: DataFrame | None = None, limit: int | None = None,
         order: str = "url", source_type: str = "paulgraham") -> DataFrame:
    """``limit``: the first so many pages by ``order`` (None: all; 0: none)."""
    if pages is None:
        raise ValueError("the web source needs pages=<DataFrame of url, html>")
    if limit is not None:
        pages = pages.orderBy(order).limit(limit)
    return read_pages(pages, source_type=source_type)


register("email", _mail)
register("text", _text)
register("web", _web)
