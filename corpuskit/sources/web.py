"""Documents from fetched web pages, links from index pages (native expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions.html import html_links, html_text, html_title
from corpuskit.functions.ids import web_doc_id
from corpuskit.functions.text import render_web_text, url_slug

# The reference's rule for essay links (no slash, ends in .html).
ESSAY_LINK = r"^[^/]*\.html$"


def read_pages(pages: DataFrame, url: str = "url", html: str = "html", source_type: str = "paulgraham") -> DataFrame:
    """``doc_id, url, slug, title, text, source_type`` per page; pages whose readable
    text is blank are dropped (F2)."""
    body = html_text(F.col(html))
    title = html_title(F.col(html))
    keep = [c for c in pages.columns if c not in (url, html)]
    # The blank test (F2) is applied after a generator: a plain filter on the computed
    # text would be pushed below the projection and run the regex chain twice.
    page = F.array(F.struct(title.alias("title"), body.alias("body")))
    out = (pages.select(*keep, F.col(url).alias("url"), F.explode_outer(page).alias("_p"))
                .where(F.col("_p.body").rlike(r"\S")))
    return out.select(*keep, web_doc_id(F.col("url")).alias("doc_id"), "url", url_slug(F.col("url")).alias("slug"),
                      F.col("_p.title").alias("title"), render_web_text(F.col("_p.title"), F.col("_p.body")).alias("text"),
                      F.lit(source_type).alias("source_type"))


def extract_links(pages: DataFrame, page_key: str = "page_id", html: str = "html", url: str = "url",
                  pattern: str = ESSAY_LINK, base: str | None = None, limit: int | None = None) -> DataFrame:
    """S7 (+F3, D2, L1): links of every index page that match ``pattern``, made absolute
    against ``base`` (default: the page's own scheme and host), distinct in first-seen
    order, optionally the first ``limit`` per page. Output ``page_key, pos, link``."""
    origin = F.lit(base.rstrip("/")) if base else F.regexp_extract(F.col(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    exploded = pages.select(page_key, origin.alias("_origin"), F.posexplode(html_links(F.col(html))).alias("pos", "href"))
    matched = exploded.where(F.col("href").rlike(pattern))
    absolute = F.when(F.col("href").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.col("href")).otherwise(
        F.concat(F.col("_origin"), F.when(F.col("href").startswith("/"), F.lit("")).otherwise(F.lit("/")), F.col("href")))
    links = matched.withColumn("link", absolute).groupBy(page_key, "link").agg(F.min("pos").alias("pos"))
    if limit is not None:
        # L1: first ``limit`` links per page (0 means none); a top-n report.
        w = Window.partitionBy(page_key).orderBy("pos")
        links = links.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
    return links.select(page_key, "pos", "link")
