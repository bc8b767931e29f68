"""S5 (+F1, F8, T10, T14): text documents from a file or a directory tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions.ids import file_doc_id, page_label

# File extensions the text source accepts (any case).
TEXT_EXTENSIONS = [".txt", ".md", ".markdown", ".pdf"]
# PDF pages need a parser; they come in as a (file_path, page, text) table instead.
READABLE_EXTENSIONS = [".txt", ".md", ".markdown"]


def read_text_files(spark: SparkSession, path: str | None) -> DataFrame:
    """One document per readable file under ``path`` (recursive, case-insensitive
    extension filter; a single file path is taken as is). A missing path is an error; no files gives an empty table.
    Output: ``doc_id, text, file_path, page, source_type``."""
    if not path:
        raise ValueError("read_text_files needs a file or directory path")
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        raise FileNotFoundError(f"path not found: {path}")
    schema = "doc_id string, text string, file_path string, page string, source_type string"
    # one row per file; zero-length files get no input split in Spark and yield no
    # document (they would give no chunk either)
    single = fs.getFileStatus(hpath).isFile()
    if single and path.lower().endswith(".pdf"):
        raise ValueError(f"{path}: PDF pages come in as a (file_path, page, text) table (documents_from_pages)")
    # the name filter is applied before any content is read
    reader = spark.read.format("binaryFile")
    if not single:
        names = ",".join("*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in READABLE_EXTENSIONS)
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + names + "}")
    files = reader.load(path).select(F.col("content").cast("string").alias("text"), F.col("path").alias("uri"))
    local = F.regexp_replace(F.col("uri"), r"^file:(//)?", "")
    out = files.select("text", local.alias("file_path"), F.lit("").alias("page"))
    if out.isEmpty():
        return spark.createDataFrame([], schema)
    return documents_from_pages(out)


def documents_from_pages(pages: DataFrame, path: str = "file_path", page: str = "page", text: str = "text") -> DataFrame:
    """Documents from a ``(file_path, page, text)`` table (page may be null or 0)."""
    label = page_label(F.col(page))
    return pages.select(file_doc_id(F.col(path), label, F.col(text)).alias("doc_id"), F.col(text).alias("text"),
                        F.col(path).alias("file_path"), label.alias("page"), F.lit("document").alias("source_type"))
