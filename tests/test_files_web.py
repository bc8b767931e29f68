import hashlib
import os

import pytest
from pyspark.sql import functions as F

from corpuskit.sources import registry
from corpuskit.sources.files import documents_from_pages, read_text_files
from corpuskit.sources.web import extract_links, read_pages


def _tree(root):
    os.makedirs(os.path.join(root, "sub"))
    files = {"a.TXT": "alpha", "sub/b.md": "beta", "sub/c.markdown": "gamma", "d.bin": "nope", "e.txt": ""}
    for name, text in files.items():
        with open(os.path.join(root, name), "w") as f:
            f.write(text)


def test_read_text_files_b6(spark, tmp_dir):
    root = os.path.join(tmp_dir, "tree")
    _tree(root)
    docs = {os.path.basename(r.file_path): r for r in read_text_files(spark, root).collect()}
    # zero-length files get no input split in Spark, so the empty e.txt yields no document
    assert set(docs) == {"a.TXT", "b.md", "c.markdown"}
    a = docs["a.TXT"]
    inner = hashlib.sha1(b"alpha").hexdigest()
    assert a.doc_id == hashlib.sha1(f"{a.file_path}||{inner}".encode()).hexdigest() and a.page == ""
    one = read_text_files(spark, os.path.join(root, "d.bin")).collect()
    assert len(one) == 1  # a single file is taken as is
    empty = os.path.join(tmp_dir, "empty")
    os.makedirs(empty)
    assert read_text_files(spark, empty).count() == 0
    with pytest.raises(FileNotFoundError):
        read_text_files(spark, os.path.join(tmp_dir, "missing"))
    with pytest.raises(ValueError):
        read_text_files(spark, "")


def test_pages_table_with_page_numbers(spark):
    df = spark.createDataFrame([("f.pdf", 0, "p0"), ("f.pdf", 2, "p2"), ("f.pdf", None, "pn")],
                               "file_path string, page int, text string")
    pages = [r.page for r in documents_from_pages(df).collect()]
    assert pages == ["", "2", ""]


def test_registry_validates(spark, tmp_dir):
    root = os.path.join(tmp_dir, "tree")
    _tree(root)
    assert registry.load(spark, "text", path=root).count() == 3
    with pytest.raises(ValueError):
        registry.load(spark, "email")
    with pytest.raises(ValueError):
        registry.load(spark, "email", mbox="x", raw=spark.range(1))
    with pytest.raises(ValueError):
        registry.load(spark, "nope")
    with pytest.raises(ValueError):
        registry.check_documents(spark.range(1))


def test_read_pages_b5(spark):
    rows = [(1, "https://x.org/a/essay.html", "<html><head><title>T &amp X</title></head><body><p>Hi</p></body></html>"),
            (2, "https://x.org/blank/", "<html><head><title>E</title></head><body>  </body></html>")]
    out = read_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.slug, r.title, r.text) == ("essay", "T & X", "Title: T & X\n\nHi")
    assert r.doc_id == hashlib.sha1(b"https://x.org/a/essay.html").hexdigest()


def test_extract_links_first_seen_distinct(spark):
    html = ('<a href="b.html">1</a><a href="a.html">2</a><a href="b.html">3</a>'
            '<a href="https://o.org/x.html">4</a><a href="dir/c.html">5</a><a href="d.htm">6</a>')
    df = spark.createDataFrame([(1, "https://pg.org/articles.html", html)], "page_id long, url string, html string")
    links = [r.link for r in extract_links(df).orderBy("pos").collect()]
    assert links == ["https://pg.org/b.html", "https://pg.org/a.html"]
    first = [r.link for r in extract_links(df, limit=1).collect()]
    assert first == ["https://pg.org/b.html"]
    assert extract_links(df, limit=0).count() == 0
    based = [r.link for r in extract_links(df, base="https://base.com/").orderBy("pos").collect()]
    assert based[0] == "https://base.com/b.html"


def test_schema_checker(spark):
    from corpuskit import schemas
    ok = spark.createDataFrame([("1", "t", "document", {"k": "v"})], schemas.DOCUMENTS)
    assert schemas.check(ok, schemas.DOCUMENTS) is ok
    with pytest.raises(TypeError):
        schemas.check(spark.createDataFrame([(1, "t", "d")], "doc_id long, text string, source_type string"),
                      schemas.DOCUMENTS, ["doc_id", "text"])
    with pytest.raises(ValueError):
        schemas.check(spark.range(1), schemas.MODEL_STATS)
