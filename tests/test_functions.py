import hashlib
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import html as H
from corpuskit.functions import ids as I
from corpuskit.functions import text as X


class _Model(HTMLParser):
    """Reference model of T6: text nodes outside script/style/head joined with newlines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head") and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def model_text(html):
    import re
    p = _Model()
    p.feed(html)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(p.parts)).strip()


B5 = [
    "<html><head><title>T</title></head><body><p>a</p><p>b</p></body></html>",
    "<html><body></body></html>",
    "<div><p>one <b>two</b> three</p></div>",
    "<p>x</p><!-- <p>hidden</p> --><p>y</p>",
    '<script>var t="</p>";</script><p>after</p>',
    "<p>fish &amp chips &quot;x&quot; &lt;tag&gt; &copy; &middot;</p>",
    "<p>a</p>\n\n\n\n<p>b</p>",
    "<style>p{margin:0}</style><header>h</header><p>z</p>",
]


@pytest.mark.parametrize("html", B5)
def test_html_text_matches_parser_model(spark, html):
    got = spark.createDataFrame([(html,)], "h string").select(H.html_text(F.col("h"))).first()[0]
    assert got == model_text(html)


def test_html_title(spark):
    rows = [("<head><title> A &amp; B </title></head>",), ("<p>no title</p>",), ("<TITLE>x</TITLE>",)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").select(H.html_title(F.col("h"))).collect()]
    assert got == ["A & B", "", "x"]


def test_url_slug_and_web_id(spark):
    rows = [("https://x.com/essay.html",), ("https://x.com/dir/",), ("https://x.com/a.html.html",)]
    df = spark.createDataFrame(rows, "u string").select(X.url_slug(F.col("u")), I.web_doc_id(F.col("u")))
    got = df.collect()
    assert [r[0] for r in got] == ["essay", "dir", "a"]
    assert got[0][1] == hashlib.sha1(b"https://x.com/essay.html").hexdigest()


def test_file_and_mail_ids(spark):
    df = spark.createDataFrame([("/a/b.txt", 0, "hello"), ("/a/b.txt", 3, "hello")], "p string, pg long, t string")
    got = df.select(I.page_label(F.col("pg")).alias("l"),
                    I.file_doc_id(F.col("p"), I.page_label(F.col("pg")), F.col("t")).alias("id")).collect()
    inner = hashlib.sha1(b"hello").hexdigest()
    assert got[0]["l"] == "" and got[1]["l"] == "3"
    assert got[0]["id"] == hashlib.sha1(f"/a/b.txt||{inner}".encode()).hexdigest()
    assert got[1]["id"] == hashlib.sha1(f"/a/b.txt|3|{inner}".encode()).hexdigest()
    m = spark.createDataFrame([("", "s", "f", "d"), ("<x@y>", "s", "f", "d")], "m string, s string, f string, d string")
    ids = [r[0] for r in m.select(I.mail_doc_id(*(F.col(c) for c in "msfd"))).collect()]
    assert ids[0] == "fallback-" + hashlib.sha1(b"s|f|d").hexdigest() and ids[1] == "<x@y>"


def test_source_label_and_aliases(spark):
    rows = [({"source_type": "email", "subject": "Hi", "from_addr": "a@b", "date": "D"}, 0.12345),
            ({"source_type": "document", "file_path": "/x.txt"}, None),
            ({"source_type": "paulgraham", "url": "https://u"}, 1.0),
            ({"source_type": "other"}, 0.5)]
    df = spark.createDataFrame(rows, "m map<string,string>, s double")
    got = [r[0] for r in df.select(X.source_label(F.col("m"), F.col("s"))).collect()]
    assert got == ["(score=0.123) Hi — a@b — D", "/x.txt", "(score=1.000) https://u", "(score=0.500) unknown"]
    names = spark.createDataFrame([("PG",), ("Email",), ("notes",)], "n string")
    out = names.select(X.canonical_collection(F.col("n")), X.source_kind(F.col("n"))).collect()
    assert [tuple(r) for r in out] == [("paulgraham", "web"), ("emails", "email"), ("notes", "text")]


def test_size_gb_half_even(spark):
    df = spark.createDataFrame([(1_250_000_000,), (1_350_000_000,), (0,)], "b long")
    assert [r[0] for r in df.select(X.size_gb(F.col("b"))).collect()] == [1.2, 1.4, 0.0]


def test_html_text_mail_variant_keeps_head(spark):
    html = "<html><head><title>T</title><style>x{}</style></head><body><p>b</p></body></html>"
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(H.html_text(F.col("h"), drop_head=False)).first()[0] == "T\nb"
    assert df.select(H.html_text(F.col("h"))).first()[0] == "b"


def test_label_options_snippet_score_and_scalar_metadata(spark):
    df = spark.createDataFrame([({"source_type": "paulgraham", "url": "https://u", "k": None}, None, "x" * 500)],
                               "m map<string,string>, s double, t string")
    r = df.select(X.source_label(F.col("m"), use_url=False).alias("old"), X.source_label(F.col("m")).alias("new"),
                  X.default_score(F.col("s")).alias("score"), X.clip_snippet(F.col("t")).alias("snip"),
                  X.scalar_metadata(F.col("m")).alias("meta")).first()
    assert (r.old, r.new, r.score, len(r.snip)) == ("unknown", "https://u", 0.0, 400)
    assert r.meta == {"source_type": "paulgraham", "url": "https://u"}


def test_character_references(spark):
    from corpuskit.functions.html import decode_entities
    cases = {"&#8217;&mdash;&eacute;": "\u2019\u2014\xe9", "a&nbsp;b": "a\xa0b", "&#x41;&amp;lt;": "A&lt;", "AT&T &copy 1": "AT&T \xa9 1", "plain": "plain"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.d for r in df.select("t", decode_entities("t").alias("d")).collect()}
    assert got == {**cases, None: None}


ODD_HTML = [
    '<a title="x > y" href=q>link</a> tail',
    "<p data-a='<b>' class=\"> \">in</p>",
    "<p>a</p><script>var s = '<p>never closed</p>';",
    "<script>var a = '<!--';</script><p>shown</p><!-- c --><p>end</p>",
    "<style>/* <!-- */</style><p>x</p><script>\"-->\"</script>y",
    "<!-- <script> --><p>kept</p><!-- </script> -->",
    "<SCRIPT type='a>b'>hidden</SCRIPT >after",
]


@pytest.mark.parametrize("html", ODD_HTML)
def test_html_text_of_odd_markup_matches_the_parser(spark, html):
    got = spark.createDataFrame([(html,)], "h string").select(H.html_text(F.col("h"))).first()[0]
    assert got == model_text(html)


def test_comment_that_is_not_closed_hides_the_rest(spark):
    # as browsers read it; the standard library's parser shows such a comment as text in some versions
    got = spark.createDataFrame([("<p>a</p><!-- never closed <p>b</p>",)], "h string").select(H.html_text(F.col("h"))).first()[0]
    assert got == "a"


def test_html_text_of_a_very_long_tag(spark):
    html = "<p " + " ".join(f'a{i}="v > {i}"' for i in range(20_000)) + ">text</p>" + "x" * 100_000
    got = spark.createDataFrame([(html,)], "h string").select(H.html_text(F.col("h"))).first()[0]
    assert got == "text\n" + "x" * 100_000
