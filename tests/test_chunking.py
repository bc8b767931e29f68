import re

import pytest
from pyspark.sql import functions as F

from corpuskit.functions.tokens import Subwords
from corpuskit.operators.chunking import (budget_chunks, merge_metadata, pack_chunks, sentence_chunks, split_units,
                                          token_breaks, token_chunks, window_chunks)


def brute_windows(text, size, overlap):
    toks = re.findall(r"\S+", text)
    if not toks:
        return []
    step, out, i = size - overlap, [], 0
    while True:
        out.append(" ".join(toks[i:i + size]))
        if i + size >= len(toks):
            return out
        i += step


B4 = ["", "one", " ".join(["w"] * 8), " ".join(["w"] * 9), "a b c. d e f. g h i j k l m n o p.",
      "para one.\n\n\npara two here.\n\n\nthird", "x" * 50, "café 東京。次の文。 último, sí; fin!"]


def test_window_chunks_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(B4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, overlap in [(8, 2), (3, 0), (5, 4)]:
        got = window_chunks(df, size, overlap).select("doc_id", "chunk_index", "text", "n_tokens", "n_chunks",
                                                       "chunk_id", "prev_chunk_id", "next_chunk_id").collect()
        by_doc = {}
        for r in got:
            by_doc.setdefault(r.doc_id, []).append(r)
        for i, t in rows:
            want = brute_windows(t, size, overlap)
            have = sorted(by_doc.get(i, []), key=lambda r: r.chunk_index)
            assert [r.text for r in have] == want
            for r in have:
                assert r.n_chunks == len(want) and r.n_tokens <= size
                assert r.chunk_id == f"{i}#{r.chunk_index}"
                assert r.prev_chunk_id == (None if r.chunk_index == 0 else f"{i}#{r.chunk_index - 1}")
                assert r.next_chunk_id == (None if r.chunk_index == len(want) - 1 else f"{i}#{r.chunk_index + 1}")


@pytest.mark.parametrize("text", B4 + ["word " * 5000, "A long sentence " * 300 + ". Next."])
@pytest.mark.parametrize("size,overlap", [(8, 2), (16, 0), (16, 15), (512, 64)])
def test_sentence_units_lossless_and_bounded(text, size, overlap):
    units = split_units(text, size)
    assert "".join(u for u, _ in units) == text
    assert all(n <= size for _, n in units)
    chunks = pack_chunks(text, size, overlap)
    assert all(len(re.findall(r"\S+", c)) <= size for c in chunks)
    # every token of the text appears in order across chunks (overlaps removed)
    toks = re.findall(r"\S+", text)
    assert (not toks) == (not chunks)
    if chunks:
        joined = " ".join(chunks)
        assert set(re.findall(r"\S+", joined)) == set(toks)


def test_pack_overlap_carries_previous_sentence():
    text = "a b c. d e f. g h i. j k l."
    chunks = pack_chunks(text, 6, 3)
    assert chunks[0] == "a b c. d e f."
    assert chunks[1].startswith("d e f.")  # the last split (3 tokens) fits the overlap


def test_pack_drops_overlap_when_next_does_not_fit():
    text = "a b c d. e f g h i j."
    chunks = pack_chunks(text, 6, 4)
    assert chunks == ["a b c d.", "e f g h i j."]


def test_sentence_chunks_dataframe(spark):
    df = spark.createDataFrame([(1, "One two three. Four five six. Seven eight nine."), (2, "")],
                               "doc_id long, text string")
    out = sentence_chunks(df, 6, 3).orderBy("chunk_index").collect()
    assert [r.doc_id for r in out] == [1, 1]
    assert out[0].text == "One two three. Four five six." and out[0].n_chunks == 2
    assert out[1].prev_chunk_id == "1#0" and out[1].next_chunk_id is None


def test_merge_metadata_overlay(spark):
    df = spark.createDataFrame([({"a": "1", "doc_id": "x", "b": "p"}, {"b": "c", "doc_id": "own"}, "7"),
                                ({"a": "1"}, {"doc_id": "own"}, None),
                                ({}, {}, None)],
                               "p map<string,string>, o map<string,string>, id string")
    got = [r[0] for r in df.select(merge_metadata(F.col("p"), F.col("o"), F.col("id"))).collect()]
    assert got[0] == {"a": "1", "b": "c", "doc_id": "7"}
    assert got[1] == {"a": "1", "doc_id": "own"}
    assert got[2] == {"doc_id": ""}


from hypothesis import given, settings, strategies as st

_WORDS = st.sampled_from(["a", "bb", "ccc", "dé", "東京", "x.", "y,", "z!", "w;", "。", "\n\n\n", "\n", "  "])


@settings(max_examples=150, deadline=None)
@given(parts=st.lists(_WORDS, max_size=120), size=st.integers(1, 20), overlap_frac=st.floats(0, 0.95))
def test_pack_properties(parts, size, overlap_frac):
    text = " ".join(parts)
    overlap = min(size - 1, int(size * overlap_frac))
    units = split_units(text, size)
    assert "".join(u for u, _ in units) == text
    chunks = pack_chunks(text, size, overlap)
    toks = re.findall(r"[^ \t\n\x0b\f\r]+", text)
    assert all(0 < len(re.findall(r"[^ \t\n\x0b\f\r]+", c)) <= size for c in chunks)
    # chunks, each cut to the part not carried over from the previous one, restore the tokens in order
    if not toks:
        assert chunks == []
    else:
        seq = " ".join(chunks).split()
        assert set(seq) <= set(toks) and seq[0] == toks[0] and seq[-1] == toks[-1]


SUBWORD = re.compile(Subwords().pattern)
B4_TOKENS = [*B4, "   \n ", "\u6f22\u5b57" * 700, "x" * 5000, "a1b22c333d4444 " * 90, "emoji \U0001f600\U0001f600, end",
             "One. Two! \"Three?\" four, five; six.\n\nseven\n eight " * 40, "\u6771\u4eac\u3002\u6b21\u306e\u6587\u3002" * 200]


def test_tokens_are_those_of_the_pattern():
    for text in B4_TOKENS:
        starts, ends, level = token_breaks(text)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [m.span() for m in SUBWORD.finditer(text)]
        assert len(level) == len(starts)


@pytest.mark.parametrize("size,overlap", [(1, 0), (2, 1), (8, 2), (16, 15), (512, 64)])
def test_token_chunks_hold_every_token_within_the_budget(size, overlap):
    together = budget_chunks(B4_TOKENS, size, overlap)
    for text, chunks in zip(B4_TOKENS, together, strict=True):
        assert chunks == budget_chunks([text], size, overlap)[0]  # whatever texts share the batch
        toks = SUBWORD.findall(text)
        assert (not toks) == (not chunks)
        behind = 0
        for c in chunks:
            first, n = c["token_start"], c["n_tokens"]
            assert 1 <= n <= size and behind - overlap <= first <= behind < first + n
            assert SUBWORD.findall(c["text"]) == toks[first:first + n] and c["text"] in text
            behind = first + n
        assert behind == len(toks)


def test_token_chunks_end_at_the_strongest_break():
    text = "aa bb cc dd. ee ff, gg hh ii jj\n\nkk ll mm nn oo pp"
    assert [c["text"] for c in budget_chunks([text], 8, 0)[0]] == [
        "aa bb cc dd.", "ee ff, gg hh ii jj", "kk ll mm nn oo pp"]
    # no sentence begins within the last four tokens, then one does
    assert [c["text"] for c in budget_chunks(["a b c d e. f g h i j k"], 9, 4)[0]] == [
        "a b c d e.", "c d e. f g h i j", "g h i j k"]
    assert [c["text"] for c in budget_chunks(["a b c d e. f g. h; i j k l"], 9, 5)[0]] == [
        "a b c d e. f g.", "f g. h; i j k l"]


def test_token_chunks_frame(spark):
    df = spark.createDataFrame([(1, "\u6f22" * 1200, "zh"), (2, None, "x"), (3, "", "x"), (4, "few words", "en")],
                               "doc_id long, text string, lang string")
    rows = token_chunks(df, places=True, keep_empty=True).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_id, r.n_chunks, r.token_start, r.n_tokens) for r in rows] == [
        (1, "1#0", 3, 0, 512), (1, "1#1", 3, 448, 512), (1, "1#2", 3, 896, 304), (2, None, 0, None, 0), (3, None, 0, None, 0),
        (4, "4#0", 1, 0, 2)]
    assert token_chunks(df.limit(0)).count() == 0
    native = token_chunks(df).select(Subwords().count("text").alias("n"), "n_tokens").collect()
    assert all(r.n == r.n_tokens for r in native)


def test_prompts_keep_to_the_whole_budget(spark):
    from corpuskit.operators.prompts import build_prompts
    rule = Subwords()
    hits = spark.createDataFrame(
        [(q, r, f"passage {r} of {q} " + "word, " * (9 * r), {"title": f"t{r}", "page": None, "source_type": "web"})
         for q in (1, 2, 3) for r in (1, 2, 3)] + [(4, 1, "\u6f22" * 900, {"title": "long"}), (5, 1, None, None)],
        "question_id long, rank int, text string, metadata map<string,string>").withColumn("n_tokens", F.lit(1))
    qs = spark.createDataFrame([(1, "short", 1000), (2, "why is " * 9, 120), (3, "q" * 2000, 100), (4, "?", 300), (5, None, 90)],
                               "question_id long, question string, b int")
    out = {r.question_id: r for r in build_prompts(hits, qs.fillna("", ["question"]), F.col("b"), meta_col="metadata", counter=rule).collect()}
    assert (out[1].n_chunks, out[1].n_dropped) == (3, 0) and "title: t3" in out[1].prompt and "page" not in out[1].prompt
    assert out[2].n_dropped > 0
    assert out[4].prompt_tokens == 300 and "title: long" in out[4].prompt
    assert out[3].context_tokens == 0 and out[3].n_dropped == 2  # the question alone is over the budget
    assert out[5].n_chunks == 1 and out[5].context_tokens == 0
    for r in out.values():
        assert r.prompt_tokens == len(SUBWORD.findall(r.prompt))
    assert all(out[q].prompt_tokens <= b for q, b in ((1, 1000), (2, 120), (4, 300), (5, 90)))
