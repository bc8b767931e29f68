"""Whitening, tokenizer alignment and language identification against plain models."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuskit.llm import bpe, cross_tokenizer, language_id, queries, textvec, whitening

JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ slice cache

def test_slices_of_one_hash_keep_their_own_ids(monkeypatch):
    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    vocab = bpe.Vocabulary(MULTI)
    (piece,) = textvec.pieces(pa.array(["the cat sat on a remarkably comfortable mat", "remarkably uncomfortable cats"]))
    got = bpe.encode_piece(piece, vocab.cache)[1].tolist()
    monkeypatch.undo()
    assert got == bpe.encode_piece(piece, bpe.Vocabulary(MULTI).cache)[1].tolist()


def test_long_slices_without_blanks():
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    rng = random.Random(3)
    texts = ["".join(chr(rng.randint(0x4E00, 0x4FFF)) for _ in range(n)) for n in (5, 22, 90, 170, 171, 2000)]
    texts += ["".join(rng.choice("あいうえお漢字語") for _ in range(400)), "ab" * 700]
    vocab = bpe.Vocabulary(MULTI)
    for piece in textvec.pieces(pa.array(texts)):
        _, ids, bounds, *_ = bpe.encode_piece(piece, vocab.cache)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [enc.encode_ordinary(t) for t in texts]


# ------------------------------------------------------------------ whitening

VECTORS = "vec_id long, embedding array<float>, x string, count int, id string, deviation string"


def brute_whitening(rows, k=8, weights="count"):
    kept = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = [x for _, x in kept] if weights == "count" else [list(x) for x in {tuple(x) for _, x in kept}]
    n, sums = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    z = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in kept:
        d = [n * a - s for a, s in zip(x, sums, strict=True)]
        for c in range(min(k, len(values))):
            if values[c] > 1e-12 * values[0]:
                out.append((i, c + 1, n, sum(v * v for v in d), abs(np.array(d) / n @ vectors[:, c]) / math.sqrt(values[c]),
                            values[c] / values.sum()))
    return out


def vector_rows(seed=5, n=300, size=10):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, size)) * np.linspace(3, 0.2, size)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a third of all rows share one vector
    rows += [(7, rows[8][1]), (None, rows[9][1]), (2000, None), (2001, []), (2002, [None] * size),
             (2003, [float("nan")] * size), (2004, [float("inf")] + [0.0] * (size - 1)), (2005, [0.25] * (size - 1) + [None])]
    return rows


@pytest.mark.parametrize("weights", ["count", "one"])
def test_whitening_equals_brute_force(spark, weights):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, "x", 1, None, "d") for i, v in rows], VECTORS).repartition(5)
    out = whitening.whiten(df, weights=weights).collect()
    got = sorted((r["vec_id"] is None, r["vec_id"], r["component"], r["n"], int(r["deviation"]), abs(r["whitened"]), r["explained"])
                 for r in out)
    want = sorted((i is None, i, *rest) for i, *rest in brute_whitening(rows, weights=weights))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)
    (error,) = {r["identity_error"] for r in out}
    assert 0 <= error < 1e-9


def test_whitening_of_little_and_of_large_entries(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, "x", 1, None, "d") for i, v in rows], VECTORS)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 4):
        assert whitening.whiten(frame(rows)).count() == 0
    flat = [(i, [float(i), 2.0 * i, 1.0]) for i in range(6)]  # one component has variance
    assert {r["component"] for r in whitening.whiten(frame(flat)).collect()} == {1}
    wide = [(i, [1e12 * math.sin(i), 1e9 * i]) for i in range(20)]  # beyond 64-bit squares: exact, or null beyond 38 digits
    want = {(i, c): (n, d) for i, c, n, d, *_ in brute_whitening([(i, np.float32(v).tolist()) for i, v in wide])}
    got = {(r["vec_id"], r["component"]): (r["n"], int(r["deviation"])) for r in whitening.whiten(frame(wide)).collect()}
    assert got == want
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(frame([(1, [1.0]), (2, [1.0, 2.0])])).collect()


def test_whitening_query_on_its_table(spark):
    out = queries.op11_embedding_whitening(spark, SF).toPandas()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = {(i, c): rest for i, c, *rest in brute_whitening(rows)}
    assert len(out) == len(want) == 8 * len(rows)
    for r in out.itertuples():
        n, deviation, whitened, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - whitened) < 1e-6 and abs(r.explained - explained) < 1e-9
    assert out["identity_error"].max() < 1e-9


# ------------------------------------------------------------------ alignment

@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    letters = {v: k for k, v in {b: chr(c) for b, c in cross_tokenizer.BYTE_LETTERS.items()}.items()}
    return a, letters, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def plain_tokens(sides, text):
    """[(id, bytes)] of both sides; empty lists where a text does not come back."""
    a, letters, b = sides
    if not text:
        return [], []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    ta = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids]
    tb = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        tb.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(t for _, t in ta) != whole or b"".join(t for _, t in tb) != whole:
        return [], []
    return ta, tb


def plain_alignment(sides, text):
    ta, tb = plain_tokens(sides, text)
    ends = lambda ts: np.cumsum([len(t) for _, t in ts]).tolist()
    ea, eb = ends(ta), ends(tb)
    links = [(i, j) for i in range(len(ta)) for j in range(len(tb))
             if max(ea[i] - len(ta[i][1]), eb[j] - len(tb[j][1])) < min(ea[i], eb[j])] if len(ta) < 400 else None
    if links is None:  # a sweep, for long texts
        links, j = [], 0
        for i in range(len(ta)):
            begin = ea[i] - len(ta[i][1])
            while eb[j] <= begin:
                j += 1
            k = j
            while k < len(tb) and eb[k] - len(tb[k][1]) < ea[i]:
                links.append((i, k))
                k += 1
    cuts = sorted(set(ea) & set(eb))
    groups = []
    for lo, hi in zip([0, *cuts], cuts, strict=False):
        groups.append(",".join(str(i) for (i, _), e in zip(ta, ea, strict=True) if lo < e <= hi) + "|"
                      + ",".join(str(i) for (i, _), e in zip(tb, eb, strict=True) if lo < e <= hi))
    return ta, tb, links, cuts, ";".join(groups)


def alignment_texts():
    rng = random.Random(8)
    alphabet = list("abcdeth  in'sé中𝒳\t\n.1<s>▁￭x́\x00\x85")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += ["", None, " ", "   ", "a ", "  a", "a  b", "<|endoftext|> and <s></s><unk><0x41>", "▁", "x▁y", "the the the",
              "ﬁne ①", "a" * 700, "don't  stop\n\n\tnow ", "中文字符没有空格" * 30, "the quick brown fox"]
    texts += [" ".join(rng.choice(["tion", "Straße", "ingly", "the", "qué", "x1"]) * rng.randint(1, 3) for _ in range(900))]
    return texts + ["the quick brown fox"] * 5


def expected_report(sides, rows):
    aligned = [(i, plain_alignment(sides, t)) for i, t in rows]
    held = Counter()
    for _, (ta, tb, links, _, _) in aligned:
        held.update({(ta[i][0], tb[j][0]) for i, j in links})
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for key, (ta, tb, links, cuts, groups) in aligned:
        counts = [held[ta[i][0], tb[j][0]] for i, j in links]
        out.append((key, len(ta), len(tb), len(cuts), len(links), sum(most[ta[i][0]] == n for (i, _), n in zip(links, counts, strict=True)),
                    sum(counts), hashlib.sha256(groups.encode()).hexdigest() if ta else ""))
    return out


@pytest.mark.parametrize("lane,chunk", [(512, 2 << 20), (16, 300)])
def test_alignment_equals_brute_force(spark, sides, monkeypatch, lane, chunk):
    rows = list(enumerate(alignment_texts())) + [(3, "other text of id 3"), (None, "the fox")]
    df = spark.createDataFrame([(i, t, "c", 1, "p") for i, t in rows], "doc_id long, text string, id string, chunk int, pairs string")
    monkeypatch.setattr(cross_tokenizer, "LANE", lane)
    monkeypatch.setattr(cross_tokenizer, "CHUNK_BYTES", chunk)
    got = cross_tokenizer.alignment_report(df.repartition(4), JSON, PIECE).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(expected_report(sides, rows), key=key)


def test_lanes_in_one_process(sides, monkeypatch):
    monkeypatch.setattr(cross_tokenizer, "LANE", 7)
    texts = alignment_texts()
    for piece in textvec.pieces(pa.array(texts), 500):
        x = cross_tokenizer.Aligned(piece, cross_tokenizer.byte_level_side(JSON), cross_tokenizer.piece_side(PIECE))
        for d in range(piece.n_docs):
            _, _, links, cuts, groups = plain_alignment(sides, texts[piece.first + d])
            mine = x.link_doc == d
            assert sorted(zip((x.link_a[mine] - x.a_bounds[d]).tolist(), (x.link_b[mine] - x.b_bounds[d]).tolist(), strict=True)) == links
            assert x.group_texts()[d].decode() == groups
            assert np.diff(x.cut_bounds)[d] == len(cuts)


def test_alignment_lists(spark, sides):
    texts = alignment_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in cross_tokenizer.align(df, JSON, PIECE).collect():
        ta, tb, links, cuts, _ = plain_alignment(sides, texts[r["id"]])
        assert r["a_ids"] == [i for i, _ in ta] and r["b_ids"] == [i for i, _ in tb]
        assert r["a_ends"] == np.cumsum([len(t) for _, t in ta]).tolist()
        assert r["b_ends"] == np.cumsum([len(t) for _, t in tb]).tolist()
        assert [tuple(x) for x in r["links"]] == links and r["cuts"] == cuts


def test_alignment_counts_and_an_empty_table(spark, sides):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert cross_tokenizer.alignment_report(empty, JSON, PIECE).count() == 0
    rows = list(enumerate(alignment_texts()))
    held = Counter()
    for _, t in rows:
        ta, tb, links, *_ = plain_alignment(sides, t)
        held.update({(ta[i][0], tb[j][0]) for i, j in links})
    chunks = cross_tokenizer.chunk_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), JSON, PIECE)
    assert {(r["a_id"], r["b_id"]): r["count"] for r in cross_tokenizer.pair_counts(chunks).collect()} == dict(held)


def test_alignment_query_on_its_table(spark, sides):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op12_cross_tokenizer(spark, SF).collect()))
    assert got == sorted(expected_report(sides, rows))


# ------------------------------------------------------------------ languages

WORDS = {"en": "the and ing tion of to is was with that her".split(), "de": "der die und ung schen ein zu ich nicht keit".split(),
         "fr": "le la et que les des eau tion ment é ce".split()}


def language_rows(n=240, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 80)))
        rows.append((i, text if rng.random() < 0.8 else text.upper(), lang))
    return rows


def plain_vector(text, dimensions):
    """Letter by letter, without batches."""
    import regex

    out = np.zeros(dimensions)
    runs = ["".join(c.lower() if len(c.lower()) == 1 else c for c in r) for r in regex.findall(r"\p{L}+", text or "")]
    line = [0, *[x for r in runs for x in (*map(ord, r), 0)]] if runs else []
    for i in range(len(line) - 2):
        bits = np.zeros(dimensions // 64, np.uint64)
        for j in range(3):
            bits ^= language_id.letter_bits(np.array([line[i + j]]), 24 + j, dimensions)[0]
        out += 1 - 2.0 * np.unpackbits(bits.view(np.uint8))
    return out


def test_language_id_equals_brute_force(spark):
    rows = language_rows() + [(500, None, "en"), (501, "", "de"), (502, "12 34 !?", "fr"), (503, "Der ich", None),
                              (None, "the and", "en"), (7, "other the and of", None), (504, "the " * 4_000, "en"), (505, "中文 é", None),
                              (506, "İSTANBUL ǅ x", None), (507, "e\x00t", None)]
    df = spark.createDataFrame([(i, t, g, "s", "k", 9) for i, t, g in rows],
                               "doc_id long, text string, lang string, lang_pred string, score string, key int").repartition(4)
    d = language_id.DIMENSIONS
    vectors = [plain_vector(t, d) for _, t, _ in rows]
    sums = {}
    for (_, _, lang), v in zip(rows, vectors, strict=True):
        if lang and v.any():
            sums[lang] = sums.get(lang, 0) + np.rint(v / np.linalg.norm(v) * language_id.UNIT).astype(np.int64)
    prototypes = language_id.language_prototypes(df)
    assert sorted(prototypes) == sorted(sums) and all((prototypes[k] == sums[k]).all() for k in sums)
    names, units, mean = language_id._centred(sums)
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["text"] or "", r["lang_pred"], r["score"], r["key"])
                  for r in language_id.identify(df, prototypes).collect()), key=str)
    want = []
    for (i, t, _), v in zip(rows, vectors, strict=True):
        if not v.any():
            want.append((i is None, i, t or "", "und", 0.0, 9))
            continue
        u = v / np.linalg.norm(v) - mean
        cosine = units @ u / np.linalg.norm(u)
        want.append((i is None, i, t or "", names[int(cosine.argmax())], max(0.0, cosine.max()), 9))
    want.sort(key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], atol=1e-9)


def test_language_id_blocks_and_nothing_learned(spark, monkeypatch):
    rows = language_rows(40)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    prototypes = language_id.language_prototypes(df)
    want = sorted(map(tuple, language_id.identify(df, prototypes).collect()))
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 1)
    assert sorted(map(tuple, language_id.identify(df, prototypes).collect())) == want
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(df, {}).collect()} == {("und", 0.0)}
    empty = df.where("doc_id < 0")
    assert language_id.language_prototypes(empty) == {} and language_id.identify(empty, prototypes).count() == 0


def test_held_out_accuracy_of_the_query(spark):
    import zlib

    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = queries.op13_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(docs) and set(out[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
    tested = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in out if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert len(tested) > 200 and sum(tested) / len(tested) > 0.97


# ------------------------------------------------------------------ token counts: one batch after the other

CHANGES = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long, seq int"


def test_token_counts_of_a_driver_that_dies_at_its_commit(spark, tmp_dir, monkeypatch):
    from corpuskit.llm.token_counts import TokenCounts

    batch = spark.createDataFrame([("insert", 1, "a", "en", "t", 10, 0)], CHANGES)
    ledger = TokenCounts(spark, f"{tmp_dir}/c")
    with monkeypatch.context() as m:
        m.setattr(ledger.log.files, "put_if_absent", lambda *a: (_ for _ in ()).throw(RuntimeError("dead")))
        with pytest.raises(RuntimeError):
            ledger.commit("b1", batch)
    assert ledger.totals().count() == 0
    assert ledger.commit("b1", batch) and not ledger.commit("b1", batch)
    assert [tuple(r) for r in ledger.totals().collect()] == [("a", "en", "t", 1, 10)]


def test_token_counts_of_two_batches_at_once(spark, tmp_dir, monkeypatch):
    from corpuskit.llm.token_counts import TokenCounts

    one, other = (TokenCounts(spark, f"{tmp_dir}/c") for _ in range(2))
    count = lambda n: spark.createDataFrame([("revise", 1, "a", "en", "t", n, 0)], CHANGES)
    assert one.commit("b0", count(1))
    publish, done = one._publish, []

    def late(*args):  # the other batch commits after this one has reckoned its rows
        if not done:
            done.append(other.commit("b2", count(100)))
        return publish(*args)

    monkeypatch.setattr(one, "_publish", late)
    assert one.commit("b1", count(10)) and done == [True]
    assert [tuple(r) for r in one.totals().collect()] == [("a", "en", "t", 1, 10)]  # b1 is the later of the two
    assert one.compact() and [tuple(r) for r in other.totals().collect()] == [("a", "en", "t", 1, 10)]
    assert not other.commit("b2", count(7))


# ------------------------------------------------------------------ one id, different texts

def test_lines_and_rows_of_a_repeated_id_are_not_lost(spark):
    from corpuskit.llm.line_dedup import drop_lines
    from corpuskit.llm.minhash_dedup import near_dedup

    say = lambda seed, n=30: " ".join(random.Random(seed).choice(["tion", "ver", "lich", "ment", "ing"]) + str(seed * k % 97) for k in range(n))
    rows = [(1, f"{say(1)}\n{say(2)}"), (2, f"{say(3)}\n{say(4)}"), (2, f"{say(5)}\n{say(2)}"), (None, say(1))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in drop_lines(df).collect())
    assert got == sorted([(0, say(1)), (1, rows[0][1]), (2, rows[1][1]), (2, say(5))])
    near = [(1, say(1, 200)), (2, say(1, 200)), (2, say(7, 200)), (3, say(1, 200) + " more"), (4, say(9, 200)), (None, say(1, 200))]
    df = spark.createDataFrame(near, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in near_dedup(df).collect())
    assert got == sorted((i or 0, t) for i, t in near if i != 3)


def test_cross_tokenizer_worker_memory_is_bounded(monkeypatch):
    # the groups of a whole piece were written out at once, and each side kept a million slices
    import random
    import tracemalloc

    import pyarrow as pa

    from corpuskit.llm import cross_tokenizer as X
    from corpuskit.llm.textvec import pieces

    a, b = (queries.vocabulary_file(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    side_a, side_b = X.ByteLevelSide(a), X.PieceSide(b)
    assert max(side_a.cache.limit, side_b.cache.limit) <= 1 << 18
    r = random.Random(5)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(1, 9))) for _ in range(3000)]
    texts = ["" if i % 9 == 0 else " ".join(r.choices(words, k=r.choice([1, 40, 900]))) for i in range(900)]
    x = X.Aligned(next(pieces(pa.array(texts), 8 << 20)), side_a, side_b)
    assert x.n_docs == 900 and len(x.a) > 3 * X.SHOWN_TOKENS
    tracemalloc.start()
    got = x.group_texts()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 * X.SHOWN_TOKENS * 2 + 20 * len(x.a)
    assert len(got) == 900 and got == x._group_texts(0, 900)
    monkeypatch.setattr(X, "SHOWN_TOKENS", 50)
    assert x.group_texts() == got
