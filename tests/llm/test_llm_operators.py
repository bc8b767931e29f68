"""Operators against plain models, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import zlib

import llm_brute as brute
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import (bpe, decontaminate, license_scan, line_dedup, minhash_dedup, quality_rules, secret_scan,
                           substring_dedup, textvec, token_counts, token_output)

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
# names that operators use inside must not clash with columns of the caller
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, hash long, words string, "
          "n_words string, failed string, ids string, label string, `odd name` int, kept string")


def frame(spark, texts, parts=3):
    """Rows of (doc_id, text) with further columns whose names clash, some of them null."""
    rows = [(i, t, None if n % 3 else "en", None if n % 4 else "src/a", None, n, None, "w", None, "f", None, "l", n, None)
            for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def as_dicts(texts):
    return [{"doc_id": i, "text": t} for i, t in texts]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdeéß中") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [say(60) for _ in range(4)]
    lines = [say(14) for _ in range(8)]
    out = []
    for i in range(40):
        kind = rng.random()
        if kind < 0.35:  # near copies
            w = rng.choice(base).split()
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
        elif kind < 0.7:  # lines that many hold, some with an edit
            mine = [rng.choice(lines) for _ in range(rng.randint(1, 5))]
            out.append("\n".join(x if rng.random() < 0.5 else x[:9] + "X" + x[9 + rng.randint(0, 2):] for x in mine))
        else:
            out.append(say(rng.randint(0, 90)) + "\t \r\n\n" + say(3))
    long = say(6000) + " " + base[0]
    out += ["", "  \n\t ", None, "one", "one two", "A b A b", "a B a b", long, long, base[1], base[1], base[1].upper(),
            "don't I'll we've 'tis ''s  x\n\n y   ", "#$% " * 30, "x" * 5000]
    return list(enumerate(out)) + [(None, base[1]), (None, None), (200, base[0] + " " + base[2])]


def test_word_and_line_helpers():
    column = pa.array(["a  bc\n", None, "", " dé\x0bf ", "a  bc\n"])
    (piece,) = textvec.pieces(column)
    words = textvec.Words(piece)
    assert words.counts.tolist() == [2, 0, 0, 2, 2]
    h = words.hashes.tolist()
    assert h[0] == h[4] and h[1] == h[5] and len(set(h)) == 4
    assert [p.n_docs for p in textvec.pieces(column, max_bytes=7)] == [3, 1, 1]
    assert list(textvec.pieces(pa.array([], pa.string()))) == []


def test_quality_rules(spark, texts):
    df = frame(spark, texts)
    ledger = quality_rules.apply_policy(quality_rules.quality_ledger(df, drop_text=False))
    got = sorted((tuple(r) for r in ledger.select(
        "doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept").collect()), key=str)
    want = sorted(((i, t, *brute.quality(t)) for i, t in texts), key=str)
    assert got == want
    kept = quality_rules.quality_filter(df)
    assert kept.columns == df.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted(
        (tuple(r) for r in df.collect() if brute.quality(r["text"])[-1]), key=str)


def test_quality_ablations_are_counts_of_the_ledger(spark, texts):
    ledger = quality_rules.quality_ledger(frame(spark, texts))
    masks = [r["failed"] for r in ledger.select("failed").collect()]
    for r in quality_rules.ablations(ledger).collect():
        bit, policy = quality_rules.BIT[r["rule"]], quality_rules.POLICIES[r["policy"]]
        assert r["n_failed"] == sum(bool(m & bit) for m in masks)
        assert r["n_only"] == sum(m & policy == bit for m in masks)


def test_line_dedup(spark, texts):
    df, rows = frame(spark, texts), as_dicts(texts)
    verdict, links = brute.removed_lines(rows, 2, 20)
    got = {(r["id"], r["line"]): (r["verdict"], r["n_links"])
           for r in line_dedup.line_verdicts(df, 2, 20).collect()}
    lines = {(r["doc_id"], n): x for r in rows if r["text"] is not None for n, x in enumerate(r["text"].split("\n"))}
    assert got == {k: (v, len(links[lines[k]])) for k, v in verdict.items()}
    assert any(v == 2 for v in verdict.values())
    out = line_dedup.drop_lines(df, 2, 20)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(
        ((r["doc_id"], r["text"]) for r in brute.drop_lines(rows, 2, 20)), key=str)


def test_line_groups_of_any_size_give_the_same_links(spark, monkeypatch):
    rng = random.Random(4)
    stem = "".join(rng.choice("abcdef ") for _ in range(60))
    texts = [(i, stem[:40] + "%03d" % rng.randint(0, 999) + stem[40:]) for i in range(150)]
    _, links = brute.removed_lines(as_dicts(texts), 2, 32)
    want = {x: len(y) for x, y in links.items()}
    for block in (1024, 16):
        monkeypatch.setattr(line_dedup, "BLOCK_MEMBERS", block)
        got = {r["id"]: r["n_links"] for r in line_dedup.line_verdicts(frame(spark, texts), 2, 32).collect()}
        assert got == {i: want[t] for i, t in texts}


def test_banded_distance_equals_the_full_table():
    rng = random.Random(3)
    for edits in (1, 2, 3):
        pairs = []
        for _ in range(1500):
            a = [rng.choice(b"abc") for _ in range(rng.randint(0, 14))]
            b = list(a)
            for _ in range(rng.randint(0, 5)):
                i = rng.randint(0, len(b))
                b[i:i + rng.randint(0, 1)] = [rng.choice(b"abc")] * rng.randint(0, 1)
            pairs.append((bytes(a), bytes(b)))
        got = line_dedup.banded_distances([a for a, _ in pairs], [b for _, b in pairs], edits)
        assert [None if g > edits else g for g in got.tolist()] == [brute.within(a, b, edits) for a, b in pairs]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, texts, k):
    df = frame(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(df, k).collect()
           if r["doc_id"] is not None}
    want = brute.groups(as_dicts(texts), k)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 5
    out = minhash_dedup.near_dedup(df, k)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == sorted(
        i for i, (_, c) in want.items() if i == c)
    assert out.where("doc_id is null").count() == 2


def test_near_duplicates_in_blocks_equal_brute_force(spark, monkeypatch):
    """A chain of copies, each near its neighbours only, in buckets that are dealt out in blocks."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_MEMBERS", 4)
    rng = random.Random(8)
    w = ["w%d" % i for i in range(80)]
    texts = []
    for i in range(40):
        texts.append((i * 7 % 41, " ".join(w)))
        at = rng.randrange(70)
        w[at:at + 2] = ["n%d" % i, "m%d" % i]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in minhash_dedup.near_duplicates(frame(spark, texts), 2).collect()}
    assert got == brute.groups(as_dicts(texts), 2)


def test_block_links_reach_a_member_behind_nearer_ones_that_fail(spark):
    """Of one label, two members share more with document 0 in relation but are below the threshold."""
    w = ["w%d" % i for i in range(25)]
    texts = [(0, " ".join(w)), (1, " ".join(w[:20])), (2, " ".join(w[1:21])),
             (3, " ".join([*("x%d" % i for i in range(6)), *w]))]
    sets = [brute.shingle_set(t, 2) for _, t in texts]
    assert [100 * len(sets[0] & s) >= 80 * len(sets[0] | s) for s in sets] == [True, False, False, True]
    df = spark.createDataFrame(texts, "id long, text string")
    members = (minhash_dedup.signatures(df, 2, True, "id").join(minhash_dedup._sorted_sets(df, 2, True), "id")
               .withColumn("bucket", F.explode("bands")).withColumn("n", F.lit(4))
               .withColumn("label", F.when(F.col("id") == 0, 0).otherwise(1).cast("long")))
    got = minhash_dedup._block_links(members, minhash_dedup.sketch_limit(0.8), 80).distinct().collect()
    assert [tuple(r) for r in got] == [(0, 3)]


def test_odd_sketch_limit_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    limit = minhash_dedup.sketch_limit(0.8)
    worst = 0
    for _ in range(150):
        pool = rng.integers(0, 10**9, 1100)
        sides = [pool[:1000], np.concatenate((pool[:int(1000 * 8 / 9)], pool[1000:1000 + 111]))]
        text = pa.array([" ".join("%d" % x for x in s) for s in sides])
        (piece,) = textvec.pieces(text)
        _, _, _, sketch = minhash_dedup._features(piece, 1, False)
        worst = max(worst, int(np.bitwise_count(sketch[0].view(np.uint64) ^ sketch[1].view(np.uint64)).sum()))
    assert worst <= limit < 0.4 * minhash_dedup.SKETCH_BITS


def test_benchmark_leaks(spark, texts):
    rng = random.Random(2)
    vocab = ["t%d" % i for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([5, 6, 8, 9, 13, 14, 20, 24, 37, 59, 90])]
    rows = []
    for i, item in items:
        w = item.split()
        for edit in range(4):
            c = list(w)
            if edit == 1 and len(c) > 20:
                c[len(c) // 2] = "changed"
            if edit == 2 and len(c) > 24:
                c.insert(len(c) // 2, "put in")
            if edit == 3:
                c = c[len(c) // 4:]
            rows.append((len(rows), "pre " * rng.randint(0, 9) + " ".join(c).upper() + " and so on" * rng.randint(0, 5)))
    rows += [(1000 + n, t) for n, (_, t) in enumerate(texts)] + [(None, None), (2000, None), (2001, items[9][1]), (2001, items[9][1])]
    bad_items = items + [(90, None), (91, ""), (92, "one two"), (None, "a b c d e f")]
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in bad_items], "item_id long, text string, words string, doc_id long")
    df = frame(spark, rows)
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["total"]) for r in decontaminate.leaks(df, bench).collect()}
    want = brute.leaks(as_dicts(rows), [{"item_id": i, "text": t} for i, t in items])
    assert got == want and len(want) > 25
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns
    assert sorted((r["doc_id"] or -1 for r in clean.collect())) == sorted(
        (i or -1 for i, _ in rows if i not in {d for d, _ in want}))


def test_a_repeated_benchmark_row_counts_once(spark):
    item = " ".join("i%d" % i for i in range(20))
    rows = [(1, "before it " + item + " behind it"), (2, "nothing of it " * 9)]
    bench = spark.createDataFrame([(7, item), (7, item), (7, item.upper() + " ")], "item_id long, text string")
    df = frame(spark, rows)
    assert [tuple(r) for r in decontaminate.leaks(df, bench).collect()] == [(1, 7, 16, 16)]
    assert [r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()] == [2]


def test_leaks_are_weighed_over_the_whole_document(spark):
    w = ["i%d" % i for i in range(24)]
    far = ["x%d" % i for i in range(100)]
    rows = [(p, " ".join(["pre"] * p + w[:14] + far + w[14:])) for p in range(9)]
    rows += [(20 + p, " ".join(["pre"] * p + w[14:] + far + w[:14])) for p in range(9)]
    rows += [(40, " ".join(w[:13] + far + w[14:]))]  # 15 of 20 shingles
    items = [(1, " ".join(w))]
    df, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["total"]) for r in decontaminate.leaks(df, bench).collect()}
    assert got == brute.leaks(as_dicts(rows), [{"item_id": i, "text": t} for i, t in items])
    assert got == {(r[0], 1): (16, 20) for r in rows[:-1]}


def test_leaks_without_ids_and_rows_of_one_id(spark):
    item, other = " ".join("i%d" % i for i in range(20)), " ".join("k%d" % i for i in range(20))
    rows = [(None, "before " + item), (None, "a clean text without an id"), (5, item), (5, "a clean namesake"),
            (6, other + " behind"), (7, None), (8, "")]
    df = frame(spark, rows)
    bench = spark.createDataFrame([(3, item), (None, other), (None, "no text holds these six words")],
                                  "item_id long, text string")
    got = sorted(map(tuple, decontaminate.leaks(df, bench).collect()), key=str)
    assert got == sorted([(None, 3, 16, 16), (5, 3, 16, 16), (6, None, 16, 16)], key=str)
    kept = {(r["doc_id"], r["text"]) for r in decontaminate.decontaminate(df, bench).collect()}
    assert kept == {rows[i] for i in (1, 3, 5, 6)}


def test_leaks_run_without_python(spark, texts):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o")], "item_id long, text string")
    plan = decontaminate.leaks(frame(spark, texts), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_simhash_is_the_majority_of_each_bit(spark):
    rng = random.Random(6)
    for size in (5, 9):
        rows = [[rng.getrandbits(64) - (1 << 63) for _ in range(size)] for _ in range(50)]
        df = spark.createDataFrame([(r,) for r in rows], "w array<long>")
        got = [r[0] for r in decontaminate.with_simhash(df, "w", size, "p").select("p").collect()]
        want = [sum(1 << b for b in range(64) if sum(x >> b & 1 for x in r) * 2 > size) for r in rows]
        assert [g & (1 << 64) - 1 for g in got] == want


def test_substring_dedup(spark, texts):
    df = frame(spark, texts)
    for hot in (2000, 1):
        spans = substring_dedup.repeated_spans(df, 12, gram=4, hot=hot, shard_words=200)
        got = sorted((tuple(r) for r in substring_dedup.kept_digests(df, spans).collect()), key=str)
        assert got == brute.passages(as_dicts(texts), 12)
    assert sum(r[2] for r in got) > 300
    cut = substring_dedup.cut_spans(df, spans).collect()
    assert sorted(hashlib.sha256(r["kept"].encode()).hexdigest() for r in cut) == sorted(r[3] for r in got)


def test_a_passage_that_many_hold_is_not_gathered_in_a_shard(spark, monkeypatch):
    """Equal windows of a hot anchor are merged before the shards, and every later holder loses them."""
    own = lambda i, n: " ".join("o%d.%d" % (i, j) for j in range(n))
    passage = " ".join("p%d" % j for j in range(30))
    rows = [(i, f"{own(i, 20)} {passage} {own(-1 - i, 15)}") for i in range(60)] + [(90, own(3, 20)), (91, passage)]
    search = substring_dedup._search_shard

    def bounded(table, window):
        assert max(table["anchor"].value_counts().field("counts").to_pylist()) <= 5
        return search(table, window)

    monkeypatch.setattr(substring_dedup, "_search_shard", bounded)
    df = frame(spark, rows)
    spans = substring_dedup.repeated_spans(df, 12, gram=4, hot=5, shard_words=20)
    got = sorted((tuple(r) for r in substring_dedup.kept_digests(df, spans).collect()), key=str)
    assert got == brute.passages(as_dicts(rows), 12) and sum(r[2] for r in got) == 60 * 30 + 20


def test_repeated_ids_do_not_mix_in_substring_dedup(spark):
    rows = [(5, "a b c d e f g h"), (5, "x a b c d e y"), (6, "q a b c d e f"), (4, "x a b c z")]
    got = sorted(tuple(r)[:3] for r in substring_dedup.kept_digests(
        frame(spark, rows), substring_dedup.repeated_spans(frame(spark, rows), 4, gram=2)).collect())
    # 4 holds "x a b c"; both rows of 5 are judged on their own, and 6 loses what either of them holds
    assert got == [(4, 5, 0), (5, 7, 4), (5, 8, 0), (6, 7, 6)]


def test_license_scan(spark, texts):
    names = license_scan.TEMPLATES
    rows = [(n, "foo bar " * (n % 5) + t.upper().replace(",", " ;") + " tail " * (n % 7)) for n, t in enumerate(names.values())]
    rows += [(100 + n, " ".join(t.split()[:-1])) for n, t in enumerate(names.values())] + [(500 + n, t) for n, (_, t) in enumerate(texts)]
    got = {(r["doc_id"], r["template"]): (r["matched"], r["total"]) for r in license_scan.license_matches(frame(spark, rows)).collect()}

    def grams(text):
        w = brute.re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (text or "").translate(brute.LOWER))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    held = [(i, grams(text)) for i, text in rows]
    want = {}
    for name, template in names.items():
        t = grams(template)
        for i, own in held:
            if 100 * len(t & own) >= 80 * len(t):
                want[i, name] = (len(t & own), len(t))
    assert got == want and len(got) >= len(names)
    with pytest.raises(ValueError):
        license_scan.TemplateIndex({"short": "four words are few"})


def test_license_bands_meet_their_bound():
    for group in license_scan.TemplateIndex(license_scan.TEMPLATES).classes:
        least = min(len(license_scan.TemplateIndex(license_scan.TEMPLATES).sets[m]) for m in group.members)
        j = 1.0 if group.span == 1 else 0.8 * least / (2 * group.span + 0.2 * least)
        assert (1 - j) ** group.bands <= license_scan.MISS


@pytest.mark.parametrize("width", [1, 7, 16, 17, 31])
def test_bit_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1000).astype(np.uint32)
    packed = token_output.pack(ids, width)
    assert len(packed) == -(-1000 * width // 8)
    for a, b in ((0, 1000), (77, 501), (63, 65), (9, 9), (999, 1000)):
        assert (token_output.unpack(packed, width, a, b) == ids[a:b]).all()
    assert token_output.pack(ids[:0], width) == b""


def test_token_output(spark, texts, tmp_dir):
    from tokenizers import Tokenizer

    token_output.write_token_blocks(frame(spark, texts), f"{tmp_dir}/t", JSON, 50257, end_id=2, block_ids=100)
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    rows = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted((tuple(r) for r in token_output.read_token_checksums(spark, f"{tmp_dir}/t").collect()), key=key) == [
        w[:4] for w in want]
    assert [r["tokens"] for r in sorted(token_output.read_token_ids(spark, f"{tmp_dir}/t").collect(), key=key)] == [
        w[4] for w in want]
    got = {r["id"]: r["tokens"] for r in token_output.fetch_documents(spark, f"{tmp_dir}/t", [3, 47, 9999]).collect()}
    assert got == {w[0]: w[4] for w in want if w[0] in (3, 47)}


def test_token_output_of_added_tokens_equals_the_untouched_library(spark, tmp_dir):
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    rows = list(enumerate(["a" + end + "b", "plain text, it's", end, f" x {end}{end}  y\n", "é" + end, "", None, "<|endof", "text|>",
                           "中 " + end + " tail", "the last"]))
    tokenizer = Tokenizer.from_file(JSON)
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert want[0] == [64, 50256, 65]
    token_output.write_token_blocks(frame(spark, rows, 1), f"{tmp_dir}/a", JSON, 50257, block_ids=10)
    got = {r["id"]: r["tokens"] for r in token_output.read_token_ids(spark, f"{tmp_dir}/a").collect()}
    assert got == want


def test_byte_bpe_equals_the_library(spark, texts):
    rng = random.Random(1)
    alphabet = list("ab'stmdrevl  \n\t é1２٣!.#'’中𝒳 \r x́\x1c\x85")
    odd = [(1000 + n, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70)))) for n in range(1500)]
    odd += [(5000, "a" * 3000 + "  "), (5001, "ab" * 500), (5002, " " * 300 + "x"), (5003, "<|endoftext|>")]
    rows = texts + odd
    df = frame(spark, rows)
    enc = brute.bpe(MULTI, public_tokenizers.PATTERN)
    want = {(i, t): enc.encode_ordinary(t or "") for i, t in rows}
    encoded = bpe.bpe_encode(df.withColumn("raw", F.col("text")), MULTI)
    for r in encoded.collect():
        ids = want[r["doc_id"], r["raw"]]
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        at = np.cumsum([0, *(len(enc.decode_single_token_bytes(i)) for i in ids)])
        assert r["offsets"] == at[:-1].tolist()
    for r in bpe.bpe_decode(encoded, MULTI).select("raw", "decoded").collect():
        assert bytes(r["decoded"]) == (r["raw"] or "").encode()
    for r in bpe.bpe_round_trip(df.withColumn("raw", F.col("text")), MULTI).collect():
        assert r["ids_sha256"] == hashlib.sha256(np.array(want[r["doc_id"], r["raw"]], "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["raw"] or "").encode()).hexdigest()


def test_slice_cache_may_be_emptied_at_any_time():
    vocab = bpe.Vocabulary(MULTI)
    texts = pa.array(["the cat's  mat", "another mat, the end"] * 5)
    (piece,) = textvec.pieces(texts)
    ids = bpe.encode_piece(piece, vocab.cache)[1].tolist()
    vocab.cache.limit = 0
    assert bpe.encode_piece(piece, vocab.cache)[1].tolist() == ids


def test_token_counts_are_idempotent(spark, tmp_dir):
    schema = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long, seq int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    ledger = token_counts.TokenCounts(spark, f"{tmp_dir}/c")
    totals = lambda: {tuple(r)[:3]: tuple(r)[3:] for r in ledger.totals().collect()}
    assert totals() == {}
    first = rows(("insert", 1, "a", "en", "t1", 10, 0), ("insert", 2, "a", "en", "t1", None, 0), ("insert", 3, None, "fr", "t1", 7, 0),
                 ("insert", None, "a", "en", "t1", 99, 0), ("insert", 1, "a", "en", "t1", 10, 0))
    assert ledger.commit("b1", first) and not ledger.commit("b1", first)
    assert totals() == {("a", "en", "t1"): (2, 10), (None, "fr", "t1"): (1, 7)}
    # a revised count, a moved document, a delete, a delete of nothing, two changes of one key
    assert ledger.commit("b2", rows(("revise", 1, "a", "en", "t1", 4, 0), ("revise", 3, "b", "fr", "t1", 8, 1),
                                    ("delete", 2, "a", "en", "t1", 0, 0), ("delete", 77, "a", "en", "t1", 0, 0),
                                    ("delete", 3, "b", "fr", "t1", 0, 0), ("insert", 1, "a", "en", "t2", 5, 0)))
    want = {("a", "en", "t1"): (1, 4), ("b", "fr", "t1"): (1, 8), ("a", "en", "t2"): (1, 5)}
    assert totals() == want
    # an attempt without a marker is not read
    ledger._write("batch-lost-1", spark.createDataFrame([(9, "a", "en", "t1", 1, 50)], token_counts.LEDGER))
    assert totals() == want
    assert ledger.compact() and totals() == want
    assert not ledger.commit("b1", first) and totals() == want
    assert ledger.commit("b3", first.limit(0)) and totals() == want
    assert ledger.commit("b4", rows(("delete", 1, "x", "y", "t2", 0, 0), ("insert", 4, "a", "en", "t2", 1, 0)))
    assert totals() == {**want, ("a", "en", "t2"): (1, 1)}


def test_secret_scan(spark, texts):
    rng = random.Random(9)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(rng.choice(["ing", "tion", "the", "ver", "lich", "ment"]) for _ in range(9))
    rows, labels = [], []
    for i in range(240):
        kind = i % 4
        secret = [f'token = "{hexa(40)}"', "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNP234567") for _ in range(16))]
        other = [word(), "4%015d" % rng.randrange(10**15)]
        thing = (secret + other)[kind]
        lead = "the thing tion is the " + "ment ver lich " * rng.randint(0, 4)
        rows.append((i, lead + thing + " of the tion"))
        begin = len(lead) + (thing.index('"') + 1 if kind == 0 else 0)
        labels.append((i, begin, int(kind < 2)))
    rows += [(1000 + n, t) for n, (_, t) in enumerate(texts)]
    df = frame(spark, rows)
    train = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, begin long, label int")
    held = {(i, b): y for i, b, y in labels if not i % 3}
    got = {(r["doc_id"], r["begin"]): r for r in secret_scan.scan_secrets(df, train).collect()}
    assert held.keys() <= got.keys()
    right = sum(got[k]["is_secret"] == bool(y) for k, y in held.items())
    assert right / len(held) >= 0.97
    assert all(rows[i][1].encode()[b:b + r["size"]].decode() == r["finding"] for (i, b), r in got.items() if i < 240)


EMPTY = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def test_empty_tables(spark, tmp_dir):
    docs = spark.createDataFrame([], EMPTY)
    items = spark.createDataFrame([], "item_id long, text string")
    assert quality_rules.quality_filter(docs).count() == 0
    assert quality_rules.ablations(quality_rules.quality_ledger(docs)).count() == 0
    assert line_dedup.line_report(docs).count() == 0 and line_dedup.drop_lines(docs).count() == 0
    assert minhash_dedup.near_duplicates(docs).count() == 0
    assert decontaminate.leaks(docs, items).count() == 0
    assert decontaminate.decontaminate(docs, items).columns == docs.columns
    assert substring_dedup.substring_dedup(docs).count() == 0
    assert license_scan.license_matches(docs).count() == 0
    assert bpe.bpe_round_trip(docs, MULTI).count() == 0
    assert secret_scan.scan_secrets(docs).count() == 0
    token_output.write_token_blocks(docs, f"{tmp_dir}/e", JSON, 50257, 2)
    assert token_output.read_token_checksums(spark, f"{tmp_dir}/e").count() == 0


def test_findings_of_one_label_are_scored_by_it(spark):
    rows = [(i, "AKIA" + "%016d" % i) for i in range(5)] + [(9, "x1" * 12)]
    df = frame(spark, rows)
    got = {r["doc_id"]: (r["score"], r["is_secret"]) for r in secret_scan.scan_secrets(df).collect()}
    assert got == {**{i: (1.0, True) for i in range(5)}, 9: (0.5, True)}
    found = secret_scan.candidates(df, secret_scan.lexicon(df))
    with pytest.raises(ValueError):
        secret_scan.train(secret_scan.format_labels(found))
