"""Benchmark decontamination with DataFrame functions only: SimHash windows, Hamming blocks, exact check.

A leak at the threshold holds a run of intact words that the item's length bounds from below
(``intact_run``). Fingerprint windows are sized to the items by that bound: every window of an item
(step 1) is indexed, and the document is read in windows of the same size, at a step that lets one of
them fall inside any intact run. So a leak meets the index at distance 0, and at up to ``RADIUS`` bits
where its words differ a little. The index splits the 64 bits into ``RADIUS + 1`` blocks: two
fingerprints within the radius agree on one block at least, so an equality join by block finds all of
them. For each text and item that meet so, the shingles of the whole text are counted and compared exactly.

Similarity: each distinct five-word shingle of the item weighs as often as it stands in the item; the
weight found in the document, wherever it stands there (each shingle as often as it is held, at most its
weight), is at least 0.8 of the whole. Words are lower-cased runs without white space. A text that holds
the item's shingles only as overlapping scraps, each shorter than the intact run, is not a copy and is not sought.

Defined results: null, empty or blank texts and items match nothing; items of fewer than five words have
no shingle and are too short to prove a leak; item rows that repeat an id are judged as one item, and those
that repeat id and words count once; items without an id are judged each by its words. Documents are judged
by their text: equal texts are decided once, rows that repeat an id with other texts are judged each by itself
(``leaks`` gives their best match), and a document without an id is dropped or stays like any other;
empty tables give an empty result; other columns play no part. The index and the shingles of the items and
the keys of the texts that were hit are broadcast only while each is counted to be below ``BROADCAST_ROWS``;
else those joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.tokens import let
from corpuskit.llm.staging import staged

SHINGLE = 5
PERCENT = 80
RADIUS = 3
WINDOW_SIZES = (9, 5)
BROADCAST_ROWS = 1_000_000
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def intact_run(n_words: Column) -> Column:
    """Fewest words of the longest intact run in a copy at the threshold, for an item of ``n_words``.

    Of n - 4 shingles at most a fifth are lost, and an edit inside the text takes four at least, so the
    others lie in at most lost / 4 + 1 runs.
    """
    total = n_words - (SHINGLE - 1)
    lost = F.floor(total * (100 - PERCENT) / 100)
    return (F.ceil((total - lost) / (F.floor(lost / (SHINGLE - 1)) + 1)) + (SHINGLE - 1)).cast("int")


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text; no text, no words."""
    plain = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    return let(plain, lambda t: F.when(F.length(t) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(t, GAP), lambda w: F.xxhash64(w))))


def windows(hashes: Column, size: int, step: int) -> Column:
    """The windows of ``size`` words, one every ``step`` words."""
    return let(hashes, lambda h: F.when(
        F.size(h) >= size, F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1), F.lit(step)),
                                       lambda i: F.slice(h, i, size))).otherwise(F.array().cast("array<array<bigint>>")))


def with_simhash(rows: DataFrame, window: str, size: int, out: str) -> DataFrame:
    """``rows`` with the 64-bit SimHash ``out`` of ``window``, 5 or 9 word hashes: each bit as in most words.

    Bits are counted for all 64 places at once, by adders of three bits. Each sum and carry is a column
    of its own, because one expression for all would be too large a method for the JVM to compile.
    """
    names = rows.columns
    step = 0

    def add(table, a, b, c):
        nonlocal step
        step += 1
        odd = table.withColumn(f"_o{step}", F.col(a).bitwiseXOR(F.col(b)))
        odd = odd.withColumn(f"_s{step}", F.col(f"_o{step}").bitwiseXOR(F.col(c))).withColumn(
            f"_c{step}", F.col(a).bitwiseAND(F.col(b)).bitwiseOR(F.col(c).bitwiseAND(F.col(f"_o{step}"))))
        return odd.drop(f"_o{step}"), f"_s{step}", f"_c{step}"

    # not null, so that no filter on the result is inferred and pushed below its making
    table = rows.select("*", *[F.coalesce(F.col(window)[i], F.lit(0)).alias(f"_h{i}") for i in range(size)])
    if size == 5:
        table, s, c = add(table, "_h0", "_h1", "_h2")
        table, s, d = add(table, s, "_h3", "_h4")
        c, d, s = F.col(c), F.col(d), F.col(s)
        most = c.bitwiseAND(d).bitwiseOR(s.bitwiseAND(c.bitwiseXOR(d)))  # two carries, or one and the rest
        return table.select(*names, most.alias(out))
    sums, carries = [], []
    for i in (0, 3, 6):
        table, s, c = add(table, f"_h{i}", f"_h{i + 1}", f"_h{i + 2}")
        sums.append(s)
        carries.append(c)
    table, s, c4 = add(table, *sums)
    table, low, high = add(table, *carries)  # the count is s + 2 * (low + 2 * high + c4); most is 5 of 9
    s, c4, low, high = (F.col(x) for x in (s, c4, low, high))
    three = high.bitwiseAND(low.bitwiseOR(c4))
    two = high.bitwiseXOR(low.bitwiseAND(c4))  # two, or three
    return table.select(*names, three.bitwiseOR(s.bitwiseAND(two)).alias(out))


def _blocks(fingerprint: Column, size: int) -> Column:
    """RADIUS + 1 keys, one for each block of the fingerprint."""
    bits = 64 // (RADIUS + 1)
    return F.array(*[F.shiftrightunsigned(fingerprint, i * bits).bitwiseAND(F.lit((1 << bits) - 1))
                     .bitwiseOR(F.lit((i + 16 * size) << 48)) for i in range(RADIUS + 1)])


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text."""
    return [F.xxhash64(text).alias("seq_a"), F.xxhash64(F.lit(1), text).alias("seq_b")]


def leaky_texts(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                item_text: str = "text") -> DataFrame:
    """(seq_a, seq_b, key, item, matched, total): the different texts that hold an item; ``key`` names the item."""
    item = F.col(f"`{item_id}`")
    anonymous = F.sha2(F.array_join(F.transform("words", lambda w: w.cast("string")), " "), 256)
    item_rows = items.select(item.alias("item"), word_hashes(F.col(f"`{item_text}`")).alias("words"))
    # a row that is there twice is one, or the item's weights would double
    item_rows = staged(item_rows.where(F.size("words") >= SHINGLE)
                       .withColumn("key", F.coalesce(F.concat(F.lit("i"), F.col("item").cast("string")),
                                                     F.concat(F.lit("n"), anonymous)))
                       .distinct().withColumn("run", intact_run(F.size("words"))))
    texts = docs.select(*text_key(F.col(f"`{text}`")), F.col(f"`{text}`").alias("text"))
    near = None
    bound = None
    for size in WINDOW_SIZES:
        sized = item_rows.where(F.col("run") >= size)
        sized = sized if bound is None else sized.where(F.col("run") < bound)
        bound = size
        run = sized.agg(F.min("run")).first()[0]
        if run is None:
            continue  # no item of this size
        # one document window in ``step`` falls inside any run of ``run`` words
        hits = _hits(texts, sized, size, step=run - size + 1)
        near = hits if near is None else near.unionByName(hits)
    if near is None:
        near = texts.limit(0).select("seq_a", "seq_b", F.lit("").alias("key"))
    hits = staged(near.distinct())
    weights = staged(item_rows.select("key", "item", F.explode(shingles(F.col("words"))).alias("gram"))
                     .groupBy("key", "gram").agg(F.min("item").alias("item"), F.count(F.lit(1)).alias("weight")))
    totals = weights.groupBy("key").agg(F.min("item").alias("item"), F.sum("weight").alias("total"))
    # each text that was hit is read whole, where it lies; copies of one count alike, so their sum is divided
    hit_texts = _bounded(staged(hits.select("seq_a", "seq_b").distinct()))
    grams = _bounded(staged(weights.select("gram").distinct()))
    held = texts.join(hit_texts, ["seq_a", "seq_b"], "left_semi")
    copies = held.groupBy("seq_a", "seq_b").agg(F.count(F.lit(1)).alias("copies"))
    found = (held.select("seq_a", "seq_b", F.explode(shingles(word_hashes(F.col("text")))).alias("gram"))
             .join(grams, "gram", "left_semi").groupBy("seq_a", "seq_b", "gram").agg(F.count(F.lit(1)).alias("n"))
             .join(copies, ["seq_a", "seq_b"]).select("seq_a", "seq_b", "gram", F.expr("n div copies").alias("found")))
    return (hits.join(weights.drop("item"), "key").join(found, ["seq_a", "seq_b", "gram"])
            .groupBy("seq_a", "seq_b", "key").agg(F.sum(F.least("found", "weight")).alias("matched")).join(totals, "key")
            .where(100 * F.col("matched") >= PERCENT * F.col("total")))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """(id_col, item_id, matched, total): documents that hold an item, with the weights found and in all."""
    bad = staged(leaky_texts(docs, items, text, item_id, item_text))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *text_key(F.col(f"`{text}`")))
    return (rows.join(bad, ["seq_a", "seq_b"]).groupBy("id", "key").agg(
        F.min("item").alias("item"), F.max("matched").alias("matched"), F.min("total").alias("total"))
        .select(F.col("id").alias(id_col), F.col("item").alias(item_id), "matched", "total"))


def shingles(words: Column) -> Column:
    """Hashes of the runs of five words, in order."""
    return let(words, lambda h: F.when(
        F.size(h) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE),
                                          lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))
    ).otherwise(F.array().cast("array<bigint>")))


def _bounded(rows: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is counted to be small; else joins shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _hits(texts: DataFrame, items: DataFrame, size: int, step: int) -> DataFrame:
    """(seq_a, seq_b, key): the texts with a window within the radius of an item's, once for each such window."""
    index = items.select("key", F.explode(windows(F.col("words"), size, 1)).alias("w"))
    index = (with_simhash(index, "w", size, "print_b").select("key", "print_b").distinct()
             .withColumn("block", F.explode(_blocks(F.col("print_b"), size))))
    index = _bounded(staged(index))
    # outer, so that no filter is inferred that would compute the windows twice
    # a column of its own, so that the generator is compiled with what follows and no window copies the words
    read = (texts.select("seq_a", "seq_b", windows(word_hashes(F.col("text")), size, step).alias("ws"))
            .select("seq_a", "seq_b", F.explode_outer("ws").alias("w")).where("w is not null"))
    prints = with_simhash(read, "w", size, "print_a").select(
        "seq_a", "seq_b", "print_a", F.explode(_blocks(F.col("print_a"), size)).alias("block"))
    close = F.bit_count(F.col("print_a").bitwiseXOR(F.col("print_b"))) <= RADIUS
    return prints.join(index, "block").where(close).select("seq_a", "seq_b", "key")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item; ids play no part, so rows without one are judged too."""
    bad = staged(leaky_texts(docs, items, text).select("seq_a", "seq_b").distinct())
    rows = docs.select(F.struct("*").alias("row"), *text_key(F.col(f"`{text}`")))
    return rows.join(bad, ["seq_a", "seq_b"], "left_anti").select("row.*")
