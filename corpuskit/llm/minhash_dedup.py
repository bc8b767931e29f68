"""Near-duplicate groups by MinHash bands and odd sketches, confirmed on whole shingle sets.

1. Each text becomes its set of word shingles. Texts with equal sets are one class (hot groups of
   copies are one row from here on), represented by their smallest id.
2. ``BANDS`` bands of ``ROWS`` MinHash samples give candidate buckets. Two sets at the threshold of 0.8
   miss each other with probability (1 - 0.8**6)**40 = 5e-6, and less above it.
3. The samples are folded into an odd sketch: a bitmap of parities. The population count of the XOR of
   two sketches estimates their similarity; a pair is dropped only when it is far (4.5 deviations)
   beyond the threshold.
4. What is left is decided on the whole sets of 64-bit shingle hashes.
5. Each member is first compared with one other only: the member of its buckets that shares most
   buckets with others, which is the likeliest centre of the group. Members of a bucket that are then
   still in different components are compared with each other, in blocks that write only links, the first
   between two components. So every candidate pair is either decided or already in one component: groups
   are whole, without a row for each pair of a group.

Defined results: a text without words (null, empty or blank) has an empty set and is alone; rows with
a null id are alone, with a null component; repeated rows are one class; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from corpuskit.llm.components import components
from corpuskit.llm.textvec import U64, Words, mix, pieces, seeds, shingle_places, shingles, with_doc
from corpuskit.llm.staging import staged
from corpuskit.session import ship_package

BANDS, ROWS = 40, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
SKETCH_LONGS = SKETCH_BITS // 64
BLOCK_MEMBERS = 2048


def sketch_limit(similarity: float, deviations: float = 4.5) -> int:
    """Largest XOR population count that a pair of this similarity may show: the mean, and so many
    standard deviations of the MinHash samples and of the parities together."""
    differ = SAMPLES * (1 - similarity)
    slope = (1 - 2 / SKETCH_BITS) ** (2 * differ)
    odd = (1 - slope) / 2
    spread = 2 * slope * math.sqrt(differ * similarity), math.sqrt(SKETCH_BITS * odd * (1 - odd))
    return math.ceil(SKETCH_BITS * odd + deviations * math.hypot(*spread))


def shingle_sets(piece, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, document of each): the distinct k-word shingles of each document; a document
    with fewer words has one, its whole sequence."""
    words = Words(piece, lower=lower)
    hashes = words.hashes
    places, docs = shingle_places(words.of, k)
    grams = shingles(hashes, k)[places] if len(places) else np.zeros(0, U64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    whole = np.zeros(len(short), U64)
    for j in range(k - 1):
        has = words.counts[short] > j
        at = words.of[short[has]] + j
        whole[has] = mix(whole[has] * U64(31) + hashes[at] + U64(7 + j))
    grams, docs = np.concatenate((grams, whole)), np.concatenate((docs, short))
    _, once = np.unique(with_doc(grams, docs), return_index=True)
    once = once[np.argsort(docs[once], kind="stable")]
    return grams[once], docs[once]


def _features(piece, k: int, lower: bool):
    grams, docs = shingle_sets(piece, k, lower)
    n = np.bincount(docs, minlength=piece.n_docs)
    filled = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[filled]
    out_bands = np.zeros((piece.n_docs, BANDS), np.int64)
    out_sketch = np.zeros((piece.n_docs, SKETCH_LONGS), np.int64)
    key = np.zeros((2, piece.n_docs), np.int64)
    if len(filled):
        key[0, filled] = np.add.reduceat(mix(grams + U64(1)), first).view(np.int64)
        key[1, filled] = np.add.reduceat(mix(grams + U64(2)), first).view(np.int64)
        x = (grams >> U64(32)).astype(np.uint32)
        times, plus = seeds(SAMPLES, 7)
        samples = np.empty((SAMPLES, len(filled)), np.uint32)
        for i in range(SAMPLES):
            samples[i] = np.minimum.reduceat(x * times[i] + plus[i], first)
        samples = samples.T.astype(U64)
        band = np.zeros((len(filled), BANDS), U64)
        for j in range(ROWS):
            band = mix(band + samples[:, j::ROWS])
        out_bands[filled] = mix(band + np.arange(BANDS, dtype=U64)).view(np.int64)
        bit = (mix(samples + (np.arange(SAMPLES, dtype=U64) << U64(32))) % U64(SKETCH_BITS)).astype(np.int64)
        tally = np.bincount((bit + np.arange(len(filled))[:, None] * SKETCH_BITS).ravel(),
                            minlength=len(filled) * SKETCH_BITS)
        out_sketch[filled] = np.packbits((tally & 1).astype(np.uint8).reshape(-1, SKETCH_BITS), axis=1).view(np.int64)
    return n, key, out_bands, out_sketch


def signatures(docs: DataFrame, k: int, lower: bool, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, set_a, set_b, bands, sketch) of each row; equal sets have equal (set_a, set_b)."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    longs = ArrayType(LongType(), False)
    schema = StructType([source.schema["id"], StructField("n_shingles", LongType()), StructField("set_a", LongType()),
                         StructField("set_b", LongType()), StructField("bands", longs), StructField("sketch", longs)])

    def run(batches):
        for batch in batches:
            for p in pieces(batch.column(1)):
                n, key, bands, sketch = _features(p, k, lower)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(p.n_docs + 1, dtype=np.int32) * m.shape[1]),
                                                  pa.array(m.ravel())) for m in (bands, sketch)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(p.first, p.n_docs), pa.array(n.astype(np.int64)), pa.array(key[0]),
                     pa.array(key[1]), *lists], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def similar_pairs(pairs: DataFrame, texts: DataFrame, k: int, lower: bool, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` whose whole sets have 100 * intersection >= percent * union.
    ``texts(id, text)`` has one row for each id in the pairs."""
    both = (pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b"))

    def run(batches):
        for batch in batches:
            keep = []
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = part.num_rows
                sides = []
                for column in (2, 3):
                    keys = []
                    for p in pieces(part.column(column)):
                        grams, docs = shingle_sets(p, k, lower)
                        keys.append((with_doc(grams, docs + p.first), docs + p.first))
                    sides.append([np.concatenate(x) for x in zip(*keys, strict=True)])
                (ka, da), (kb, db) = sides
                common = np.bincount(da[np.isin(ka, kb)], minlength=rows)
                union = np.bincount(da, minlength=rows) + np.bincount(db, minlength=rows) - common
                keep.append((100 * common >= percent * union) & (common > 0))
            yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return both.mapInArrow(run, StructType([both.schema["a"], both.schema["b"]]))


def _near_sketches(pairs: DataFrame, sketches: DataFrame, limit: int) -> DataFrame:
    side = lambda x: sketches.select(F.col("id").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    bits = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH_LONGS)),
               F.lit(0))
    return pairs.join(side("b"), "b").join(side("a"), "a").where(bits <= limit).select("a", "b")


def _sorted_sets(texts: DataFrame, k: int, lower: bool) -> DataFrame:
    """(id, grams): the sorted shingle hashes of each text, for deciding pairs in blocks."""
    schema = StructType([texts.schema["id"], StructField("grams", BinaryType())])

    def run(batches):
        for batch in batches:
            for p in pieces(batch.column(1)):
                grams, docs = shingle_sets(p, k, lower)
                grams = grams[np.lexsort((grams, docs))]
                at = np.searchsorted(docs, np.arange(p.n_docs + 1)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(p.first, p.n_docs),
                     pa.array([grams[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)], pa.binary())],
                    names=schema.fieldNames())

    return texts.select("id", "text").mapInArrow(run, schema)


def _block_links(members: DataFrame, limit: int, percent: int) -> DataFrame:
    """``members(bucket, n, id, label, bands, sketch, grams)`` -> links (a, b) between members of a bucket that
    have other labels, each decided on the whole sets.

    A bucket of n members is dealt out as pairs of blocks of about BLOCK_MEMBERS. A pair is looked at in
    the first bucket that both have in common only, so the work is once a pair; pairs that fail are not
    written. The members of a label are in one component already, and two labels of a block are after their
    first link: that one is written, and members that it joins are not compared any more.
    """
    blocks = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    dealt = (members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("bucket", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
                     "mine", "id", "label", "bands", "sketch", "grams"))
    id_type = members.schema["id"].dataType
    schema = StructType([StructField("a", id_type), StructField("b", id_type)])

    def run(key, table):
        bucket, lo, hi = (x.as_py() for x in key)
        ids, labels, mine = (table[c].to_numpy() for c in ("id", "label", "mine"))
        labels = labels.copy()  # links join them as they are found
        sketch = np.stack(table["sketch"].to_numpy(zero_copy_only=False)).view(U64)
        bands = np.stack(table["bands"].to_numpy(zero_copy_only=False))
        band = int(np.argmax(bands[0] == bucket))
        sets = [np.frombuffer(x, U64) for x in table["grams"].to_pylist()]
        size = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        out_a, out_b = [ids[:0]], [ids[:0]]
        for i in left:
            other = right[(labels[right] != labels[i]) & ((ids[right] > ids[i]) if lo == hi else True)]
            other = other[np.bitwise_count(sketch[other] ^ sketch[i]).sum(1) <= limit]
            other = other[~(bands[other, :band] == bands[i, :band]).any(1)]
            while len(other):
                part, other = other[:512], other[512:]
                values = np.concatenate([sets[j] for j in part])
                at = np.minimum(np.searchsorted(sets[i], values), size[i] - 1)
                owner = np.repeat(np.arange(len(part)), size[part])
                common = np.bincount(owner[sets[i][at] == values], minlength=len(part))
                union = size[i] + size[part] - common
                linked = part[(100 * common >= percent * union) & (common > 0)]
                linked = linked[np.unique(labels[linked], return_index=True)[1]]
                out_a.append(np.minimum(ids[linked], ids[i]))
                out_b.append(np.maximum(ids[linked], ids[i]))
                labels[np.isin(labels, labels[linked])] = labels[i]
                other = other[labels[other] != labels[i]]
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return dealt.groupBy("bucket", "lo", "hi").applyInArrow(run, schema)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, lower: bool = True, id_col: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of each row of ``docs``: the component of documents linked
    by a Jaccard similarity of at least ``percent`` of their k-word shingle sets, named by its
    smallest id, which is the one that is kept. Ids are integers."""
    limit = sketch_limit(percent / 100)
    marked = staged(signatures(docs, k, lower, id_col, text))
    filled = marked.where("n_shingles > 0 and id is not null")
    # rows of a class have the same bands and sketch, so any of them will do
    classes = staged(filled.groupBy("set_a", "set_b").agg(
        F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    sketches = classes.select("id", "sketch")
    slots = classes.select(F.explode("bands").alias("bucket"), "id")
    buckets = staged(slots.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).where("n > 1"))
    # a text that shares most buckets is the likeliest centre of its group: each member meets one first
    degree = buckets.groupBy("id").agg(F.sum(F.col("n") - 1).alias("degree"))
    centre = F.max(F.struct("degree", "id")).over(Window.partitionBy("bucket"))
    hubs = buckets.select("bucket", "id").join(degree, "id").select("id", centre.alias("hub")).groupBy("id").agg(
        F.max("hub").alias("hub")).select("id", F.col("hub.id").alias("hub")).where("id <> hub")
    near = staged(_near_sketches(hubs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(),
                                 sketches, limit))
    # every text that a comparison may need, shuffled once
    texts = staged(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
                   .join(degree.select("id"), "id", "left_semi").dropDuplicates(["id"]))
    links = staged(similar_pairs(near, texts, k, lower, percent))
    labels = components(links)
    # buckets that still hold several components: members not yet compared with each other
    named = buckets.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "label", F.coalesce("label", "id"))
    mixed = named.withColumn("lo", F.min("label").over(Window.partitionBy("bucket"))).withColumn(
        "hi", F.max("label").over(Window.partitionBy("bucket"))).where("lo < hi").select("bucket", "n", "id", "label")
    mixed = staged(mixed)
    sets = _sorted_sets(texts.join(mixed.select("id").distinct(), "id", "left_semi"), k, lower)
    members = mixed.join(classes.select("id", "bands", "sketch"), "id").join(sets, "id")
    more = staged(_block_links(members, limit, percent).distinct())
    if more.limit(1).count():
        labels = components(links.union(more))
    named_sets = staged(classes.select("set_a", "set_b", "id").join(
        labels.withColumnRenamed("node", "id"), "id", "left").select(
        "set_a", "set_b", F.coalesce("label", "id").alias("label")))
    linked = marked.select("id", "n_shingles", "set_a", "set_b").join(named_sets, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("id").isNotNull(), F.col("label"))).otherwise(F.col("id"))
    return linked.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(f"`{id_col}`") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is the one kept of its group. Rows of an id that stands for
    different texts take no part and stay: an id says which of a group goes, so it must name one text."""
    of_text = F.xxhash64(f"`{text}`")
    several = docs.groupBy(id_col).agg(F.min(of_text).alias("lo"), F.max(of_text).alias("hi")).where("lo <> hi").select(id_col)
    groups = near_duplicates(docs.join(several, id_col, "left_anti"), k, percent, True, id_col, text)
    gone = groups.where("not kept").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
