"""Line de-duplication: equal lines, and lines within a few edits by a segment-partition join.

A line is removed when an equal line, or a line within ``EDITS`` edits, stands earlier: at a smaller
(document id, line number), judged on the input. Edits are of UTF-8 bytes; lines of fewer than
``MIN_BYTES`` are compared for equality only; lines without a word always stay.

1. Equal lines are one from here on, known by a 64-bit hash and their first place.
2. A line is split into ``EDITS + 1`` segments. Of two lines within EDITS edits, the longer holds one of
   the shorter's segments whole, at one of a few places (multi-match-aware choice by the difference of
   lengths). Keys are hashes of (length, segment number, bytes): three of the index and nine of the probe
   at two edits. Keys are sorted by Spark and read as a stream.
3. Small groups of a key give their pairs. Members of larger groups are dealt out in pairs of blocks and
   filtered by a bound on the edit distance from their byte counts before any pair is written.
4. Pairs are verified by a banded bit-parallel edit distance, all pairs of a batch at a time.

Defined results: null and empty texts have no lines that could go; rows with a null id keep all lines and
remove none; rows that repeat an id and a text lose the same lines; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, IntegerType, LongType, StructField, StructType)

from corpuskit.llm.textvec import U64, Words, mix, pieces, range_hashes, text_buffer, _BYTE_VALUE
from corpuskit.llm.staging import staged
from corpuskit.session import ship_package

EDITS = 2
MIN_BYTES = 32
SMALL_GROUP = 32
BLOCK_MEMBERS = 1024
SEEN_LINES = 500_000
LONG = LongType()


class Lines:
    """The lines with a word of a piece: byte spans, document, number (from 0) and hash (even)."""

    def __init__(self, piece):
        data, bounds = piece.data, piece.bounds
        at = np.flatnonzero(data == 0x0A)
        starts = np.concatenate((bounds[:-1], at + 1))
        ends = np.concatenate((at, bounds[1:]))
        doc = np.concatenate((np.arange(piece.n_docs), np.searchsorted(bounds, at, "right") - 1))
        end_doc = np.concatenate((doc[piece.n_docs:], np.arange(piece.n_docs)))
        by_start, by_end = np.lexsort((starts, doc)), np.lexsort((ends, end_doc))
        starts, ends, doc = starts[by_start], ends[by_end], doc[by_start]
        number = np.arange(len(doc)) - np.searchsorted(doc, doc)
        words = Words(piece)
        full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
        self.starts, self.ends, self.doc, self.number = starts[full], ends[full], doc[full], number[full]
        self.data = data
        self.hashes = (range_hashes(_BYTE_VALUE[data], self.starts, self.ends) & ~U64(1)).view(np.int64)


def segment_starts(lengths: np.ndarray, edits: int) -> np.ndarray:
    """Start of each of the ``edits + 1`` segments of lines of these lengths, and the end: one row a line."""
    parts = edits + 1
    short, longer = lengths // parts, lengths % parts
    i = np.arange(parts + 1)
    return short[:, None] * i + np.maximum(0, i - (parts - longer[:, None]))


def segment_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index keys, probe keys), a row for each line. A probe key that would repeat an index key of the
    same line is left out, so two lines of one length meet by their index keys."""
    length = ends - starts
    parts = edits + 1
    index, probe = [], []
    values = _BYTE_VALUE[data]

    def key(first, last, indexed, i):
        return mix(range_hashes(values, first, last) + mix(indexed.astype(U64) * U64(parts) + U64(i))).view(np.int64)

    for less in range(edits + 1):
        indexed = length - less
        cuts = segment_starts(indexed, edits)
        for i in range(parts):
            # shifts that leave enough edits for what lies before and behind the segment
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                if less == 0 and shift == 0:
                    index.append(key(starts + cuts[:, i], starts + cuts[:, i + 1], indexed, i))
                else:
                    first = starts + np.clip(cuts[:, i] + shift, 0, None)
                    last = np.minimum(starts + cuts[:, i + 1] + shift, ends)
                    probe.append(key(np.minimum(first, last), last, indexed, i))
    return np.stack(index, 1), np.stack(probe, 1)


def banded_distances(a: list[bytes], b: list[bytes], edits: int) -> np.ndarray:
    """Edit distance of each pair, ``edits + 1`` where it is more. Bit k of a band vector is row
    ``column - edits + k`` of the pair's table, so the band moves down the diagonal by itself."""
    out = np.full(len(a), edits + 1)
    todo, left, right = [], [], []
    for n, (x, y) in enumerate(zip(a, b, strict=True)):
        if abs(len(x) - len(y)) > edits:
            continue
        # what both begin and end with costs nothing
        p = _common(x, y)
        x, y = x[p:], y[p:]
        s = _common(x[::-1], y[::-1])
        x, y = x[:len(x) - s], y[:len(y) - s]
        if not x or not y:
            out[n] = max(len(x), len(y))
        else:
            todo.append(n)
            left.append(x)
            right.append(y)
    if not todo:
        return out
    at = np.array(todo)
    m, n = (np.array([len(s) for s in side]) for side in (left, right))
    # rows outside the string match nothing: a margin of 256 around each left string
    pad = edits + 1
    base_l = np.cumsum(m + 2 * pad) - (m + 2 * pad) + pad
    flat_l = np.full(int((m + 2 * pad).sum()) + pad, 256, np.int16)
    rows = np.arange(int(m.sum())) + np.repeat(base_l - (np.cumsum(m) - m), m)
    flat_l[rows] = np.frombuffer(b"".join(left), np.uint8)
    base_r = np.cumsum(n) - n
    flat_r = np.frombuffer(b"".join(right), np.uint8).astype(np.int16)
    width = 2 * edits + 1
    full = (1 << width) - 1
    more = np.full(len(at), (full << edits) & full)  # +1 from row 1 on in column 0
    less = np.zeros(len(at), np.int64)
    low = np.full(len(at), edits)  # value at the band's last row
    column = 0
    while len(at):
        ended = n == column
        if ended.any():
            # back from the band's last row, column + edits, up to row m
            skip = (m - column + edits)[ended]
            above = (full >> 1) >> skip << skip
            dist = low[ended] - np.bitwise_count(more[ended] & above) + np.bitwise_count(less[ended] & above).astype(np.int64)
            out[at[ended]] = np.minimum(dist, edits + 1)
        live = ~ended & (low <= 3 * edits)
        at, m, n, base_l, base_r, more, less, low = (v[live] for v in (at, m, n, base_l, base_r, more, less, low))
        if not len(at):
            break
        char = flat_r[base_r + column]
        match = np.zeros(len(at), np.int64)
        for k in range(width):
            row = column - edits + k
            place = np.clip(base_l + row, base_l - pad, base_l + m + pad - 1)
            match |= (flat_l[place] == char).astype(np.int64) << k
        same = ((((match & more) + more) ^ more) | match | less) & full  # no cost along the diagonal
        up = less | (~(same | more) & full)
        down = same & more
        low = low + 1 - (same >> (width - 1) & 1)
        more = down | (~((same >> 1) | up) & full)
        less = (same >> 1) & up
        column += 1
    return out


def _common(x: bytes, y: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(x), len(y))
    if x[:hi] == y[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _source(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.col("id").isNotNull())


def line_places(source: DataFrame) -> DataFrame:
    """(id, line, hash) of each line with a word."""
    schema = StructType([source.schema["id"], StructField("line", IntegerType()), StructField("hash", LONG)])

    def run(batches):
        for batch in batches:
            for p in pieces(batch.column(1)):
                lines = Lines(p)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lines.doc + p.first)), pa.array(lines.number.astype(np.int32)),
                     pa.array(lines.hashes)], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def _fresh(lines: Lines, seen: set, min_bytes: int) -> np.ndarray:
    """Places of lines that are long enough and that this task has not met; only a saving, so that a
    line which many documents hold is sent on once a task."""
    _, once = np.unique(lines.hashes, return_index=True)
    once = once[(lines.ends - lines.starts)[once] >= min_bytes]
    new = np.array([h not in seen for h in lines.hashes[once].tolist()], bool)
    if len(seen) > SEEN_LINES:
        seen.clear()
    seen.update(lines.hashes[once].tolist())
    return once[new] if len(once) else once


def _keys(source: DataFrame, edits: int, min_bytes: int) -> DataFrame:
    """(key, line): ``line`` is a line's hash, odd for the keys that only probe."""
    schema = StructType([StructField("line", LONG), StructField("index", ArrayType(LONG, False)),
                         StructField("probe", ArrayType(LONG, False))])

    def run(batches):
        seen: set = set()
        for batch in batches:
            for p in pieces(batch.column(0)):
                lines = Lines(p)
                take = _fresh(lines, seen, min_bytes)
                keys = segment_keys(lines.data, lines.starts[take], lines.ends[take], edits)
                yield pa.RecordBatch.from_arrays([pa.array(lines.hashes[take])] + [
                    pa.ListArray.from_arrays(pa.array(np.arange(len(take) + 1, dtype=np.int32) * k.shape[1]),
                                             pa.array(k.ravel())) for k in keys], names=schema.fieldNames())

    rows = source.select("text").mapInArrow(run, schema)
    tagged = rows.select(F.explode(F.concat(
        F.transform("index", lambda k: F.struct(k.alias("key"), F.col("line").alias("line"))),
        F.transform("probe", lambda k: F.struct(k.alias("key"), (F.col("line") + 1).alias("line"))))).alias("x"))
    return tagged.select("x.key", "x.line")


def _meet(keys: DataFrame) -> DataFrame:
    """Streams sorted (key, line) rows: pairs (a, b) of small groups, and members (a, key) of larger ones."""
    schema = StructType([StructField("a", LONG), StructField("b", LONG), StructField("key", LONG)])

    def small(key, line):
        """Pairs of each run of equal keys."""
        out_a, out_b = [], []
        for gap in range(1, SMALL_GROUP):
            same = np.flatnonzero(key[gap:] == key[:-gap]) if len(key) > gap else np.zeros(0, np.int64)
            if not len(same):
                break
            x, y = line[same], line[same + gap]
            good = ((x & 1) + (y & 1) < 2) & ((x | 1) != (y | 1))
            x, y = x[good] & ~1, y[good] & ~1
            out_a.append(np.minimum(x, y))
            out_b.append(np.maximum(x, y))
        return out_a, out_b

    def emit(key, line, whole):
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(key)))
        big = np.repeat(size > SMALL_GROUP, size) if whole else np.ones(len(key), bool)
        a, b = small(key[~big], line[~big])
        n = sum(map(len, a))
        members, of_key = line[big], key[big]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([*a, members])),
             pa.array(np.concatenate([*b, members]), mask=np.arange(n + len(members)) >= n),
             pa.array(np.concatenate([np.zeros(n, np.int64), of_key]), mask=np.arange(n + len(members)) < n)],
            names=schema.fieldNames())

    def run(batches):
        key, line, open_key = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            key = np.concatenate((key, batch.column(0).to_numpy()))
            line = np.concatenate((line, batch.column(1).to_numpy()))
            if open_key is not None:  # a large group whose first members have gone out
                n = int(np.searchsorted(key != open_key, True))
                yield emit(key[:n], line[:n], False)
                key, line, open_key = key[n:], line[n:], open_key if n == len(key) else None
                if not len(key):
                    continue
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield emit(key[:last], line[:last], True)
            key, line = key[last:], line[last:]
            if len(key) > SMALL_GROUP:
                yield emit(key, line, False)
                open_key, key, line = int(key[0]), key[:0], line[:0]
        yield emit(key, line, True)

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _line_texts(source: DataFrame, hashes: DataFrame, min_bytes: int) -> DataFrame:
    """(hash, bytes) of the lines with these hashes."""
    schema = StructType([StructField("hash", LONG), StructField("bytes", BinaryType())])

    def run(batches):
        seen: set = set()
        for batch in batches:
            for p in pieces(batch.column(0)):
                lines = Lines(p)
                take = _fresh(lines, seen, min_bytes)
                raw = p.data.tobytes()
                cuts = zip(lines.starts[take].tolist(), lines.ends[take].tolist(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lines.hashes[take]),
                                                  pa.array([raw[a:b] for a, b in cuts], pa.binary())],
                                                 names=schema.fieldNames())

    return (source.select("text").mapInArrow(run, schema).join(hashes, "hash", "left_semi")
            .groupBy("hash").agg(F.first("bytes").alias("bytes")))


def _byte_counts(texts: DataFrame) -> DataFrame:
    """(hash, counts): how many bytes of a line fall in each of 64 classes, at most 255."""
    schema = StructType([StructField("hash", LONG), StructField("counts", BinaryType())])

    def run(batches):
        for batch in batches:
            data, bounds = text_buffer(batch.column(1).cast(pa.large_binary()).view(pa.large_string()))
            data = data[bounds[0]:bounds[-1]]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            counts = np.bincount(owner * 64 + (data & 63), minlength=batch.num_rows * 64)
            packed = np.minimum(counts, 255).astype(np.uint8).reshape(-1, 64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in packed], pa.binary())],
                                             names=schema.fieldNames())

    return texts.mapInArrow(run, schema)


def _block_pairs(members: DataFrame, edits: int) -> DataFrame:
    """``members(key, line, counts, n)`` -> pairs (a, b) of a key that their byte counts do not rule out."""
    blocks = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    dealt = (members.withColumn("blocks", blocks)
             .withColumn("mine", F.pmod(F.xxhash64(F.col("line").bitwiseAND(F.lit(-2))), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "line",
                     "counts"))
    schema = StructType([StructField("a", LONG), StructField("b", LONG)])

    def run(key, table):
        _, lo, hi = (x.as_py() for x in key)
        line, mine = table["line"].to_numpy(), table["mine"].to_numpy()
        counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint8).reshape(-1, 64).astype(np.int16)
        left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        out_a, out_b = [line[:0]], [line[:0]]
        for i in left:
            other = right[((line[right] & ~1) > (line[i] & ~1)) | ((lo != hi) & (line[right] | 1 != line[i] | 1))]
            other = other[(line[other] & 1) + (line[i] & 1) < 2]
            gap = counts[other] - counts[i]
            near = other[(np.maximum(gap, 0).sum(1) <= edits) & (np.maximum(-gap, 0).sum(1) <= edits)]
            out_a.append(np.minimum(line[near] & ~1, line[i] & ~1))
            out_b.append(np.maximum(line[near] & ~1, line[i] & ~1))
        return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return dealt.groupBy("key", "lo", "hi").applyInArrow(run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) within ``edits``, with their distance."""
    side = lambda x: texts.select(F.col("hash").alias(x), F.col("bytes").alias(f"bytes_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "bytes_a", "bytes_b")
    schema = StructType([StructField("a", LONG), StructField("b", LONG), StructField("distance", IntegerType())])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                dist = banded_distances(part.column(2).to_pylist(), part.column(3).to_pylist(), edits)
                near = pa.array(dist <= edits)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(near), part.column(1).filter(near),
                                                  pa.array(dist[dist <= edits].astype(np.int32))], names=schema.fieldNames())

    return both.mapInArrow(run, schema)


def near_lines(source: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(a, b, distance): every pair of different lines of ``source(id, text)`` within ``edits``, by hash."""
    met = staged(_meet(_keys(source, edits, min_bytes)))
    large = met.where("key is not null").select("key", F.col("a").alias("line")).distinct()
    pairs = met.where("key is null").select("a", "b")
    ends = pairs.select(F.col("a").alias("hash")).union(pairs.select("b")).union(
        large.select(F.col("line").bitwiseAND(F.lit(-2)))).distinct()
    texts = staged(_line_texts(source, ends, min_bytes))
    large = staged(large)
    if large.limit(1).count():
        sizes = large.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        counts = _byte_counts(texts).withColumnRenamed("hash", "even")
        members = large.withColumn("even", F.col("line").bitwiseAND(F.lit(-2))).join(counts, "even").join(sizes, "key")
        pairs = pairs.union(_block_pairs(members, edits))
    return _verified(pairs.distinct(), texts, edits)


def line_verdicts(docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES, id_col: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """(id, line, verdict, n_links) of each line with a word: verdict 0 stays, 1 an equal line stands
    earlier, 2 a near line does; n_links counts the different lines within ``edits`` of this one."""
    source = _source(docs, id_col, text)
    places = staged(line_places(source))
    first = places.groupBy("hash").agg(F.min(F.struct("id", "line")).alias("first"))
    links = staged(near_lines(source, edits, min_bytes))
    both = links.select(F.col("a").alias("hash"), F.col("b").alias("near")).union(links.select("b", "a"))
    linked = both.select("hash").distinct()
    known = staged(first.join(linked, "hash", "left_semi"))
    near = (both.join(known, "hash").join(known.select(F.col("hash").alias("near"), F.col("first").alias("near_first")), "near")
            .groupBy("hash").agg(F.count(F.lit(1)).alias("n_links"),
                                 F.max((F.col("near_first") < F.col("first")).cast("int")).alias("later")))
    # lines of one place and without links have no verdict to look up
    matter = first.join(near, "hash", "left").select("hash", "first", "n_links", "later")
    judged = places.join(staged(matter), "hash")
    return judged.select("id", "line", F.when(F.struct("id", "line") != F.col("first"), 1)
                         .when(F.col("later") == 1, 2).otherwise(0).alias("verdict"),
                         F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def line_report(docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES, id_col: str = "doc_id",
                text: str = "text") -> DataFrame:
    """(id_col, n_lines, n_equal, n_near, n_links, removed) of each id that has a line with a word."""
    gone = F.when(F.col("verdict") > 0, F.col("line"))
    return line_verdicts(docs, edits, min_bytes, id_col, text).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("verdict") == 1).alias("n_equal"),
        F.count_if(F.col("verdict") == 2).alias("n_near"), F.sum("n_links").alias("n_links"),
        F.array_sort(F.collect_set(gone)).alias("removed")).withColumnRenamed("id", id_col)


def drop_lines(docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES, id_col: str = "doc_id",
               text: str = "text") -> DataFrame:
    """``docs`` without the removed lines; a text that loses its last line with a word goes whole. Rows of one
    id with different texts are documents of their own, in the order of their texts' hashes."""
    own = F.when(F.col(f"`{id_col}`").isNotNull(), F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text}`").alias("hash")))
    verdicts = line_verdicts(docs.select(own.alias("_doc_"), F.col(f"`{text}`")), edits, min_bytes, "_doc_", text)
    gone = verdicts.where("verdict > 0").groupBy(F.col("id").alias("_doc_")).agg(F.collect_set("line").alias("_gone_"))
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    rest = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_gone_", i)), "\n")
    joined = docs.withColumn("_doc_", own).join(gone, "_doc_", "left")
    kept = joined.select(*[(F.when(F.col("_gone_").isNull(), F.col(f"`{c}`")).otherwise(rest) if c == text
                            else F.col(f"`{c}`")).alias(c) for c in docs.columns], "_gone_")
    return kept.where(F.col("_gone_").isNull() | F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]")).drop("_gone_")
