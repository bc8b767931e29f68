"""Removal of passages that also stand in an earlier document, by an FM-index per shard.

A window is ``window`` consecutive words. Word for word equal windows pick the same anchor: the 8-word
gram of least hash within them. So windows are dealt to shards by their anchor, and a window finds all
its equals in its shard.

1. Texts with the same words are one (hot groups of copies); a copy of an earlier text is covered whole.
2. Each text is cut into runs of windows with one anchor. Anchors of one document only are dropped.
3. Runs with the same words are one segment, whose text is read once, from its first document.
4. Segments of an anchor with very many of them (the two ends of a passage that many documents hold,
   each in other surroundings) are cut into single windows instead, one row of hashes each. Equal windows
   are merged to their smallest id by an aggregate, and a join marks every later holder as covered. So
   no shard holds more than ``hot`` segments of an anchor.
5. Each shard indexes the other segments: BWT in a wavelet matrix, with the smallest document id of any range
   of suffixes. Each segment is streamed through the index from right to left; its matching statistics
   against documents of smaller ids give the intervals of at least ``window`` words.

Defined results: a null, empty or short text (fewer words than a window) loses nothing; rows with
equal ids do not remove words from each other; rows with a null id lose
and remove nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, IntegerType, LongType, StringType, StructField, StructType)

from corpuskit.llm.fm_index import FMIndex, reach_left
from corpuskit.llm.textvec import U64, Words, mix, pieces, range_hashes, shingle_places, shingles
from corpuskit.llm.staging import staged
from corpuskit.session import ship_package

WINDOW = 50
GRAM = 8
SHARD_WORDS = 400_000
HOT_SEGMENTS = 2_000


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of each ``width`` consecutive values."""
    at = np.arange(len(values))
    done = 1
    while done < width:
        more = min(done, width - done)
        left, right = at[:len(at) - more], at[more:]
        at = np.where(values[left] <= values[right], left, right)
        done += more
    return at


def _anchor_runs(words: Words, hashes: np.ndarray, window: int, gram: int):
    """(doc, first window, last window, anchor hash, hash of the run's words) of each run."""
    places, docs = shingle_places(words.of, window)
    if not len(places):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U64)] * 2
    grams = shingles(hashes, gram)
    anchor = sliding_argmin(grams, window - gram + 1)[places]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (docs[1:] != docs[:-1])))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(places)) - 1
    first, last = places[begin], places[end]
    return docs[begin], first, last, grams[anchor[begin]], range_hashes(mix(hashes), first, last + window)


def _sequence_hashes(words: Words, hashes: np.ndarray, salt: int) -> np.ndarray:
    return range_hashes(mix(hashes + U64(salt)), words.of[:-1], words.of[1:]).view(np.int64)


def _source(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))


def _sequences(source: DataFrame) -> DataFrame:
    """(id, n_words, seq_a, seq_b): texts with the same words have the same (seq_a, seq_b)."""
    schema = StructType([source.schema["id"], *(StructField(c, LongType()) for c in ("n_words", "seq_a", "seq_b"))])

    def run(batches):
        for batch in batches:
            for p in pieces(batch.column(1)):
                words = Words(p)
                seqs = [_sequence_hashes(words, words.hashes, salt) for salt in (1, 2)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.first, p.n_docs), pa.array(words.counts),
                                                  *map(pa.array, seqs)], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def _runs(source: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, seq_a, first, windows, anchor, seg) of each run of windows with one anchor."""
    schema = StructType([source.schema["id"], StructField("seq_a", LongType()), StructField("first", IntegerType()), StructField("windows", IntegerType()),
                         StructField("anchor", LongType()), StructField("seg", LongType())])

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for p in pieces(batch.column(1)):
                words = Words(p)
                hashes = words.hashes
                doc, first, last, anchor, seg = _anchor_runs(words, hashes, window, gram)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc + p.first)), pa.array(_sequence_hashes(words, hashes, 1)[doc]), pa.array((first - words.of[doc]).astype(np.int32)),
                     pa.array((last - first + 1).astype(np.int32)), pa.array(anchor.view(np.int64)),
                     pa.array(seg.view(np.int64))], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def _segment_texts(rows: DataFrame, window: int) -> DataFrame:
    """``rows(id, text, wanted: array<struct<place<first, seq_a>, windows, anchor, seg>>)`` -> words of each.
    Rows that repeat an id are told apart by the hash of their words."""
    schema = StructType([rows.schema["id"], StructField("anchor", LongType()), StructField("seg", LongType()),
                         StructField("windows", IntegerType()), StructField("words", StringType())])

    def run(batches):
        for batch in batches:
            for p in pieces(batch.column(1)):
                words = Words(p)
                wanted = batch.column(2).slice(p.first, p.n_docs)
                doc = np.repeat(np.arange(p.n_docs), wanted.value_lengths().to_numpy())
                items = wanted.flatten()
                own = np.flatnonzero(items.field(0).field(1).to_numpy() == _sequence_hashes(words, words.hashes, 1)[doc])
                doc, items = doc[own], items.take(pa.array(own))
                first, windows, anchor, seg = items.field(0).field(0), items.field(1), items.field(2), items.field(3)
                at = words.of[doc] + first.to_numpy()
                raw = p.data.tobytes()
                cuts = zip(words.starts[at].tolist(), words.ends[at + windows.to_numpy() + window - 2].tolist(), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(p.first, p.n_docs).take(pa.array(doc)), anchor, seg, windows,
                     pa.array([raw[a:b].decode("utf-8", "replace") for a, b in cuts], pa.string())],
                    names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def _single_windows(segments: DataFrame, window: int) -> DataFrame:
    """Segments cut into windows: (id, anchor, seg, at, win), ``win`` the hash of the window's words."""
    schema = StructType([segments.schema["id"], StructField("anchor", LongType()), StructField("seg", LongType()),
                         StructField("at", IntegerType()), StructField("win", LongType())])
    source = segments.select("words", "id", "anchor", "seg")

    def run(batches):
        for batch in batches:
            for p in pieces(batch.column(0)):
                words = Words(p)
                places, doc = shingle_places(words.of, window)
                win = range_hashes(mix(words.hashes), places, places + window)
                take = pa.array(doc + p.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(take), batch.column(2).take(take), batch.column(3).take(take),
                     pa.array((places - words.of[doc]).astype(np.int32)), pa.array(win.view(np.int64))],
                    names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def covered_windows(index: FMIndex, text: np.ndarray, first: np.ndarray, stop: np.ndarray, own: np.ndarray,
                    window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, last window) ranges of windows of the segments ``text[first:stop]`` that start at a
    place of smaller value too. Ranges of undecided windows are halved until decided: the search from
    the end of a range tells its windows that are covered, and those that cannot be."""
    seg = np.arange(len(first))
    lo, hi = first.copy(), stop - window  # undecided window starts, both included
    out = []
    while len(seg):
        keep = lo <= hi
        seg, lo, hi = seg[keep], lo[keep], hi[keep]
        if not len(seg):
            break
        # from the end of the first undecided window: windows that hold a mismatch are out
        ends = lo + window - 1
        reached = reach_left(index, text, ends, lo, own[seg])
        missed = reached > lo
        hit = ~missed
        # a match of the first window: try the whole range at once, from the end of its last window
        full = np.flatnonzero(hit)
        far = reach_left(index, text, hi[full] + window - 1, lo[full], own[seg[full]])
        got = far <= hi[full]
        out.append((seg[full], lo[full], lo[full]))
        out.append((seg[full][got], far[got], hi[full][got]))
        rest_lo, rest_hi = lo[full] + 1, np.where(got, far - 1, hi[full] - 1)
        middle = (rest_lo + rest_hi) // 2
        seg = np.concatenate((seg[missed], seg[full], seg[full]))
        lo, hi = (np.concatenate((reached[missed], rest_lo, middle + 1)),
                  np.concatenate((hi[missed], middle, rest_hi)))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _search_shard(table: pa.Table, window: int) -> pa.Table:
    """The covered spans of each segment of a shard, in words from the segment's start."""
    table = table.combine_chunks()
    (piece,) = pieces(table["words"], max_bytes=1 << 62)
    words = Words(piece)
    symbols, code = np.unique(words.hashes, return_inverse=True)
    # segments stand one after another, each closed by symbol 0, which no pattern holds
    n_seg = piece.n_docs
    first = words.of[:-1] + np.arange(n_seg)
    stop = words.of[1:] + np.arange(n_seg)
    text = np.zeros(len(code) + n_seg, np.int64)
    text[np.arange(len(code)) + np.repeat(np.arange(n_seg), words.counts)] = code + 1
    _, own = np.unique(table["id"].to_numpy(), return_inverse=True)
    own = own.astype(np.int32)
    values = np.repeat(own, stop - first + 1)
    index = FMIndex(text, values, depth=int((stop - first).max()) + 1)
    seg, lo, hi = covered_windows(index, text, first, stop, own, window)
    return pa.table({
        "anchor": table["anchor"].take(pa.array(seg)), "seg": table["seg"].take(pa.array(seg)),
        "from": pa.array((lo - first[seg]).astype(np.int32)),
        "to": pa.array((hi - first[seg] + window).astype(np.int32))})


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text",
                   gram: int = GRAM, hot: int = HOT_SEGMENTS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, spans): the word ranges ``[from, to)`` of each document that lie in windows which also start in
    a document of smaller id; ``seq_a`` is the hash of the words of the row that is meant. Documents
    without any are left out. Ids are integers."""
    gram = min(gram, window)
    source = _source(docs, id_col, text)
    sequences = staged(_sequences(source).where("id is not null"))
    long = sequences.where(F.col("n_words") >= window)
    origin = staged(long.groupBy("seq_a", "seq_b").agg(F.min("id").alias("origin")))
    copies = long.join(origin, ["seq_a", "seq_b"]).where("id > origin").select("id", "seq_a", "n_words")
    first_ids = origin.select(F.col("origin").alias("id")).distinct()

    # every document that is not a copy, as runs of windows
    runs = staged(_runs(source.join(first_ids, "id", "left_semi"), window, gram))
    # written, so that the join has an exchange of its own, which can be split at an anchor that very many hold
    shared = staged(runs.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor"))
    shared_runs = staged(runs.join(shared, "anchor"))
    owners = shared_runs.groupBy("anchor", "seg", "windows").agg(F.min("id").alias("id"))
    owned = shared_runs.join(owners, ["anchor", "seg", "windows", "id"]).groupBy("anchor", "seg", "windows", "id").agg(
        F.min(F.struct("first", "seq_a")).alias("place"))
    wanted = owned.groupBy("id").agg(F.collect_list(F.struct("place", "windows", "anchor", "seg")).alias("wanted"))
    segments = staged(_segment_texts(source.join(wanted, "id").select("id", "text", "wanted"), window))
    busy = staged(segments.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"))
    plain = segments.join(busy, "anchor", "left_anti").select("id", "anchor", "seg", "words")
    n_words = plain.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(1, -(-n_words // (5 * shard_words)))
    schema = StructType([StructField("anchor", LongType()), StructField("seg", LongType()),
                         StructField("from", IntegerType()), StructField("to", IntegerType())])
    matched = (plain.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
               .groupBy("shard").applyInArrow(lambda table: _search_shard(table, window), schema))
    # written, so that the join reads it by an exchange and a window that very many hold can be dealt out
    single = staged(_single_windows(segments.join(busy, "anchor", "left_semi"), window))
    earliest = staged(single.groupBy("anchor", "win").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
                      .where("lo < hi").drop("hi"))
    later = single.join(earliest, ["anchor", "win"]).where("id > lo").select(
        "anchor", "seg", F.col("at").alias("from"), (F.col("at") + window).cast("int").alias("to"))
    found = staged(matched.unionByName(later).groupBy("anchor", "seg").agg(
        F.collect_list(F.struct("from", "to")).alias("spans")))

    # a segment's first document loses what the index found; each later holder of it loses all
    by_segment = staged(owners.withColumnRenamed("id", "owner").join(found, ["anchor", "seg"], "left"))
    from_to = lambda a, b: F.struct(F.col("seq_a"), a.cast("int").alias("from"), b.cast("int").alias("to"))
    first = F.col("first")
    lost = shared_runs.join(by_segment, ["anchor", "seg", "windows"]).select("id", F.explode(
        F.when(F.col("id") > F.col("owner"), F.array(from_to(first, first + F.col("windows") + (window - 1))))
        .otherwise(F.transform("spans", lambda s: from_to(first + s["from"], first + s["to"])))).alias("span"))
    whole = copies.select("id", from_to(F.lit(0), F.col("n_words")).alias("span"))
    return lost.unionByName(whole).groupBy("id").agg(F.collect_list("span").alias("spans"))


def cut_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept): ``kept`` holds the words outside the spans, joined by a space."""
    return _cut(docs, spans, id_col, text, StructField("kept", StringType()), lambda kept: kept.decode("utf-8", "replace"))


def kept_digests(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256) of the words outside the spans, joined by a space."""
    return _cut(docs, spans, id_col, text, StructField("kept_sha256", StringType()),
                lambda kept: hashlib.sha256(kept).hexdigest())


def _cut(docs, spans, id_col, text, field, derive) -> DataFrame:
    rows = _source(docs, id_col, text).join(spans, "id", "left").select("id", "text", "spans")
    schema = StructType([StructField(id_col, rows.schema["id"].dataType), StructField("n_words", LongType()),
                         StructField("n_removed", LongType()), field])

    def run(batches):
        for batch in batches:
            for p in pieces(batch.column(1)):
                words = Words(p)
                spans = batch.column(2).slice(p.first, p.n_docs)
                doc = np.repeat(np.arange(p.n_docs), spans.value_lengths().fill_null(0).to_numpy())
                items = spans.flatten()
                own = np.flatnonzero(items.field(0).to_numpy() == _sequence_hashes(words, words.hashes, 1)[doc])
                base = words.of[doc[own]]
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, base + items.field(1).to_numpy()[own], 1)
                np.add.at(cover, base + items.field(2).to_numpy()[own], -1)
                stays = np.cumsum(cover[:-1]) == 0
                # the kept words, each with a space behind it
                starts, lengths = words.starts[stays], (words.ends - words.starts)[stays]
                stops = np.cumsum(lengths + 1)
                out = np.full(int(stops[-1]) if len(stops) else 0, 0x20, np.uint8)
                shift = np.repeat(stops - lengths - 1 - starts, lengths)
                at = np.arange(len(shift)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
                out[at + shift] = p.data[at]
                kept = np.concatenate(([0], np.cumsum(stays)))[words.of]
                cuts = np.concatenate(([0], stops))[kept].tolist()
                raw = out.tobytes()
                texts = [raw[a:max(a, b - 1)] for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(p.first, p.n_docs), pa.array(words.counts),
                     pa.array(words.counts - np.diff(kept)), pa.array([derive(t) for t in texts], pa.string())],
                    names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept) of each row of ``docs``."""
    return cut_spans(docs, repeated_spans(docs, window, id_col, text), id_col, text)
