"""Cross-tokenizer alignment: how two tokenizers cut the same bytes, merged in lockstep.

A text is encoded by two tokenizers, A and B. Both cut the same bytes, so their tokens merge like two sorted
lists of ends: the tokens at hand are linked, then the one that ends first moves on, or both, which is a cut.
One state vector holds the two places of every document of a batch; each step links, cuts and advances all of
them at once, and documents that are finished leave it. A long document is dealt out into several lanes of
the vector at ends that A and B share, so that the number of steps stays bounded.

Links are counted over the whole corpus: an id pair's count is the number of documents that hold it linked.
Documents go in chunks of some megabytes. Each chunk writes its distinct id pairs once, with the number of
its documents, so that the shuffles move pairs of chunks, not links of documents; the counts come back to the
chunk, where its documents look them up.

Defined results: a text that is null or empty, or of which the tokens of A or B do not give back the bytes
(a blank before the text and the text), has no tokens, zeros and an empty column ``groups_sha256``; bytes
that are not UTF-8 count as U+FFFD; each of several rows with one id, or with one text, is a document of its
own; an empty table gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType)

from corpuskit.llm.bpe import SliceCache, _clean, _ranges, encode_piece
from corpuskit.llm.staging import staged
from corpuskit.llm.textvec import Piece, pieces
from corpuskit.llm.token_output import BYTE_LETTERS, LibraryTokenizer
from corpuskit.session import ship_package

LANE = 512  # tokens of A after which a lane ends at the next shared end
CHUNK_BYTES = 2 << 20
SLICES = 1 << 18  # kept by the cache of each side; two of them lie in every worker
SHOWN_TOKENS = 1 << 17  # tokens of A whose groups are written out at once


class TokenBytes:
    """The bytes of every id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[_ranges(self.begin[ids], self.lengths[ids])]


class ByteLevelSide(LibraryTokenizer):
    """A tokenizer file of the ``tokenizers`` library with byte-level entries; the strings of its special
    tokens in a text are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.cache.limit = SLICES
        letter = {chr(c): b for b, c in BYTE_LETTERS.items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            tokens[i] = bytes(letter[c] for c in entry) if all(c in letter for c in entry) else entry.encode()
        self.table = TokenBytes(tokens)

    def ids(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        if self.by_slice:
            _, ids, bounds, *_ = encode_piece(piece, self.cache)
            return ids, bounds
        lists = self._encode_whole(piece, range(piece.n_docs))
        return _flat(lists)


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.cumsum([0, *map(len, lists)])
    return np.fromiter((x for ids in lists for x in ids), np.uint32, int(bounds[-1])), bounds


class PieceSide:
    """A SentencePiece model that puts a blank before the text. Where no piece has a blank behind another
    character, a run of blanks with what follows up to the next blank is encoded by itself: the library is
    asked for each distinct one once."""

    BLANK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens, self.by_slice = [], True
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                tokens.append(bytes([int(piece[3:5], 16)]))
                continue
            tokens.append(piece.replace(self.BLANK, " ").encode())
            self.by_slice &= self.BLANK not in piece.lstrip(self.BLANK)
        probe = "ﬁ a  b　¨ ① "  # a normaliser, or blanks taken together, would show here
        self.by_slice &= self.model.decode(self.model.encode(probe)) == probe
        self.table = TokenBytes(tokens)
        self.cache = SliceCache(self._encode, SLICES)

    def _encode(self, new: list[bytes]) -> list[list[int]]:
        # the library puts one blank before what it is given; a single blank is a piece
        texts = [s[1:].decode("utf-8") for s in new]
        lone = [self.model.piece_to_id(self.BLANK)]
        return [ids if t else lone for t, ids in zip(texts, self.model.encode(texts, num_threads=1), strict=True)]

    def ids(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a piece whose texts begin with the blank that the library would add."""
        if not self.by_slice:
            return _flat(self.model.encode([piece.text(i)[1:].decode("utf-8") for i in range(piece.n_docs)], num_threads=1))
        blank = piece.data == 0x20
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[piece.bounds[:-1][np.diff(piece.bounds) > 0]] = True
        starts = np.flatnonzero(begins)
        ids, counts = self.cache.ids(piece.data, starts, np.append(starts[1:], len(piece.data))[:len(starts)])
        return ids, np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, piece.bounds)]


@lru_cache(maxsize=4)
def byte_level_side(path: str) -> ByteLevelSide:
    return ByteLevelSide(path)


@lru_cache(maxsize=4)
def piece_side(path: str) -> PieceSide:
    return PieceSide(path)


def spaced(piece: Piece) -> Piece:
    """The piece with a blank before every text that is not empty."""
    piece, _ = _clean(piece)
    some = np.diff(piece.bounds) > 0
    data = np.insert(piece.data, piece.bounds[:-1][some], 0x20)
    return Piece(piece.first, piece.last, data, piece.bounds + np.concatenate(([0], np.cumsum(some))))


def _faithful(piece: Piece, ids: np.ndarray, bounds: np.ndarray, table: TokenBytes) -> np.ndarray:
    """Documents whose tokens join to their bytes."""
    lengths = np.concatenate(([0], np.cumsum(table.lengths[ids])))[bounds]
    ok = np.diff(lengths) == np.diff(piece.bounds)
    same = np.flatnonzero(ok & (np.diff(piece.bounds) > 0))
    sizes = np.diff(piece.bounds)[same]
    joined = table.join(ids[_ranges(bounds[same], np.diff(bounds)[same])])
    differs = joined != piece.data[_ranges(piece.bounds[same], sizes)]
    if differs.any():
        ok[same] = ~np.logical_or.reduceat(differs, np.cumsum(sizes) - sizes)
    return ok


def _lanes(end_a: np.ndarray, end_b: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray):
    """(first token of A, first of B, end of A's tokens) of each lane."""
    first_a, first_b = a_bounds[:-1], b_bounds[:-1]
    probes = np.arange(LANE, len(end_a), LANE)
    if len(probes) and len(end_b):
        near = np.minimum(probes[:, None] + np.arange(64), len(end_a) - 1)
        at = np.minimum(np.searchsorted(end_b, end_a[near]), len(end_b) - 1)
        shared = end_b[at] == end_a[near]
        found = shared.argmax(1)
        row = np.flatnonzero(shared.any(1))
        first_a = np.concatenate((first_a, near[row, found[row]] + 1))
        first_b = np.concatenate((first_b, at[row, found[row]] + 1))
    first_a, keep = np.unique(first_a, return_index=True)
    first_b = first_b[keep]
    stop_a = np.append(first_a[1:], len(end_a))[:len(first_a)]
    some = stop_a > first_a
    return first_a[some], first_b[some], stop_a[some]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray):
    """Merge the token ends of documents that lie one after another: (A and B token of each link, in no
    order; A and B token at which each cut ends, in order)."""
    ia, ib, stop = _lanes(end_a, end_b, a_bounds, b_bounds)
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(ia):
        links_a.append(ia)
        links_b.append(ib)
        ea, eb = end_a[ia], end_b[ib]
        cut = ea == eb
        cuts_a.append(ia[cut])
        cuts_b.append(ib[cut])
        ia, ib = ia + (ea <= eb), ib + (eb <= ea)
        going = ia < stop
        if not going.all():
            ia, ib, stop = ia[going], ib[going], stop[going]
    none = [np.zeros(0, np.int64)]
    return (np.concatenate(links_a or none), np.concatenate(links_b or none),
            np.sort(np.concatenate(cuts_a or none)), np.sort(np.concatenate(cuts_b or none)))


class Aligned:
    """The documents of a piece, aligned: ids and token bounds of both sides (no tokens where a text does
    not come back), links as pairs of token numbers, and cuts."""

    def __init__(self, piece: Piece, side_a, side_b):
        piece = spaced(piece)
        self.n_docs = piece.n_docs
        a, a_bounds = side_a.ids(piece)
        b, b_bounds = side_b.ids(piece)
        ok = _faithful(piece, a, a_bounds, side_a.table) & _faithful(piece, b, b_bounds, side_b.table)
        self.a, self.a_bounds = _only(a, a_bounds, ok)
        self.b, self.b_bounds = _only(b, b_bounds, ok)
        end_a = np.cumsum(side_a.table.lengths[self.a])
        end_b = np.cumsum(side_b.table.lengths[self.b])
        self.link_a, self.link_b, self.cut_a, self.cut_b = lockstep(end_a, end_b, self.a_bounds, self.b_bounds)
        self.end_a, self.end_b = end_a, end_b
        self.link_doc = np.searchsorted(self.a_bounds, self.link_a, "right") - 1
        self.cut_bounds = np.searchsorted(self.cut_a, self.a_bounds)  # cuts before the first token of each document
        self.n_links = np.bincount(self.link_doc, minlength=self.n_docs)

    def group_texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` of each document: the ids of A and B in each group."""
        out = []
        while len(out) < self.n_docs:
            first = len(out)
            last = int(np.searchsorted(self.a_bounds, self.a_bounds[first] + SHOWN_TOKENS, "right")) - 1
            out += self._group_texts(first, min(max(last, first + 1), self.n_docs))
        return out

    def _group_texts(self, first: int, last: int) -> list[bytes]:
        a_bounds, b_bounds, cuts = (x[first:last + 1] for x in (self.a_bounds, self.b_bounds, self.cut_bounds))
        a, b = self.a[a_bounds[0]:a_bounds[-1]], self.b[b_bounds[0]:b_bounds[-1]]
        cut_a, cut_b = self.cut_a[cuts[0]:cuts[-1]] - a_bounds[0], self.cut_b[cuts[0]:cuts[-1]] - b_bounds[0]
        ids = np.concatenate((a, b)).astype(np.int64)
        if not len(ids):
            return [b""] * (last - first)
        # a token's place: its own side's tokens before it and the other side's of the groups before (A) or up to it (B)
        group_a = np.searchsorted(cut_a, np.arange(len(a)))
        group_b = np.searchsorted(cut_b, np.arange(len(b)))
        before_b = np.concatenate(([0], cut_b + 1))
        place = np.concatenate((np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + cut_a[group_b] + 1))
        after = np.full(len(ids), ord(","), np.uint8)
        after[cut_a] = ord("|")
        after[len(a) + cut_b] = ord(";")
        width = len(str(int(ids.max())))
        digits = ids[:, None] // 10 ** np.arange(width - 1, -1, -1)
        shown = digits > 0
        shown[:, -1] = True
        grid = np.empty((len(ids), width + 1), np.uint8)
        keep = np.ones((len(ids), width + 1), bool)
        grid[place, :width], grid[place, width] = digits % 10 + 48, after
        keep[place, :width] = shown
        ends = np.cumsum(keep.sum(1))
        text = grid[keep].tobytes()
        stops = np.concatenate(([0], ends))[a_bounds + b_bounds - a_bounds[0] - b_bounds[0]].tolist()
        return [text[x:max(x, y - 1)] for x, y in zip(stops, stops[1:], strict=False)]  # without the last ;

    def pairs(self):
        """(distinct id pairs; of each document and pair: document, pair, number of links)."""
        pair = self.a[self.link_a].astype(np.int64) << 32 | self.b[self.link_b].astype(np.int64)
        distinct = np.unique(pair)
        key = np.sort(self.link_doc * max(1, len(distinct)) + np.searchsorted(distinct, pair))
        first = np.flatnonzero(np.diff(key, prepend=-1) != 0)
        doc, index = np.divmod(key[first], max(1, len(distinct)))
        return distinct, doc, index, np.diff(np.append(first, len(key)))


def _only(ids: np.ndarray, bounds: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.where(ok, np.diff(bounds), 0)
    return ids[_ranges(bounds[:-1], counts)], np.concatenate(([0], np.cumsum(counts)))


def _source(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The alignment itself: ``id, a_ids, b_ids, a_ends, b_ends`` (byte offsets in blank + text),
    ``links`` (token numbers of A and B), ``cuts`` (byte offsets where both end)."""
    source = _source(docs, id_col, text)
    ints, longs = ArrayType(IntegerType()), ArrayType(LongType())
    link = StructType([StructField("a", IntegerType()), StructField("b", IntegerType())])
    schema = StructType([source.schema["id"], StructField("a_ids", ints), StructField("b_ids", ints),
                         StructField("a_ends", longs), StructField("b_ends", longs),
                         StructField("links", ArrayType(link)), StructField("cuts", longs)])

    def run(batches):
        for batch in batches:
            for p in pieces(batch.column(1), CHUNK_BYTES):
                x = Aligned(p, byte_level_side(a_path), piece_side(b_path))
                zero = np.concatenate(([0], x.end_a))[x.a_bounds[:-1]]  # byte at which a document begins

                def lists(values, bounds):
                    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))

                def own(ends, bounds):
                    return ends - np.repeat(zero, np.diff(bounds))

                order = np.lexsort((x.link_b, x.link_a))
                doc = x.link_doc[order]
                links = pa.StructArray.from_arrays(
                    [pa.array((x.link_a[order] - x.a_bounds[doc]).astype(np.int32)),
                     pa.array((x.link_b[order] - x.b_bounds[doc]).astype(np.int32))], ["a", "b"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(p.first, p.n_docs), lists(x.a.astype(np.int32), x.a_bounds),
                     lists(x.b.astype(np.int32), x.b_bounds), lists(own(x.end_a, x.a_bounds), x.a_bounds),
                     lists(own(x.end_b, x.b_bounds), x.b_bounds),
                     lists(links, np.concatenate(([0], np.cumsum(x.n_links)))),
                     lists(own(x.end_a[x.cut_a], x.cut_bounds), x.cut_bounds)], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def chunk_table(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document with its figures and its distinct pairs, as places in the list of pairs of
    its chunk; a chunk's first row has that list and, of each pair, the number of its documents."""
    source = _source(docs, id_col, text)
    longs = ["n_a", "n_b", "n_groups", "n_links"]
    blobs = ["places", "times", "pairs", "pair_docs"]
    schema = StructType([StructField("chunk", LongType()), source.schema["id"],
                         *[StructField(c, LongType()) for c in longs], StructField("groups_sha256", StringType()),
                         StructField("n_pairs", LongType()), *[StructField(c, BinaryType()) for c in blobs]])

    def rows(ids, p: Piece, chunk: int) -> pa.RecordBatch:  # a function of its own, so that nothing of a piece outlives it
        x = Aligned(p, byte_level_side(a_path), piece_side(b_path))
        distinct, doc, index, times = x.pairs()
        sums = [hashlib.sha256(t).hexdigest() if t else "" for t in x.group_texts()]
        bounds = np.searchsorted(doc, np.arange(x.n_docs + 1)).tolist()
        index = index.astype("<u2" if len(distinct) <= 1 << 16 else "<u4")
        times = times.astype("<u2" if not len(times) or times.max() < 1 << 16 else "<u4")
        rest = [None] * (x.n_docs - 1)
        docs_of = np.bincount(index, minlength=len(distinct)).astype("<i4")
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(x.n_docs, chunk)), ids,
             pa.array(np.diff(x.a_bounds)), pa.array(np.diff(x.b_bounds)), pa.array(np.diff(x.cut_bounds)),
             pa.array(x.n_links), pa.array(sums, pa.string()), pa.array(np.diff(bounds)),
             *[pa.array([y[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
               for y in (index, times)],
             pa.array([distinct.astype("<i8").tobytes(), *rest], pa.binary()),
             pa.array([docs_of.tobytes(), *rest], pa.binary())], names=schema.fieldNames())

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for p in pieces(batch.column(1), CHUNK_BYTES):
                yield rows(batch.column(0).slice(p.first, p.n_docs), p, chunk)
                chunk += 1

    return source.mapInArrow(run, schema)


def _chunk_pairs(chunks: DataFrame) -> DataFrame:
    """(chunk, place, pair, n): the distinct pairs of every chunk."""
    schema = StructType([StructField("chunk", LongType()), StructField("place", IntegerType()),
                         StructField("pair", LongType()), StructField("n", LongType())])

    def run(batches):
        for batch in batches:
            for chunk, pairs, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair = np.frombuffer(pairs, "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pair), chunk)), pa.array(np.arange(len(pair), dtype=np.int32)),
                     pa.array(pair), pa.array(np.frombuffer(n, "<i4").astype(np.int64))], names=schema.fieldNames())

    return chunks.select("chunk", "pairs", "pair_docs").where("pairs is not null").mapInArrow(run, schema)


def _pair_totals(listed: DataFrame) -> DataFrame:
    return listed.groupBy("pair").agg(F.sum("n").alias("count"))


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(a_id, b_id, count) of every id pair that is linked: the number of documents that hold it."""
    return _pair_totals(_chunk_pairs(chunks)).select(
        F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"),
        "count")


def alignment_report(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each document."""
    chunks = staged(chunk_table(docs, a_path, b_path, id_col, text))
    totals = staged(_pair_totals(_chunk_pairs(chunks)))
    # one row for each id of A's vocabulary: a bound that does not grow with the corpus
    best = totals.groupBy(F.shiftright("pair", 32).alias("a_id")).agg(F.max("count").alias("most"))
    known = totals.join(F.broadcast(best), F.shiftright("pair", 32) == F.col("a_id")).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))
    counted = _chunk_pairs(chunks).drop("n").join(known, "pair").select("chunk", "place", "count", "best")
    rows = chunks.drop("pairs", "pair_docs")
    shown = ["id", "n_a", "n_b", "n_groups", "n_links"]
    schema = StructType([*[rows.schema[c] for c in shown], StructField("n_best", LongType()),
                         StructField("count_sum", LongType()), rows.schema["groups_sha256"]])

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.num_rows
        count, best_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = right.column("place").to_numpy()
        count[place] = right.column("count").to_numpy()
        best_of[place] = right.column("best").to_numpy(zero_copy_only=False)
        n_best, total = [], []
        for k, places, times in zip(*(left.column(c).to_pylist() for c in ("n_pairs", "places", "times")), strict=True):
            at = np.frombuffer(places, f"<u{len(places) // max(1, k) or 2}").astype(np.int64)
            often = np.frombuffer(times, f"<u{len(times) // max(1, k) or 2}").astype(np.int64)
            n_best.append(int((often * best_of[at]).sum()))
            total.append(int((often * count[at]).sum()))
        return pa.Table.from_arrays([*[left.column(c) for c in shown], pa.array(n_best, pa.int64()),
                                     pa.array(total, pa.int64()), left.column("groups_sha256")], names=schema.fieldNames())

    out = rows.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(look_up, schema)
    return out.withColumnRenamed("id", id_col)
