"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding with offsets.

Pre-tokenisation needs no regex at run time. Code points are mapped to a few classes (letter, number,
other, apostrophe that opens a contraction, white space by what follows it). Each class is a
transition function over eight states; functions compose associatively, so the state before every code
point comes from a blocked prefix scan over indices into the finite set of compositions. A token starts
where (state, class) says so. Slices between starts are looked up in a cache of merged slices; only
slices not seen before are merged, pair by pair, lowest rank first, all of them together.

Defined results: a null text is empty and has no tokens; bytes that are not UTF-8 are replaced by
U+FFFD, as decoding to a string would; repeated rows are encoded one by one; extra columns stay. The
work is row-local: no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from corpuskit.llm.textvec import Piece, pieces, span_hashes
from corpuskit.session import ship_package

CACHE_SLICES = 1_000_000  # a cache only: emptied when full, results do not depend on it
LONG_SLICE = 512  # bytes from which on a slice is merged by a heap, not in rounds with the others
BLOCK = 64

# Classes of code points; + FIRST for the first code point of a text.
L, N, O, A1, A2, SPACE, LONE, RUN, FIRST = 0, 1, 2, 3, 4, 5, 6, 7, 8
# States: what the code points so far leave open.
FRESH, IN_L, IN_N, IN_O, PREFIX, IN_RUN, ONE_MORE, TWO_MORE = range(8)


def _next_state(state: int, cls: int) -> int:
    if cls == L:
        return {TWO_MORE: ONE_MORE, ONE_MORE: FRESH}.get(state, IN_L)
    if cls in (A1, A2) and state not in (IN_O, PREFIX):
        return ONE_MORE if cls == A1 else TWO_MORE
    return {N: IN_N, O: IN_O, A1: IN_O, A2: IN_O, SPACE: PREFIX, LONE: FRESH, RUN: IN_RUN}[cls]


def _goes_on(state: int, cls: int) -> bool:
    """The code point belongs to the token that is open in this state."""
    return state in {L: (IN_L, PREFIX, ONE_MORE, TWO_MORE), N: (IN_N, PREFIX), O: (IN_O, PREFIX),
                     A1: (IN_O, PREFIX), A2: (IN_O, PREFIX), RUN: (IN_RUN,)}.get(cls, ())


@lru_cache(maxsize=1)
def _scan_tables():
    """(function index of each class, composition table, state table, start-of-token table)."""
    basic = [tuple(_next_state(s, c) for s in range(8)) for c in range(8)]
    basic += [(f[FRESH],) * 8 for f in basic]  # a text's first code point forgets what was before
    found = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    while todo:
        f = todo.pop()
        for g in basic:
            h = tuple(g[s] for s in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    functions = list(found)
    m = len(functions)
    # closed under composition: a product of generators followed by a product of generators
    compose = np.array([[found[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint8)
    assert m <= 256
    starts = np.array([[not _goes_on(s, c) for c in range(8)] + [True] * 8 for s in range(8)])
    return np.array([found[g] for g in basic], np.uint8), compose.ravel(), np.array(functions, np.uint8), starts.ravel()


def _states_before(functions: np.ndarray) -> np.ndarray:
    """State before each place, by a blocked prefix scan of the composition of functions."""
    _, compose, apply, _ = _scan_tables()
    m, n = len(apply), len(functions)
    if n <= BLOCK:
        out, state = np.zeros(n, np.uint8), FRESH
        for i, f in enumerate(functions.tolist()):
            out[i] = state
            state = apply[f, state]
        return out
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    for j in range(1, BLOCK):
        grid[j] = compose[grid[j - 1].astype(np.int32) * m + grid[j]]
    entry = _states_before(grid[-1])
    after = apply.ravel()[grid.astype(np.int32) * 8 + entry]
    before = np.empty_like(after)
    before[0] = entry
    before[1:] = after[:-1]
    return before.T.ravel()[:n]


@lru_cache(maxsize=1)
def _base_classes() -> np.ndarray:
    """L, N, O or RUN (white space) of every code point."""
    import regex

    points = np.arange(0x110000)
    points[0xD800:0xE000] = 0
    everything = points.astype(np.uint32).tobytes().decode("utf-32-le")
    out = np.full(0x110000, O, np.uint8)
    for pattern, cls in ((r"\p{L}+", L), (r"\p{N}+", N), (r"\p{White_Space}+", RUN)):
        for hit in regex.finditer(pattern, everything):
            out[hit.start():hit.end()] = cls
    return out


def _clean(piece: Piece) -> tuple[Piece, str]:
    raw = piece.data.tobytes()
    try:
        return piece, raw.decode("utf-8")
    except UnicodeDecodeError:
        texts = [piece.text(i).decode("utf-8", "replace").encode() for i in range(piece.n_docs)]
        bounds = np.cumsum([0, *map(len, texts)])
        piece = Piece(piece.first, piece.last, np.frombuffer(b"".join(texts), np.uint8), bounds)
        return piece, piece.data.tobytes().decode("utf-8")


def token_slices(piece: Piece) -> tuple[Piece, np.ndarray, np.ndarray]:
    """(piece, byte starts of the pre-tokens, bounds of each document's pre-tokens)."""
    piece, text = _clean(piece)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return piece, np.zeros(0, np.int64), np.zeros(piece.n_docs + 1, np.int64)
    at = np.flatnonzero((piece.data & 0xC0) != 0x80)
    cls = _base_classes()[points]
    first = np.searchsorted(at, piece.bounds[:-1][np.diff(piece.bounds) > 0])
    last = np.append(first[1:], n) - 1
    # white space: the last of a run that is followed by something stands alone or joins what follows
    space = cls == RUN
    followed = np.empty(n, bool)
    followed[:-1] = ~space[1:]
    followed[last] = False
    alone = space & followed
    cls[alone] = np.where(points[alone] == 0x20, SPACE, LONE)
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        end = last[np.searchsorted(first, quotes, "right") - 1]
        one = np.where(quotes + 1 <= end, points[np.minimum(quotes + 1, n - 1)], 0)
        two = np.where(quotes + 2 <= end, points[np.minimum(quotes + 2, n - 1)], 0)
        cls[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = A1
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        cls[quotes[pair]] = A2
    cls[first] += FIRST
    index, _, _, starts_at = _scan_tables()
    begins = starts_at[_states_before(index[cls]).astype(np.int32) * 16 + cls]
    starts = at[begins]
    return piece, starts, np.searchsorted(starts, piece.bounds)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Which adjacent parts of a vocabulary merge, and to what: sorted (left, right) keys and merged ids."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.none = 1 << 32
        self.lookup = pairs  # (left << 32 | right) -> merged id

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair; ``none`` where the pair does not merge."""
        if not len(self.keys):
            return np.full(len(left), self.none)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.merged[at], self.none)


def merge_long(word: bytes, pairs: PairTable) -> list[int]:
    """Ids of a long slice: a heap of mergeable pairs over linked parts."""
    n = len(word)
    ids = pairs.of_byte[np.frombuffer(word, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    lookup = pairs.lookup
    heap: list = []

    def offer(i):
        j = after[i]
        if j < n and (rank := lookup.get(ids[i] << 32 | ids[j])) is not None:
            heapq.heappush(heap, (rank, i, ids[i], ids[j]))

    for i in range(n):
        offer(i)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j >= n or ids[j] != right:
            continue  # one of the two has been merged meanwhile
        ids[i], ids[j] = rank, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [x for x in ids if x >= 0]


def merge_slices(slices: list[bytes], pairs: PairTable, long: int = LONG_SLICE) -> list[list[int]]:
    """Ids of each slice. In each round every slice merges one pair: the one of lowest rank, the
    leftmost among equals. All slices of a round are handled together; finished ones leave."""
    out: list = [None] * len(slices)
    short = []
    for i, s in enumerate(slices):
        if len(s) > long:
            out[i] = merge_long(s, pairs)
        else:
            short.append(i)
    owner = np.array(short, np.int64)
    lengths = np.array([len(slices[i]) for i in short], np.int64)
    ids = pairs.of_byte[np.frombuffer(b"".join(slices[i] for i in short), np.uint8)]
    first = np.cumsum(lengths) - lengths

    def ranks_at(places, last):
        ranks = np.full(len(places), pairs.none)
        inner = np.flatnonzero(~last)
        ranks[inner] = pairs.rank(ids[places[inner]], ids[places[inner] + 1])
        return ranks

    is_last = np.zeros(len(ids), bool)
    is_last[first + lengths - 1] = True
    rank = ranks_at(np.arange(len(ids)), is_last)
    while len(owner):
        best = np.minimum.reduceat(rank << 24 | np.arange(len(ids)), first)
        done = best >> 24 >= pairs.none
        if done.any():
            stops = first + lengths
            for k in np.flatnonzero(done).tolist():
                out[owner[k]] = ids[first[k]:stops[k]].tolist()
            stay = np.repeat(~done, lengths)
            ids, rank, is_last = ids[stay], rank[stay], is_last[stay]
            owner, lengths = owner[~done], lengths[~done]
            first = np.cumsum(lengths) - lengths
            continue
        at = best & 0xFFFFFF
        ids[at] = best >> 24
        is_last[at] = is_last[at + 1]
        stay = np.ones(len(ids), bool)
        stay[at + 1] = False
        ids, rank, is_last = ids[stay], rank[stay], is_last[stay]
        at -= np.arange(len(at))  # one part of every slice before has gone
        lengths = lengths - 1
        first = np.cumsum(lengths) - lengths
        rank[at] = ranks_at(at, is_last[at])
        prior = at[at > first] - 1
        rank[prior] = pairs.rank(ids[prior], ids[prior + 1])
    return out


class _Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.size, self.store = 0, np.zeros(1024, dtype)

    def extend(self, values: np.ndarray) -> None:
        stop = self.size + len(values)
        if stop > len(self.store):
            self.store = np.concatenate((self.store[:self.size], np.zeros(max(stop, self.size), self.store.dtype)))
        self.store[self.size:stop] = values
        self.size = stop


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``starts[i] .. starts[i] + counts[i] - 1`` of all i, one after another."""
    stops = np.cumsum(counts)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - (stops - counts), counts)


_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _heads(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first eight bytes of each range as one number (zeros after a shorter one)."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    return words[starts] & _HEAD[np.minimum(sizes, 8)]


class SliceCache:
    """Ids of slices seen so far. ``encode`` maps a list of distinct new slices to lists of ids.

    Slices are found by their 64-bit hash in an open-addressing table of numpy arrays, all slices of a piece
    at once; the bytes of a hit are compared with those kept for it, so that equal hashes of other slices
    never share ids. Python objects are made for new slices only.
    """

    def __init__(self, encode, limit: int = CACHE_SLICES):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self):
        self.keys, self.slots = np.zeros(1 << 16, np.uint64), np.full(1 << 16, -1, np.int32)
        # by slot: hash, bytes (number, first eight, place in raw), ids (place in flat, number)
        self.hashes, self.sizes, self.heads, self.at = (_Grown(t) for t in (np.uint64, np.int64, np.uint64, np.int64))
        self.begin, self.counts = _Grown(np.int64), _Grown(np.int64)
        self.raw, self.flat = _Grown(np.uint8), _Grown(np.uint32)

    def __len__(self):
        return self.hashes.size

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot or -1, place in the table where the search ended) of each hash."""
        mask = len(self.keys) - 1
        place = (hashes & np.uint64(mask)).astype(np.int64)
        slot = self.slots[place]
        todo = np.flatnonzero((slot >= 0) & (self.keys[place] != hashes))
        while len(todo):
            place[todo] = (place[todo] + 1) & mask
            slot[todo] = self.slots[place[todo]]
            todo = todo[(slot[todo] >= 0) & (self.keys[place[todo]] != hashes[todo])]
        return slot, place

    def _enter(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        """Put distinct new hashes into the table."""
        while len(hashes):
            _, place = self._find(hashes)
            first = np.unique(place, return_index=True)[1]  # one for each free place, the rest search on
            self.keys[place[first]], self.slots[place[first]] = hashes[first], slots[first]
            rest = np.ones(len(hashes), bool)
            rest[first] = False
            hashes, slots = hashes[rest], slots[rest]

    def _add(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Encode new slices; their slots."""
        raw = data.tobytes()
        lists = self.encode([raw[a:b] for a, b in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)])
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        slots = np.arange(self.at.size, self.at.size + len(lists))
        self.at.extend(self.raw.size + np.cumsum(sizes) - sizes)
        self.sizes.extend(sizes)
        self.heads.extend(_heads(data, starts, sizes))
        self.raw.extend(data[_ranges(starts, sizes)])
        self.begin.extend(self.flat.size + np.cumsum(counts) - counts)
        self.counts.extend(counts)
        self.flat.extend(np.fromiter(chain.from_iterable(lists), np.uint32, int(counts.sum())))
        return slots

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the slices ``data[start:end]`` in order, number of ids of each slice)."""
        if len(self) > self.limit:
            self.clear()
        hashes, sizes = span_hashes(data, starts, ends), ends - starts
        slots, _ = self._find(hashes)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            made = self._add(data, starts[missing[first]], sizes[missing[first]])
            self.hashes.extend(new)
            while 2 * len(self) > len(self.keys):
                self.keys, self.slots = np.zeros(2 * len(self.keys), np.uint64), np.full(2 * len(self.keys), -1, np.int32)
                new, made = self.hashes.store[:len(self)], np.arange(len(self))
            self._enter(new, made.astype(np.int32))
            slots[missing], _ = self._find(hashes[missing])
        slots = slots.astype(np.int64)
        other = (self.sizes.store[slots] != sizes) | (self.heads.store[slots] != _heads(data, starts, sizes))
        tails = np.flatnonzero(~other & (sizes > 8))
        rest = sizes[tails] - 8
        differs = (self.raw.store[_ranges(self.at.store[slots[tails]] + 8, rest)] != data[_ranges(starts[tails] + 8, rest)])
        if differs.any():
            other[tails] = np.logical_or.reduceat(differs, np.cumsum(rest) - rest)
        counts = self.counts.store[slots]
        if other.any():  # another slice of the same hash: encoded by itself, not kept
            return self._with_own(data, starts, ends, slots, counts, np.flatnonzero(other))
        return self.flat.store[_ranges(self.begin.store[slots], counts)], counts

    def _with_own(self, data, starts, ends, slots, counts, own):
        lists = self.encode([data[starts[i]:ends[i]].tobytes() for i in own.tolist()])
        counts = counts.copy()
        counts[own] = [len(x) for x in lists]
        begin = self.begin.store[slots]
        begin[own] = self.flat.size + np.cumsum(counts[own]) - counts[own]
        flat = np.concatenate((self.flat.store[:self.flat.size], np.fromiter(chain.from_iterable(lists), np.uint32)))
        return flat[_ranges(begin, counts)], counts


def encode_piece(piece: Piece, cache: SliceCache):
    """(piece, ids, id bounds by document, byte starts and bounds of the slices, ids by slice)."""
    piece, starts, of = token_slices(piece)
    ids, counts = cache.ids(piece.data, starts, np.append(starts[1:], len(piece.data))[:len(starts)])
    bounds = np.concatenate(([0], np.cumsum(counts)))[of]
    return piece, ids, bounds, starts, of, counts


class Vocabulary:
    """Ranks of a vocabulary file with what encoding and decoding need; one per process and path."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.pairs = PairTable(self.ranks)
        self.cache = SliceCache(self._merge)

    def _merge(self, new: list[bytes]) -> list[list[int]]:
        whole = [self.ranks.get(s) for s in new]
        todo = [s for s, k in zip(new, whole, strict=True) if k is None]
        rest = chain.from_iterable(merge_slices(todo[i:i + 65_536], self.pairs) for i in range(0, len(todo), 65_536))
        return [next(rest) if k is None else [k] for k in whole]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, byte start of each id)."""
        ids = ids.astype(np.int64)
        lengths = self.lengths[ids]
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        places = np.arange(total) + np.repeat(self.begin[ids] - (stops - lengths), lengths)
        return self.bytes[places], stops - lengths


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _out(docs: DataFrame, text: str, new: list[StructField]):
    ship_package(docs.sparkSession)
    names = [f.name for f in new]
    keep = [c for c in docs.columns if c not in names and c != text]
    source = docs.select(*[F.col(f"`{c}`") for c in [*keep, text]])
    schema = StructType([f for f in source.schema if f.name in keep] + new)
    return keep, source, schema


def bpe_encode(docs: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``ids`` and ``offsets`` (byte start of each id)."""
    keep, source, schema = _out(docs, text, [
        StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType(), False)),
        StructField("offsets", ArrayType(LongType(), False))])

    def run(batches):
        vocab = vocabulary(vocab_path)
        for batch in batches:
            column = batch.column(len(keep))
            for p in pieces(column):
                q, ids, bounds, *_ = encode_piece(p, vocab.cache)
                _, at = vocab.decode(ids)
                at = at - np.repeat(q.bounds[:-1], np.diff(bounds))
                off = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [c.slice(p.first, p.n_docs) for c in batch.columns[:len(keep)]]
                    + [pa.array(np.diff(bounds)), pa.ListArray.from_arrays(off, pa.array(ids.astype(np.int32))),
                       pa.ListArray.from_arrays(off, pa.array(at))], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, vocab_path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` without its ids, with ``decoded`` (binary): the bytes that the ids stand for."""
    from pyspark.sql.types import BinaryType

    keep, source, schema = _out(encoded, ids, [StructField("decoded", BinaryType())])

    def run(batches):
        vocab = vocabulary(vocab_path)
        for batch in batches:
            out = [vocab.decode(np.asarray(row.values if row.is_valid else []))[0].tobytes()
                   for row in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(out, pa.binary())],
                                             names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def bpe_round_trip(docs: DataFrame, vocab_path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit
    integers) and ``decoded_sha256`` (bytes decoded from the ids); ids leave the task only as a column."""
    keep, source, schema = _out(docs, text, [
        StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType()),
        *([StructField("ids", ArrayType(IntegerType(), False))] if with_ids else [])])

    def run(batches):
        vocab = vocabulary(vocab_path)
        for batch in batches:
            for p in pieces(batch.column(len(keep))):
                _, ids, bounds, *_ = encode_piece(p, vocab.cache)
                data, at = vocab.decode(ids)
                cuts = np.append(at, len(data))[bounds].tolist()
                ids, where = ids.astype("<u4"), bounds.tolist()
                column = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(
                    [c.slice(p.first, p.n_docs) for c in batch.columns[:len(keep)]] + [pa.array(np.diff(bounds))]
                    + [pa.array([hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(y, y[1:], strict=False)])
                       for x, y in ((ids, where), (data, cuts))] + column * with_ids, names=schema.fieldNames())

    return source.mapInArrow(run, schema)
