"""Token-id output: ids of a fixed number of bits in blocks that open at any place.

``write_token_blocks`` encodes texts with a tokenizer of the ``tokenizers`` library and writes blocks in
ascending order of the document ids. A block holds whole documents: their ids, packed in the fewest bits
that the vocabulary needs, the offset of each document, and where the block starts among the ids of its
file. As every id has the same width, id i of a block lies at bit ``i * width``: any slice of a block
unpacks with a few numpy operations. The files are written by Spark's Parquet writer, so they can lie in
any store that Spark reaches, and only files of a committed job are seen.

Encoding splits the text where the tokenizer itself would (byte-level pre-tokenizers only) and asks the
library for each distinct slice once; a tokenizer of another kind gets the whole texts, and so does any
tokenizer a text that holds one of its added tokens (``<|endoftext|>``), which is that token's id.

Defined results: a null or empty text has the end id only; rows with equal ids follow one another in the
order of their texts; a null id comes first; an empty table writes no block and reads back empty.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, IntegerType, LongType, StructField, StructType)

from corpuskit.llm.bpe import SliceCache, encode_piece
from corpuskit.llm.textvec import pieces
from corpuskit.session import ship_package

BLOCK_IDS = 1 << 18


def bits_needed(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids of ``width`` bits each, one after another, lowest bits first."""
    n = len(ids)
    groups = -(-n // 64)
    grid = np.zeros(groups * 64, np.uint64)
    grid[:n] = ids
    grid = grid.reshape(groups, 64)
    words = np.zeros((groups, width), np.uint64)  # 64 ids fill exactly ``width`` words
    for j in range(64):
        word, shift = divmod(j * width, 64)
        words[:, word] |= grid[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= grid[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()[:-(-n * width // 8)]


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start:stop`` of a packed block; only the bytes that hold them are touched."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    group, last = start // 64, -(-stop // 64)
    raw = payload[group * width * 8:last * width * 8]
    raw += b"\0" * ((last - group) * width * 8 - len(raw))
    words = np.frombuffer(raw, "<u8").reshape(-1, width)
    out = np.empty((len(words), 64), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, j] = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            out[:, j] |= words[:, word + 1] << np.uint64(64 - shift)
    out &= np.uint64((1 << width) - 1)
    return out.ravel()[start - group * 64:stop - group * 64].astype(np.uint32)


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: visible characters of Latin-1 stand
    for themselves, the other bytes for the code points from 256 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + n for n, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


class LibraryTokenizer:
    """A tokenizer file of the ``tokenizers`` library, as loaded: added tokens in texts are those tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.by_slice = (before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
                         and before.get("use_regex", True) and not spec.get("normalizer"))
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or ()]
        self.cache = SliceCache(self._encode)

    def _encode(self, new: list[bytes]) -> list[list[int]]:
        # a slice is one pre-token: the library's model takes it as it would after its own splitting
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(s.decode("latin-1").translate(BYTE_LETTERS))] for s in new]

    def _encode_whole(self, piece, docs) -> list[list[int]]:
        texts = [piece.text(i).decode("utf-8", "replace") for i in docs]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _with_added(self, piece) -> list[int]:
        """Documents of the piece that hold the text of an added token."""
        raw, found = piece.data.tobytes(), set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                doc = int(np.searchsorted(piece.bounds, at, "right")) - 1
                found.add(doc)
                # on in the next document; a match that runs over the bound of two does no harm
                at = raw.find(token, int(piece.bounds[doc + 1]))
        return sorted(found)

    def ids(self, piece) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts of a piece, bounds by document)."""
        if self.by_slice:
            _, ids, bounds, *_ = encode_piece(piece, self.cache)
            whole = self._with_added(piece)
            if not whole:
                return ids, bounds
            parts = np.split(ids, bounds[1:-1])
            for i, own in zip(whole, self._encode_whole(piece, whole), strict=True):
                parts[i] = np.array(own, ids.dtype)
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        lists = self._encode_whole(piece, range(piece.n_docs))
        bounds = np.cumsum([0, *map(len, lists)])
        return np.array([x for ids in lists for x in ids], np.uint32), bounds


@lru_cache(maxsize=4)
def library_tokenizer(path: str) -> LibraryTokenizer:
    return LibraryTokenizer(path)


def _with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))


def write_token_blocks(docs: DataFrame, path: str, tokenizer_path: str, vocab_size: int, end_id: int | None = None,
                       id_col: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write the token ids of ``docs`` below ``path``; ``end_id`` is appended to each document."""
    ship_package(docs.sparkSession)
    width = bits_needed(vocab_size)
    # ties of the id are put in order by their text
    source = (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
              .repartitionByRange("id").sortWithinPartitions("id", "text"))
    schema = StructType([
        StructField("part", IntegerType()), StructField("block", LongType()), StructField("part_start", LongType()),
        StructField("n_ids", LongType()), StructField("width", IntegerType()),
        StructField("ids", ArrayType(source.schema["id"].dataType)), StructField("offsets", ArrayType(LongType())),
        StructField("payload", BinaryType())])

    def run(batches):
        tokenizer = library_tokenizer(tokenizer_path)
        part = TaskContext.get().partitionId()
        block = start = 0
        held_ids, held, counts, size = [], [], [], 0

        def flush():
            offsets = np.cumsum([0, *np.concatenate(counts)])
            packed = pack(np.concatenate(held), width)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block]), pa.array([start]), pa.array([size]),
                 pa.array([width], pa.int32()),
                 pa.ListArray.from_arrays(pa.array([0, len(offsets) - 1], pa.int32()), pa.concat_arrays(held_ids)),
                 pa.array([offsets], pa.list_(pa.int64())), pa.array([packed], pa.binary())],
                names=schema.fieldNames())

        for batch in batches:
            for p in pieces(batch.column(1)):
                ids, bounds = tokenizer.ids(p)
                if end_id is not None:
                    ids, bounds = _with_end(ids, bounds, end_id)
                held.append(ids)
                held_ids.append(batch.column(0).slice(p.first, p.n_docs))
                counts.append(np.diff(bounds))
                size += len(ids)
                if size >= block_ids:
                    yield flush()
                    block, start = block + 1, start + size
                    held_ids, held, counts, size = [], [], [], 0
        if held:
            yield flush()

    source.mapInArrow(run, schema).write.mode("error").parquet(path)


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of ``path`` with ``start``: the number of ids in all blocks before."""
    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per file part: its number is that of the write's tasks, whatever the number of rows
    earlier = parts.selectExpr("part", "sum(n) over (order by part rows between unbounded preceding and current row)"
                                       " - n as before")
    return blocks.join(F.broadcast(earlier), "part").withColumn("start", F.col("before") + F.col("part_start")).drop(
        "before", "part_start")


def _read(spark: SparkSession, path: str, field: StructField, arrow_type, derive) -> DataFrame:
    ship_package(spark)
    index = block_index(spark, path).select("start", "width", "ids", "offsets", "payload")
    schema = StructType([StructField("id", index.schema["ids"].dataType.elementType), StructField("start", LongType()),
                         StructField("n_tokens", LongType()), field])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                start, width, ids, offsets, payload = (batch.column(k)[i] for k in range(5))
                offsets = np.asarray(offsets.values)
                tokens = unpack(payload.as_py(), width.as_py(), 0, int(offsets[-1]))
                values = [derive(tokens[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(offsets[:-1] + start.as_py()), pa.array(np.diff(offsets)),
                     pa.array(values, arrow_type)], names=schema.fieldNames())

    return index.mapInArrow(run, schema)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, tokens) of each document."""
    return _read(spark, path, StructField("tokens", ArrayType(IntegerType())), pa.list_(pa.int32()),
                 lambda t: t.astype(np.int32))


def read_token_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32): crc32 of the ids as little-endian unsigned 32-bit integers."""
    return _read(spark, path, StructField("ids_crc32", LongType()), pa.int64(),
                 lambda t: zlib.crc32(t.astype("<u4").tobytes()))


def fetch_documents(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """(id, tokens) of the named documents: only blocks that hold one are read, and of those only the
    bits of its ids are unpacked."""
    ship_package(spark)
    wanted = F.array(*[F.lit(i) for i in ids])
    blocks = spark.read.parquet(path).where(F.arrays_overlap("ids", wanted)).select("width", "ids", "offsets", "payload")
    schema = StructType([StructField("id", blocks.schema["ids"].dataType.elementType),
                         StructField("tokens", ArrayType(IntegerType()))])
    names = set(ids)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                hits = [(k, row["offsets"][j], row["offsets"][j + 1]) for j, k in enumerate(row["ids"]) if k in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h[0] for h in hits], batch.schema.field("ids").type.value_type),
                     pa.array([unpack(row["payload"], row["width"], a, b).astype(np.int32) for _, a, b in hits],
                              pa.list_(pa.int32()))], names=schema.fieldNames())

    return blocks.mapInArrow(run, schema)
