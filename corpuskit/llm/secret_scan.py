"""Secret scan: candidate strings, their features, and a random forest that removes false positives.

Candidates are runs of ``[A-Za-z0-9+/_-]`` of at least ``MIN_LENGTH`` characters that hold a digit, follow a
credential word, or are ``LONG_LENGTH`` long. Features are the candidate's length, its character
transitions (changes between lower case, upper case, digit and symbol, and how likely its letter pairs
are in the corpus), how much of it dictionary words cover, its path, and the words around it. The
dictionary (``DICTIONARY_WORDS`` most frequent words) and the letter pairs are counted over all documents.

The forest is trained on labelled findings: rows (doc_id, begin, label), a table of reviewed findings. At
most ``TRAIN_ROWS`` of them are used, chosen by a hash of the finding and balanced by label; that bound is
the parameter of ``train``. ``format_labels`` labels findings whose format alone decides, for corpora
without reviews.

Defined results: null and empty texts hold no candidate; repeated rows are scanned one by one; a null path
is an empty one; extra columns play no part; an empty table gives an empty result. Without findings of both
labels there is nothing to learn from: ``train`` raises, and ``scan_secrets`` scores a finding by its label, 0.5
(still reported) where it has none.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from corpuskit.llm.staging import staged
from corpuskit.llm.textvec import Words, pieces
from corpuskit.session import ship_package

MIN_LENGTH = 16
LONG_LENGTH = 24
DICTIONARY_WORDS = 4_000
COUNT_LIMIT = 200_000
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 24, 8, 17

# Words that name credentials, and words that name trial material.
CREDENTIAL_WORDS = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "access_key", "auth",
                    "authorization", "bearer", "credential", "credentials")
TRIAL_PATHS = ("test", "example", "sample", "fixture", "doc", "demo", "mock")

FEATURES = ("length", "n_digits", "n_upper", "n_lower", "class_changes", "distinct", "entropy", "pair_score",
            "dictionary", "credential_before", "assigned", "quoted", "trial_path", "path_depth", "word_before",
            "word_after")

IS_GAP = np.ones(256, bool)
IS_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), ord("+"), ord("/"), ord("_"), ord("-")]] = False
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
KIND = np.zeros(256, np.int8)
KIND[0x30:0x3A], KIND[0x41:0x5B], KIND[0x61:0x7B] = 1, 2, 3


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): runs of 3 to 12 ASCII letters, lower-cased, over all documents. Each task adds up what it
    reads and passes sums on, so that the shuffle holds one row a word and task, not one a place."""
    ship_package(docs.sparkSession)
    schema = StructType([StructField("word", StringType()), StructField("n", LongType())])

    def out(sums: Counter):
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in sums], pa.string()),
                                           pa.array(list(sums.values()), pa.int64())], names=schema.fieldNames())

    def run(batches):
        sums: Counter = Counter()
        for batch in batches:
            for p in pieces(batch.column(0)):
                words = Words(p, lower=True, is_gap=NOT_LETTER)
                size = words.ends - words.starts
                fit = (size >= 3) & (size <= 12)
                _, at, n = np.unique(words.hashes[fit], return_index=True, return_counts=True)
                raw = words.data.tobytes()
                starts, ends = words.starts[fit][at].tolist(), words.ends[fit][at].tolist()
                sums.update(dict(zip((raw[a:b] for a, b in zip(starts, ends, strict=True)), n.tolist(), strict=True)))
                if len(sums) > COUNT_LIMIT:
                    yield out(sums)
                    sums.clear()
        yield out(sums)

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """The dictionary and the letter-pair scores of a corpus: bounded tables that go with the code."""

    def __init__(self, words: list[str], pairs: dict[str, int]):
        self.words = frozenset(words)
        total = sum(pairs.values()) + 26 * 26
        self.pairs = {p: math.log((n + 1) / total) for p, n in pairs.items()}
        self.unseen = math.log(1 / total)

    def pair_score(self, s: str) -> float:
        """Mean log-probability of the neighbouring letters; -20 without any."""
        scores = [self.pairs.get(s[i:i + 2], self.unseen) for i in range(len(s) - 1) if s[i:i + 2].isalpha()]
        return sum(scores) / len(scores) if scores else -20.0

    def coverage(self, s: str) -> float:
        """Share of the characters that dictionary words cover, the longest word first at each place."""
        covered = i = 0
        while i < len(s):
            size = next((k for k in range(min(12, len(s) - i), 2, -1) if s[i:i + k] in self.words), 0)
            covered += size
            i += size or 1
        return covered / len(s)


def lexicon(docs: DataFrame, text: str = "text", dictionary_words: int = DICTIONARY_WORDS) -> Lexicon:
    counts = staged(word_counts(docs, text))
    top = counts.orderBy(F.desc("n"), "word").limit(dictionary_words).collect()  # bounded by the parameter
    pairs = (counts.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1),
                                                      lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("pair"))
             .groupBy("pair").agg(F.sum("n").alias("n")).collect())  # at most 26 * 26 rows
    return Lexicon([r["word"] for r in top], {r["pair"]: r["n"] for r in pairs})


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def candidates(docs: DataFrame, known: Lexicon, id_col: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, begin, size, finding, word columns, features): each candidate with its byte place."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                         F.coalesce(F.col(f"`{path}`"), F.lit("")).alias("path"))
    schema = StructType([source.schema["doc_id"], StructField("begin", LongType()), StructField("size", IntegerType()),
                         StructField("finding", StringType()), *(StructField(f, DoubleType()) for f in FEATURES)])

    def run(batches):
        for batch in batches:
            for p in pieces(batch.column(1)):
                words = Words(p, is_gap=IS_GAP)
                size = words.ends - words.starts
                raw = p.data.tobytes()
                rows = []
                for w in np.flatnonzero(size >= MIN_LENGTH).tolist():
                    a, b = int(words.starts[w]), int(words.ends[w])
                    doc = int(np.searchsorted(words.of, w, "right")) - 1
                    s = raw[a:b].decode()
                    ahead = w > words.of[doc]
                    behind = w + 1 < words.of[doc + 1]
                    before = raw[words.starts[w - 1]:words.ends[w - 1]].decode().lower() if ahead else ""
                    after = raw[words.starts[w + 1]:words.ends[w + 1]].decode().lower() if behind else ""
                    between = raw[words.ends[w - 1] if ahead else p.bounds[doc]:a]
                    credential = before in CREDENTIAL_WORDS and len(between) <= 5
                    if not (credential or b - a >= LONG_LENGTH or any(c.isdigit() for c in s)):
                        continue
                    kinds = KIND[p.data[a:b]]
                    where = batch.column(2)[p.first + doc].as_py().lower()
                    low = s.lower()
                    rows.append((p.first + doc, a - int(p.bounds[doc]), b - a, s, (
                        b - a, int((kinds == 1).sum()), int((kinds == 2).sum()), int((kinds == 3).sum()),
                        int((kinds[1:] != kinds[:-1]).sum()) / (b - a), len(set(s)) / (b - a), _entropy(s),
                        known.pair_score(low), known.coverage(low), credential, between[-1:] in b"=:" and between != b"",
                        between[-1:] in (b'"', b"'"), any(t in where for t in TRIAL_PATHS), where.count("/"),
                        known.coverage(before) if before else 0.0, known.coverage(after) if after else 0.0)))
                if rows:
                    doc, begin, length, finding, values = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(doc)), pa.array(begin, pa.int64()), pa.array(length, pa.int32()),
                         pa.array(finding), *(pa.array(np.array(v, float)) for v in zip(*values, strict=True))],
                        names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def format_labels(found: DataFrame) -> DataFrame:
    """``found`` with ``label``: 1 or 0 where the format alone tells, else null.

    Findings: keys of a published prefix and length; strings of letters and digits assigned to a credential
    word. Not findings: all digits; words of letters only; joined words that the dictionary covers.
    """
    known_key = F.col("finding").rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abpr]-[A-Za-z0-9-]{20,}$")
    assigned = (F.col("credential_before") == 1) & (F.col("n_digits") > 2) & (F.col("n_lower") + F.col("n_upper") > 2)
    plain = F.col("finding").rlike(r"^[0-9]+$|^[A-Za-z]+$") | (F.col("dictionary") > 0.6)
    return found.withColumn("label", F.when(known_key | assigned, 1).when(plain, 0))


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS):
    """A random forest fitted on at most ``train_rows`` labelled findings, half of them of each label at most."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    order = F.xxhash64("finding", "doc_id", "begin")
    known = labelled.where("label is not null").withColumn("_order", order)
    rows = None
    for label in (0, 1):
        side = known.where(F.col("label") == label).orderBy("_order", "finding", "doc_id", "begin").limit(train_rows // 2)
        rows = side if rows is None else rows.unionByName(side)
    # in one order, so that the forest does not depend on how the findings were dealt out
    rows = staged(rows.select(*FEATURES, F.col("label").cast("double").alias("label"), "_order").orderBy("_order").coalesce(1))
    if rows.select("label").distinct().count() < 2:
        raise ValueError("labelled findings of both labels are needed")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows))


def judge(found: DataFrame, forest) -> DataFrame:
    """``found`` with ``score`` (probability of a secret) and ``is_secret``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scored = forest.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(found))
    return scored.withColumn("score", F.round(vector_to_array("probability")[1], 9)).withColumn(
        "is_secret", F.col("score") >= 0.5).drop("vector", "rawPrediction", "probability", "prediction")


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text: str = "text",
                 path: str = "source", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, begin, size, finding, score, is_secret) of each candidate; ``begin`` is its byte place.

    ``labelled(doc_id, begin, label)`` are reviewed findings of these documents; without them findings are
    labelled by format. A corpus without candidates gives an empty result.
    """
    found = staged(candidates(docs, lexicon(docs, text), id_col, text, path))
    columns = ["doc_id", "begin", "size", "finding", "score", "is_secret"]
    if not found.limit(1).count():
        return found.withColumn("score", F.lit(0.0)).withColumn("is_secret", F.lit(False)).select(columns)
    known = format_labels(found) if labelled is None else found.join(
        labelled.select("doc_id", "begin", "label"), ["doc_id", "begin"])
    if known.where("label is not null").select("label").distinct().count() < 2:
        told = known.groupBy("doc_id", "begin").agg(F.max("label").alias("label"))
        scored = found.join(told, ["doc_id", "begin"], "left").withColumn("score", F.coalesce(F.col("label"), F.lit(0.5)).cast("double"))
        return scored.withColumn("is_secret", F.col("score") >= 0.5).select(columns)
    return judge(found, train(known, train_rows)).select(columns)


