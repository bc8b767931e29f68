"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes says, for (document, tokenizer), what it counts from now on (``insert``, ``revise``) or
that it is gone (``delete``). ``commit`` turns the batch into signed rows against what the ledger holds for
the same documents: minus the old count, plus the new one. The signed rows join the ledger, and their
sums by (source, lang, tokenizer) are the batch's delta of the rollup. Totals are sums of deltas; the old
counts are found by a semi join of the ledger with the batch's keys.

Commits are idempotent and follow one another. Rows are written below a folder of the attempt; a version of
the commit log, published whole and only if nobody published it before, takes the attempt in. Attempts that
no version names (a lost job, or a second job of the same batch) are not read. A batch id that is committed
already does nothing. A batch whose rows were reckoned against a ledger that another batch has changed
meanwhile is reckoned again, so two batches at once give the same totals as one after the other.

Defined results: a null source, language or tokenizer is a group of its own; null counts are 0; rows with a
null document id are left out; of several changes of a key in a batch the one of greatest ``seq`` holds (of
equal ones a delete, then the greater count); deleting what is not there and inserting what is there with
the same count change nothing; extra columns play no part; an empty batch commits and adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.commitlog import CommitLog, FileSystem

GROUP = ("source", "lang", "tokenizer")
LEDGER = "doc_id bigint, source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
ROLLUP = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def word_tokens(text) -> F.Column:
    """Words between white space: the counting rule of tokenizer ``words-1``."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")


def run_tokens(text) -> F.Column:
    """Runs of letters and digits, and each other visible character: tokenizer ``words-2``."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")).cast("bigint")


class TokenCounts:
    """A ledger of token counts below ``path`` (any store that Spark writes to)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(FileSystem(spark), f"{self.path}/log")

    def _state(self) -> dict:
        """The newest version: live attempts (``attempts``), ids of all batches committed so far."""
        return self.log.latest() or {"version": -1, "attempts": [], "batches": []}

    def _read(self, kind: str, schema: str, state: dict | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{a}/{kind}" for a in (state or self._state())["attempts"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _publish(self, base: dict, attempts: list[str], batches: list[str]) -> bool:
        """Make this the version after ``base``; False if there is another by now."""
        mine = {"attempts": attempts, "batches": batches}

        def step(latest):
            return mine if (latest or {"version": -1})["version"] == base["version"] else None

        return self.log.commit(step)["attempts"] == attempts

    def _write(self, attempt: str, signed: DataFrame) -> None:
        base = f"{self.path}/data/{attempt}"
        signed.write.parquet(f"{base}/ledger")
        (self.spark.read.schema(LEDGER).parquet(f"{base}/ledger").groupBy(*GROUP)
         .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{base}/rollup"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply ``changes(op, doc_id, source, lang, tokenizer, n_tokens, seq)`` once under ``batch_id``.
        False if the batch had been committed before."""
        order = F.struct("seq", (F.col("op") == "delete").alias("gone"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n"),
                         "source", "lang")
        last = (changes.where("doc_id is not null").groupBy("doc_id", "tokenizer").agg(F.max(order).alias("x"))
                .select("doc_id", "x.source", "x.lang", "tokenizer", "x.gone", "x.n"))
        added = last.where("not gone").select("doc_id", "source", "lang", "tokenizer", F.lit(1).cast("bigint").alias("n_docs"),
                                              F.col("n").alias("n_tokens"))
        while True:
            base = self._state()
            if batch_id in base["batches"]:
                return False
            signed = added
            if base["attempts"]:
                keys = last.select("doc_id", F.col("tokenizer").alias("t")).distinct()
                held = self._read("ledger", LEDGER, base)
                held = held.join(keys, (held.doc_id == keys.doc_id) & held.tokenizer.eqNullSafe(keys.t), "left_semi")
                signed = self._net(added.unionByName(
                    held.withColumn("n_docs", -F.col("n_docs")).withColumn("n_tokens", -F.col("n_tokens"))))
            attempt = f"batch-{uuid.uuid4().hex}"
            self._write(attempt, signed.select("doc_id", *GROUP, "n_docs", "n_tokens"))
            if self._publish(base, [*base["attempts"], attempt], [*base["batches"], batch_id]):
                return True

    @staticmethod
    def _net(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc_id", *GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where(
            "n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Put the committed batches together in one, which still knows their ids. False if there is nothing
        to put together, or another batch came in between."""
        base = self._state()
        if len(base["attempts"]) < 2:
            return False
        attempt = f"base-{uuid.uuid4().hex}"
        self._write(attempt, self._net(self._read("ledger", LEDGER, base)).select("doc_id", *GROUP, "n_docs", "n_tokens"))
        return self._publish(base, [attempt], base["batches"])

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of the groups that hold documents."""
        return self._read("rollup", ROLLUP).groupBy(*GROUP).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0")


def changes(docs: DataFrame, op: str, tokenizer: str, n_tokens, seq: int = 0) -> DataFrame:
    """One change of kind ``op`` for each document."""
    return docs.select(F.lit(op).alias("op"), F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang",
                       F.lit(tokenizer).alias("tokenizer"), n_tokens.alias("n_tokens"), F.lit(seq).alias("seq"))
