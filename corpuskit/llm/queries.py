"""The registered queries of this subpackage: ``QUERIES`` by name and ``ORACLE`` (DuckDB SQL) by name.

Each query reads a whole driver table, applies its operator with production parameters and derives
the columns that the result carries from the operator's own output.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm import oracle
from corpuskit.llm.bpe import bpe_round_trip
from corpuskit.llm.cross_tokenizer import alignment_report
from corpuskit.llm.decontaminate import leaks
from corpuskit.llm.language_id import held_out, identify, language_prototypes
from corpuskit.llm.license_scan import license_matches
from corpuskit.llm.line_dedup import line_report
from corpuskit.llm.minhash_dedup import near_duplicates
from corpuskit.llm.quality_rules import apply_policy, quality_ledger
from corpuskit.llm.secret_scan import scan_secrets
from corpuskit.llm.substring_dedup import kept_digests, repeated_spans
from corpuskit.llm.token_counts import TokenCounts, changes, run_tokens, word_tokens
from corpuskit.llm.token_output import read_token_checksums, write_token_blocks
from corpuskit.llm.whitening import whiten
from corpuskit.session import scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = line_report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return report.withColumn("removed", F.array_join("removed", ","))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five batches over ``documents``: all counted by tokenizer words-1; all by words-2; documents labelled
    toxic cut to their first line (revised count); documents of quality 0 deleted; the first one again."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")

    def counted(n):  # counted where the text is read, so that joins move numbers, not texts
        return docs.select("doc_id", "source", "lang", n.alias("n"))

    labels = table(spark, sf_dir, "labels")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    bad = labels.where("quality = 0").select("doc_id").distinct()
    first_lines = counted(word_tokens(F.substring_index(text, "\n", 1))).join(toxic, "doc_id", "left_semi")
    gone = docs.select("doc_id", "source", "lang").join(bad, "doc_id", "left_semi")
    ledger = TokenCounts(spark, scratch_path(spark, f"token-counts-{uuid.uuid4().hex}"))
    load = changes(counted(word_tokens(text)), "insert", "words-1", F.col("n"))
    ledger.commit("load", load)
    ledger.commit("words-2", changes(counted(run_tokens(text)), "insert", "words-2", F.col("n")))
    ledger.commit("toxic", changes(first_lines, "revise", "words-1", F.col("n")))
    ledger.commit("quality", changes(gone, "delete", "words-1", F.lit(0)).unionByName(
        changes(gone, "delete", "words-2", F.lit(0))))
    ledger.commit("load", load)
    return ledger.totals()


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks(docs, table(spark, sf_dir, "benchmark"))


def op5_token_output(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, f"token-blocks-{uuid.uuid4().hex}")
    write_token_blocks(docs, path, tokenizer_path or vocabulary_file("byte_bpe_50k.json"), vocab_size=50_257, end_id=2)
    return read_token_checksums(spark, path).withColumnRenamed("id", "doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = apply_policy(quality_ledger(docs))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        "kept", F.col("failed").alias("failed_rules"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, k=2, percent=80, lower=True)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "begin", "size", F.sha2("finding", 256).alias("finding_sha256"), "score", "is_secret")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return kept_digests(docs, repeated_spans(docs, window=50))


def op10_byte_bpe(spark: SparkSession, sf_dir: str, vocab_path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_round_trip(docs, vocab_path or vocabulary_file("byte_bpe_multi_50k.tiktoken"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten(vectors, components=8).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str, a_path: str | None = None,
                         b_path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment_report(docs, a_path or vocabulary_file("byte_bpe_50k.json"),
                            b_path or vocabulary_file("piece_bpe_32k.model"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id"))
    prototypes = language_prototypes(docs.where("not held_out").select("text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), prototypes).drop("text")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_token_output": op5_token_output,
    "op6_quality_rules": op6_quality_rules,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_cross_tokenizer": op12_cross_tokenizer,
    "op13_language_id": op13_language_id,
}
ORACLE = {
    "op1_license_scan": oracle.LICENSES,
    "op2_line_dedup": oracle.LINES,
    "op3_token_counts": oracle.TOKEN_COUNTS,
    "op4_benchmark_decontamination": oracle.LEAKS,
    "op6_quality_rules": oracle.QUALITY_RULES,
    "op7_minhash_near_dedup": oracle.NEAR_DUPLICATES,
}
