"""The pipeline against plain models, and each stage on tables it must not stumble over."""

import os

import llm_brute as brute
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline

SMOKE = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    read = lambda t: [r.asDict() for r in spark.read.parquet(f"{SMOKE}/{t}.parquet").collect()]
    encoding = brute.bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = brute.pipeline(read("documents"), read("benchmark"), encoding)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMOKE).collect()}
    assert {i: r["ids"] for i, r in got.items()} == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got.values())


@pytest.fixture()
def benchmark_dir(spark, tmp_dir):
    spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, None)], "item_id long, text string").write.parquet(
        os.path.join(tmp_dir, "benchmark.parquet"))
    return tmp_dir


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, label string, words int"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_any_table(spark, benchmark_dir, name, stage):
    clean = " ".join("word%d and more of it" % i for i in range(12))
    rows = [(1, clean, "en", "s", len(clean), 5, "x", 1), (2, None, None, None, None, None, None, None), (3, "", "en", None, 0, 1, None, 2),
            (4, clean + " x", None, "s", None, 5, "x", 1), (4, clean + " x", None, "s", None, 5, "x", 1), (None, clean + "\n" + clean, "en", "s", 3, 1, "y", 1),
            (6, "long " * 20_000, "en", "s", 100_000, 1, "y", 1), (7, "A b c d e f g h i j k l m n " + clean, "en", "s", 1, 1, "z", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = stage(spark, docs, benchmark_dir)
    got = out.collect()
    ids = sorted((r["doc_id"] for r in got), key=str)
    if name != "byte_level_bpe":
        assert out.columns == docs.columns
    assert ids == sorted({
        "quality_rules": [1, 4, 4, 7],  # the text of the null id repeats itself
        "line_dedup": [1, 2, 3, None, 6, 7],  # the line of 4 is two edits from that of 1
        "minhash_near_dedup": [1, 2, 3, 6, None],  # 56 of 70 shingles of 7 are those of 1
        "benchmark_decontamination": [1, 2, 3, 4, 4, None, 6],
        "byte_level_bpe": [1, 2, 3, 4, 4, None, 6, 7],
    }[name], key=str)
    empty = stage(spark, docs.limit(0), benchmark_dir)
    assert empty.collect() == [] and (name == "byte_level_bpe" or empty.columns == docs.columns)


def test_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup",
                                                     "benchmark_decontamination", "byte_level_bpe"]
