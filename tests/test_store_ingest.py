import os

from pyspark.sql import functions as F

from corpuskit.config import Settings
from corpuskit.plans.ask import ask
from corpuskit.plans.ingest import ingest, retry_failed
from corpuskit.store import CollectionStore
from tests.conftest import SF001

S = Settings(chunk_size=64, chunk_overlap=8)


def _docs(spark, n=60):
    d = spark.read.parquet(f"{SF001}/documents.parquet").where(F.col("doc_id") < n)
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "source")


def test_store_collections_and_drop(spark, tmp_dir):
    st = CollectionStore(spark, os.path.join(tmp_dir, "store"))
    assert st.read("x") is None and st.list_collections() == [] and st.existing_doc_ids("x").count() == 0
    a = spark.createDataFrame([("1", "t"), (None, "u")], "doc_id string, text string")
    st.append(a, "a")
    st.append(a.limit(1), "b")
    assert st.list_collections() == ["a", "b"] and st.collection_exists("a")
    assert [r[0] for r in st.existing_doc_ids("a").collect()] == ["1"]
    st.replace(spark.createDataFrame([("9", "n")], "doc_id string, text string"), "a")
    assert [r.doc_id for r in st.read("a").collect()] == ["9"] and st.read("b").count() == 1
    st.drop("a")
    st.drop("never")
    assert st.list_collections() == ["b"]


def test_ingest_twice_is_once(spark, tmp_dir):
    st = CollectionStore(spark, os.path.join(tmp_dir, "store"))
    docs = _docs(spark)
    r1 = ingest(docs, st, "documents", settings=S)
    n1 = st.read("documents").count()
    r2 = ingest(docs, st, "documents", settings=S)
    assert r1.docs_new > 0 and r1.chunks == n1 and r1.chunks_failed == 0
    assert r2.docs_new == 0 and st.read("documents").count() == n1
    assert st.staged_runs("documents") == []
    # documents are told apart by their ids: equal texts are stored under each id
    assert r1.docs_new == docs.count()
    by_text = ingest(docs, CollectionStore(spark, os.path.join(tmp_dir, "other")), "documents", settings=S, by_text=True)
    assert by_text.docs_new == docs.select("text").distinct().count()


class Breaks:
    def __call__(self, texts):
        if any("e" in t[:3] for t in texts):
            raise ValueError("refused")
        return [[1.0] * 4 for _ in texts]


def test_failed_chunks_quarantined_and_retried(spark, tmp_dir):
    st = CollectionStore(spark, os.path.join(tmp_dir, "store"))
    r = ingest(_docs(spark, 30), st, "documents", embedder=Breaks(), settings=Settings(chunk_size=64, chunk_overlap=8, embed_concurrency=2))
    stored = st.read("documents").count()
    assert r.chunks == stored + r.chunks_failed and r.chunks_failed > 0
    assert st.quarantined("documents").count() == r.chunks_failed
    fixed = retry_failed(st, "documents", embedder=lambda ts: [[0.0] * 4 for _ in ts])
    assert fixed == r.chunks_failed and st.quarantined("documents") is None
    assert st.read("documents").count() == r.chunks


def test_resume_uses_own_collection_stage(spark, tmp_dir):
    st = CollectionStore(spark, os.path.join(tmp_dir, "store"))
    chunks = spark.createDataFrame([("d1", "d1#0", "alpha beta", 2)], "doc_id string, chunk_id string, text string, n_tokens int")
    st.stage(chunks, "emails", run_id="leftover")
    r = ingest(_docs(spark, 5), st, "documents", settings=S)
    assert r.resumed_run is None and st.staged_runs("emails") == ["leftover"]
    r2 = ingest(_docs(spark, 5), st, "emails", settings=S)
    # the leftover is finished first, and the call's own documents follow
    assert r2.resumed_run == "leftover" and r2.docs_new == 5
    assert st.read("emails").where("doc_id = 'd1'").count() == 1
    assert st.read("emails").select("doc_id").distinct().count() == 6


def test_crash_after_append_adds_nothing(spark, tmp_dir):
    st = CollectionStore(spark, os.path.join(tmp_dir, "store"))
    keep = st.clear_stage
    st.clear_stage = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        ingest(_docs(spark, 6), st, "documents", settings=S)
    except RuntimeError:
        pass
    st.clear_stage = keep
    n = st.read("documents").count()
    assert n > 0 and st.staged_runs("documents")
    r = ingest(_docs(spark, 6), st, "documents", settings=S)
    assert r.resumed_run and r.docs_new == 0 and st.read("documents").count() == n and not st.staged_runs("documents")


def test_torn_stage_is_dropped(spark, tmp_dir):
    st = CollectionStore(spark, os.path.join(tmp_dir, "store"))
    os.makedirs(os.path.join(tmp_dir, "store", "staging", "collection=documents", "run=torn"))
    r = ingest(_docs(spark, 4), st, "documents", settings=S)
    assert r.docs_new == 4 and r.resumed_run is None and st.staged_runs("documents") == []


def test_an_id_twice_in_one_load_or_in_two(spark, tmp_dir):
    rows = spark.createDataFrame([("a", "one two"), ("a", "one three"), ("b", "one two"), ("b", "one two")], "doc_id string, text string")
    one = CollectionStore(spark, os.path.join(tmp_dir, "one"))
    assert ingest(rows, one, "c", settings=S).docs_new == 2
    two = CollectionStore(spark, os.path.join(tmp_dir, "two"))
    ingest(rows.where("doc_id = 'a'"), two, "c", settings=S)
    ingest(rows, two, "c", settings=S)
    key = lambda st: sorted((r.chunk_id, r.text) for r in st.read("c").collect())
    assert key(one) == key(two) == [("a#0", "one three"), ("b#0", "one two")]


def test_metadata_of_every_source_survives(spark, tmp_dir):
    st = CollectionStore(spark, os.path.join(tmp_dir, "store"))
    mail = spark.createDataFrame([("m1", "hello", "email", "Hi", None)], "doc_id string, text string, source_type string, subject string, folder string")
    files = spark.createDataFrame([("f1", "words", "document", "/x/a.txt")], "doc_id string, text string, source_type string, file_path string")
    ingest(mail, st, "emails", settings=S)
    ingest(files, st, "documents", settings=S)
    assert st.read("emails").first().metadata == {"source_type": "email", "subject": "Hi", "doc_id": "m1"}
    assert st.read("documents").first().metadata == {"source_type": "document", "file_path": "/x/a.txt", "doc_id": "f1"}


def test_fresh_ingest_of_nothing_empties(spark, tmp_dir):
    st = CollectionStore(spark, os.path.join(tmp_dir, "store"))
    ingest(_docs(spark, 4), st, "documents", settings=S)
    ingest(_docs(spark, 0), st, "documents", settings=S, fresh=True)
    assert not st.collection_exists("documents")


class RefusesZ:
    def __call__(self, texts):
        if any(t.startswith("z") for t in texts):
            raise ValueError("refused")
        return [[float(len(t)), 1.0] for t in texts]


def test_ask_returns_a_row_for_each_question(spark, tmp_dir):
    st = CollectionStore(spark, os.path.join(tmp_dir, "store"))
    for name in ("emails", "documents"):
        docs = spark.createDataFrame([(f"{name}{i}", "w " * (i + 1)) for i in range(6)], "doc_id string, text string")
        ingest(docs, st, name, embedder=RefusesZ(), settings=S)
    qs = spark.createDataFrame([(1, "w w", None, None), (2, "z fails", None, None), (3, "w", "emails", 2), (4, "w", "nowhere", None)],
                               "question_id long, question string, collection string, top_k int")
    out = {r.question_id: r for r in ask(qs, st, "documents", completer=lambda ps: ["ok"] * len(ps), settings=S, embedder=RefusesZ()).collect()}
    assert sorted(out) == [1, 2, 3, 4]
    assert out[1].answer == "ok" and len(out[1].sources) == S.top_k and out[1].sources[0]["doc_id"].startswith("documents")
    assert out[2].answer is None and "refused" in out[2].answer_error
    assert [s["rank"] for s in out[3].sources] == [1, 2] and out[3].sources[0]["metadata"]["doc_id"].startswith("emails")
    assert out[4].answer is None and "nowhere" in out[4].answer_error


def test_ask_end_to_end(spark, tmp_dir):
    st = CollectionStore(spark, os.path.join(tmp_dir, "store"))
    ingest(_docs(spark), st, "documents", settings=S, chunker="window")
    qs = spark.read.parquet(f"{SF001}/benchmark.parquet").where("item_id < 3").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    out = ask(qs, st, "documents", completer=lambda ps: [f"n={len(p)}" for p in ps], settings=S).collect()
    assert len(out) == 3
    for r in out:
        assert r.answer.startswith("n=") and len(r.sources) == S.top_k
        assert [s["rank"] for s in r.sources] == list(range(1, S.top_k + 1))
        assert "=== Passages ===" in r.prompt and r.n_chunks + r.n_dropped == S.top_k


def test_ask_approximate_and_model_budget(spark, tmp_dir):
    st = CollectionStore(spark, os.path.join(tmp_dir, "store"))
    ingest(_docs(spark), st, "documents", settings=S, chunker="window")
    qs = spark.read.parquet(f"{SF001}/benchmark.parquet").where("item_id < 4").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"),
        F.when(F.col("item_id") % 2 == 0, F.lit("anthropic/claude-opus-4-7")).otherwise(F.lit("other")).alias("model"))
    out = ask(qs, st, "Documents".lower(), settings=S, approximate=True).collect()
    assert len(out) == 4 and all(r.answer is None and r.tokens_used is None for r in out)
    assert all(1 <= len(r.sources) <= S.top_k for r in out)


def test_context_budget(spark):
    from corpuskit.operators.prompts import context_budget
    df = spark.createDataFrame([("anthropic/claude-sonnet-4-6",), ("x",), (None,)], "m string")
    got = [r[0] for r in df.select(context_budget(F.col("m"))).collect()]
    assert got == [200_000 - 1024, 128_000 - 1024, 128_000 - 1024]
    assert df.select(context_budget(F.col("m"), local=True)).first()[0] == 4096 - 1024


def test_fresh_ingest_replaces_only_its_collection(spark, tmp_dir):
    st = CollectionStore(spark, os.path.join(tmp_dir, "store"))
    ingest(_docs(spark, 20), st, "documents", settings=S, chunker="window")
    ingest(_docs(spark, 10), st, "other", settings=S, chunker="window")
    n_other = st.read("other").count()
    r = ingest(_docs(spark, 5), st, "documents", settings=S, chunker="window", fresh=True)
    ids = {row.doc_id for row in st.read("documents").select("doc_id").distinct().collect()}
    assert r.docs_new == len(ids) and all(int(i) < 5 for i in ids)
    assert st.read("other").count() == n_other
