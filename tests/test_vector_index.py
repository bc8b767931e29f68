"""The stored index: recall, appends, splits, replaced commits, hot cells."""

import numpy as np
import pandas as pd
import pytest

from corpuskit.config import Settings
from corpuskit.operators.search import exact_top_k
from corpuskit.operators.vector_index import VectorIndex, kmeans, nearest
from corpuskit.plans.ask import retrieve
from corpuskit.store import CollectionStore


def clustered(n, dim=12, centres=40, seed=2):
    rng = np.random.default_rng(seed)
    c = np.random.default_rng(99).normal(size=(centres, dim)) * 3  # the same clusters for every seed
    return (c[rng.integers(centres, size=n)] + rng.normal(size=(n, dim)) * 0.4).astype(np.float32)


def chunks(spark, vectors, first=0):
    return spark.createDataFrame(pd.DataFrame({
        "doc_id": [f"d{first + i}" for i in range(len(vectors))], "chunk_id": [f"d{first + i}#0" for i in range(len(vectors))],
        "text": "t", "embedding": list(vectors)}))


def asked(spark, vectors):
    return spark.createDataFrame(pd.DataFrame({"question_id": np.arange(len(vectors)), "embedding": [v.astype(float) for v in vectors]}))


def pairs(hits):
    return {(r.question_id, r.chunk_id) for r in hits.select("question_id", "chunk_id").collect()}


def recall(spark, store, questions, k=5, **how):
    want = pairs(exact_top_k(questions, store.read("c"), k))
    return len(want & pairs(VectorIndex(store, "c").search(questions, k, **how))) / len(want)


def test_kmeans_gives_different_centroids():
    x = np.array([[0.0, 0], [0, 0], [5, 5], [5, 5.2], [9, 0]])
    c = kmeans(x, 3)
    assert len(c) == 3 and len(set(nearest(x, c)[[0, 2, 4]].tolist())) == 3
    assert len(kmeans(np.ones((50, 4)), 8)) == 1


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    st = CollectionStore(spark, str(tmp_path_factory.mktemp("index")))
    st.append(chunks(spark, clustered(4000)), "c")
    VectorIndex(st, "c").build(cell_rows=100)
    return st


def test_recall_on_a_share_of_the_rows(spark, store):
    q = asked(spark, clustered(80, seed=5))
    index = VectorIndex(store, "c")
    read = index.probes(q, 5, 0.1).groupBy("qid").agg({"n": "sum"}).toPandas()
    assert len(read) == 80 and read["sum(n)"].max() <= 400
    assert recall(spark, store, q, share=0.1) >= 0.95
    whole = index.search(q, 5, share=1.0, rerank=4000)
    exact = exact_top_k(q, store.read("c"), 5)
    key = lambda df: sorted((r.question_id, r["rank"], r.chunk_id, round(r.distance, 6)) for r in df.collect())
    assert key(whole) == key(exact)


def test_appends_splits_and_replaced_commits(spark, tmp_dir):
    st = CollectionStore(spark, tmp_dir)
    index = VectorIndex(st, "c")
    assert index.update() == 0 and index.search(asked(spark, clustered(2)), 3).count() == 0
    st.append(chunks(spark, clustered(600)), "c")
    q = asked(spark, clustered(30, seed=6))
    assert recall(spark, st, q) == 1.0  # nothing is indexed yet: searched exactly
    index.build(cell_rows=50)
    model = index.state()["model"]
    st.append(chunks(spark, clustered(400, seed=3), 1000), "c")
    _, missing = index._live()
    assert len(missing) == 1 and recall(spark, st, q, share=0.3) >= 0.9
    # a dense cluster that makes one cell overflow, with rows that all are one vector
    dense = np.vstack([clustered(500, centres=1, seed=7), np.repeat(clustered(1, seed=8), 300, 0)])
    st.append(chunks(spark, dense, 5000), "c")
    assert index.update() == 2 and index.state()["model"] != model
    cells = index._model(index.state()["model"])[0].toPandas()
    assert cells["n"].sum() == 1800 and set(cells[cells["n"] > 100]["solid"]) <= {True}
    assert recall(spark, st, q, share=0.3) >= 0.9
    assert st.compact("c") == 3 and index._live()[1] == []  # compacted commits are indexed under their old names
    assert recall(spark, st, q, share=0.3) >= 0.9
    st.replace(chunks(spark, clustered(50, seed=9), 9000), "c")
    hits = index.search(q, 3)
    assert all(r.chunk_id.startswith("d90") for r in hits.collect()) and hits.count() == 90


def test_questions_and_cells_beyond_a_group(spark, store, monkeypatch):
    from corpuskit.operators import vector_index

    q = asked(spark, np.vstack([clustered(40, seed=12), np.repeat(clustered(1, seed=13), 60, 0)]))
    want = sorted(map(tuple, VectorIndex(store, "c").search(q, 4, share=0.1).select("question_id", "rank", "chunk_id").collect()))
    monkeypatch.setattr(vector_index, "GROUP_ROWS", 17)
    monkeypatch.setattr(vector_index, "GROUP_QUESTIONS", 9)
    got = sorted(map(tuple, VectorIndex(store, "c").search(q, 4, share=0.1).select("question_id", "rank", "chunk_id").collect()))
    assert got == want


def test_null_vectors_and_questions(spark, tmp_dir):
    st = CollectionStore(spark, tmp_dir)
    rows = [("a", "a#0", "t", [0.0, 1.0]), ("b", "b#0", "t", None), ("c", "c#0", "t", [5.0, 1.0])]
    st.append(spark.createDataFrame(rows, "doc_id string, chunk_id string, text string, embedding array<float>"), "c")
    VectorIndex(st, "c").build()
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "question_id long, embedding array<double>")
    got = [tuple(r) for r in VectorIndex(st, "c").search(q, 5).select("question_id", "chunk_id", "rank").orderBy("rank").collect()]
    assert got == [(1, "a#0", 1), (1, "c#0", 2)]


def test_retrieve_by_the_index(spark, store):
    q = asked(spark, clustered(10, seed=21))
    exact = retrieve(q, store.read("c"), Settings())
    by_index = retrieve(q, store.read("c"), Settings(), index=VectorIndex(store, "c"), share=0.2)
    assert by_index.columns == exact.columns
    assert len(pairs(exact) & pairs(by_index)) >= 45
