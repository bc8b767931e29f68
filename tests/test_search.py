import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpuskit.operators.search import answer_sources, approx_top_k, build_ivf, exact_top_k


def _frames(spark, n_q=30, n_c=600, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    C = rng.normal(size=(n_c, dim))
    C[10] = C[11] = C[12] = C[13]  # exact duplicates: ties broken by id
    Q = rng.normal(size=(n_q, dim))
    Q[0] = C[13]
    qs = spark.createDataFrame(pd.DataFrame({"question_id": np.arange(n_q), "embedding": list(Q)}))
    cs = spark.createDataFrame(pd.DataFrame({"chunk_id": [f"c{i:04d}" for i in range(n_c)],
                                             "embedding": [v.astype(np.float32) for v in C]}))
    return Q, C.astype(np.float32).astype(np.float64), qs, cs


def brute(Q, C, k):
    out = {}
    for qi, q in enumerate(Q):
        d = ((C - q) ** 2).sum(1)
        order = sorted(range(len(C)), key=lambda j: (round(d[j], 9), f"c{j:04d}"))[:k]
        out[qi] = [f"c{j:04d}" for j in order]
    return out


def test_exact_top_k_matches_brute_force_any_blocking(spark):
    Q, C, qs, cs = _frames(spark)
    want = brute(Q, C, 5)
    for max_block, parts in [(8192, 1), (7, 5)]:
        hits = exact_top_k(qs, cs.repartition(parts), 5, max_block=max_block).collect()
        got = {}
        for r in sorted(hits, key=lambda r: (r.question_id, r["rank"])):
            got.setdefault(r.question_id, []).append(r.chunk_id)
        assert got == want
    top = [r for r in hits if r.question_id == 0 and r["rank"] == 1][0]
    assert abs(top.distance) < 1e-9 and abs(top.score - 1.0) < 1e-9 and top.chunk_id == "c0010"


def test_exact_top_k_skips_null_vectors(spark):
    qs = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "question_id long, embedding array<double>")
    cs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 2.0])], "chunk_id string, embedding array<float>")
    got = [(r.question_id, r.chunk_id, r["rank"]) for r in exact_top_k(qs, cs, 5).orderBy("rank").collect()]
    assert got == [(1, "a", 1), (1, "c", 2)]


def test_approx_top_k_recall(spark):
    Q, C, qs, cs = _frames(spark, n_q=40, n_c=800, dim=6, seed=3)
    index = build_ivf(cs, n_cells=8)
    approx = approx_top_k(qs, index, 5, n_probe=4, max_group_rows=30).collect()
    want = brute(Q, C, 5)
    found = sum(1 for r in approx if r.chunk_id in want[r.question_id])
    assert found / (5 * len(Q)) >= 0.8
    assert all(r["rank"] <= 5 for r in approx)


def test_answer_sources_ordered(spark):
    hits = spark.createDataFrame([(1, 2, 0.5, "b", 7, "L2", "s2"), (1, 1, 0.9, "a", 7, "L1", "s1")],
                                 "question_id long, rank int, score double, chunk_id string, doc_id long, label string, snippet string")
    row = answer_sources(hits).first()
    assert [s["chunk_id"] for s in row.sources] == ["a", "b"]


def test_approx_probing_all_cells_is_exact_with_hot_cell(spark):
    rng = np.random.default_rng(11)
    hot = rng.normal(size=(900, 6)) * 0.05 + 3.0   # a dense cluster holding 90 % of the rows
    rest = rng.normal(size=(100, 6)) * 2.0
    C = np.vstack([hot, rest]).astype(np.float32)
    Q = rng.normal(size=(25, 6)) + 1.5
    qs = spark.createDataFrame(pd.DataFrame({"question_id": np.arange(len(Q)), "embedding": list(Q)}))
    cs = spark.createDataFrame(pd.DataFrame({"chunk_id": [f"c{i:04d}" for i in range(len(C))],
                                             "embedding": list(C)}))
    index = build_ivf(cs, n_cells=5)
    sizes = sorted(r["count"] for r in index.cell_sizes.collect())
    assert sizes[-1] > 100  # the hot cell is split into several salted groups below
    got = approx_top_k(qs, index, 5, n_probe=5, max_group_rows=50).collect()
    have = {}
    for r in sorted(got, key=lambda r: (r.question_id, r["rank"])):
        have.setdefault(r.question_id, []).append(r.chunk_id)
    assert have == brute(Q, C.astype(np.float64), 5)


def test_large_vectors_rank_by_their_true_distance(spark):
    base = [1e4, -1e4, 1e4]
    rows = [(i, [base[0] + 1e-3 * i, base[1], base[2]]) for i in range(20)]
    c = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [base[0] + 0.0041, base[1], base[2]]), (2, [0.0, 0.0, 0.0])], "question_id long, embedding array<double>")
    hits = exact_top_k(q, c, 3).where("question_id = 1").orderBy("rank").collect()
    assert [h.chunk_id for h in hits] == [4, 5, 3]


def test_short_cells_are_widened(spark):
    import numpy as np
    from corpuskit.operators.search import ivf_from_centroids
    c = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(12)], "chunk_id long, embedding array<double>")
    index = ivf_from_centroids(c, np.array([[0.0, 0.0], [20.0, 0.0]]))
    q = spark.createDataFrame([(1, [19.0, 0.0])], "question_id long, embedding array<double>")
    assert [h.chunk_id for h in approx_top_k(q, index, 4, n_probe=1).orderBy("rank").collect()] == [11, 10, 9, 8]


def test_grid_equals_brute_force_whatever_the_blocks(spark):
    from corpuskit.operators.search import grid_top_k
    rng = np.random.default_rng(17)
    centres = rng.normal(size=(12, 8)) * 6
    C = (centres[rng.integers(12, size=900)] + rng.normal(size=(900, 8)) * 0.3).astype(np.float32)
    C[100:400] = C[100]  # a third of the rows are one vector
    Q = np.vstack([centres[rng.integers(12, size=50)] + rng.normal(size=(50, 8)) * 0.3, np.repeat(C[100:101], 30, 0).astype(float)])
    qs = spark.createDataFrame(pd.DataFrame({"question_id": np.arange(len(Q)), "embedding": list(Q)}))
    cs = spark.createDataFrame(pd.DataFrame({"chunk_id": [f"c{i:04d}" for i in range(len(C))], "embedding": list(C)}))
    want = brute(Q, C.astype(np.float64), 5)
    for how in ({}, {"n_pivots": 5, "sample_rows": 40, "block_rows": 37, "block_questions": 11}, {"sample_rows": 3, "n_pivots": 1}):
        got = {}
        for r in sorted(grid_top_k(qs.repartition(3), cs.repartition(4), 5, **how).collect(), key=lambda r: (r.question_id, r["rank"])):
            got.setdefault(r.question_id, []).append(r.chunk_id)
        assert got == want
    empty = cs.where("chunk_id = ''")
    assert grid_top_k(qs, empty, 3).count() == 0 and grid_top_k(qs.where("question_id < 0"), cs, 3).count() == 0


def test_grid_skips_far_blocks_and_scans_once(spark):
    from corpuskit.operators.search import exact_top_k as exact
    Q, C, qs, cs = _frames(spark, n_q=40)
    many = exact(qs, cs, 5, max_block=10)
    plan = many._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    got = {}
    for r in sorted(many.collect(), key=lambda r: (r.question_id, r["rank"])):
        got.setdefault(r.question_id, []).append(r.chunk_id)
    assert got == brute(Q, C, 5)


def test_scan_scores_few_cells_at_a_time():
    # distances of four million pairs, and their copies, were held at once
    import tracemalloc

    import numpy as np

    from corpuskit.operators.search import _local_best

    r = np.random.default_rng(3)
    q, c = r.normal(size=(200, 8)), r.normal(size=(20_000, 8))
    tracemalloc.start()
    got = _local_best(np.arange(200), q, np.arange(20_000), c, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    want = ((q[7] - c) ** 2).sum(1).argsort(kind="stable")[:5]
    assert got[got["qi"] == 7]["cid"].tolist() == want.tolist()
