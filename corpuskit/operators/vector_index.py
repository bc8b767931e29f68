"""V3/V4: a stored index of a collection's vectors, trained once and kept up at every append.

Inverted lists: a cell is a centroid, and each chunk lies in the list of the nearest one. Lists are Parquet
folders partitioned by cell, so a search reads the cells that it probes and no other. A row has the chunk's
vector and a short code of its residual (vector minus centroid): the residual's parts of 8 dimensions, each
replaced by one of 256 code vectors (product quantisation).

* Training takes a sample of at most ``sample_rows`` vectors: at most 256 top centroids (MLlib k-means), cells
  below each top (one group of the sample each), code vectors of each part. Every vector is indexed.
* Vectors meet the cells of their top in a cogroup; groups of many vectors are dealt out by a salt. What goes
  with a task are the tops and the codes, which do not grow with the corpus.
* ``update`` puts the commits that the index does not have yet into the lists of their cells, and splits a cell
  that has grown beyond twice its size by k-means of its own rows. Only lists of such cells are written anew.
* ``search`` ranks a question's cells by their distance and probes the nearest ones until they hold a given
  share of all rows. Codes alone rank the rows of a cell (one table look-up a part); the best of a question are
  then ranked by their true distance. Commits that are not in the index yet are searched exactly, and rows of
  commits that were replaced are left out.

An index lives below ``index/collection=<name>`` of the store, under a commit log of its own.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.commitlog import CommitLog
from corpuskit.config import DEFAULT_TOP_K
from corpuskit.operators.embedding import as_pandas_vectors
from corpuskit.operators.search import each_salt, exact_top_k, rank_hits, salted
from corpuskit.session import cut_lineage

PART = 8  # dimensions of a part of a vector
CODES = 256
MAX_TOPS = 256
GROUP_ROWS = 20_000  # vectors of one group of a cogroup
GROUP_QUESTIONS = 2_048
SPLIT_SAMPLE = 4_096  # rows of a cell that its split is learned from
SPLIT_WAYS = 64


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_TEXT, _LONG, _INT, _DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_VECTOR = T.ArrayType(_DOUBLE)
ROW = _schema(commit=_TEXT, chunk_id=_TEXT, embedding=T.ArrayType(T.FloatType()))
CELL = _schema(key=_TEXT, cell=_TEXT, centroid=_VECTOR, n=_LONG, solid=T.BooleanType())


def kmeans(x: np.ndarray, k: int, seed: int = 7, rounds: int = 10) -> np.ndarray:
    """At most k centroids of the rows of ``x``, all different (Lloyd's rounds from rows drawn far apart)."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    first = [int(rng.integers(len(x)))]
    near = ((x - x[first[0]]) ** 2).sum(1)
    while len(first) < k and near.sum() > 0:
        first.append(int(rng.choice(len(x), p=near / near.sum())))
        near = np.minimum(near, ((x - x[first[-1]]) ** 2).sum(1))
    c = x[first]
    for _ in range(rounds):
        cell = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, x)
        n = np.bincount(cell, minlength=len(c))
        c = sums[n > 0] / n[n > 0, None]
    return np.unique(c, axis=0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Number of the nearest row of ``c`` for each row of ``x``."""
    out = np.empty(len(x), np.int64)
    norm = (c * c).sum(1)
    for at in range(0, len(x), 4096):
        out[at:at + 4096] = (norm - 2 * (x[at:at + 4096] @ c.T)).argmin(1)
    return out


def _parts(dims: int) -> list[slice]:
    return [slice(at, min(at + PART, dims)) for at in range(0, dims, PART)]


def encode(residuals: np.ndarray, codebook: list[np.ndarray]) -> np.ndarray:
    """One code byte for each part of each residual."""
    return np.stack([nearest(residuals[:, p], c) for p, c in zip(_parts(residuals.shape[1]), codebook, strict=True)],
                    axis=1).astype(np.uint8)


def _no_rows(schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in schema.fields})


def _split_of(wanted: int):
    def split(key, pdf):
        """The cells that a cell of too many rows becomes; one solid cell where its rows are all equal."""
        c = kmeans(as_pandas_vectors(pdf["embedding"]), max(2, min(SPLIT_WAYS, math.ceil(pdf["size"].iloc[0] / wanted))))
        return pd.DataFrame({"key": key[0], "cell": [f"{key[0]}-{i}" for i in range(len(c))], "centroid": list(c),
                             "n": 0, "solid": len(c) == 1})
    return split


class VectorIndex:
    def __init__(self, store, collection: str):
        self.store, self.collection, self.spark = store, collection, store.spark
        self.root = f"{store.root}/index/collection={store.files.escape(collection)}"
        self.log = CommitLog(store.files, f"{self.root}/log")

    # ------------------------------------------------------------ state
    def state(self) -> dict | None:
        """The newest version: ``model`` (folder), ``lists`` (folders), ``covers`` (commits), ``cell_rows``."""
        found = self.log.latest()
        return found if found and found.get("model") else None

    def _commit(self, state: dict, expected: dict | None) -> bool:
        def step(latest):
            if (latest or {}).get("version") != (expected or {}).get("version"):
                return None  # somebody else was faster: their version stands
            return state
        return self.log.commit(step).get("model") == state.get("model")

    def drop(self) -> None:
        self.store.files.delete(self.root)

    def _model(self, folder: str):
        """(cells, top centroids, code vectors of each part); the latter two come to the driver: at most 256
        vectors and 256 for each part."""
        cells = self.spark.read.schema(CELL).parquet(f"{self.root}/{folder}/cells")
        tops = as_pandas_vectors(self.spark.read.parquet(f"{self.root}/{folder}/tops").orderBy("top").toPandas()["centroid"])
        codes = self.spark.read.parquet(f"{self.root}/{folder}/codes").orderBy("part", "code").toPandas()
        book = [as_pandas_vectors(g["centroid"]) for _, g in codes.groupby("part")]
        return cells, tops, book

    def _live(self) -> tuple[list, list]:
        """(names under which rows of live commits may be listed, live commits that are not in the index)."""
        covers = set((self.state() or {"covers": []})["covers"])
        entries = [e for e in self.store.manifest(self.collection)["entries"] if e["rows"]]
        names = sorted({c for e in entries for c in [e["commit"], *e["from"]]})
        return names, [e["commit"] for e in entries if e["commit"] not in covers and not set(e["from"]) <= covers]

    def _vectors(self, commits: list) -> DataFrame:
        chunks = self.store.read_commits(self.collection, commits)
        return chunks.where("embedding is not null").select("commit", "chunk_id", "embedding")

    def _lists(self, state: dict, cells: DataFrame) -> DataFrame:
        """Listed rows of live commits in the given cells (a column ``cell`` and what is to come along)."""
        schema = T.StructType([*ROW.fields, T.StructField("codes", T.BinaryType()),
                               T.StructField("cell", T.StringType())])
        parts = [self.spark.read.schema(schema).option("basePath", f"{self.root}/{f}").parquet(f"{self.root}/{f}")
                 for f in state["lists"]]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows.where(F.col("commit").isin(self._live()[0])).join(cells, "cell")

    # ------------------------------------------------------------ build and update
    def build(self, cell_rows: int | None = None, sample_rows: int = 200_000, seed: int = 7) -> None:
        """Train an index of about one cell for ``cell_rows`` vectors and put all vectors of the collection in.
        By default there are 8 n^0.4 cells: 350 for 13,000 vectors, 32,000 for a billion."""
        before = self.log.latest()
        commits = [e["commit"] for e in self.store.manifest(self.collection)["entries"] if e["rows"]]
        if not commits:
            return
        vectors = self._vectors(commits)
        n = vectors.count()
        if not n:
            return
        cell_rows = cell_rows or math.ceil(n / (8 * n ** 0.4))
        # the sample is drawn by a hash of the chunk id
        keep = min(1.0, sample_rows / n)
        drawn = F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 20)) < int(math.ceil(keep * (1 << 20)))
        sample = cut_lineage(vectors.where(drawn).limit(2 * sample_rows))
        n_sample = max(1, sample.count())
        n_cells = max(1, round(n / cell_rows))
        tops = self._tops(sample, min(MAX_TOPS, math.ceil(math.sqrt(n_cells))), seed)

        def cells_of(key, pdf):
            c = kmeans(as_pandas_vectors(pdf["embedding"]), max(1, round(len(pdf) / n_sample * n_cells)), seed)
            return pd.DataFrame({"key": key[0], "cell": [f"{key[0]}-{i}" for i in range(len(c))], "centroid": list(c),
                                 "n": 0, "solid": False})

        topped = cut_lineage(self._to_top(sample, tops))
        model = f"model-{uuid.uuid4().hex[:12]}"
        topped.groupBy("key").applyInPandas(cells_of, CELL).write.parquet(f"{self.root}/{model}/cells-empty")
        empty = self.spark.read.schema(CELL).parquet(f"{self.root}/{model}/cells-empty")
        self._write_small(f"{model}/tops", [(i, c.tolist()) for i, c in enumerate(tops)], "top int, centroid array<double>")
        self._train_codes(model, self._place(topped, empty, None), seed)
        _, _, book = self._codes_only(model)
        lists = f"lists-{uuid.uuid4().hex[:12]}"
        self._place(self._to_top(vectors, tops), empty, book).write.partitionBy("cell").parquet(f"{self.root}/{lists}")
        self._count_cells(empty, lists).write.parquet(f"{self.root}/{model}/cells")
        state = {"model": model, "lists": [lists], "covers": commits, "cell_rows": cell_rows, "n_tops": len(tops)}
        if self._commit(state, before):
            self._split()

    def update(self) -> int:
        """Put live commits that the index does not have into it; how many. Nothing without an index."""
        state = self.state()
        if state is None:
            return 0
        _, missing = self._live()
        if not missing:
            return 0
        cells, tops, book = self._model(state["model"])
        lists = f"lists-{uuid.uuid4().hex[:12]}"
        self._place(self._to_top(self._vectors(missing), tops), cells.withColumn("key", F.element_at(F.split("cell", "-"), 1)),
                    book).write.partitionBy("cell").parquet(f"{self.root}/{lists}")
        model = self._next_model(state["model"], self._count_cells(cells, lists))
        new = {**state, "model": model, "lists": [*state["lists"], lists], "covers": [*state["covers"], *missing]}
        if self._commit(new, state):
            self._split()
        return len(missing)

    def _write_small(self, path: str, rows: list, schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{self.root}/{path}")

    def _codes_only(self, model: str):
        codes = self.spark.read.parquet(f"{self.root}/{model}/codes").orderBy("part", "code").toPandas()
        return None, None, [as_pandas_vectors(g["centroid"]) for _, g in codes.groupby("part")]

    def _next_model(self, old: str, cells: DataFrame) -> str:
        """A model with other cells; tops and codes are taken over."""
        model = f"model-{uuid.uuid4().hex[:12]}"
        cells.write.parquet(f"{self.root}/{model}/cells")
        for part in ("tops", "codes"):
            self.spark.read.parquet(f"{self.root}/{old}/{part}").write.parquet(f"{self.root}/{model}/{part}")
        return model

    def _tops(self, sample: DataFrame, k: int, seed: int) -> np.ndarray:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if k == 1:
            first = sample.select("embedding").first()
            return np.asarray([first["embedding"]], np.float64) if first else np.zeros((1, 1))
        data = sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
        fit = KMeans(k=k, seed=seed, maxIter=5).fit(data)
        return np.unique(np.vstack([np.asarray(c, np.float64) for c in fit.clusterCenters()]), axis=0)

    def _to_top(self, rows: DataFrame, tops: np.ndarray) -> DataFrame:
        """``rows`` with the number of the nearest top as ``key``."""
        schema = T.StructType([*rows.schema.fields, T.StructField("key", T.StringType())])

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(key=[str(i) for i in nearest(as_pandas_vectors(pdf["embedding"]), tops).tolist()])

        return rows.mapInPandas(run, schema)

    def _place(self, rows: DataFrame, cells: DataFrame, book: list | None) -> DataFrame:
        """Rows with the nearest cell of their key, and the codes (without ``book``: the residual)."""
        extra = T.StructField("codes", T.BinaryType()) if book is not None else T.StructField("residual", _VECTOR)
        schema = T.StructType([*ROW.fields, extra, T.StructField("cell", T.StringType())])

        def place(some: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
            if not len(some) or not len(group):
                return _no_rows(schema)
            group = group.sort_values("cell")
            c = as_pandas_vectors(group["centroid"])
            x = as_pandas_vectors(some["embedding"])
            at = nearest(x, c)
            out = some[["commit", "chunk_id", "embedding"]].copy()
            if book is not None:
                out["codes"] = [row.tobytes() for row in encode(x - c[at], book)]
            else:
                out["residual"] = list(x - c[at])
            out["cell"] = group["cell"].to_numpy()[at]
            return out

        rows = cut_lineage(rows)
        dealt, salts = salted(rows, ["key"], "chunk_id", GROUP_ROWS, "salt")
        whole = each_salt(cells.select("key", "cell", "centroid"), salts, ["key"], "salt")
        return dealt.groupBy("key", "salt").cogroup(whole.groupBy("key", "salt")).applyInPandas(place, schema)

    def _train_codes(self, model: str, placed: DataFrame, seed: int) -> None:
        """Code vectors of each part, from at most 65,536 residuals of the sample."""
        few = placed.limit(65_536).select("residual")
        schema = _schema(part=_INT, code=_INT, centroid=_VECTOR)
        dims = F.size("residual")
        parts = few.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((dims - 1) / PART).cast("int")),
                                                    lambda p: F.slice("residual", p * PART + 1, PART))).alias("part", "x"))

        def learn(key, pdf):
            c = kmeans(as_pandas_vectors(pdf["x"]), CODES, seed, rounds=6)
            return pd.DataFrame({"part": key[0], "code": np.arange(len(c), dtype=np.int32), "centroid": list(c)})

        parts.groupBy("part").applyInPandas(learn, schema).write.parquet(f"{self.root}/{model}/codes")

    def _count_cells(self, cells: DataFrame, lists: str) -> DataFrame:
        """Cells with the rows of a lists folder added to their numbers."""
        added = (self.spark.read.schema("cell string").option("basePath", f"{self.root}/{lists}").parquet(f"{self.root}/{lists}")
                 .groupBy("cell").agg(F.count(F.lit(1)).alias("more")))
        return cells.join(added, "cell", "left").select(
            "key", "cell", "centroid", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "solid")

    def _split(self) -> None:
        """Split cells of more than twice the wanted rows until there are none but solid ones (equal rows)."""
        while True:
            state = self.state()
            cells, _, book = self._model(state["model"])
            wanted = state["cell_rows"]
            large = cut_lineage(cells.where((F.col("n") > 2 * wanted) & ~F.col("solid")).select(
                "cell", F.col("n").alias("size")))
            if not large.count():
                return
            rows = self._lists(state, large)
            order = Window.partitionBy("cell").orderBy(F.xxhash64("chunk_id", F.lit(11)), "chunk_id")
            some = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SPLIT_SAMPLE)

            new = cut_lineage(some.select("cell", "size", "embedding").groupBy("cell").applyInPandas(_split_of(wanted), CELL))
            lists = f"lists-{uuid.uuid4().hex[:12]}"
            moved = rows.select("commit", "chunk_id", "embedding", F.col("cell").alias("key"))
            self._place(moved, new, book).write.partitionBy("cell").parquet(f"{self.root}/{lists}")
            kept = cells.join(large, "cell", "left_anti").select(*CELL.fieldNames())
            model = self._next_model(state["model"], kept.unionByName(self._count_cells(new, lists)))
            # the old lists of a split cell stay where they are: no cell of the model names them any more
            if not self._commit({**state, "model": model, "lists": [*state["lists"], lists]}, state):
                return

    # ------------------------------------------------------------ search
    def probes(self, questions: DataFrame, k: int, share: float, q_id: str = "question_id",
               q_vec: str = "embedding", tops_probed: int = 16) -> DataFrame:
        """(qid, qv, cell, n, residual): the nearest cells of each question that together hold at most
        ``share`` of the indexed rows, and at least the first ones that hold k."""
        cells, tops, _ = self._model(self.state()["model"])
        total = cells.agg(F.sum("n")).first()[0] or 0
        q = questions.select(F.col(q_id).alias("qid"), F.col(q_vec).cast("array<double>").alias("qv"))
        schema = T.StructType([*q.schema.fields, T.StructField("key", T.StringType())])
        wide = min(len(tops), tops_probed)

        def near_tops(batches):
            for pdf in batches:
                pdf = pdf[pdf["qv"].notna()]
                if len(pdf):
                    v = as_pandas_vectors(pdf["qv"])
                    d = (tops * tops).sum(1) - 2 * v @ tops.T
                    best = np.argsort(d, axis=1, kind="stable")[:, :wide]
                    out = pdf.loc[pdf.index.repeat(wide)].copy()
                    out["key"] = [str(i) for i in best.ravel().tolist()]
                    yield out

        dealt, salts = salted(cut_lineage(q.mapInPandas(near_tops, schema)), ["key"], "qid", GROUP_QUESTIONS, "deal")
        by_top = cells.where("n > 0").select(F.element_at(F.split("cell", "-"), 1).alias("key"), "cell", "centroid", "n")
        by_top, cell_salts = salted(by_top, ["key"], "cell", GROUP_ROWS, "part")
        left = each_salt(dealt, cell_salts, ["key"], "part")
        right = each_salt(by_top, salts, ["key"], "deal")
        out = T.StructType([*q.schema.fields, T.StructField("cell", T.StringType()), T.StructField("n", T.LongType()),
                            T.StructField("d", T.DoubleType()), T.StructField("residual", _VECTOR)])

        def measure(some: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
            if not len(some) or not len(group):
                return _no_rows(out)
            v, c = as_pandas_vectors(some["qv"]), as_pandas_vectors(group["centroid"])
            # no more of a question's cells than could be probed leave the group
            d = ((v[:, None, :] - c[None]) ** 2).sum(2) if len(v) * c.size < 5_000_000 else np.stack(
                [((v - row) ** 2).sum(1) for row in c], axis=1)
            order = np.argsort(d, axis=1, kind="stable")
            n = group["n"].to_numpy()[order]
            before = np.cumsum(n, axis=1) - n
            row, col = np.nonzero((before + n <= share * total) | (before < k))
            at = order[row, col]
            return pd.DataFrame({"qid": some["qid"].to_numpy()[row], "qv": list(v[row]), "cell": group["cell"].to_numpy()[at],
                                 "n": n[row, col], "d": d[row, at], "residual": list(v[row] - c[at])})

        keys = ["key", "deal", "part"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(measure, out)
        w = Window.partitionBy("qid").orderBy("d", "cell").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("n").over(w), F.lit(0))
        return found.withColumn("_b", before).where(
            (F.col("_b") + F.col("n") <= share * total) | (F.col("_b") < k)).drop("_b", "d")

    def search(self, questions: DataFrame, k: int = DEFAULT_TOP_K, share: float = 0.2, rerank: int = 100,
               q_id: str = "question_id", q_vec: str = "embedding") -> DataFrame:
        """The k nearest chunks of each question among the cells that it probes, ranked by their true distance:
        ``q_id, chunk_id, distance, score, rank``, like the exact search. ``rerank``: how many of a question's
        rows, best by their codes, are looked at again."""
        state = self.state()
        qtype = questions.schema[q_id].dataType
        hits = None
        if state is not None:
            probes = cut_lineage(self.probes(questions, k, share, q_id, q_vec))
            hits = self._score(state, probes, max(rerank, k), qtype)
        _, missing = self._live()
        if missing:
            exact = exact_top_k(questions, self._vectors(missing), k, q_id=q_id, q_vec=q_vec).select(
                F.col(q_id).alias("qid"), F.col("chunk_id").alias("cid"), "distance")
            hits = exact if hits is None else hits.unionByName(exact)
        if hits is None:
            schema = T.StructType([T.StructField("qid", qtype), *_schema(cid=_TEXT, distance=_DOUBLE).fields])
            hits = self.spark.createDataFrame([], schema)
        return rank_hits(hits, k).select(F.col("qid").alias(q_id), F.col("cid").alias("chunk_id"), "distance", "score", "rank")

    def _score(self, state: dict, probes: DataFrame, rerank: int, qtype) -> DataFrame:
        _, _, book = self._model(state["model"])
        dealt, deals = salted(probes.drop("n", "qv"), ["cell"], "qid", GROUP_QUESTIONS, "deal")
        salts = probes.select("cell", F.ceil(F.col("n") / F.lit(GROUP_ROWS)).cast("int").alias("n_salt")).distinct()
        rows = self._lists(state, salts.join(deals, "cell"))
        codes = (rows.select("cell", "commit", "chunk_id", "codes", F.pmod(F.xxhash64("chunk_id"), "n_salt").cast("int").alias("salt"),
                             F.explode(F.sequence(F.lit(0), F.col("n_deal") - 1)).alias("deal")))
        asked = each_salt(dealt, salts, ["cell"], "salt")
        schema = T.StructType([T.StructField("qid", qtype), *_schema(
            cell=_TEXT, commit=_TEXT, chunk_id=_TEXT, guess=_DOUBLE).fields])

        def by_codes(key, some, group):
            if not len(some) or not len(group):
                return _no_rows(schema)
            group = group.sort_values("chunk_id")
            code = np.frombuffer(b"".join(group["codes"]), np.uint8).reshape(len(group), -1)
            r = as_pandas_vectors(some["residual"])
            keep = min(rerank, len(group))
            row, col, guess = [], [], []
            for at in range(0, len(r), 128):  # bounds the look-up tables and distances of a step
                q = r[at:at + 128]
                d = np.zeros((len(q), len(group)))
                for j, (p, c) in enumerate(zip(_parts(r.shape[1]), book, strict=True)):
                    d += ((q[:, None, p] - c[None]) ** 2).sum(2)[:, code[:, j]]
                best = np.argsort(d, axis=1, kind="stable")[:, :keep]
                row.append(np.repeat(np.arange(at, at + len(q)), keep))
                col.append(best.ravel())
                guess.append(np.take_along_axis(d, best, 1).ravel())
            row, col = np.concatenate(row), np.concatenate(col)
            return pd.DataFrame({"qid": some["qid"].to_numpy()[row], "cell": key[0], "commit": group["commit"].to_numpy()[col],
                                 "chunk_id": group["chunk_id"].to_numpy()[col], "guess": np.concatenate(guess)})

        keys = ["cell", "deal", "salt"]
        guessed = asked.groupBy(*keys).cogroup(codes.groupBy(*keys)).applyInPandas(by_codes, schema)
        w = Window.partitionBy("qid").orderBy("guess", "chunk_id")
        best = cut_lineage(guessed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rerank).drop("_r", "guess"))
        vectors = self._lists(state, best.select("cell").distinct()).select("cell", "commit", "chunk_id", "embedding")
        both = best.join(vectors, ["cell", "commit", "chunk_id"]).join(probes.select("qid", "qv").dropDuplicates(["qid"]), "qid")
        true = T.StructType([T.StructField("qid", qtype), *_schema(cid=_TEXT, distance=_DOUBLE).fields])

        def measure(batches):
            for pdf in batches:
                if len(pdf):
                    d = ((as_pandas_vectors(pdf["qv"]) - as_pandas_vectors(pdf["embedding"])) ** 2).sum(1)
                    yield pd.DataFrame({"qid": pdf["qid"], "cid": pdf["chunk_id"], "distance": d})

        return both.select("qid", "qv", "chunk_id", "embedding").mapInPandas(measure, true)
