"""Named collections of chunks as Parquet folders under a commit log.

Layout below ``root`` (a shared path; every file operation goes through Hadoop's file systems):

* ``data/commit=<id>/collection=<name>/part-*``: the chunks of one commit; never changed once written.
* ``ids/commit=<id>/collection=<name>/bucket=<b>/part-*``: the document ids of the commit, by hash bucket, and
  ``blooms/commit=<id>/collection=<name>/part-*``: a Bloom filter of them for each bucket, in pages.
* ``log/collection=<name>/<version>.json``: one manifest for each version: the live commits. The newest one
  is the collection. A manifest is written aside and published under its name only if nobody has published
  that version, so a version is there whole or not at all, and of two writers one has to look again.
* ``staging/collection=<name>/run=<id>/``: runs that wait to be embedded, and ``quarantine/``.

Readers take one manifest and its folders: they see a replace or an append entirely or not at all. A commit
names the run that it comes from, so a run that is repeated after its commit adds nothing. Folders that no
manifest names (a writer died before its commit) are never read; ``vacuum`` deletes them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpuskit.commitlog import CommitConflict, CommitLog, FileSystem
from corpuskit.operators.chunking import merge_metadata
from corpuskit.operators.dedupe import distinct_ids
from corpuskit.schemas import STORED

__all__ = ["CollectionStore", "CommitConflict", "stored_form"]

ID_BUCKETS = 32  # hash buckets of a collection's ids, fixed by its first commit
PAGE_BITS = 32_768  # a page of a Bloom filter: one id sets all its bits in one page
BITS_PER_ID, PROBES = 12, 5
SMALL_INDEX = 1_000_000  # ids of a collection below which they are all read, without asking the filters
MAX_COMMITS = 32  # live commits of a collection from which on ``ingest`` compacts it


def stored_form(chunks: DataFrame) -> DataFrame:
    """Chunks with the columns of ``schemas.STORED``: every column that is not one of them is metadata
    (as text, null values left out), under the metadata that the chunk brings along, plus its
    document's id (T15). So collections of different sources share one schema and lose nothing."""
    own = {f.name for f in STORED}
    extra = [c for c in chunks.columns if c not in own]
    pairs = [x for c in extra for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    parent = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    mine = F.col("metadata") if "metadata" in chunks.columns else F.create_map().cast("map<string,string>")
    mine = F.coalesce(mine, F.create_map().cast("map<string,string>"))
    doc_id = F.col("doc_id") if "doc_id" in chunks.columns else F.lit(None).cast("string")
    merged = F.map_filter(merge_metadata(parent, mine, doc_id), lambda _, v: v.isNotNull())
    column = lambda f: F.col(f.name).cast(f.dataType) if f.name in chunks.columns else F.lit(None).cast(f.dataType)
    return chunks.select(*[(merged if f.name == "metadata" else column(f)).alias(f.name) for f in STORED])


def _bucket(id_col: str, buckets):
    return F.pmod(F.xxhash64(id_col), buckets).cast("int")


def _page(id_col: str, pages):
    return F.pmod(F.xxhash64(id_col, F.lit(1)), pages).cast("int")


def _positions(id_col: str):
    return [F.pmod(F.xxhash64(id_col, F.lit(2 + i)), F.lit(PAGE_BITS)) for i in range(PROBES)]


def _bit_is_set(bitmap, position):
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("bit_get", byte, (position % 8).cast("int")) == 1


class CollectionStore:
    def __init__(self, spark: SparkSession, root: str, id_buckets: int = ID_BUCKETS, small_index: int = SMALL_INDEX):
        self.spark = spark
        self.root = root.rstrip("/")
        self.data, self.ids, self.blooms = (f"{self.root}/{x}" for x in ("data", "ids", "blooms"))
        self.staging = f"{self.root}/staging"
        self.quarantine_path = f"{self.root}/quarantine"
        self.id_buckets, self.small_index = id_buckets, small_index
        self.files = FileSystem(spark)

    # ------------------------------------------------------------ manifests
    def _log(self, name: str) -> CommitLog:
        return CommitLog(self.files, f"{self.root}/log/collection={self.files.escape(name)}")

    def manifest(self, name: str) -> dict:
        """The newest version of a collection: ``version`` (-1: never written), ``entries`` (live commits),
        ``runs`` (runs committed so far whose stage may still be there), ``buckets``."""
        return self._log(name).latest() or {"version": -1, "entries": [], "runs": [], "buckets": self.id_buckets}

    def version(self, name: str) -> int:
        return self.manifest(name)["version"]

    def _publish(self, name: str, mode: str, change, expected: int | None = None, run: str | None = None) -> dict:
        """Publish ``change(entries)`` as the next version. ``expected``: refuse (``CommitConflict``) if the
        collection is no longer at this version; otherwise start over from what another writer published."""
        def step(latest):
            latest = latest or {"version": -1, "entries": [], "runs": [], "buckets": self.id_buckets}
            if run is not None and run in latest["runs"]:
                return None  # this run is in already
            if expected is not None and latest["version"] != expected:
                raise CommitConflict(f"{name} is at version {latest['version']}, not {expected}")
            waiting = set(self._stage_folders(name))
            runs = [r for r in latest["runs"] if r in waiting] + ([run] if run else [])
            return {"mode": mode, "entries": change(latest["entries"]), "runs": runs, "buckets": latest["buckets"]}

        return self._log(name).commit(step)

    def _folder(self, base: str, commit: str, name: str) -> str:
        return f"{base}/commit={commit}/collection={self.files.escape(name)}"

    # ------------------------------------------------------------ reads
    def read(self, name: str | None = None, version: int | None = None) -> DataFrame | None:
        """A collection's chunks (or all collections); None when nothing is stored. Only folders of
        live commits are listed. Reading never creates a collection."""
        names = [name] if name is not None else self.list_collections()
        folders = []
        for n in names:
            state = self.manifest(n) if version is None else self._log(n).read(version)
            folders += [self._folder(self.data, e["commit"], n) for e in state["entries"] if e["rows"]]
        if not folders:
            return None
        return self._read_folders(folders)

    def _read_folders(self, folders: list, commit: bool = False) -> DataFrame:
        schema = StructType([*STORED.fields, StructField("commit", StringType()), StructField("collection", StringType())])
        df = self.spark.read.schema(schema).option("basePath", self.data).parquet(*folders)
        return df if commit else df.drop("commit")

    def read_commits(self, name: str, commits: list) -> DataFrame | None:
        """The chunks of some commits, with the commit of each."""
        folders = [self._folder(self.data, c, name) for c in commits]
        return self._read_folders(folders, commit=True) if folders else None

    def list_collections(self) -> list:
        """K3: names of the collections that hold something, from the manifests alone."""
        names = [self.files.unescape(x.split("=", 1)[1]) for x in self.files.names(f"{self.root}/log") if "=" in x]
        return sorted(n for n in names if self.collection_exists(n))

    def collection_exists(self, name: str) -> bool:
        return any(e["rows"] for e in self.manifest(name)["entries"])

    def existing_doc_ids(self, name: str, id_col: str = "doc_id") -> DataFrame:
        """Distinct non-null ids of the stored chunks of a collection as strings (one-column scan)."""
        df = self.read(name)
        if df is None or id_col not in df.columns:
            return self.spark.createDataFrame([], f"{id_col} string")
        return distinct_ids(df, id_col)

    def stored_ids(self, id_col: str = "doc_id") -> DataFrame:
        """K3 + K4 over all collections: distinct ``(collection, id)`` pairs."""
        df = self.read()
        if df is None:
            return self.spark.createDataFrame([], f"collection string, {id_col} string")
        return (df.where(F.col(id_col).isNotNull())
                  .select("collection", F.col(id_col).cast("string").alias(id_col)).distinct())

    # ------------------------------------------------------------ id index
    def known_ids(self, batch: DataFrame, name: str, id_col: str = "doc_id", commits: list | None = None) -> DataFrame:
        """Ids of the collection among which every stored id of ``batch`` is: what an anti join needs.

        The batch's ids are looked up in the Bloom filters of their buckets; only buckets of which a filter
        says that it may hold one are opened. A small index is read whole. ``commits``: of these only."""
        state = self.manifest(name)
        entries = [e for e in state["entries"] if e["ids"] and (commits is None or e["commit"] in commits)]
        none = self.spark.createDataFrame([], f"{id_col} string")
        if not entries:
            return none
        folders = [self._folder(self.ids, e["commit"], name) for e in entries]
        if sum(e["ids"] for e in entries) > self.small_index:
            folders = [f"{self._folder(self.ids, c, name)}/bucket={b}"
                       for c, b in self.buckets_to_open(batch, name, id_col, entries, state["buckets"])]
        if not folders:
            return none
        return (self.spark.read.schema("doc_id string, commit string, collection string, bucket int")
                .option("basePath", self.ids).parquet(*folders).select(F.col("doc_id").alias(id_col)))

    def buckets_to_open(self, batch: DataFrame, name: str, id_col: str, entries: list, buckets: int) -> list:
        """(commit, bucket) of the filters that may hold an id of the batch: at most one for each bucket of
        each live commit."""
        ids = batch.select(F.col(id_col).cast("string").alias("id")).where("id is not null").distinct()
        ids = ids.withColumn("bucket", _bucket("id", F.lit(buckets)))
        # no more commits than MAX_COMMITS are live for long: ingest compacts them
        pages = F.explode(F.array(*[F.struct(F.lit(e["commit"]).alias("commit"), F.lit(e["pages"]).alias("pages"))
                                    for e in entries]))
        want = ids.select("id", "bucket", pages.alias("e")).select(
            "bucket", F.col("e.commit").alias("commit"), _page("id", F.col("e.pages")).alias("page"),
            *[p.alias(f"p{i}") for i, p in enumerate(_positions("id"))])
        blooms = self.spark.read.schema("bucket int, page int, bits binary, commit string, collection string").option(
            "basePath", self.blooms).parquet(*[self._folder(self.blooms, e["commit"], name) for e in entries])
        may = want.join(blooms.drop("collection"), ["commit", "bucket", "page"])
        for i in range(PROBES):
            may = may.where(_bit_is_set(F.col("bits"), F.col(f"p{i}")))
        return sorted((r["commit"], r["bucket"]) for r in may.select("commit", "bucket").distinct().collect())

    def _write_ids(self, ids: DataFrame, commit: str, buckets: dict) -> dict:
        """Write the id files and filters of a commit from rows (collection, doc_id); ``buckets``: number of
        buckets by collection. Returns (number of ids, pages of a bucket's filter) by collection."""
        of = lambda numbers: F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])[F.col("collection")]
        rows = ids.select("collection", F.col("doc_id").cast("string").alias("doc_id")).where("doc_id is not null").distinct()
        path = f"{self.ids}/commit={commit}"
        (rows.withColumn("bucket", _bucket("doc_id", of(buckets))).repartition("collection", "bucket")
             .sortWithinPartitions("collection", "bucket", "doc_id").write.partitionBy("collection", "bucket").parquet(path))
        written = self.spark.read.schema("doc_id string, collection string, bucket int").parquet(path)
        counts = {r["collection"]: r["n"] for r in written.groupBy("collection").agg(F.count("*").alias("n")).collect()}
        pages = {c: max(1, -(-n * BITS_PER_ID // (buckets[c] * PAGE_BITS))) for c, n in counts.items()}
        if pages:
            bits = written.select("collection", "bucket", _page("doc_id", of(pages)).alias("page"),
                                  F.explode(F.array(*_positions("doc_id"))).alias("at"))
            (bits.groupBy("collection", "bucket", "page").agg(F.bitmap_construct_agg("at").alias("bits"))
                 .write.partitionBy("collection").parquet(f"{self.blooms}/commit={commit}"))
        return {c: (counts.get(c, 0), pages.get(c, 1)) for c in buckets}

    # ------------------------------------------------------------ writes
    def write_commit(self, chunks: DataFrame, name: str, ids: DataFrame | None = None) -> dict:
        """Write chunks (and the ids of their documents, or ``ids``) as folders of a new commit, which nobody
        sees until it is published; its entry."""
        commit = uuid.uuid4().hex[:16]
        folder = self._folder(self.data, commit, name)
        obs = Observation()
        stored_form(chunks).observe(obs, F.count(F.lit(1)).alias("n")).write.parquet(folder)
        if ids is None:
            ids = self.spark.read.schema(STORED).parquet(folder).select("doc_id")
        ids = ids.select(F.lit(name).alias("collection"), "doc_id")
        n_ids, pages = self._write_ids(ids, commit, {name: self.manifest(name)["buckets"]})[name]
        return {"commit": commit, "rows": obs.get.get("n", 0), "ids": n_ids, "pages": pages,
                "bytes": self.files.size(folder), "from": [commit]}

    def discard(self, entry: dict, name: str) -> None:
        """Delete the folders of a commit that is not to be published."""
        for base in (self.data, self.ids, self.blooms):
            self.files.delete(self._folder(base, entry["commit"], name))

    def append(self, chunks: DataFrame, name: str, ids: DataFrame | None = None, run: str | None = None,
               expected: int | None = None) -> None:
        """K1: one bulk append of chunks into collection ``name``; ``run`` is appended once."""
        entry = self.write_commit(chunks, name, ids)
        if not entry["rows"] and not entry["ids"]:
            return self.discard(entry, name)
        try:
            self._publish(name, "append", lambda live: [*live, entry], expected, run)
        except CommitConflict:
            self.discard(entry, name)
            raise

    def append_many(self, chunks: DataFrame, collection_col: str = "collection") -> None:
        """K1 for several collections in one write job (rows carry their collection); each collection
        is a commit of its own."""
        rows = stored_form(chunks.withColumnRenamed(collection_col, "collection"))
        rows = rows.withColumn("collection", F.col("metadata")["collection"]).withColumn(
            "metadata", F.map_filter("metadata", lambda k, _: k != "collection"))
        commit = uuid.uuid4().hex[:16]
        rows.write.partitionBy("collection").parquet(f"{self.data}/commit={commit}")
        written = self.spark.read.schema(StructType([*STORED.fields, StructField("collection", StringType())])).parquet(
            f"{self.data}/commit={commit}")
        counts = {r["collection"]: r["n"] for r in written.groupBy("collection").agg(F.count("*").alias("n")).collect()}
        ids = self._write_ids(written, commit, {name: self.manifest(name)["buckets"] for name in counts}) if counts else {}
        for name, (n_ids, pages) in ids.items():
            entry = {"commit": commit, "rows": counts[name], "ids": n_ids, "pages": pages,
                     "bytes": self.files.size(self._folder(self.data, commit, name)), "from": [commit]}
            self._publish(name, "append", lambda live, entry=entry: [*live, entry])

    def replace(self, chunks: DataFrame, name: str, ids: DataFrame | None = None, run: str | None = None) -> None:
        """K2 (fresh): the new data is written first and then becomes the whole collection in one step; other
        collections are untouched. No chunks leave an empty collection."""
        entry = self.write_commit(chunks, name, ids)
        self._publish(name, "replace", lambda _: [entry] if entry["rows"] or entry["ids"] else [], run=run)

    def drop(self, name: str) -> None:
        """K2: empty a collection; no-op when absent. ``vacuum`` frees the space."""
        if self.manifest(name)["entries"]:
            self._publish(name, "drop", lambda _: [])

    def compact(self, name: str, target_bytes: int = 256 << 20) -> int:
        """Put the commits that are smaller than ``target_bytes`` together into one; how many went into it.
        Appends meanwhile stay; if one of the commits is replaced meanwhile, nothing is done."""
        small = [e for e in self.manifest(name)["entries"] if e["bytes"] < target_bytes]
        if len(small) < 2:
            return 0
        gone = {e["commit"] for e in small}
        chunks = self.read_commits(name, [e["commit"] for e in small if e["rows"]] or [small[0]["commit"]])
        ids = self.spark.read.schema("doc_id string, bucket int").option("basePath", self.ids).parquet(
            *[self._folder(self.ids, e["commit"], name) for e in small if e["ids"]]) if any(e["ids"] for e in small) \
            else self.spark.createDataFrame([], "doc_id string")
        parts = max(1, -(-sum(e["bytes"] for e in small) // target_bytes))
        entry = self.write_commit(chunks.drop("commit", "collection").repartition(parts), name, ids)
        entry["from"] = [c for e in small for c in e["from"]]

        def change(live):
            if not gone <= {e["commit"] for e in live}:
                raise CommitConflict(f"{name} was replaced while it was compacted")
            return [*[e for e in live if e["commit"] not in gone], entry]

        try:
            self._publish(name, "compact", change)
        except CommitConflict:
            self.discard(entry, name)
            return 0
        return len(small)

    def vacuum(self, name: str, keep_versions: int = 1) -> int:
        """Delete folders of the collection that none of its last ``keep_versions`` manifests names, and the
        older manifests; how many commits went. Not while somebody writes to or reads an older version."""
        log = self._log(name)
        versions = log.versions()
        keep = versions[-keep_versions:]
        live = {e["commit"] for v in keep for e in log.read(v)["entries"]}
        gone = 0
        for folder in self.files.names(self.data):
            commit = folder.split("=", 1)[-1]
            if commit not in live and self.files.exists(self._folder(self.data, commit, name)):
                self.discard({"commit": commit}, name)
                gone += 1
        for v in versions[:-keep_versions]:
            log.forget(v)
        return gone

    # ------------------------------------------------------------ staging (K6) and quarantine (Q2)
    def _run(self, name: str, run_id: str) -> str:
        return f"{self.staging}/collection={self.files.escape(name)}/run={run_id}"

    def stage(self, chunks: DataFrame, name: str, run_id: str | None = None, mode: str = "append",
              base: int | None = None) -> tuple:
        """Persist chunks before embedding; returns (run_id, staged DataFrame). Kept with the run: its mode
        (``append`` or ``fresh``) and the version of the collection in which it looked for stored ids (the
        current one by default). The run is there once its last file, this note, is."""
        run_id = run_id or uuid.uuid4().hex[:12]
        path = self._run(name, run_id)
        base = self.version(name) if base is None else base
        chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        self.files.put(f"{path}/run.json", json.dumps({"mode": mode, "base": base}))
        return run_id, self.spark.read.parquet(f"{path}/chunks")

    def _stage_folders(self, name: str) -> dict:
        """Run id -> whether it was staged whole."""
        base = f"{self.staging}/collection={self.files.escape(name)}"
        runs = [x.split("=", 1)[1] for x in self.files.names(base) if x.startswith("run=")]
        return {r: self.files.exists(f"{self._run(name, r)}/run.json") for r in sorted(runs)}

    def staged_runs(self, name: str) -> list:
        """Runs whose chunks are staged whole and wait to be embedded."""
        return [r for r, whole in self._stage_folders(name).items() if whole and not r.endswith("-vectors")]

    def drop_broken_stages(self, name: str) -> None:
        """Delete what a lost job left half written, and vectors, which are made anew from their run. One
        job at a time stages for a collection."""
        for run, whole in self._stage_folders(name).items():
            if not whole or run.endswith("-vectors"):
                self.clear_stage(name, run)

    def staged(self, name: str, run_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._run(name, run_id)}/chunks")

    def staged_note(self, name: str, run_id: str) -> dict:
        """``mode`` and ``base`` of a staged run."""
        return json.loads(self.files.text(f"{self._run(name, run_id)}/run.json"))

    def commits_since(self, name: str, version: int) -> list:
        """Live commits that are not made of commits of this version (all, when it is gone)."""
        log = self._log(name)
        known = {c for e in log.read(version)["entries"] for c in e["from"]} if version in log.versions() else set()
        return [e["commit"] for e in self.manifest(name)["entries"] if not set(e["from"]) <= known]

    def is_committed(self, name: str, run_id: str) -> bool:
        return run_id in self.manifest(name)["runs"]

    def clear_stage(self, name: str, run_id: str) -> None:
        self.files.delete(self._run(name, run_id))

    def quarantine(self, failed: DataFrame, name: str, run_id: str | None = None) -> None:
        """Keep chunks that could not be embedded; those of a run once, however often it is repeated."""
        path = f"{self.quarantine_path}/collection={self.files.escape(name)}/run={run_id or uuid.uuid4().hex[:12]}"
        failed.write.mode("overwrite").parquet(path)

    def quarantined(self, name: str) -> DataFrame | None:
        base = f"{self.quarantine_path}/collection={self.files.escape(name)}"
        runs = [f"{base}/{x}" for x in self.files.names(base) if self.files.exists(f"{base}/{x}/_SUCCESS")]
        return self.spark.read.parquet(*runs) if runs else None

    def clear_quarantine(self, name: str) -> None:
        self.files.delete(f"{self.quarantine_path}/collection={self.files.escape(name)}")
