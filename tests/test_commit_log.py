"""The commit log of the store: deaths at every step, two writers, readers of old versions, the id index."""

import os

import pytest
from pyspark.sql import functions as F

from corpuskit.commitlog import CommitConflict, CommitLog, FileSystem
from corpuskit.config import Settings
from corpuskit.plans import ingest as ingest_module
from corpuskit.plans.ingest import ingest
from corpuskit.store import CollectionStore

S = Settings(chunk_size=16, chunk_overlap=2)


def docs(spark, ids, word="w"):
    return spark.createDataFrame([(str(i), f"{word} " * (i % 40 + 1)) for i in ids], "doc_id string, text string")


def stored(st, name="c"):
    df = st.read(name)
    return [] if df is None else sorted(r.chunk_id for r in df.select("chunk_id").collect())


class Death(RuntimeError):
    pass


def test_a_version_is_published_once(spark, tmp_dir):
    files = FileSystem(spark)
    log = CommitLog(files, f"{tmp_dir}/log")
    assert log.latest() is None and log.versions() == []
    assert log.commit(lambda latest: {"n": 1})["version"] == 0
    assert not files.put_if_absent(f"{tmp_dir}/log/{0:020d}.json", "{}")  # taken
    assert log.latest()["n"] == 1
    seen = []

    def slow(latest):  # another writer is faster, once
        seen.append(latest["version"])
        if len(seen) == 1:
            log.commit(lambda x: {"n": x["n"] + 10})
        return {"n": latest["n"] + 1}

    assert log.commit(slow) == {"n": 12, "version": 2} and seen == [0, 1]
    assert log.commit(lambda latest: None)["version"] == 2
    files.put(f"{tmp_dir}/note", "a")
    files.put(f"{tmp_dir}/note", "b")
    assert files.text(f"{tmp_dir}/note") == "b"
    assert [n for n in os.listdir(f"{tmp_dir}/log") if "tmp" in n and not n.endswith(".crc")] == []


def test_reader_keeps_its_version_and_vacuum(spark, tmp_dir):
    st = CollectionStore(spark, f"{tmp_dir}/s")
    ingest(docs(spark, range(5)), st, "c", settings=S)
    before, version = st.read("c"), st.version("c")
    ingest(docs(spark, range(5, 7)), st, "c", settings=S, fresh=True)
    assert before.select("doc_id").distinct().count() == 5  # a plan made before sees what it saw
    assert st.read("c", version=version).select("doc_id").distinct().count() == 5
    assert st.read("c").select("doc_id").distinct().count() == 2
    os.makedirs(f"{tmp_dir}/s/data/commit=dead/collection=c")  # a writer that died before its commit
    assert st.vacuum("c") == 2
    assert st.read("c").select("doc_id").distinct().count() == 2 and os.listdir(f"{tmp_dir}/s/data/commit=dead") == []


STEPS = ["stage", "quarantine_check", "write_commit", "publish", "clear"]


@pytest.mark.parametrize("fresh", [False, True])
@pytest.mark.parametrize("step", STEPS)
def test_death_at_each_step(spark, tmp_dir, monkeypatch, step, fresh):
    """Whatever dies, the collection holds the old or the new state, and the next call ends with the same rows."""
    st = CollectionStore(spark, f"{tmp_dir}/s")
    ingest(docs(spark, range(4)), st, "c", settings=S)
    old = stored(st)
    whole = CollectionStore(spark, f"{tmp_dir}/whole")
    ingest(docs(spark, range(4)), whole, "c", settings=S)
    ingest(docs(spark, range(2, 9)), whole, "c", settings=S, fresh=fresh)
    want = stored(whole)

    def dies(*a, **k):
        raise Death

    with monkeypatch.context() as m:
        if step == "stage":  # chunks are written, the note that the run is whole is not
            m.setattr(st.files, "put", dies)
        elif step == "quarantine_check":
            m.setattr(ingest_module, "quarantine", dies)
        elif step == "write_commit":  # the chunks' folder is there, the commit is not
            m.setattr(st, "_write_ids", dies)
        elif step == "publish":
            m.setattr(st, "_publish", dies)
        else:
            m.setattr(st, "clear_stage", dies)
        with pytest.raises(Death):
            ingest(docs(spark, range(2, 9)), st, "c", settings=S, fresh=fresh)
    assert stored(st) == (want if step == "clear" else old)
    report = ingest(docs(spark, range(2, 9)), st, "c", settings=S)
    if step == "stage":
        # nothing was staged: the second call, which is no fresh one, adds what is new
        want = stored(whole) if not fresh else sorted({*old, *want})
        assert report.resumed_run is None
    else:
        assert report.resumed_run and report.docs_new == 0
    assert stored(st) == want and st.staged_runs("c") == []
    ingest(docs(spark, range(2, 9)), st, "c", settings=S)
    assert stored(st) == want


def test_two_writers_at_once(spark, tmp_dir, monkeypatch):
    """A second job commits other and equal documents while the first has written, but not published."""
    st, other = CollectionStore(spark, f"{tmp_dir}/s"), CollectionStore(spark, f"{tmp_dir}/s")
    publish, done = st._publish, []

    def late(name, *a, **k):
        if not done:
            done.append(1)
            other.append(_chunks(spark, range(3, 8)), "c")
        return publish(name, *a, **k)

    monkeypatch.setattr(st, "_publish", late)
    ingest(docs(spark, range(5)), st, "c", settings=S)
    ids = [c.split("#")[0] for c in stored(st)]
    assert sorted(set(ids)) == [str(i) for i in range(8)]
    assert len(stored(st)) == len(set(stored(st)))  # documents 3 and 4 once
    with pytest.raises(CommitConflict):
        st.append(_chunks(spark, [99]), "c", expected=0)
    assert "99" not in {c.split("#")[0] for c in stored(st)}


def _chunks(spark, ids):
    return docs(spark, ids).selectExpr("doc_id", "concat(doc_id, '#0') as chunk_id", "0 as chunk_index", "text",
                                       "array(1f, 2f) as embedding")


def test_compaction(spark, tmp_dir, monkeypatch):
    st = CollectionStore(spark, f"{tmp_dir}/s")
    for n in range(4):
        st.append(_chunks(spark, range(10 * n, 10 * n + 10)), "c")
    before = stored(st)
    assert len(before) == 40 and len(st.manifest("c")["entries"]) == 4
    assert st.compact("c") == 4 and st.compact("c") == 0
    (entry,) = st.manifest("c")["entries"]
    assert stored(st) == before and entry["rows"] == entry["ids"] == 40
    assert ingest(docs(spark, range(40)), st, "c", settings=S).docs_new == 0
    st.append(_chunks(spark, [50]), "c")
    publish = st._publish
    monkeypatch.setattr(st, "_publish", lambda name, mode, *a, **k: (  # replaced while it is compacted
        CollectionStore(spark, f"{tmp_dir}/s").replace(_chunks(spark, [7]), "c") if mode == "compact" else None,
        publish(name, mode, *a, **k))[1])
    assert st.compact("c") == 0 and stored(st) == ["7#0"]


def test_names_that_folders_escape(spark, tmp_dir):
    st = CollectionStore(spark, f"{tmp_dir}/s")
    rows = docs(spark, range(3)).selectExpr("case doc_id when '0' then 'a:b/c' else 'x y' end as collection", "doc_id",
                                            "doc_id as chunk_id", "text")
    st.append_many(rows)
    assert st.list_collections() == ["a:b/c", "x y"]
    assert [r.doc_id for r in st.read("a:b/c").collect()] == ["0"]
    assert sorted(map(tuple, st.stored_ids().collect())) == [("a:b/c", "0"), ("x y", "1"), ("x y", "2")]


def test_null_ids_and_documents_without_chunks(spark, tmp_dir):
    st = CollectionStore(spark, f"{tmp_dir}/s")
    rows = spark.createDataFrame([(None, "one"), (None, "two"), (None, "two"), ("e", ""), ("n", None), ("b", "  \n"), ("x", "one")],
                                 "doc_id string, text string")
    first = ingest(rows, st, "c", settings=S)
    assert (first.docs_loaded, first.docs_without_id, first.docs_new, first.chunks) == (7, 3, 6, 3)
    again = ingest(rows, st, "c", settings=S)
    assert again.docs_new == 0 and again.docs_skipped == 7
    assert sorted(r.text for r in st.read("c").collect()) == ["one", "one", "two"]
    assert st.read("c").where("doc_id is null or chunk_id is null").count() == 0
    numbers = spark.createDataFrame([(1, "a"), (None, "b")], "doc_id long, text string")
    assert ingest(numbers, st, "n", settings=S).docs_new == 2 and ingest(numbers, st, "n", settings=S).docs_new == 0


def test_id_index_opens_few_buckets(spark, tmp_dir):
    st = CollectionStore(spark, f"{tmp_dir}/s", id_buckets=128, small_index=0)
    many = spark.range(20_000).selectExpr("concat('d', id) as doc_id", "concat('d', id, '#0') as chunk_id", "'t' as text")
    st.append(many, "c")
    state = st.manifest("c")
    asked = lambda q: st.buckets_to_open(q, "c", "doc_id", state["entries"], state["buckets"])
    new = spark.range(100).selectExpr("concat('new', id) as doc_id")
    assert len(asked(new)) <= 6  # the filters say no: one id in a hundred at most passes
    old = spark.range(0, 200, 10).selectExpr("concat('d', id) as doc_id")
    opened = asked(old)
    assert len(opened) <= 22
    known = st.known_ids(old.unionByName(new), "c")
    files = known.inputFiles()
    assert len(files) <= 30 < len(os.listdir(f"{tmp_dir}/s/ids/commit={state['entries'][0]['commit']}/collection=c"))
    got = {r.doc_id for r in known.join(old, "doc_id", "left_semi").collect()}
    assert got == {f"d{i}" for i in range(0, 200, 10)}
    # no stored id is ever missed
    assert many.join(st.known_ids(many, "c"), "doc_id", "left_anti").count() == 0
    assert st.known_ids(new.where("doc_id is null"), "c").count() == 0
    report = ingest(spark.range(19_990, 20_020).selectExpr("concat('d', id) as doc_id", "'t' as text"), st, "c", settings=S)
    assert report.docs_new == 20 and report.docs_skipped == 10
    assert st.existing_doc_ids("c").count() == 20_020


def test_streamed_batches_find_their_ids_by_the_index(spark, tmp_dir):
    from corpuskit.streaming.ingest import stream_documents, stream_ingest

    st = CollectionStore(spark, f"{tmp_dir}/s", id_buckets=32, small_index=0)
    src = f"{tmp_dir}/in"
    docs(spark, range(30)).coalesce(1).write.parquet(src)
    schema = docs(spark, [0]).schema
    for n in range(2):
        stream_ingest(stream_documents(spark, src, schema), st, "c", checkpoint=f"{tmp_dir}/ck{n}", settings=S).awaitTermination()
        assert st.read("c").select("doc_id").distinct().count() == 30
    docs(spark, range(25, 40)).coalesce(1).write.mode("append").parquet(src)
    stream_ingest(stream_documents(spark, src, schema), st, "c", checkpoint=f"{tmp_dir}/ck1", settings=S).awaitTermination()
    assert st.read("c").select("doc_id").distinct().count() == 40
    assert st.read("c").groupBy("chunk_id").count().where(F.col("count") > 1).count() == 0
