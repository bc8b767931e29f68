import datetime as dt
import os

from pyspark.sql import functions as F

from corpuskit.config import Settings
from corpuskit.operators.latency import model_latency
from corpuskit.store import CollectionStore
from corpuskit.streaming.ingest import stream_documents, stream_ingest
from corpuskit.streaming.state import stream_cumulative_text, stream_model_latency
from tests.conftest import SF001


def test_stream_ingest_replay_adds_nothing(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where("doc_id < 40").select(
        F.col("doc_id").cast("string").alias("doc_id"), "text")
    docs.orderBy(F.rand(3)).repartition(4).write.parquet(src)
    st = CollectionStore(spark, os.path.join(tmp_dir, "store"))
    s = Settings(chunk_size=64, chunk_overlap=8)
    q = stream_ingest(stream_documents(spark, src, docs.schema, max_files_per_trigger=1), st, "documents",
                      os.path.join(tmp_dir, "ck1"), settings=s)
    q.awaitTermination()
    n = st.read("documents").count()
    assert n > 0 and len(q.reports) >= 1
    q2 = stream_ingest(stream_documents(spark, src, docs.schema), st, "documents", os.path.join(tmp_dir, "ck2"), settings=s)
    q2.awaitTermination()
    assert st.read("documents").count() == n


def test_stream_model_latency_equals_batch(spark, tmp_dir):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=(i * 7919) % 1000), "m" + str(i % 3), float((i * 37) % 101))
            for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, model string, ttft_ms double")
    src = os.path.join(tmp_dir, "ev")
    df.orderBy("ts").coalesce(1).write.parquet(src)  # arrival order = time order
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = (stream_model_latency(stream).writeStream.outputMode("update").format("memory")
         .queryName("lat_out").option("checkpointLocation", os.path.join(tmp_dir, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {r.model: (r.runs, r.avg_ttft_ms) for r in spark.sql("select * from lat_out").collect()}
    want = {r.model: (r.runs, r.avg_ttft_ms) for r in model_latency(df).collect()}
    assert got == want


def test_stream_cumulative_text(spark, tmp_dir):
    rows = [("r1", 1, "a", False), ("r1", 2, "", False), ("r1", 3, "b", True), ("r2", 1, "x", False)]
    df = spark.createDataFrame(rows, "response_id string, seq long, delta string, done boolean")
    src = os.path.join(tmp_dir, "tok")
    df.coalesce(1).write.parquet(src)
    q = (stream_cumulative_text(spark.readStream.schema(df.schema).parquet(src), is_final="done")
         .writeStream.outputMode("append").format("memory").queryName("cum_out")
         .option("checkpointLocation", os.path.join(tmp_dir, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = sorted((r.response_id, r.seq, r.text_so_far) for r in spark.sql("select * from cum_out").collect())
    assert got == [("r1", 1, "a"), ("r1", 3, "ab"), ("r2", 1, "x")]


def test_stream_latency_state_survives_restart(spark, tmp_dir):
    import time as _time
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=i), "m" + str(i % 2), float((i * 53) % 97) + 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, model string, ttft_ms double")
    src, ck = os.path.join(tmp_dir, "ev"), os.path.join(tmp_dir, "ck")

    def write_part(lo, hi):
        # one file per part, written in time order (the file source takes files by age)
        df.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).coalesce(1) \
          .write.mode("append").parquet(src)
        _time.sleep(1.1)

    latest = {}

    def keep(batch, epoch_id):
        for r in batch.collect():  # a handful of rows per micro-batch (one per model)
            latest[r.model] = (r.runs, r.avg_ttft_ms)

    def run(name):
        q = (stream_model_latency(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src))
             .writeStream.outputMode("update").foreachBatch(keep)
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
        return dict(latest)

    write_part(0, 100)
    write_part(100, 200)
    first = run("lat_a")
    write_part(200, 300)
    write_part(300, 400)
    second = run("lat_b")  # restarted from the same checkpoint: state carried over
    want = {r.model: (r.runs, r.avg_ttft_ms) for r in model_latency(df).collect()}
    assert second == want and first != want


def test_latency_table_folds_each_epoch_once(spark, tmp_dir):
    from corpuskit.streaming.state import LatencyTable, stream_latency_table

    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=i), "m" + str(i % 5 // 4), float((i * 53) % 97) + 0.5) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, model string, ttft_ms double")
    src, root = os.path.join(tmp_dir, "ev"), os.path.join(tmp_dir, "table")
    import time as _time
    for n in range(3):
        df.where(f"event_id div 200 = {n}").coalesce(1).write.mode("append").parquet(src)
        _time.sleep(1.1)  # the file source takes files by age
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    stream_latency_table(stream, root, os.path.join(tmp_dir, "ck")).awaitTermination()
    table = LatencyTable(spark, root)
    want = {r.model: (r.runs, r.avg_ttft_ms) for r in model_latency(df).collect()}
    assert {r.model: (r.runs, r.avg_ttft_ms) for r in table.read().collect()} == want
    assert not table.fold(df, 2) and not table.fold(df, 0)  # epochs that come again
    assert {r.model: (r.runs, r.avg_ttft_ms) for r in table.read().collect()} == want
    assert table.fold(df.limit(0), 3) and table.read().count() == len(want)
