"""Calls to a service: a rate that tasks share, streams of tokens."""

import fcntl
import json
import time

import pytest
from pyspark.sql import functions as F

from corpuskit.operators.embedding import RateLimited, ServiceError, SlotPacer, embed, quarantine
from corpuskit.operators.latency import cumulative_text, first_token_latency, model_latency
from corpuskit.operators.prompts import answer_batch, answer_stream, chat_messages


class Clock:
    def __init__(self):
        self.now = 1000.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def test_slots_of_tasks_do_not_meet():
    calls = []
    for index in range(4):
        clock = Clock()
        pacer = SlotPacer(10, index, 4, clock, clock.sleep)
        for _ in range(50):
            pacer.wait()
            calls.append(clock.now)
    calls.sort()
    assert len({int(t * 9 + 1e-6) for t in calls}) == len(calls)  # one call a slot; a tenth of 10 is kept in hand
    assert all(sum(t <= x < t + 1 for x in calls) <= 10 for t in calls)


def test_pacer_backs_off_and_comes_back():
    clock = Clock()
    pacer = SlotPacer(10, 0, 1, clock, clock.sleep)
    refuse = [True, True] + [False] * 40

    def service(x):
        if refuse.pop(0):
            raise RateLimited()
        return x

    call = pacer.paced(service)
    for _ in range(2):
        with pytest.raises(RateLimited):
            call(1)
    assert pacer.every == 4
    for _ in range(16):
        call(1)
    assert pacer.every == 1


class Gate:
    """An embedder whose service counts calls in a file and refuses more than ``limit`` in any second."""

    def __init__(self, path, limit):
        self.path, self.limit = path, limit

    def __call__(self, texts):
        with open(self.path, "a+") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.seek(0)
            log = [json.loads(x) for x in f]
            now = time.time()
            refused = sum(now - 1 < t for t, ok in log if ok) >= self.limit
            f.write(json.dumps([now, not refused]) + "\n")
        if refused:
            raise RateLimited("too many")
        return [[1.0, float(len(t))] for t in texts]


def test_tasks_share_a_rate(spark, tmp_dir):
    df = spark.createDataFrame([(i, "x" * i) for i in range(60)], "id long, text string").repartition(7)
    embedded = embed(df, Gate(f"{tmp_dir}/calls", 20), batch_size=1, concurrency=4, rate=20, base_delay=0.05)
    out = embedded.collect()
    assert sorted(r.id for r in out) == list(range(60)) and all(r.embed_error is None for r in out)
    with open(f"{tmp_dir}/calls") as f:
        log = [json.loads(x) for x in f]
    times = sorted(t for t, _ in log)
    assert max(sum(t <= x < t + 1 for x in times) for t in times) <= 21
    ok, bad = quarantine(spark.createDataFrame(out, embedded.schema))
    assert ok.count() == 60 and bad.count() == 0
    with pytest.raises(ValueError):
        embed(df, Gate("x", 1), rate=5)


class Stream:
    def __init__(self, fails=0, breaks_at=None):
        self.fails, self.breaks_at = fails, breaks_at

    def __call__(self, request):
        if self.fails:
            self.fails -= 1
            raise ServiceError(503)
        text = request if isinstance(request, str) else request[-1]["content"]
        for i, word in enumerate(text.split(" ")):
            if i == self.breaks_at:
                raise ServiceError(500, "broke")
            yield word + " "


def prompts(spark):
    return spark.createDataFrame([(1, "a b c", "m1"), (2, "", "m2"), (3, None, None), (4, "x", "m1")],
                                 "response_id long, prompt string, model string").coalesce(1)


def test_stream_feeds_the_statistics(spark):
    rows = answer_stream(prompts(spark), Stream(fails=2), model="model", base_delay=0.0, sleep=lambda s: None)
    rows = rows.cache()
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.response_id, r.seq)):
        got.setdefault(r.response_id, []).append((r.seq, r.delta, r.is_final, r.error))
        assert r.ts >= r.start
    assert got[1] == [(0, "a ", False, None), (1, "b ", False, None), (2, "c ", False, None), (3, "", True, None)]
    assert got[3] == [(0, " ", False, None), (1, "", True, None)] and len(got) == 4
    text = {r.response_id: r.text for r in cumulative_text(rows, final_only=True).collect()}
    assert text[1] == "a b c "
    first = first_token_latency(rows, start="start", model="model")
    assert {r.response_id for r in first.collect()} == {1, 2, 4}  # a response without a model is not measured
    assert {r.response_id: r.ttft_ms is None for r in first.collect()} == {1: False, 2: True, 4: False}
    stats = model_latency(first.withColumn("n", F.lit(0)), value="ttft_ms", order=("first_ts", "response_id"))
    assert {r.model: r.runs for r in stats.collect()} == {"m1": 2}


def test_stream_that_breaks_keeps_its_deltas(spark):
    rows = answer_stream(prompts(spark).where("response_id = 1"), Stream(breaks_at=2), base_delay=0.0).collect()
    assert [r.delta for r in rows] == ["a ", "b ", ""] and "broke" in rows[-1].error and rows[-1].is_final
    down = answer_stream(prompts(spark).where("response_id = 1"), Stream(fails=9), max_retries=2, base_delay=0.0).collect()
    assert len(down) == 1 and "503" in down[0].error and down[0].seq == 0


class Endless:
    def __call__(self, request):
        n = 0
        while True:
            yield f"{n} "
            n += 1


def test_endless_stream_is_read_as_far_as_wanted(spark):
    rows = answer_stream(prompts(spark).where("response_id = 1"), Endless()).limit(100).collect()
    assert [r.delta for r in rows] == [f"{i} " for i in range(100)]


class Echo:
    def __call__(self, chats):
        return [" / ".join(f"{m['role']}={m['content']}" for m in c) if c else "" for c in chats]


def test_chat_completions(spark):
    turns = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "assistant", None), (2, 1, "user", "x")],
                                  "conv_id long, turn int, role string, text string")
    chats = chat_messages(turns)
    got = {r.conv_id: r.answer for r in answer_batch(chats, Echo(), prompt_col="messages").collect()}
    assert got == {1: "user=hi / assistant=", 2: "user=x"}
    streamed = answer_stream(chats, Stream(), response="conv_id", prompt_col="messages").where("not is_final").collect()
    assert sorted((r.conv_id, r.delta) for r in streamed) == [(1, " "), (2, "x ")]
