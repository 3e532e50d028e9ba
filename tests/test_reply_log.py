"""Commits that are whole or absent, and the index against the anti-join."""

import json
import os

import pytest
from pyspark.sql import functions as F

from verdict import schemas
from verdict.config import FIXTURE
from verdict.operators import replies as rp
from verdict.sources.reply_log import ReplyLog

KEYS = schemas.WORK_KEYS


def work(spark, prompts=40, models=("m/a", "m/b"), reps=2):
    rows = [(f"p{i}", m, meth, r, "rt", 0.5, 64, f"prompt {i}") for i in range(prompts) for m in models
            for meth in ("baseline", "span") for r in range(1, reps + 1)]
    return spark.createDataFrame(rows, "prompt_id string, model string, method string, replicate int, runtime string, "
                                       "temperature double, max_tokens int, prompt string")


def echo(records):
    return [f"Label: {r['prompt']}/{r['replicate']}" for r in records]


def keys(df):
    return sorted(tuple(r) for r in df.select(*KEYS).collect())


def test_collects_each_reply_once(spark, scratch):
    log = ReplyLog(spark, f"{scratch}/log", buckets=3)
    owed = work(spark, 20)
    assert rp.collect_committed(owed, log, echo, size=7, tasks=2) == 160
    got = log.read()
    assert keys(got) == keys(owed) and got.schema == schemas.LOG
    assert {r["response"] for r in got.where("prompt_id = 'p3' and replicate = 2").collect()} == {"Label: prompt 3/2"}
    assert log.read(model="m/a", method="span").count() == 40
    assert rp.collect_committed(owed, log, echo, tasks=2) == 0
    assert ReplyLog(spark, f"{scratch}/log", buckets=99).buckets == 3


def test_killed_between_write_and_commit(spark, scratch, monkeypatch):
    log = ReplyLog(spark, f"{scratch}/log", buckets=2)
    owed = work(spark, 12)
    publish, calls = ReplyLog._publish, []

    def dies(self, name, content):
        calls.append(name)
        if len(calls) == 2:
            raise KeyboardInterrupt  # files and index are written, nothing published
        return publish(self, name, content)
    monkeypatch.setattr(ReplyLog, "_publish", dies)
    with pytest.raises(KeyboardInterrupt):
        rp.collect_committed(owed, log, echo, slices=2, tasks=2)
    monkeypatch.setattr(ReplyLog, "_publish", publish)
    seen = keys(log.read())
    assert 0 < len(seen) < 96 and len(log.commits()) == 1  # one slice of one bucket
    left = log.outstanding(owed)
    assert keys(left) == sorted(set(keys(owed)) - set(seen))
    asked = []
    assert rp.collect_committed(owed, log, echo, slices=2, tasks=2) == 96 - len(seen)
    assert keys(log.read()) == keys(owed) and not asked
    assert log.vacuum() == 2 and keys(log.read()) == keys(owed)  # its files and its index


def test_two_writers_do_not_double(spark, scratch):
    log = ReplyLog(spark, f"{scratch}/log", buckets=1)
    owed = work(spark, 10)
    first = rp.call_judge_batches(owed.where("prompt_id < 'p6'"), echo)
    second = rp.call_judge_batches(owed.where("prompt_id > 'p3'"), echo)
    assert log.append(first, 0, since=0) == 48
    assert log.append(second, 0, since=0) == 32  # began from the same version
    assert keys(log.read()) == keys(owed)
    assert log.append(second, 0, since=0) == 0
    assert [c["rows"] for c in log.commits()[0]] == [48, 32]
    assert not log._publish("000000-00000002", {"token": "other"})


def test_index_equals_the_anti_join_and_is_rebuilt(spark, scratch):
    log = ReplyLog(spark, f"{scratch}/log", buckets=3)
    owed = work(spark, 30, reps=3)

    def moody(records):
        return [ValueError("no") if int(r["prompt_id"][1:]) % 5 == 0 else "Label: x" for r in records]
    rp.collect_committed(owed.where("prompt_id < 'p2'"), log, moody, tasks=2)
    rp.collect_committed(owed.where("replicate = 2 and model = 'm/b'"), log, moody, tasks=2)
    for retry in (False, True):
        assert keys(log.outstanding(owed, retry)) == keys(rp.outstanding(owed, log.read(), retry))
    assert log.index().count() <= 3 * 2 * 2  # a row per bucket, model and method
    newest = log.commits()[0][-1]["token"]
    os.rename(f"{log.path.removeprefix('file:')}/index/{newest}", f"{log.path.removeprefix('file:')}/index-{newest}")
    assert keys(log.outstanding(owed)) == keys(rp.outstanding(owed, log.read()))
    plan = log.outstanding(owed)._jdf.queryExecution().executedPlan().toString()
    assert "/index/" in plan and "/files/" not in plan


def test_failures_stay_with_their_rows():
    asked = []

    def ask(records):
        asked.append(len(records))
        if any(r["n"] == 5 for r in records):
            raise RuntimeError("bad batch")
        return [KeyError("k") if r["n"] == 2 else None if r["n"] == 3 else str(r["n"]) for r in records]
    got = rp.settle(ask, [{"n": n} for n in range(8)])
    assert got == [("0", ""), ("1", ""), (None, "KeyError: 'k'"), (None, "no reply"), ("4", ""), (None, "RuntimeError: bad batch"), ("6", ""), ("7", "")]
    assert asked == [8, 4, 4, 2, 1, 1, 2]
    assert rp.settle(lambda rs: ["one"], [{}, {}])[0] == ("one", "")  # too few replies: asked one by one


def test_calls_in_flight_are_limited():
    import threading
    import time
    now, most, lock = [0], [0], threading.Lock()

    def ask(records):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.01)
        with lock:
            now[0] -= 1
        return [r["n"] for r in records]
    taken = []

    def groups():
        for n in range(30):
            taken.append(n)
            yield [{"n": n}]
    out = []
    for g, settled in rp.in_order(ask, groups(), 4):
        out.append(settled[0][0])
        assert len(taken) <= len(out) + 4  # no more are read ahead than asked
    assert out == list(range(30)) and 1 < most[0] <= 4


def test_layout_is_text(spark, scratch):
    log = ReplyLog(spark, f"{scratch}/log", buckets=5)
    with open(f"{log.path.removeprefix('file:')}/commits/layout") as f:
        assert json.load(f) == {"buckets": 5}
    assert log.read().count() == 0 and log.outstanding(work(spark, 2)).count() == 16
    assert log.read().select(F.max("logged_at")).first()[0] is None


def test_index_parts_hold_every_key_once_and_sorted():
    """A part of a bucket is looked up alone, so wanted rows with prompts are never one group."""
    import numpy as np
    import pyarrow as pa

    from verdict.sources import reply_log
    hashes = np.unique(np.random.default_rng(1).integers(-2**63, 2**63 - 1, 5000))
    bits = np.arange(len(hashes)) % 14
    row = pa.RecordBatch.from_pylist([{"bucket": 1, "model": "m", "method": None, "prompts": reply_log._pack(hashes),
                                       "logged": reply_log._pack(bits), "fine": reply_log._pack(bits // 2)}])
    parts = [p.to_pylist()[0] for p in reply_log._in_parts(iter([row]))]
    assert len(parts) == reply_log.PARTS and {p["method"] for p in parts} == {None}
    found = {}
    for p in parts:
        own, logged, fine = (reply_log._unpack(p[c]) for c in ("prompts", "logged", "fine"))
        assert (np.diff(own) > 0).all() and (own % reply_log.PARTS == p["_part"]).all()
        found |= dict(zip(own.tolist(), zip(logged.tolist(), fine.tolist())))
    assert found == dict(zip(hashes.tolist(), zip(bits.tolist(), (bits // 2).tolist())))
