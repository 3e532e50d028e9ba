"""Owed replies, calls, bodies, review round, durable collection."""

import json

from pyspark.sql import functions as F

from verdict.config import FIXTURE
from verdict.operators import prompts as prompt_ops
from verdict.operators import replies
from verdict.sources import fixture as fx
from verdict.sources import tables

from .conftest import SF_SMALL


def test_outstanding_of_wanted_is_empty(spark):
    w = replies.wanted_replies(fx.prompts(spark, SF_SMALL), FIXTURE)
    assert w.count() == 3132
    assert replies.outstanding(w, w).count() == 0


def test_retry_failed_owes_error_rows_again(spark):
    w = replies.wanted_replies(fx.prompts(spark, SF_SMALL), FIXTURE)
    have = fx.replies(spark, SF_SMALL)
    assert replies.outstanding(w, have).count() == 0
    errors = have.filter(F.col("error") != "").count()
    assert errors > 0
    assert replies.outstanding(w, have, retry_failed=True).count() == errors


def test_owed_keys_and_prompts_are_merged_not_broadcast(spark):
    """Rows made by explode look small to the planner however many they are."""
    spec = fx.prompts(spark, SF_SMALL)
    owed = replies.outstanding(replies.wanted_replies(spec, FIXTURE), fx.collected(spark, SF_SMALL, FIXTURE, spec=spec))
    work = replies.attach_prompts(owed, prompt_ops.build_prompts(fx.items(spark, SF_SMALL), FIXTURE))
    assert work.count() > 0
    work.collect()
    joins = [x for x in work._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n")
             if "Join" in x and "prompt_id#" in x]
    assert len(joins) == 2 and all("SortMergeJoin" in x for x in joins), joins


def test_usage_reads_each_body_once_and_lists_no_model_without_a_call(spark):
    ok = '{"choices":[],"usage":{"prompt_tokens":3,"completion_tokens":2}}'
    bodies = spark.createDataFrame([("a", ok), ("a", ok), ("a", "<html>"), ("b", "<html>"), (None, ok), ("c", "{}")], "model string, body string")
    usage = replies.token_usage(replies.read_responses(bodies))
    assert sorted(usage.collect(), key=str) == sorted([("a", 2, 6, 4), (None, 1, 3, 2), ("c", 1, 0, 0)], key=str)
    made = replies.token_usage(replies.read_responses(fx.response_bodies(spark, SF_SMALL, FIXTURE)))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()


def test_budget_and_bodies(spark):
    w = replies.wanted_replies(fx.prompts(spark, SF_SMALL), FIXTURE)
    caps = {(r["model"], r["method"]): r["max_tokens"]
            for r in w.select("model", "method", "max_tokens").distinct().collect()}
    assert caps[("org/alpha", "span")] == 512
    assert caps[("org/beta", "baseline")] == 48 + 640
    owed = replies.attach_prompts(w, prompt_ops.build_prompts(fx.items(spark, SF_SMALL), FIXTURE))
    bodies = {(r["model"], r["prompt_id"], r["replicate"]): json.loads(r["body"])
              for r in replies.request_bodies(owed, FIXTURE).limit(50).collect()}
    for (model, _, _), b in bodies.items():
        assert [m["role"] for m in b["messages"]] == ["system", "user"]
        assert ("temperature" in b) == (model == "org/alpha")


def test_read_responses(spark):
    bodies = spark.createDataFrame([
        ("a", json.dumps({"choices": [{"message": {"content": "  Label: x \n"}}],
                          "usage": {"prompt_tokens": 3, "completion_tokens": 2}})),
        ("b", json.dumps({"choices": []})),
        ("c", "<html>oops</html>"),
        ("d", json.dumps({"choices": [{"message": {}}], "usage": {}})),
    ], "k string, body string")
    got = {r["k"]: r for r in replies.read_responses(bodies).collect()}
    assert (got["a"]["reply"], got["a"]["prompt_tokens"], got["a"]["error"]) == ("Label: x", 3, "")
    assert (got["b"]["reply"], got["b"]["completion_tokens"]) == ("", 0)
    assert got["c"]["error"].startswith("JSONDecodeError") and got["c"]["reply"] == ""
    assert (got["d"]["reply"], got["d"]["prompt_tokens"]) == ("", 0)


def _stub(rec):
    if rec["replicate"] == 2:
        raise ValueError("boom")
    return "Label: Hallucination"


def test_call_judge_records_failures(spark):
    w = replies.wanted_replies(fx.prompts(spark, SF_SMALL), FIXTURE)
    owed = replies.attach_prompts(w, prompt_ops.build_prompts(fx.items(spark, SF_SMALL), FIXTURE))
    out = replies.call_judge(owed, _stub).cache()
    assert out.count() == w.count()
    bad = out.filter(F.col("error") != "")
    assert bad.count() == w.filter(F.col("replicate") == 2).count()
    assert bad.first()["error"] == "ValueError: boom"
    assert out.filter((F.col("error") == "") & F.col("truncated")).count() == 0
    out.unpersist()


def test_collect_replies_is_resumable(spark, scratch):
    w = replies.wanted_replies(fx.prompts(spark, SF_SMALL), FIXTURE).filter(
        F.col("method") == "baseline")
    owed = replies.attach_prompts(w, prompt_ops.build_prompts(fx.items(spark, SF_SMALL), FIXTURE))
    log = f"{scratch}/log"
    assert replies.collect_replies(owed, _stub, log, buckets=4) == 4
    first = tables.read_replies(spark, log).count()
    assert first == w.count()
    # A rerun owes nothing and writes nothing.
    assert replies.collect_replies(owed, _stub, log, buckets=4) == 0
    assert tables.read_replies(spark, log).count() == first
    # Partition pruning on method/model.
    assert tables.read_replies(spark, log, method="baseline", model="org/beta").count() > 0


def test_review_prompts(spark):
    items = fx.items(spark, SF_SMALL)
    p = fx.prompts(spark, SF_SMALL)
    first = fx.replies(spark, SF_SMALL)
    r = replies.review_prompts(p, items, first, FIXTURE, model="org/beta", reviewer="org/alpha")
    usable = first.filter((F.col("model") == "org/alpha") & (F.col("method") == "baseline")
                          & (F.col("error") == ""))
    assert r.count() == usable.count()
    row = r.filter(F.col("other_label") == "Label: Hallucination").first()
    assert "Another reviewer judged this as: Label: Hallucination" in row["prompt"]
    assert row["method"] == "debate" and row["max_tokens"] == 384 + 640


def test_completeness_and_cost(spark):
    w = replies.wanted_replies(fx.prompts(spark, SF_SMALL), FIXTURE)
    c = replies.completeness(w, fx.replies(spark, SF_SMALL))
    assert c.filter(~F.col("ok")).count() == 0
    part = replies.completeness(w, fx.collected(spark, SF_SMALL))
    assert part.filter(~F.col("ok")).count() > 0
    cost = {r["model"]: r["calls"] for r in replies.pass_cost(fx.prompts(spark, SF_SMALL),
                                                               FIXTURE).collect()}
    assert cost == {"org/alpha": 87 * 6 * 3, "org/beta": 87 * 6 * 3}


def test_call_judge_with_workers(spark):
    w = replies.wanted_replies(fx.prompts(spark, SF_SMALL), FIXTURE).filter(
        F.col("method") == "span")
    owed = replies.attach_prompts(w, prompt_ops.build_prompts(fx.items(spark, SF_SMALL), FIXTURE))
    one = sorted(map(tuple, replies.call_judge(owed, _stub).collect()))
    many = sorted(map(tuple, replies.call_judge(owed, _stub, workers=4).collect()))
    assert one == many and len(one) == w.count()


def test_replies_of_single_calls_share_frames(spark):
    """Frames, not calls, are what a task hands on: one for each record was most of its time."""
    import pandas as pd
    work = spark.range(1, 2502, 1, 1).selectExpr("string(id) AS prompt_id", "'m' AS model", "'span' AS method", "1 AS replicate", "'x' AS prompt")
    taken = []

    class Work:  # as call_judge_batches takes it, run here
        columns = work.columns

        def select(self, *cols):
            return self

        def mapInPandas(self, run, schema):
            taken.extend(run(iter([work.toPandas()])))

    replies.call_judge(Work(), lambda r: None if r["prompt_id"] == "7" else "Label: x")
    assert [len(f) for f in taken] == [1000, 1000, 501]
    rows = pd.concat(taken)
    assert rows["prompt_id"].tolist() == [str(k) for k in range(1, 2502)]
    assert rows.loc[rows["error"] != "", "prompt_id"].tolist() == ["7"]
