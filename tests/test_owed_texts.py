"""Prompts are attached to owed replies without moving a prompt."""

import re

import pytest
from pyspark.sql import functions as F

from verdict import session
from verdict.config import FIXTURE, Method
from verdict.functions import templates
from verdict.operators import prompts as prompt_ops
from verdict.operators import replies
from verdict.plans import queries as Q
from verdict.sources.reply_log import ReplyLog

from .conftest import SF_SMALL

ITEM = "item_id {}, source_language string, target_language string, direction string, grade string, answer string, source_text string, target_text string"


def items(spark, ids, kind):
    rows = [(k, "de", "en", None if n == 4 else "German to English", "g", FIXTURE.positive_label if n % 2 else FIXTURE.negative_label,
             f"source {n} é", None if n == 3 else f"target {n}") for n, k in enumerate(ids)]
    return spark.createDataFrame(rows, ITEM.format(kind))


def both_ways(work, own, cfg):
    cols = [*work.columns, "prompt"]
    old = replies.attach_prompts(work, prompt_ops.build_prompts(own, cfg)).select(*cols)
    new = prompt_ops.attach_rendered(work, own, cfg).select(*cols)
    kept = prompt_ops.attach_rendered(work, own, cfg, prompt_ops.kept_example_maps(own, cfg), tasks=3).select(*cols)
    got, again = sorted(map(str, new.collect())), sorted(map(str, kept.collect()))
    assert got == again
    return sorted(map(str, old.collect())), got


def test_whole_number_ids_as_by_the_prompt_table(spark):
    own = items(spark, [1, 2, 2, 30, 4, -5, None], "bigint")
    work = replies.wanted_replies(prompt_ops.prompt_spec(own, FIXTURE), FIXTURE)
    stray = [("007-span", "m", "span", 1), (" 1-span", "m", "span", 1), ("1-nothing", "m", "x", 1), (None, "m", "x", 1), ("-span", "m", "x", 1),
             ("2-fewshot2", None, "debate", None)]
    stray = spark.createDataFrame(stray, "prompt_id string, model string, method string, replicate int")
    old, new = both_ways(work.unionByName(stray, allowMissingColumns=True), own, FIXTURE)
    assert old == new and len(new) == (4 * 1 + 2 * 2) * 36 + 2


def test_text_ids_as_by_the_prompt_table(spark):
    # Kinds whose ends overlap: "x-b-a" is item "x" asked by "b-a" and item "x-b" asked by "a".
    cfg = FIXTURE.with_(methods=(Method("span", "s", 9), Method("b-span", "s", 9), Method("fewshot", "f", 9, (1, 2))))
    own = items(spark, ["x", "x-b", "-", "", "7", "x"], "string")
    kept = dict(templates.TEMPLATES)
    templates.TEMPLATES["b-span"] = kept["span"] + "!"
    try:
        work = prompt_ops.prompt_spec(own, cfg).select("prompt_id", "method", F.lit(1).alias("replicate"))
        old, new = both_ways(work, own, cfg)
    finally:
        templates.TEMPLATES.clear()
        templates.TEMPLATES.update(kept)
    assert old == new and len(new) > 24


def moved(df) -> list[set[str]]:
    """Names of the columns each exchange of the plan moves."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [set(re.findall(r"(\w+)#\d+", m)) for m in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]


@pytest.mark.parametrize("name", ["outstanding_replies", "request_bodies", "outstanding_indexed"])
def test_no_prompt_is_moved(spark, name):
    seen = moved(Q.queries()[name](spark, SF_SMALL))
    assert seen
    assert not [s for s in seen if "prompt" in s]
    # Texts are dealt out with their item alone, never once for each of its prompts.
    assert not [s for s in seen if s & {"src_text", "source_text"} and s & {"prompt_id", "shots", "method", "_owed"}]


def test_committed_replies_write_keys_and_no_prompt(spark, scratch, monkeypatch):
    own = items(spark, [1, 2, 2, 30], "bigint")
    owed = replies.wanted_replies(prompt_ops.prompt_spec(own, FIXTURE), FIXTURE)
    at = []
    named = session.scratch_dir
    monkeypatch.setattr(session, "scratch_dir", lambda s, label: (at.append(named(s, label)), at[-1])[1])
    before = spark.conf.get(session._CLEANUP, None)

    def ask(records):
        return [f"Label: {len(r['prompt'])}/{r['prompt'][-9:]}" for r in records]
    logs = [ReplyLog(spark, f"{scratch}/{k}", buckets=2) for k in "ab"]
    whole = prompt_ops.attach_rendered(owed, own, FIXTURE)
    assert replies.collect_committed(whole, logs[0], ask, slices=2, tasks=2) == (2 + 2 * 2) * 36
    n = replies.collect_committed(owed, logs[1], ask, slices=2, tasks=2,
                                  attach=lambda part, tasks: prompt_ops.attach_rendered(part, own, FIXTURE, tasks=tasks))
    cols = [*replies.WORK_KEYS, "error", "response", "temperature"]
    a, b = (sorted(map(str, log.read().select(*cols).collect())) for log in logs)
    assert a == b and n == len(a)
    staged = [spark.read.parquet(p).columns for p in at if "/owed-" in p]
    assert "prompt" in staged[0] and "prompt" not in staged[1] and "prompt_id" in staged[1]
    assert spark.conf.get(session._CLEANUP, None) == before
