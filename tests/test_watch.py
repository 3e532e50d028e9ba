"""Checks counted while a build writes, against ``quality_checks`` on the tables written."""

import pytest
from pyspark.sql import functions as F

from verdict.config import FIXTURE
from verdict.operators import items as item_ops
from verdict.operators import prompts as prompt_ops
from verdict.operators import quality
from verdict.plans import stages
from verdict.sources import fixture as fx

from .conftest import SF_SMALL

CFG = FIXTURE.with_(items_per_direction=10)


def _table(checks):
    return sorted((r.check, r.failures) for r in checks.collect())


def _items(spark):
    return item_ops.stratified_sample(item_ops.build_items(fx.corpus(spark, SF_SMALL), CFG, item_ids="make"), 10,
                                      CFG.sample_seed, CFG.positive_label)


def _faulty(items):
    """Items with repeated, null and textless rows."""
    first = items.orderBy("item_id").limit(3)
    twice = first.unionByName(first.limit(1))
    return (items.unionByName(twice)
            .unionByName(first.limit(2).withColumn("item_id", F.lit(None).cast("string")))
            .unionByName(first.limit(1).withColumns({"item_id": F.lit("new"), "source_text": F.lit(""),
                                                     "target_text": F.lit(None).cast("string")})))


@pytest.mark.parametrize("by_id", [True, False])
@pytest.mark.parametrize("fault", [False, True])
def test_watched_counts_are_the_checks(spark, scratch, by_id, fault):
    items = _faulty(_items(spark)) if fault else _items(spark)
    watch = quality.Watch(spark, CFG)
    watch.items(items.orderBy("item_id") if by_id else items, by_id).write.parquet(f"{scratch}/items")
    items = spark.read.parquet(f"{scratch}/items")
    made = prompt_ops.build_prompts(items, CFG)
    if fault:
        made = made.withColumn("prompt", F.when(F.col("method") == "span", F.lit("no format"))
                               .when((F.col("method") == "baseline") & (F.col("item_id") == "new"), F.lit(""))
                               .otherwise(F.col("prompt")))
    watch.prompts(made).write.parquet(f"{scratch}/prompts")
    prompts = spark.read.parquet(f"{scratch}/prompts")
    if not by_id:
        watch.ids(items, "item_id")
    watch.ids(prompts, "prompt_id")
    got = _table(watch.checks())
    assert got == _table(quality.quality_checks(items, prompts, CFG))
    assert any(n for _, n in got) == fault


def test_repeats_are_numbered_on_the_sorts_exchange(spark):
    frame = quality.Watch(spark, CFG).items(_items(spark).orderBy("item_id"), by_id=True)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    last = plan[:plan.index("WindowGroupLimit")] if "WindowGroupLimit" in plan else plan
    assert "rangepartitioning(item_id" in last and "hashpartitioning(item_id" not in last


def test_a_failing_build_leaves_the_prompts(spark, scratch):
    corpus = fx.corpus(spark, SF_SMALL)
    paths = stages.build(corpus, CFG, f"{scratch}/b")
    before = sorted(map(tuple, spark.read.parquet(paths["prompts"]).collect()), key=str)
    with pytest.raises(AssertionError, match="item_without_source"):
        stages.build(corpus.withColumn("src_text", F.lit("")), CFG, f"{scratch}/b")
    assert sorted(map(tuple, spark.read.parquet(paths["prompts"]).collect()), key=str) == before
    stages.build(corpus, CFG.with_(items_per_direction=4), f"{scratch}/b", sort_items=False)
    spark.catalog.clearCache()
    assert spark.read.parquet(paths["prompts"]).count() < len(before)
