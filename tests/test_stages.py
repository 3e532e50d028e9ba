"""The stages end to end on the sf0.001 fixture, written to the shared folder."""

from pyspark.sql import functions as F

from verdict.config import FIXTURE
from verdict.operators import judge, metrics
from verdict.plans import stages
from verdict.plans.queries import stub_judge
from verdict.sources import fixture as fx
from verdict.sources import tables

from .conftest import SF_SMALL


def _rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(r) for r in df.select(cols).collect())


def test_build_generate_review_evaluate(spark, scratch):
    cfg = FIXTURE.with_(items_per_direction=10)
    paths = stages.build(fx.corpus(spark, SF_SMALL), cfg, f"{scratch}/build")
    items = spark.read.parquet(paths["items"])
    prompts = spark.read.parquet(paths["prompts"])
    assert items.count() <= 10 * 6
    assert prompts.count() == items.count() * len(cfg.prompt_methods())
    assert items.filter(F.col("item_id").rlike("^[a-z]{4}-[0-9]{4,}$")).count() == items.count()

    log = f"{scratch}/log"
    n = stages.generate(spark, paths["prompts"], log, cfg, stub_judge, "org/alpha",
                        method="baseline", buckets=2)
    assert n == 2
    assert stages.generate(spark, paths["prompts"], log, cfg, stub_judge, "org/alpha",
                           method="baseline", buckets=2) == 0
    got = tables.read_replies(spark, log)
    assert got.count() == prompts.filter(F.col("method") == "baseline").count() * 3

    assert stages.review(spark, paths["items"], paths["prompts"], log, cfg, stub_judge,
                         model="org/beta", reviewer="org/alpha", buckets=2) > 0
    debate = tables.read_replies(spark, log, method="debate", model="org/beta")
    usable = got.filter(F.col("error") == "").count()
    assert debate.count() == usable

    out = stages.evaluate(spark, log, paths["prompts"], cfg, f"{scratch}/eval")
    scores = spark.read.parquet(out["scores"])
    want = metrics.score_everything(
        judge.judgements(tables.read_replies(spark, log), prompts, cfg), cfg)
    assert _rows(scores) == _rows(want)
    assert spark.read.parquet(out["agreement"]).count() == 1
