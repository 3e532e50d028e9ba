"""Items: numbering within a pair, stratified sampling, profiles."""

import hashlib

import pandas as pd

from verdict.config import FIXTURE
from verdict.operators import items as item_ops
from verdict.sources import fixture as fx

from .conftest import SF_MID, SF_SMALL


def test_position_within_matches_row_number_under_skew(spark):
    # One hot group holds a third of the rows; ordinals are sparse.
    rows = [("hot", "x", 3 * i) for i in range(600)]
    rows += [("g%d" % (i % 7), "y", 5 * i + 1) for i in range(1200)]
    df = spark.createDataFrame(rows, "a string, b string, o long")
    for width in (16, 1000, 1 << 20):
        got = item_ops.position_within(df, ["a", "b"], "o", "pos", bucket_width=width)
        pdf = got.toPandas().sort_values(["a", "b", "o"])
        want = pdf.groupby(["a", "b"]).cumcount()
        assert list(pdf["pos"]) == list(want), width


def test_position_within_bounds_task_size(spark):
    df = spark.createDataFrame([("hot", i) for i in range(1000)], "a string, o long")
    got = item_ops.position_within(df, ["a"], "o", bucket_width=64)
    # Every window partition (a, bucket) holds at most the bucket width.
    per = (df.withColumn("_b", (df.o / 64).cast("long")).groupBy("a", "_b").count()
           .agg({"count": "max"}).first()[0])
    assert per <= 64
    assert got.count() == 1000


def _py_sample(items: pd.DataFrame, n_cap: int, seed: int, positive: str) -> set:
    """W2 in plain pandas: quotas with half-even rounding, md5 order."""
    out = set()
    for _, g in items.groupby("direction"):
        wanted = min(n_cap, len(g))
        pos = int((g["answer"] == positive).sum())
        kpos = min(pos, round(wanted * (pos / len(g))))
        kneg = min(len(g) - pos, wanted - kpos)
        for side, k in ((g[g["answer"] == positive], kpos), (g[g["answer"] != positive], kneg)):
            keyed = side.assign(h=[hashlib.md5(f"{seed}|{i}".encode()).hexdigest()
                                   for i in side["item_id"]])
            out |= set(keyed.sort_values(["h", "item_id"]).head(k)["item_id"])
    return out


def test_stratified_sample_matches_brute_force(spark):
    items = fx.items(spark, SF_MID)
    pdf = items.select("item_id", "direction", "answer").toPandas()
    for cap in (7, 13, 40):
        got = set(r[0] for r in item_ops.stratified_sample(
            items, cap, FIXTURE.sample_seed, FIXTURE.positive_label).select("item_id").collect())
        assert got == _py_sample(pdf, cap, FIXTURE.sample_seed, FIXTURE.positive_label), cap


def test_stratified_sample_keeps_all_when_zero(spark):
    items = fx.items(spark, SF_SMALL)
    assert item_ops.stratified_sample(items, 0, 1, FIXTURE.positive_label) is items


def test_stratified_sample_plans_group_limit(spark):
    items = fx.items(spark, SF_SMALL)
    s = item_ops.stratified_sample(items, 40, FIXTURE.sample_seed, FIXTURE.positive_label)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_direction_balance_and_severity(spark):
    items = fx.items(spark, SF_MID)
    pdf = items.toPandas()
    bal = {r["direction"]: (r["items"], r["hallucinated"], r["directions"])
           for r in item_ops.direction_balance(items, FIXTURE.positive_label).collect()}
    for d, g in pdf.groupby("direction"):
        assert bal[d][0] == len(g)
        assert abs(bal[d][1] - (g["answer"] == FIXTURE.positive_label).mean()) < 1e-12
        assert bal[d][2] == pdf["direction"].nunique()
    sev = {r["grade"]: r["items"] for r in item_ops.severity_counts(items).collect()}
    assert sev == pdf["grade"].value_counts().to_dict()


def test_build_items_whitelist_and_ids(spark):
    corpus = spark.createDataFrame(
        [("de", "en", "1_No_hallucination", " a ", "b\n", 0),
         ("de", "en", "4_Full_hallucination", "c", "d", 5),
         ("xx", "en", "1_No_hallucination", "e", "f", 1),
         ("en", "fr", None, "g", None, 2)],
        "src_lang string, tgt_lang string, class_hall string, src_text string, "
        "mt_text string, ordinal long")
    got = item_ops.build_items(corpus, FIXTURE, item_ids="make").orderBy("item_id").collect()
    assert [r["item_id"] for r in got] == ["deen-0000", "deen-0001", "enfr-0000"]
    assert [r["answer"] for r in got] == ["No hallucination", "Hallucination", "Hallucination"]
    assert got[0]["source_text"] == "a" and got[0]["target_text"] == "b"
    assert got[2]["target_text"] == "" and got[2]["direction"] == "English to French"


def test_merged_states_draw_as_the_whole_corpus(spark):
    import random
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", "c"]), rng.choice(["Hallucination", "No hallucination", "No hallucination"]), rng.randrange(4))
            for i in range(400)] + [(1000 + i, "only", "Hallucination", i % 2) for i in range(5)]
    items = spark.createDataFrame(rows, "item_id long, direction string, answer string, part int").cache()
    for n in (1, 7, 30, 500):
        states = [item_ops.sample_state(items.where(f"part = {k}").drop("part"), n, 3) for k in range(4)]
        # In two steps, as a corpus grows; the part without rows changes nothing.
        grown = item_ops.merge_sample_states([item_ops.merge_sample_states(states[:2], n, 3), *states[2:]], n, 3)
        got = item_ops.sample_from_state(grown, n, 3, "Hallucination")
        want = item_ops.stratified_sample(items.drop("part"), n, 3, "Hallucination")
        assert set(got.columns) == set(want.columns)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert grown.groupBy().sum("_count").first()[0] == len(rows)
    items.unpersist()
