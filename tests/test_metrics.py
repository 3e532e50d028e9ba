"""Scores against a plain-Python scorer; invariants of the views and groupings."""

import math
import random

import pandas as pd
from hypothesis import given, settings as hsettings, strategies as st

from pyspark.sql import functions as F

from verdict.config import FIXTURE, NEGATIVE_LABEL, POSITIVE_LABEL
from verdict.operators import judge, metrics
from verdict.sources import fixture as fx

from .conftest import SF_SMALL

VIEWS = ("all", "parsed", "judged")


def _py_score(rows, view):
    """The evaluated pipeline's score(view_of(frame, view), view), in Python."""
    if view == "parsed":
        rows = [r for r in rows if r["parsed"]]
    elif view == "judged":
        rows = [r for r in rows if r["parsed"] and not r["refusal"]]
    if not rows:
        return None
    y = [1 if r["answer"] == POSITIVE_LABEL else 0 for r in rows]
    if view == "all":
        p = [1 if r["observed"] == POSITIVE_LABEL else 0 if r["observed"] == NEGATIVE_LABEL
             else 1 - t for r, t in zip(rows, y)]
    else:
        p = [1 if r["observed"] == POSITIVE_LABEL else 0 for r in rows]
    if len(set(y)) < 2 or len(set(p)) < 2:
        return None
    tp = sum(1 for a, b in zip(y, p) if a and b)
    tn = sum(1 for a, b in zip(y, p) if not a and not b)
    fp = sum(1 for a, b in zip(y, p) if not a and b)
    fn = sum(1 for a, b in zip(y, p) if a and not b)
    mcc = (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {"n": len(rows), "mcc": mcc, "precision": tp / (tp + fp), "recall": tp / (tp + fn),
            "f1": 2 * tp / (2 * tp + fp + fn), "accuracy": (tp + tn) / len(rows)}


def _check(spark, rows, group_cols=("model",)):
    df = spark.createDataFrame(pd.DataFrame(rows), "model string, method string, shots int, "
                               "direction string, answer string, observed string, "
                               "parsed boolean, refusal boolean")
    got = {(r["model"], r["view"]): r.asDict()
           for r in metrics.score_overall(df, FIXTURE, group_cols=list(group_cols)).collect()}
    for m in {r["model"] for r in rows}:
        part = [r for r in rows if r["model"] == m]
        for v in VIEWS:
            want = _py_score(part, v)
            if want is None:
                assert (m, v) not in got
                continue
            g = got[(m, v)]
            assert g["n"] == want["n"]
            for k in ("mcc", "precision", "recall", "f1", "accuracy"):
                assert math.isclose(g[k], want[k], rel_tol=1e-12, abs_tol=1e-12), (k, g, want)
            assert g["refusals"] == sum(r["refusal"] for r in part)
            assert g["unparsed"] == sum(not r["parsed"] for r in part)


def _rows(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        obs = rnd.choice([POSITIVE_LABEL, NEGATIVE_LABEL, ""])
        refusal = obs == "" and rnd.random() < 0.5
        if rnd.random() < 0.1:
            refusal = True  # as a classifier score may decide
        out.append({"model": rnd.choice("ab"), "method": "baseline", "shots": 0,
                    "direction": rnd.choice(["x", "y"]),
                    "answer": rnd.choice([POSITIVE_LABEL, NEGATIVE_LABEL]),
                    "observed": obs, "parsed": obs != "", "refusal": refusal})
    return out


def test_scores_match_python(spark):
    _check(spark, _rows(1, 400))


@hsettings(max_examples=8, deadline=None)
@given(st.integers(min_value=0, max_value=10_000), st.integers(min_value=1, max_value=60))
def test_scores_match_python_property(spark, seed, n):
    _check(spark, _rows(seed, n))


def test_degenerate_groups_are_dropped(spark):
    rows = [{"model": "a", "method": "m", "shots": 0, "direction": "x", "answer": POSITIVE_LABEL,
             "observed": POSITIVE_LABEL, "parsed": True, "refusal": False}] * 5
    _check(spark, rows)


def test_direction_counts_sum_to_overall(spark):
    j = judge.judgements(fx.replies(spark, SF_SMALL), fx.prompts(spark, SF_SMALL), FIXTURE)
    g = ["model", "method", "shots"]
    by_dir = metrics.confusion(j, g + ["direction"], FIXTURE)
    overall = metrics.confusion(j, g, FIXTURE)
    summed = metrics.resum(by_dir, g)
    a = sorted(tuple(r) for r in overall.select(*sorted(overall.columns)).collect())
    b = sorted(tuple(r) for r in summed.select(*sorted(overall.columns)).collect())
    assert a == b


def test_fixture_sizes_and_identity(spark):
    j = judge.judgements(fx.replies(spark, SF_SMALL), fx.prompts(spark, SF_SMALL), FIXTURE)
    assert fx.replies(spark, SF_SMALL).count() == 3132
    s = metrics.score_everything(j, FIXTURE)
    parsed = {tuple(r[:4]): r["mcc"] for r in s.filter(s.view == "parsed").collect()}
    judged = {tuple(r[:4]): r["mcc"] for r in s.filter(s.view == "judged").collect()}
    assert parsed == judged  # Q6, pattern-only refusals
    assert len(parsed) == 72
    assert sum(1 for k in parsed if k[3] == "overall") == 12


def test_replicate_agreement_matches_pandas(spark):
    j = judge.judgements(fx.replies(spark, SF_SMALL), fx.prompts(spark, SF_SMALL), FIXTURE)
    pdf = j.toPandas()
    want = (pdf.groupby(["prompt_id", "model"])["observed"].nunique() == 1).mean()
    got = metrics.replicate_agreement(j).first()
    assert math.isclose(got["agreement"], want)
    by = {r["model"]: r["agreement"]
          for r in metrics.replicate_agreement(j, by=("model",)).collect()}
    for m, g in pdf.groupby("model"):
        assert math.isclose(by[m], (g.groupby("prompt_id")["observed"].nunique() == 1).mean())


def test_dedupe_keeps_latest_per_key(spark):
    r = fx.replies(spark, SF_SMALL)
    doubled = r.withColumn("seq", F.lit(1)).unionByName(
        r.withColumn("seq", F.lit(2)).withColumn("response", F.lit("Label: Hallucination"))
        .withColumn("error", F.lit("")))
    once = judge.dedupe_replies(doubled, "seq")
    assert once.count() == r.count()
    assert once.filter(F.col("seq") != 2).count() == 0
    p = fx.prompts(spark, SF_SMALL)
    # Without de-duplication every copy counts: the second copies carry no error.
    twice = judge.judgements(doubled.drop("seq"), p, FIXTURE)
    assert twice.count() == 2 * r.count() - r.filter(F.col("error") != "").count()
    deduped = judge.judgements(doubled, p, FIXTURE, dedupe=True, order_col="seq")
    assert deduped.count() == r.count()


def test_hot_prompt_id_collapses_before_the_join(spark):
    """One prompt id holds a third of all replies (copies of its replies)."""
    r = fx.replies(spark, SF_SMALL)
    p = fx.prompts(spark, SF_SMALL)
    hot_id = r.filter(F.col("error") == "").first()["prompt_id"]
    n = r.count()
    hot = (r.filter(F.col("prompt_id") == hot_id)
           .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(n // 12 + 1))))
           .drop("_copy"))
    skewed = r.unionByName(hot)
    share = skewed.filter(F.col("prompt_id") == hot_id).count() / skewed.count()
    assert share > 0.3
    counted = metrics.judged_counts(skewed, p, FIXTURE)
    assert counted.filter(F.col("prompt_id") == hot_id).count() <= 2 * 3 * 2
    got = metrics.score_replies(skewed, p, FIXTURE)
    want = metrics.score_everything(judge.judgements(skewed, p, FIXTURE), FIXTURE)
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == \
        sorted(map(tuple, want.select(cols).collect()))
