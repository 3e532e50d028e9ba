"""Scores -> the report tables behind the figures (data only, no drawing).

All inputs are the scores table, whose size is bounded by (models x methods x
shots x directions x views); pivots are given their values explicitly so Spark
does not run a job to discover them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids

VIEW = "judged"


def _models(scores: DataFrame, models: list[str] | None) -> list[str]:
    if models:
        return list(models)
    # The scores table is small; this distinct is over it, not over replies.
    return sorted(r[0] for r in scores.select("model").distinct().collect())


def report_headline(scores: DataFrame, models: list[str] | None = None,
                    view: str = VIEW) -> DataFrame:
    """(method, shots) x model MCC, overall, one view."""
    part = scores.filter((F.col("direction") == "overall") & (F.col("view") == view))
    return (part.groupBy("method", "shots")
            .pivot("model", _models(scores, models)).agg(F.first("mcc"))
            .orderBy("method", "shots"))


def report_views(scores: DataFrame, method: str = "baseline") -> DataFrame:
    """R2: model x view MCC, overall, one method."""
    part = scores.filter((F.col("direction") == "overall") & (F.col("method") == method))
    return (part.groupBy("model").pivot("view", ["all", "parsed", "judged"])
            .agg(F.first("mcc")).orderBy("model"))


def report_directions(scores: DataFrame, models: list[str] | None = None,
                      method: str = "baseline", view: str = VIEW) -> DataFrame:
    """R3 + S4: direction x model MCC and the mean over models, by which the
    directions are ordered (numerically)."""
    part = scores.filter((F.col("direction") != "overall") & (F.col("view") == view)
                         & (F.col("method") == method))
    cols = [F.first(F.when(F.col("model") == m, F.col("mcc")), ignorenulls=True).alias(m)
            for m in _models(scores, models)]
    return (part.groupBy("direction").agg(*cols, F.avg("mcc").alias("mean_mcc"))
            .orderBy("mean_mcc", "direction"))


def report_methods(scores: DataFrame, models: list[str] | None = None,
                   view: str = VIEW) -> DataFrame:
    """R4 + P9: method label x model MCC, a missing cell as 0 (a dense grid:
    every label that any model has, every model)."""
    part = scores.filter((F.col("direction") == "overall") & (F.col("view") == view))
    labelled = part.withColumn("label", ids.method_label("method", "shots"))
    ms = _models(scores, models)
    grid = labelled.groupBy("label").pivot("model", ms).agg(F.first("mcc"))
    return grid.na.fill(0.0, subset=ms).orderBy("label")


def report_shots(scores: DataFrame, view: str = VIEW) -> DataFrame:
    """MCC by number of worked examples (baseline = 0 and few-shot)."""
    part = scores.filter((F.col("direction") == "overall") & (F.col("view") == view)
                         & F.col("method").isin("baseline", "fewshot"))
    return (part.select("model", F.col("shots").cast("int").alias("shots"), "mcc")
            .orderBy("model", "shots"))
