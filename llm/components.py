"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _minimum(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    return edges.join(least, "u").withColumn("m", F.least("u", "low")).drop("low")


def components(edges: DataFrame) -> DataFrame:
    """(v, u): every vertex of the edges (a, b) but the least of its component,
    with that least vertex. Edges and labels stay distributed; the driver sees
    one count per step."""
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    now, seen = common.stage(both, "stars"), None
    while True:
        t = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (t.n, t.s) == seen:
            return now
        seen = (t.n, t.s)
        two = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minimum(two).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = _minimum(large.select("u", "v"))  # every v here is below its u
        small = (low.select(F.col("v").alias("x"), "m").unionAll(low.select(F.col("u").alias("x"), "m"))
                 .where("x <> m").distinct().select(F.col("x").alias("v"), F.col("m").alias("u")))
        now = common.stage(small, "stars")
