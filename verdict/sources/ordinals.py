"""Running totals in key order without a window over the whole table.

Keys are range-partitioned and summed within their partition; the partitions'
own totals (one row each) come to the driver, which hands every partition what
stands before it. Both levels are exact, and no task holds more than its range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sum_within(keys: list[str], value: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(value).to_numpy()
            upto = total + np.cumsum(n)
            total = int(upto[-1]) if len(n) else total
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keys), b.column(value), pa.array(upto - n), pa.array(np.full(len(n), piece, np.int32))],
                names=[*keys, value, "_within", "_piece"])
    return run


def totals_before(counts: DataFrame, keys: list[str], value: str, out: str, scratch: str) -> DataFrame:
    """``counts`` (one row per key, ``value`` a long) with ``out``, the sum of
    ``value`` over all smaller keys. Written to ``scratch`` on the way, so both
    levels see the same partitions."""
    spark = counts.sparkSession
    narrow = counts.select(*keys, F.col(value).cast("long").alias(value))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (narrow.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
     .mapInArrow(_sum_within(keys, value), f"{kind}, _within long, _piece int").write.mode("overwrite").parquet(scratch))
    within = spark.read.parquet(scratch)
    per = within.groupBy("_piece").agg(F.sum(value).alias("n")).orderBy("_piece").collect()  # one a partition
    before, total = [], 0
    for r in per:
        before.append((r["_piece"], total))
        total += r["n"]
    offsets = spark.createDataFrame(before, "_piece int, _before long")
    return (within.join(F.broadcast(offsets), "_piece")
            .select(*keys, value, (F.col("_within") + F.col("_before")).alias(out)))
