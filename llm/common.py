"""Shared helpers: reading the tables, staging, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run without ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Rows of one Arrow batch; bounds what a Python worker holds of long texts.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Python workers get it in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of its own only where the
    session names none and runs in a single process (as in tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.conf.get("spark.master", "") or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="llm-stage-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Paths staged inside open scopes, innermost last.
_SCOPES: list[list[str]] = []


def stage(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write a frame once under the shared folder and read it back: cuts the
    lineage, survives lost executors, and fixes generated row ids. Inside a
    ``scope`` the files go when it ends; with ``keep`` they go with the scope
    around it, if any."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if len(_SCOPES) > keep:
        _SCOPES[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Frames staged inside are deleted at its end: what leaves must be staged
    with ``keep`` or be no frame."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for p in _SCOPES.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """A-Z lowered, every other character kept. ``lower`` is quicker and does
    the same where the text is all ASCII."""
    return (F.when(F.octet_length(c) == F.char_length(c), F.lower(c))
            .otherwise(F.translate(c, UPPER, LOWER)))


def word_count(c: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def ordered(spark: SparkSession, rows: int, per_part: int = 512, most: int = 16384) -> int:
    """How many hash buckets a table of ``rows`` is laid out in."""
    return max(1, min(most, -(-rows // per_part)))


#: A Bloom filter has 2^6 to 2^20 bits: at most 128 KiB, whatever it is built from.
BLOOM_BITS = 1 << 20


def _bloom_bits(h: Column, n_bits: int) -> list[Column]:
    return [F.shiftrightunsigned(h, s).bitwiseAND(F.lit(n_bits - 1).cast("long")) for s in _BLOOM_SHIFTS]


_BLOOM_SHIFTS = (0, 21, 42)


def _bloom_cell(b: Column) -> Column:
    return F.shiftright(b, 6).cast("int")


def _bloom_bit(b: Column) -> Column:
    low = b.bitwiseAND(F.lit(63).cast("long")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), low)


def _bloom_cells(keys: DataFrame) -> list[int]:
    """The filter's bits for a frame with one column ``h`` of 64-bit hashes."""
    n, n_bits = keys.distinct().count(), 64
    while n_bits < min(48 * n, BLOOM_BITS):
        n_bits *= 2
    found = (keys.select(F.explode(F.array(*_bloom_bits(F.col("h"), n_bits))).alias("b"))
             .groupBy(_bloom_cell(F.col("b")).alias("i")).agg(F.bit_or(_bloom_bit(F.col("b"))).alias("m")))
    cells = [0] * (n_bits // 64)
    for r in found.collect():  # at most BLOOM_BITS / 64 rows
        cells[r.i] = r.m
    return cells


def bloom(keys: DataFrame) -> Callable[[Column], Column]:
    """A test "may be among the keys" in SQL functions alone. The filter is an
    array literal of fixed greatest size; with far more keys it lets more
    through, so an exact join always follows."""
    cells = _bloom_cells(keys)
    lits = ",".join("(-9223372036854775807L - 1L)" if m == -(1 << 63) else f"{m}L" for m in cells)
    table = F.expr(f"array({lits})")

    def may(h: Column) -> Column:
        tests = [F.get(table, _bloom_cell(b)).bitwiseAND(_bloom_bit(b)) != 0 for b in _bloom_bits(h, 64 * len(cells))]
        return tests[0] & tests[1] & tests[2]
    return may


def bloom_udf(keys: DataFrame) -> Callable[[Column], Column]:
    """The same test in numpy: the filter travels with the tasks and stays out
    of the plan, which the driver keeps and logs many times over."""
    cells = np.array(_bloom_cells(keys), np.int64).view(np.uint64)

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        x, ok = h.to_numpy().view(np.uint64), np.ones(len(h), bool)
        for s in _BLOOM_SHIFTS:
            b = (x >> np.uint64(s)) & np.uint64(64 * len(cells) - 1)
            ok &= (cells[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63)) & np.uint64(1)) > 0
        return pd.Series(ok)
    return may
