"""Quoted multi-line delimited files read by many tasks a file.

A record may hold line ends inside quotes, so a byte range cannot know alone
where records begin. Whether a line begins inside quotes depends on all lines
before it, but each line is a map of two cases, outside and inside, to how it
ends; maps compose, and so do the numbers of records that begin under either
case. The job has three steps:

1. every byte range of every file composes the maps of its lines and counts
   the records that begin in it, for both cases (lines without a quote, most of
   them, never leave the JVM);
2. the ranges of each file are scanned in order, which settles the case and the
   record number that each range begins with (one row a range);
3. every range cuts its records; the two ends of a record that crosses ranges
   are joined by their record number.

Rows come with their record's place in its file and can so be numbered in file
order. Fields are then parsed by Spark's own CSV parser, one record at a time.

A quote opens a field only at its start; doubled, it stands for itself. Line
ends are ``\\n`` or ``\\r\\n``. Empty lines are no records. A quote that is never
closed makes the rest of its file one record. Compressed files are one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import scratch_dir
from .ordinals import totals_before

OUTSIDE, INSIDE = 0, 1
#: Ranges up to which their starting cases travel as a broadcast (some 100
#: bytes each); with more, lines and cases meet in a shuffle by range.
BROADCAST_RANGES = 1 << 18


def line_end(line: str, case: int, sep: str) -> int:
    """How a line ends that begins in ``case``: inside quotes or not."""
    line = line.removesuffix("\r")
    i, n = 0, len(line)
    while True:
        if case == INSIDE:
            i = line.find('"', i) + 1
            if not i:
                return INSIDE
            if line.startswith('"', i):
                i += 1  # a doubled quote stands for itself
                continue
            case = OUTSIDE
        elif line.startswith('"', i) and (i == 0 or line.startswith(sep, i - 1)):
            case, i = INSIDE, i + 1
            continue
        i = line.find(sep, i) + 1  # the start of the next field
        if not i or i > n:
            return OUTSIDE


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with their file and byte range, in order within a range."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), "value"))


def _compose(sep: str):
    """mapInArrow: one row a range. Cases and record counts if it begins
    outside (end_0, records_0) and inside quotes (end_1, records_1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ends, counts = None, [OUTSIDE, INSIDE], [0, 0]

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip((*at, *ends, *counts), (pa.string(), pa.int64(), *[pa.int32()] * 2, *[pa.int64()] * 2))],
                names=["file", "range", "end_0", "end_1", "records_0", "records_1"])

        for b in batches:
            for file, start, quoted, empty in zip(*(b.column(c).to_pylist() for c in ("file", "range", "quoted", "empty"))):
                if at != (file, start):
                    if at:
                        yield out()
                    at, ends, counts = (file, start), [OUTSIDE, INSIDE], [0, 0]
                for case in (0, 1):
                    counts[case] += ends[case] == OUTSIDE and not empty
                if quoted is not None:
                    ends = [line_end(quoted, e, sep) for e in ends]
        if at:
            yield out()
    return run


def _settle(rows: pa.Table) -> pa.Table:
    """One file's ranges in order: how each begins, and the number of records
    before it. A row a range."""
    rows = rows.sort_by("range")
    case, number, cases, numbers = OUTSIDE, 0, [], []
    for r in rows.to_pylist():
        cases.append(case)
        numbers.append(number)
        number += r[f"records_{case}"]
        case = r[f"end_{case}"]
    return pa.table({"file": rows.column("file"), "range": rows.column("range"), "case": pa.array(cases, pa.int32()),
                     "number": pa.array(numbers, pa.int64())})


_CUT = "file string, number long, range long, whole boolean, record string"


def _cut(sep: str):
    """mapInArrow over lines in order, each with its range's case and number:
    records that lie within a range, and the parts of those that do not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, case, number, held, begun = None, OUTSIDE, 0, [], True
        rows: list[tuple] = []

        def part(whole: bool):
            rows.append((*at[:1], number - 1, at[1], whole, "\n".join(held)))
            held.clear()

        def out():
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file", "number", "range", "whole", "record"])
            rows.clear()
            return done

        for b in batches:
            for file, start, value, c, n in zip(*(b.column(x).to_pylist() for x in ("file", "range", "value", "case", "number"))):
                if at != (file, start):
                    if held:
                        part(False)
                    at, case, number, begun = (file, start), c, n, c == OUTSIDE
                if case == OUTSIDE:
                    if value.removesuffix("\r") == "":
                        continue
                    number, begun = number + 1, True
                held.append(value)
                if '"' in value:
                    case = line_end(value, case, sep)
                if case == OUTSIDE:
                    part(begun)  # not whole: it began in a range before
                    begun = True
            yield out()
        if held:
            part(False)
            yield out()
    return run


def read_records(spark: SparkSession, path: str, sep: str = "\t", broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """(file, number, record): every record of the files at ``path`` as its
    text, numbered from 0 in its file."""
    lines = _lines(spark, path)
    quoted = F.when(F.contains("value", F.lit('"')), F.col("value"))
    ranges_at = scratch_dir(spark, "ranges")
    (lines.select("file", "range", quoted.alias("quoted"), F.rtrim(F.col("value"), F.lit("\r")).eqNullSafe("").alias("empty"))
     .mapInArrow(_compose(sep), "file string, range long, end_0 int, end_1 int, records_0 long, records_1 long")
     .write.parquet(ranges_at))
    ranges = spark.read.parquet(ranges_at)
    cases_at = scratch_dir(spark, "cases")
    ranges.groupBy("file").applyInArrow(_settle, "file string, range long, case int, number long").write.parquet(cases_at)
    cases = spark.read.parquet(cases_at)
    if cases.count() <= broadcast_ranges:
        told = lines.join(F.broadcast(cases), ["file", "range"])  # lines stay where and as they are
    else:
        placed = lines.withColumn("line", F.monotonically_increasing_id()).join(cases, ["file", "range"])
        told = placed.repartition("file", "range").sortWithinPartitions("file", "range", "line")
    cut_at = scratch_dir(spark, "records")
    told.select("file", "range", "value", "case", "number").mapInArrow(_cut(sep), _CUT).write.parquet(cut_at)
    cut = spark.read.parquet(cut_at)
    joined = (cut.where(~F.col("whole")).groupBy("file", "number")
              .agg(F.array_sort(F.collect_list(F.struct("range", "record"))).alias("parts"))
              .select("file", "number", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record")))
    return cut.where("whole").select("file", "number", "record").unionAll(joined)


def read_delimited(spark: SparkSession, path: str, schema: StructType, sep: str = "\t", header: bool = True,
                   ordinal: str | None = None, broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """The files at ``path`` by position, as ``spark.read.csv`` with
    ``multiLine`` reads them in one task a file. ``ordinal`` names a further
    column with each row's place over all files, in the order of their paths."""
    records = read_records(spark, path, sep, broadcast_ranges)
    if header:
        records = records.where("number > 0").withColumn("number", F.col("number") - 1)
    fields = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    # A trailing line end belongs to the line, not to the last field.
    text = F.when(F.endswith("record", F.lit("\r")), F.expr("substring(record, 1, length(record) - 1)")).otherwise(F.col("record"))
    parsed = F.from_csv(text, fields.simpleString()[len("struct<"):-1].replace(":", " "),
                        {"sep": sep, "escape": '"', "multiLine": "true"})
    rows = records.select("file", "number", parsed.alias("r"))
    cols = [F.col(f"r.c{i}").alias(f.name) for i, f in enumerate(schema.fields)]
    if not ordinal:
        return rows.select(*cols)
    per_file = records.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = totals_before(per_file, ["file"], "n", "before", scratch_dir(spark, "files"))
    return (rows.join(before.select("file", "before"), "file")
            .select(*cols, (F.col("before") + F.col("number")).alias(ordinal)))
