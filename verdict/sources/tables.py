"""Scans and sinks: the corpus, string tables, the reply log, result tables.

Every read takes an explicit schema. The reply log is one dataset partitioned
by ``method`` and ``model`` (real columns, pruned on read), not one file per
model and method.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas
from ..session import scratch_dir
from . import splittable
from .ordinals import totals_before


def read_corpus(spark: SparkSession, path: str, fmt: str = "csv",
                schema: StructType = schemas.CORPUS) -> DataFrame:
    """A1: the labelled corpus. TSV with quoted multi-line fields, or Parquet.

    A TSV is read by many tasks a file (``splittable``). Item numbering follows
    file order, which Spark rows do not carry: a corpus without an ``ordinal``
    (a TSV whose ``schema`` has none, or such a Parquet corpus) gets its place
    over all files in the order of their paths."""
    if fmt == "csv":
        own = "ordinal" in schema.fieldNames()
        return splittable.read_delimited(spark, path, schema, ordinal=None if own else "ordinal")
    df = spark.read.parquet(path)
    if "ordinal" not in df.columns:
        df = with_file_ordinal(df)
    return df


def with_file_ordinal(df: DataFrame, out: str = "ordinal") -> DataFrame:
    """A Parquet scan's rows numbered from 0 in file order: by path, then by
    row index within the file. Rows are counted per file, the counts summed in
    two levels, and joined back by path; the planner broadcasts them or not by
    their size (one row a file)."""
    keyed = df.withColumn("_file", F.col("_metadata.file_path")).withColumn(
        "_row", F.col("_metadata.row_index"))
    per_file = keyed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = totals_before(per_file, ["_file"], "_n", "_first", scratch_dir(df.sparkSession, "files"))
    return (keyed.join(before.select("_file", "_first"), "_file")
            .withColumn(out, F.col("_first") + F.col("_row"))
            .drop("_file", "_row", "_first"))


def read_table(spark: SparkSession, path: str, columns: list[str],
               separator: str = ",") -> DataFrame:
    """A2: a CSV read as strings, an empty field kept as '' (not null)."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    df = (spark.read.schema(schema)
          .options(sep=separator, header=True, multiLine=True, escape='"')
          .csv(path))
    return df.na.fill("")


def read_replies(spark: SparkSession, path: str, method: str | None = None,
                 model: str | None = None, fmt: str = "parquet",
                 schema: StructType = schemas.REPLIES) -> DataFrame:
    """A3/A4: the reply log, or an empty frame when nothing was written yet.
    ``method`` / ``model`` filters prune partitions."""
    try:
        if fmt == "json":
            df = spark.read.schema(schema).json(path)
        else:
            df = spark.read.schema(schema).parquet(path)
        df.schema  # resolves the path
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem) and "does not exist" not in str(problem):
            raise
        df = spark.createDataFrame([], schema)
    if method is not None:
        df = df.filter(F.col("method") == method)
    if model is not None:
        df = df.filter(F.col("model") == model)
    return df


#: What a log line that cannot be read is put down to.
NOT_JSON, WRONG_TYPE, NO_KEY = "not JSON", "wrong type", "no key"
QUARANTINE = ["file", "range", "line", "reason", "value"]


def read_log_lines(spark: SparkSession, path: str, schema: StructType = schemas.LOG) -> tuple[DataFrame, DataFrame]:
    """A3 with a quarantine: (replies, damaged) of a JSON-lines log. Every line
    that is not blank is in one of the two. ``damaged`` keeps the line as it
    stands, with its reason and place: file, start of its byte range, and line
    within the range (from 0). A line is damaged if it is no JSON object, if a
    value is not of its column's type, or if the reply's key is not whole."""
    told = StructType([*schema.fields, StructField("_damaged", StringType())])
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
                     F.monotonically_increasing_id().alias("_at"), "value"))
    full = lines.where(F.trim(F.col("value")) != "")
    read = full.withColumn("_r", F.from_json("value", told, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"}))
    keyless = " OR ".join(f"_r.{k} IS NULL" for k in schemas.WORK_KEYS)
    is_object = F.from_json("value", "map<string,string>").isNotNull()
    reason = (F.when(F.col("_r").isNull() | F.col("_r._damaged").isNotNull(), F.when(is_object, F.lit(WRONG_TYPE)).otherwise(F.lit(NOT_JSON)))
              .when(F.expr(keyless), F.lit(NO_KEY)))
    marked = read.withColumn("reason", reason)
    replies = marked.where("reason IS NULL").select(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields])
    # Lines of a range are numbered in a row; its first number is its base.
    base = lines.groupBy("file", "range").agg(F.min("_at").alias("_base"))
    damaged = (marked.where("reason IS NOT NULL").select("file", "range", "_at", "reason", "value")
               .join(base, ["file", "range"]).withColumn("line", F.col("_at") - F.col("_base")))
    return replies, damaged.select(*QUARANTINE)


def quarantine(damaged: DataFrame, sink: str) -> int:
    """Writes the damaged lines of a log by reason, in place of an earlier
    account of the same log. Returns their number."""
    write_table(damaged, sink, columns=QUARANTINE, partition_by=["reason"])
    kept = damaged.sparkSession.read.schema(damaged.schema).parquet(sink)
    return kept.count()


def write_table(df: DataFrame, path: str, columns: list[str] | None = None,
                partition_by: list[str] | None = None, mode: str = "overwrite",
                fmt: str = "parquet") -> str:
    """Project to the declared column order, then write."""
    if columns:
        df = df.select(*columns)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt in ("csv", "tsv"):
        (writer.options(sep="\t" if fmt == "tsv" else ",", header=True, escape='"')
         .csv(path))
    else:
        writer.format(fmt).save(path)
    return path


def put_in_place(spark: SparkSession, draft: str, path: str) -> str:
    """Moves a written table to ``path`` by renames, in place of an earlier one,
    which is deleted only once the new one stands there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    source, target, before = hadoop(draft), hadoop(path), hadoop(f"{path}_before")
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.delete(before, True)
        if not fs.rename(target, before):
            raise OSError(f"cannot move the earlier table of {path}")
    if not fs.rename(source, target):
        raise OSError(f"cannot move {draft} to {path}")
    fs.delete(before, True)
    return path


def append_replies(df: DataFrame, path: str) -> str:
    """Append replies to the log, partitioned by method and model, with the
    time of the append and a classifier's refusal score where there is one.
    Each task writes its own file and the job commits atomically, so concurrent
    writers need no lock."""
    if "logged_at" not in df.columns:
        df = df.withColumn("logged_at", F.current_timestamp())
    cols = [f.name for f in schemas.LOG.fields if f.name in df.columns]
    return write_table(df.select(*cols), path, partition_by=["method", "model"],
                       mode="append")


def save_bucketed(df: DataFrame, table: str, key: str = "prompt_id", buckets: int = 512,
                  mode: str = "overwrite") -> DataFrame:
    """A catalog table hash-bucketed (and sorted) by ``key``.

    Saving the reply log and the prompt keys this way, with the same key and
    bucket count, co-locates them: a scan of either already has the hash
    partitioning a join or aggregation on ``key`` needs, so scoring reads the
    replies, pre-aggregates and joins the prompts without shuffling reply data
    (``metrics.score_replies`` on ``spark.table(...)``). Appends keep the
    bucketing. Needs a catalog that persists tables (a metastore)."""
    (df.write.mode(mode).bucketBy(buckets, key).sortBy(key).format("parquet")
     .saveAsTable(table))
    return df.sparkSession.table(table)
