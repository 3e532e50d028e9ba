"""Judging a reply log as it grows (Structured Streaming).

The evaluated pipeline appends replies to a log and re-reads it whole; here
the log is a file stream. New files are read once, judged with the same
operators as the batch path (a stream-static inner join to the prompt keys),
and appended to a judgements sink; the confusion counts of all three views
per (model, method, shots, direction) are kept as streaming state, and the
full score table derived from them equals scoring every reply seen in one
batch. Progress lives in the checkpoint, so a restarted query resumes where it
stopped and a lost executor only re-runs its micro-batch.

A reply's event time is when it was logged (``logged_at``; where the log has
none, when its file was written). With ``dedupe_within`` a reply logged again
within that time of the first counts once, the first as it came. Its key is
let go when the watermark (that much behind the newest time of the
micro-batches before) has passed that time, and a repeat after that is a new
reply; one logged before the watermark is late and left out. The state is one
key per reply of that time; without it, the counts state is bounded by the
number of groups.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas
from ..config import Settings
from ..functions import labels
from ..operators import judge, metrics
from ..schemas import WORK_KEYS


def reply_stream(spark: SparkSession, path: str, fmt: str = "json",
                 max_files_per_trigger: int | None = None,
                 dedupe_within: str | None = None) -> DataFrame:
    """The log as a stream, each reply once if ``dedupe_within`` says so."""
    reader = spark.readStream.schema(schemas.LOG).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.load(path)
    rows = rows.withColumn("logged_at", F.coalesce("logged_at", F.col("_metadata.file_modification_time")))
    if dedupe_within:
        rows = rows.withWatermark("logged_at", dedupe_within).dropDuplicatesWithinWatermark(WORK_KEYS)
    return rows


def _start(writer, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_judgements(spark: SparkSession, log_path: str, prompts: DataFrame,
                      settings: Settings, sink_path: str, checkpoint_path: str,
                      fmt: str = "json", max_files_per_trigger: int | None = None,
                      available_now: bool = True, dedupe_within: str | None = None) -> StreamingQuery:
    """Every new reply file -> judgements appended to ``sink_path``."""
    stream = reply_stream(spark, log_path, fmt, max_files_per_trigger, dedupe_within)
    judged = judge.judgements(stream, prompts, settings)
    writer = (judged.writeStream.format("parquet").outputMode("append")
              .option("path", sink_path).option("checkpointLocation", checkpoint_path))
    return _start(writer, available_now)


def running_counts(judged: DataFrame, settings: Settings,
                   group_cols=("model", "method", "shots", "direction")) -> DataFrame:
    """T2 body: the one-pass confusion counts of all three views, refusals and
    unparsed, per group, the same aggregate the batch scores use. Counts only:
    metrics, agreement and pivots are derived in batch from the output
    (distinct counts and pivots do not run on a stream)."""
    return metrics.confusion(judged, list(group_cols), settings)


#: Published tables that stay: the current one, and the one a reader may still hold.
KEPT_EPOCHS = 2


class Published:
    """A small result table, published whole epoch by epoch: each epoch is
    written to a folder of its own, and one pointer file, replaced by a rename,
    names the current one. A reader sees an epoch or the one before it, never
    part of one. Publishing an epoch that is current or older does nothing, so
    a replayed micro-batch changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def current(self) -> int | None:
        at = self._path(f"{self.path}/current")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["epoch"]
        finally:
            stream.close()

    def publish(self, table: DataFrame, epoch: int) -> bool:
        now = self.current()
        if now is not None and epoch <= now:
            return False
        table.write.mode("overwrite").parquet(f"{self.path}/epochs/{epoch}")
        draft = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"epoch": epoch}).encode()))
        out.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        files = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        files.rename(draft, self._path(f"{self.path}/current"), how)
        for s in self._fs.listStatus(self._path(f"{self.path}/epochs")):
            if int(s.getPath().getName()) <= epoch - KEPT_EPOCHS:
                self._fs.delete(s.getPath(), True)
        return True

    def read(self) -> DataFrame:
        epoch = self.current()
        if epoch is None:
            raise FileNotFoundError(f"nothing published at {self.path}")
        return self.spark.read.parquet(f"{self.path}/epochs/{epoch}")


def stream_counts(spark: SparkSession, log_path: str, prompts: DataFrame,
                  settings: Settings, sink_path: str, checkpoint_path: str,
                  fmt: str = "json", max_files_per_trigger: int | None = None,
                  available_now: bool = True, dedupe_within: str | None = None) -> StreamingQuery:
    """Running counts; each micro-batch publishes the (small) complete
    result table, so ``Published(spark, sink_path).read()`` always holds the
    counts of every reply seen up to one moment."""
    stream = reply_stream(spark, log_path, fmt, max_files_per_trigger, dedupe_within)
    counts = running_counts(judge.judgements(stream, prompts, settings), settings)

    def publish(batch: DataFrame, epoch: int) -> None:
        Published(batch.sparkSession, sink_path).publish(batch, epoch)

    writer = (counts.writeStream.outputMode("complete").foreachBatch(publish)
              .option("checkpointLocation", checkpoint_path))
    return _start(writer, available_now)


#: Cells of M6 as a stream emits them.
CELLS = "prompt_id string, model string, replies int, judged int, same boolean, complete boolean"
_WAITING = ("prompt_id", "model", "replies", "judged", "least", "greatest", "expires")
_CELL_STATE = ("prompt_id array<string>, model array<string>, replies array<int>, judged array<int>, least array<int>, "
               "greatest array<int>, expires array<bigint>")
#: Buckets of cells. A checkpoint keeps the number it began with.
CELL_BUCKETS = 1024


def _merged(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """Parts of cells as one row per cell, keys in the order they came."""
    return pd.concat(parts).groupby(["prompt_id", "model"], sort=False, dropna=False).agg(
        {"replies": "sum", "judged": "sum", "least": "min", "greatest": "max", "newest": "max", "expires": "max"}).reset_index()


def _cells(replicates: int, expiry_ms: int):
    """The cells (prompt, model) of a bucket, each until all its replies are in,
    or it expires."""
    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        parts = []
        if state.exists:  # newest -1: no reply now
            parts.append(pd.DataFrame(dict(zip(_WAITING, map(list, state.get)))).assign(newest=-1))
        if not state.hasTimedOut:
            parts += [_merged([f.assign(replies=1, newest=f["logged_ms"].clip(lower=0), expires=0)]) for f in frames if len(f)]
        if not parts:
            return
        cells = _merged(parts)
        for c in ("prompt_id", "model"):
            cells[c] = cells[c].astype(object).where(cells[c].notna(), None)
        fresh = cells["newest"] >= 0
        cells["expires"] = cells["expires"].mask(fresh, cells["newest"].clip(lower=now) + expiry_ms)
        cells["complete"] = cells["replies"] >= replicates
        ends = cells["complete"] | ~fresh & (cells["expires"] < now)
        waiting, ended = cells[~ends], cells[ends]
        if len(waiting):
            state.update(tuple(waiting[c].tolist() for c in _WAITING))
            state.setTimeoutTimestamp(int(waiting["expires"].min()))
        elif state.exists:
            state.remove()
        same = (ended["least"] == ended["greatest"]).astype(object).where(ended["judged"] > 0, None)
        yield ended.assign(same=same)[["prompt_id", "model", "replies", "judged", "same", "complete"]]
    return run


def agreement_cells(replies: DataFrame, settings: Settings, expiry: str = "1 day", buckets: int = CELL_BUCKETS) -> DataFrame:
    """M6 as a stream: one row per (prompt, model) once as many replies as the
    settings' replicates have come, failed ones included, or ``expiry`` after
    its last one. State: counts and two labels a cell that waits, kept by hash
    bucket, so that Python is called once a bucket of a micro-batch and not once
    a cell; a bucket's cells of a micro-batch are in memory together, so a log of
    billions of replies a batch asks for more ``buckets``. A reply later than
    its cell's row begins a new cell; de-duplicate the stream where replies may
    be logged twice. ``replies`` needs a watermark on ``logged_at``."""
    observed = labels.parse_label("response", settings.positive_label, settings.negative_label)
    # Labels as numbers; a failed reply has none and moves neither bound.
    label = F.when(~labels.has_error("error"), F.when(observed == settings.positive_label, 1)
                   .when(observed == settings.negative_label, 2).otherwise(0))
    rows = replies.select("prompt_id", "model", "logged_at", F.unix_millis("logged_at").alias("logged_ms"), label.alias("_label"))
    rows = rows.select("prompt_id", "model", "logged_at", "logged_ms", F.col("_label").isNotNull().cast("int").alias("judged"),
                       F.coalesce("_label", F.lit(3)).alias("least"), F.coalesce("_label", F.lit(-1)).alias("greatest"),
                       F.pmod(F.xxhash64("prompt_id", "model"), F.lit(buckets)).alias("_bucket"))
    expiry_ms = int(pd.Timedelta(expiry).total_seconds() * 1000)
    return rows.groupBy("_bucket").applyInPandasWithState(
        _cells(settings.replicates, expiry_ms), CELLS, _CELL_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_agreement(spark: SparkSession, log_path: str, settings: Settings, sink_path: str, checkpoint_path: str,
                     fmt: str = "json", max_files_per_trigger: int | None = None, available_now: bool = True,
                     dedupe_within: str | None = None, late: str = "1 day", expiry: str = "1 day") -> StreamingQuery:
    """M6 over the growing log: finished cells appended to ``sink_path``."""
    stream = reply_stream(spark, log_path, fmt, max_files_per_trigger, dedupe_within)
    if not dedupe_within:
        stream = stream.withWatermark("logged_at", late)
    writer = (agreement_cells(stream, settings, expiry).writeStream.format("parquet").outputMode("append")
              .option("path", sink_path).option("checkpointLocation", checkpoint_path))
    return _start(writer, available_now)


def agreement_from_cells(cells: DataFrame) -> DataFrame:
    """M6's table from the cells that have a judged reply."""
    judged = cells.where("judged > 0")
    return judged.agg(F.count(F.lit(1)).alias("cells"), F.count_if("same").alias("agreed"),
                      (F.count_if("same") / F.count(F.lit(1))).alias("agreement"))


def scores_from_counts(counts: DataFrame, views=metrics.VIEWS) -> DataFrame:
    """The full score table (every direction and overall, three views) from
    the running counts: a batch read of the sink, the same result as scoring
    every reply seen so far."""
    cols = ["model", "method", "shots", "direction"]
    overall = metrics.resum(counts, metrics.GROUP, direction="overall")
    both = counts.unionByName(overall.select(*counts.columns))
    return metrics.score(both, cols, views)
