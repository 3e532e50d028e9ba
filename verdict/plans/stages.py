"""The stages a run goes through, each writing its tables before the next.

    build     corpus -> items, prompts (checked)
    generate  prompts -> what a model still owes -> replies appended to the log
    review    a second round over another model's baseline replies
    evaluate  log -> judgements (partitioned by method, model) -> scores, agreement

Every stage reads what the previous one wrote, so a stage can be rerun alone,
a failed stage costs only itself, and no plan carries the lineage of the
stages before it. Paths should be on the shared file system (for example
under ``spark.checkpoint.dir``), never a machine-local folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Settings
from ..operators import items as item_ops
from ..operators import judge, metrics, quality, replies
from ..operators import prompts as prompt_ops
from ..sources import tables


def build(corpus: DataFrame, settings: Settings, out_dir: str, item_ids: str = "make",
          check: bool = True, sort_items: bool = True) -> dict[str, str]:
    """Items (sampled per direction) and rendered prompts, written as
    Parquet. The quality checks are counted as the rows are written. Prompts are
    written once, beside their place, and move there only after the checks pass;
    a failing build leaves earlier prompts as they were."""
    spark = corpus.sparkSession
    paths = {"items": f"{out_dir}/items", "prompts": f"{out_dir}/prompts"}
    watch = quality.Watch(spark, settings)
    built = item_ops.build_items(corpus, settings, item_ids=item_ids)
    sampled = item_ops.stratified_sample(built, settings.items_per_direction,
                                         settings.sample_seed, settings.positive_label)
    # The items table is sorted by id at the sink (a range-partitioned
    # sort; nothing upstream depends on order).
    if sort_items:
        sampled = sampled.orderBy("item_id")
    tables.write_table(watch.items(sampled, by_id=sort_items) if check else sampled,
                       paths["items"], columns=schemas.ITEM_COLUMNS)
    items = spark.read.parquet(paths["items"])
    rendered = prompt_ops.build_prompts(items, settings)
    draft = f"{out_dir}/prompts_unchecked"
    tables.write_table(watch.prompts(rendered) if check else rendered, draft,
                       columns=schemas.PROMPT_COLUMNS + ["examples_shown"], partition_by=["method"])
    if check:
        if not sort_items:
            watch.ids(items, "item_id")
        watch.ids(spark.read.parquet(draft), "prompt_id")
        quality.assert_clean(watch.checks())
    tables.put_in_place(spark, draft, paths["prompts"])
    return paths


def owed(spark: SparkSession, prompts_path: str, log_path: str, settings: Settings,
         model: str, method: str | None = None, retry_failed: bool = False,
         limit: int | None = None) -> DataFrame:
    """What one model still owes (all methods but the review one, or one).
    S2: ``limit`` takes the first of what is owed, by prompt and replicate."""
    prompts = spark.read.parquet(prompts_path)
    if method:
        prompts = prompts.filter(F.col("method") == method)
    else:
        prompts = prompts.filter(F.col("method") != settings.review_method)
    wanted = replies.wanted_replies(prompts, settings, models=[model])
    have = tables.read_replies(spark, log_path, model=model)
    work = replies.outstanding(wanted, have, retry_failed)
    if limit is not None:
        work = work.orderBy("prompt_id", "replicate").limit(limit)
    return replies.attach_prompts(work, prompts)


def generate(spark: SparkSession, prompts_path: str, log_path: str, settings: Settings,
             produce: Callable[[dict], str], model: str, method: str | None = None,
             buckets: int = 16, workers: int = 1, retry_failed: bool = False,
             limit: int | None = None) -> int:
    """Call the judge for everything still owed (or the first ``limit``
    of it); resumable."""
    work = owed(spark, prompts_path, log_path, settings, model, method, retry_failed, limit)
    return replies.collect_replies(work, produce, log_path, buckets=buckets,
                                   workers=workers, owed=True)


def review(spark: SparkSession, items_path: str, prompts_path: str, log_path: str,
           settings: Settings, produce: Callable[[dict], str], model: str, reviewer: str,
           buckets: int = 16, workers: int = 1, limit: int | None = None) -> int:
    """E2, second round: ``model`` reviews ``reviewer``'s baseline replies (or
    the first ``limit`` owed reviews). Of a reply logged twice the latest is
    reviewed, once."""
    log = tables.read_replies(spark, log_path, schema=schemas.LOG).withColumn(
        "logged_at", F.coalesce("logged_at", F.timestamp_seconds(F.lit(0))))
    work = replies.review_prompts(spark.read.parquet(prompts_path),
                                  spark.read.parquet(items_path), log, settings,
                                  model=model, reviewer=reviewer,
                                  collected=log.filter(F.col("model") == model),
                                  order_col="logged_at")
    if limit is not None:
        work = work.orderBy("prompt_id", "replicate").limit(limit)
    work = work.withColumn("runtime", F.lit(settings.model(model).runtime)).withColumn(
        "temperature", F.lit(float(settings.temperature)))
    return replies.collect_replies(work, produce, log_path, buckets=buckets, workers=workers,
                                   owed=True)


def evaluate(spark: SparkSession, log_path: str, prompts_path: str, settings: Settings,
             out_dir: str, refusal_score: str | None = None) -> dict[str, str]:
    """Judgements, then the scores and agreement read from them.
    ``refusal_score`` names a column of the log (F2), usually
    ``refusal_score``; where it is null the patterns decide."""
    paths = {"judgements": f"{out_dir}/judgements", "scores": f"{out_dir}/scores",
             "agreement": f"{out_dir}/agreement", "summary": f"{out_dir}/summary"}
    log = tables.read_replies(spark, log_path, schema=schemas.LOG)
    judged = judge.judgements(log,
                              spark.read.parquet(prompts_path), settings,
                              refusal_score=refusal_score)
    tables.write_table(judged, paths["judgements"], columns=schemas.JUDGEMENT_COLUMNS,
                       partition_by=["method", "model"])
    j = spark.read.parquet(paths["judgements"])
    tables.write_table(metrics.score_everything(j, settings), paths["scores"],
                       columns=schemas.SCORE_COLUMNS)
    tables.write_table(metrics.replicate_agreement(j, settings=settings), paths["agreement"])
    tables.write_table(judge.judge_summary(j), paths["summary"])
    return paths
