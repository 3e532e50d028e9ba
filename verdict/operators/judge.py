"""Replies -> judgements: drop errors, read labels, flag refusals, attach the
prompt's gold answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import labels
from ..schemas import JUDGEMENT_COLUMNS


def dedupe_replies(replies: DataFrame, order_col: str | None = None,
                   keys=("prompt_id", "model", "method", "replicate")) -> DataFrame:
    """Q17 option: one reply per key. With ``order_col`` (an ingest order) the
    latest is kept; without, the greatest row, so the choice never depends on
    which task ran first. The rows of one key are combined map-side
    (``max`` of a struct is decomposable)."""
    rest = [c for c in replies.columns if c not in keys and c != order_col]
    first = [order_col] if order_col else []
    best = replies.groupBy(*keys).agg(F.max(F.struct(*first, *rest)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in first + rest])


def read_replies(replies: DataFrame, settings: Settings,
                 refusal_score: str | None = None) -> DataFrame:
    """P13 + P10 + P11 (+ F2): one narrow row per usable reply. ``response``
    is read here and dropped, so nothing wide reaches a shuffle."""
    kept = replies.filter(~labels.has_error("error"))
    observed = labels.parse_label("response", settings.positive_label,
                                  settings.negative_label)
    out = kept.select("prompt_id", "model", "replicate", "method",
                      observed.alias("observed"), "response",
                      *([refusal_score] if refusal_score else []))
    refusal = labels.is_refusal("response", "observed")
    if refusal_score:
        refusal = labels.refusal_with_score(refusal, refusal_score,
                                            settings.refusal_threshold)
    return out.select("prompt_id", "model", "replicate", "method", "observed",
                      refusal.alias("refusal"))


def judgements(replies: DataFrame, prompts: DataFrame, settings: Settings,
               refusal_score: str | None = None, keep: tuple[str, ...] = (),
               dedupe: bool = False, order_col: str | None = None) -> DataFrame:
    """J2 + U1: read every reply (all methods and models in one scan) and join
    the prompt's shots, direction and answer. ``method`` stays the reply's own
    (a review reply reuses a baseline prompt id). Replies whose prompt is
    unknown are dropped (inner join). Repeated replies count each time, as in
    the evaluated pipeline, unless ``dedupe`` (Q17). The join key is narrow on
    both sides; AQE broadcasts the prompt side while it is small and splits
    skewed keys otherwise. For scores, ``metrics.score_replies`` aggregates
    before this join instead."""
    if dedupe:
        replies = dedupe_replies(replies, order_col)
    read = read_replies(replies, settings, refusal_score)
    spec = prompts.select("prompt_id", "shots", "direction", "answer", *keep)
    joined = read.join(spec, "prompt_id")
    return joined.select(*[c for c in JUDGEMENT_COLUMNS if c not in ("parsed", "refusal")],
                         (F.col("observed") != "").alias("parsed"), "refusal", *keep)


def judge_summary(judged: DataFrame) -> DataFrame:
    """M7: replies, unparsed and refusals per (model, method)."""
    return judged.groupBy("model", "method").agg(
        F.count(F.lit(1)).alias("replies"),
        F.count_if(~F.col("parsed")).alias("unparsed"),
        F.count_if(F.col("refusal")).alias("refusals"))


def refusal_crosstab(judged: DataFrame, model: str | None = None,
                     method: str | None = "baseline") -> DataFrame:
    """Direction x refusal counts (pivot on the two known values)."""
    part = judged
    if model:
        part = part.filter(F.col("model") == model)
    if method:
        part = part.filter(F.col("method") == method)
    grid = part.groupBy("direction").pivot("refusal", [False, True]).count().na.fill(0)
    return (grid.withColumnRenamed("false", "refusal_false")
            .withColumnRenamed("true", "refusal_true"))


def inspect_replies(replies: DataFrame, prompts: DataFrame, model: str | None = None,
                    method: str | None = "baseline", n: int = 5) -> DataFrame:
    """J7 + S6: the first few replies with their prompt's direction and answer."""
    part = replies
    if model:
        part = part.filter(F.col("model") == model)
    if method:
        part = part.filter(F.col("method") == method)
    merged = part.join(prompts.select("prompt_id", "direction", "answer"), "prompt_id")
    return (merged.orderBy("prompt_id", "replicate").limit(n)
            .select("prompt_id", "replicate", "direction", "answer", "response"))
