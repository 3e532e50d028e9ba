"""Judgements -> scores: confusion counts under three views, closed-form
metrics, replicate agreement, recall by severity.

Counts are additive, so the data is read once: one hash aggregate produces the
four counts of every view per (model, method, shots, direction); the overall
rows are a re-sum of those small rows, and the three views are unpacked from
one row with ``explode``. No view or grouping rescans the judgements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..dimensions import literal
from . import judge

VIEWS = ("all", "parsed", "judged")
CELLS = ("tp", "fp", "fn", "tn")
GROUP = ["model", "method", "shots"]


def _view_masks(settings: Settings) -> dict[str, tuple[str, str]]:
    """Per view, as SQL text: which rows it holds, and whether the row was read
    as positive (in ``all`` an unreadable reply counts against its truth)."""
    y = f"answer = {literal(settings.positive_label)}"
    pred = f"observed = {literal(settings.positive_label)}"
    return {
        "all": ("true", f"CASE WHEN {pred} THEN true WHEN observed = {literal(settings.negative_label)} THEN false ELSE NOT ({y}) END"),
        "parsed": ("parsed", pred),
        "judged": ("parsed AND NOT refusal", pred),
    }


def confusion(judged: DataFrame, group_cols: list[str], settings: Settings,
              weight: str | None = None) -> DataFrame:
    """One pass: tp/fp/fn/tn of every view, and refusals / unparsed of the
    whole group, per group. With ``weight``, each row stands for that many
    judgements (see ``judged_counts``)."""
    y = f"answer = {literal(settings.positive_label)}"

    def n(cond, name):
        of = f"count_if({cond})" if weight is None else f"sum(CAST(CASE WHEN {cond} THEN {weight} ELSE 0 END AS BIGINT))"
        return F.expr(of).alias(name)

    aggs = []
    for v, (member, pred) in _view_masks(settings).items():
        for name, truth, said in (("tp", y, pred), ("fp", f"NOT ({y})", pred), ("fn", y, f"NOT ({pred})"), ("tn", f"NOT ({y})", f"NOT ({pred})")):
            aggs.append(n(f"({member}) AND ({truth}) AND ({said})", f"{v}_{name}"))
    aggs += [n("refusal", "refusals"), n("NOT parsed", "unparsed")]
    return judged.groupBy(*group_cols).agg(*aggs)


def judged_counts(replies: DataFrame, prompts: DataFrame, settings: Settings,
                  refusal_score: str | None = None) -> DataFrame:
    """Judgements collapsed before the join: one row per (prompt, model,
    method, observed label, refusal) with its count ``_n``.

    Scoring needs only counts, so replies are aggregated first; the partial
    aggregate runs map-side, so a prompt id holding a large share of all
    replies is reduced to a handful of rows before anything is shuffled, and
    the join to the prompt keys sees at most as many times fewer rows as there
    are replicates."""
    read = judge.read_replies(replies, settings, refusal_score)
    counted = read.groupBy("prompt_id", "model", "method", "observed", "refusal").agg(
        F.count(F.lit(1)).alias("_n"))
    spec = prompts.select("prompt_id", "shots", "direction", "answer")
    return counted.join(spec, "prompt_id").withColumn("parsed", F.col("observed") != "")


def resum(counts: DataFrame, group_cols: list[str], **constants) -> DataFrame:
    """Re-aggregate count rows to coarser groups (counts are additive)."""
    count_cols = [c for c in counts.columns if c not in group_cols
                  and c not in constants and c != "direction"]
    out = counts.groupBy(*group_cols).agg(*[F.sum(c).alias(c) for c in count_cols])
    for k, v in constants.items():
        out = out.withColumn(k, F.lit(v))
    return out



def score(counts: DataFrame, group_cols: list[str], views=VIEWS) -> DataFrame:
    """M1 + M3: unpack the views and compute n, MCC, precision, recall, F1 and
    accuracy. A view row is kept only when truth and prediction both take
    two values, which also rules out every zero denominator."""
    packed = ", ".join("named_struct('view', " + literal(v) + ", " + ", ".join(f"'{c}', {v}_{c}" for c in CELLS) + ")" for v in views)
    # Degenerate views are dropped inside the array, before the explode.
    keep = "v.tp + v.fn > 0 AND v.tn + v.fp > 0 AND v.tp + v.fp > 0 AND v.tn + v.fn > 0"
    rows = counts.selectExpr(*group_cols, "refusals", "unparsed", f"explode(filter(array({packed}), v -> {keep})) AS _v")
    rows = rows.selectExpr(*group_cols, "refusals", "unparsed", "_v.view AS view", "_v.tp + _v.fp + _v.fn + _v.tn AS n",
                           *(f"CAST(_v.{c} AS DOUBLE) AS {c}" for c in CELLS))
    return rows.selectExpr(
        *group_cols, "view", "CAST(refusals AS BIGINT) AS refusals", "CAST(unparsed AS BIGINT) AS unparsed",
        "CAST(n AS BIGINT) AS n",
        "try_divide(tp * tn - fp * fn, sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))) AS mcc",
        "try_divide(tp, tp + fp) AS precision", "try_divide(tp, tp + fn) AS recall",
        "try_divide(2.0D * tp, 2.0D * tp + fp + fn) AS f1", "try_divide(tp + tn, tp + fp + fn + tn) AS accuracy")


def score_everything(judged: DataFrame, settings: Settings, views=VIEWS,
                     weight: str | None = None) -> DataFrame:
    """M4: scores per (model, method, shots) for every direction and overall.

    The judgements are aggregated once, by direction; 'overall' is the re-sum
    of those rows (one per group and direction), not a second scan or a
    grouping-sets expand of the data."""
    by_dir = confusion(judged, GROUP + ["direction"], settings, weight)
    overall = resum(by_dir, GROUP, direction="overall")
    both = by_dir.unionByName(overall.select(*by_dir.columns))
    cols = ["model", "method", "shots", "direction"]
    return score(both, cols, views)


def score_overall(judged: DataFrame, settings: Settings, views=VIEWS,
                  group_cols: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """M1 / M3 at one grouping (default model, method, shots)."""
    group_cols = group_cols or GROUP
    return score(confusion(judged, group_cols, settings, weight), group_cols, views)


def score_replies(replies: DataFrame, prompts: DataFrame, settings: Settings, views=VIEWS,
                  group_cols: list[str] | None = None,
                  refusal_score: str | None = None) -> DataFrame:
    """Scores straight from the reply log, aggregating before the join
    (``judged_counts``). ``group_cols=None`` gives the full table of
    ``score_everything``; otherwise one grouping as ``score_overall``."""
    counted = judged_counts(replies, prompts, settings, refusal_score)
    if group_cols is None:
        return score_everything(counted, settings, views, weight="_n")
    return score_overall(counted, settings, views, group_cols, weight="_n")


def replicate_agreement(judged: DataFrame, keys=("prompt_id", "model"),
                        by: tuple[str, ...] = (), settings: Settings = DEFAULT) -> DataFrame:
    """M6: share of cells (default prompt x model) whose replicates all gave
    the same label. ``min = max`` per cell equals one distinct value (labels
    are never null), and both are decomposable, so a hot cell is combined
    map-side; labels are compared as one byte each, which a hash aggregate
    holds. A label that the settings do not name fails the job."""
    obs = F.col("observed")
    unknown = F.raise_error(F.concat(obs, F.lit(" is not a label of the settings"))).cast("tinyint")
    code = (F.when(obs == F.lit(settings.positive_label), F.lit(2))
            .when(obs == F.lit(settings.negative_label), F.lit(1)).when(obs == "", F.lit(0))
            .when(obs.isNotNull(), unknown)).cast("tinyint")
    cells = judged.withColumn("_code", code).groupBy(*keys, *by).agg(
        (F.min("_code") == F.max("_code")).alias("_same"))
    grouped = cells.groupBy(*by) if by else cells.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("cells"),
                       F.count_if("_same").alias("agreed"),
                       (F.count_if("_same") / F.count(F.lit(1))).alias("agreement"))


def severity_recall(judged: DataFrame, items: DataFrame, settings: Settings,
                    by=("model",)) -> DataFrame:
    """share of replies saying the positive label, per grade. For the
    positive grades this is recall; for the negative grade, the false
    positive rate. ``judged`` must carry ``item_id``."""
    said = F.col("observed") == F.lit(settings.positive_label)
    per_item = judged.groupBy(*by, "item_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(said).alias("_pos"))
    with_grade = per_item.join(items.select("item_id", "grade"), "item_id")
    return with_grade.groupBy(*by, "grade").agg(
        F.sum("_n").alias("n"), F.sum("_pos").alias("said_positive"),
        (F.sum("_pos") / F.sum("_n")).alias("share_positive"))
