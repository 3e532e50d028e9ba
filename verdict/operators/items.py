"""Corpus -> items: whitelist, numbering, labels, stratified sample, profiles."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dimensions
from ..config import Settings
from ..functions import ids, labels, text


def position_within(df: DataFrame, group_cols: list[str], order_col: str,
                    out: str = "position", bucket_width: int = 1 << 20,
                    tie_break: tuple[str, ...] = (), total: str | None = None) -> DataFrame:
    """0-based position of each row within its group, in ``order_col``
    order (a unique, numeric file ordinal).

    A plain ``row_number`` over the group puts a whole group in one task. Here
    each group is cut into ordinal ranges of ``bucket_width``; a small table of
    per-range counts gives each range its starting offset (a running sum over
    ranges, not rows), and rows are numbered inside their range only. No task
    holds more than ``bucket_width`` distinct ordinals, however large a group
    is. Equal ordinals are ordered by ``tie_break``. ``total`` adds the number of
    rows of the group, summed over its ranges."""
    keyed = df.withColumn("_bucket", F.floor(F.col(order_col) / F.lit(bucket_width)))
    counts = keyed.groupBy(*group_cols, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*group_cols).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    # Null keys and null ordinals are values like any other (they sort first),
    # so the join compares null-safe and no row is lost.
    keys = [*group_cols, "_bucket"]
    offsets = counts.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate(keys)],
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                            *([F.sum("_n").over(Window.partitionBy(*group_cols)).alias(total)] if total else []))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(keys)]
    local = Window.partitionBy(*group_cols, "_bucket").orderBy(order_col, *tie_break)
    return (keyed.join(offsets, reduce(and_, same))
            .withColumn(out, F.col("_offset") + F.row_number().over(local) - 1)
            .drop("_bucket", "_offset", *[f"_of_{i}" for i in range(len(keys))]))


def build_items(corpus: DataFrame, settings: Settings, item_ids: str = "ordinal",
                bucket_width: int = 1 << 20) -> DataFrame:
    """E1 items: J1 whitelist, P1 label, P2 trim, P3/P4 direction name, and
    the item id (``'ordinal'``: the corpus ordinal as is; ``'make'``: P5 over
    the W1 position within the language pair)."""
    spark = corpus.sparkSession
    wanted = dimensions.directions(spark, settings).select(
        F.col("source_language").alias("src_lang"),
        F.col("target_language").alias("tgt_lang"))
    # The whitelist has one row per configured direction: broadcast.
    kept = corpus.join(F.broadcast(wanted), ["src_lang", "tgt_lang"], "left_semi")
    names = settings.language_names()
    if item_ids == "make":
        kept = position_within(kept, ["src_lang", "tgt_lang"], "ordinal", "_index",
                               bucket_width)
        item = ids.item_id("src_lang", "tgt_lang", "_index")
    else:
        item = F.col("ordinal")
    grade = F.col("class_hall").cast("string")
    return kept.select(
        item.alias("item_id"),
        F.col("src_lang").alias("source_language"),
        F.col("tgt_lang").alias("target_language"),
        ids.direction_name(ids.language_name("src_lang", names),
                           ids.language_name("tgt_lang", names)).alias("direction"),
        grade.alias("grade"),
        labels.binary_label(grade, settings.negative_grade, settings.positive_label,
                            settings.negative_label).alias("answer"),
        text.clean_or_empty("src_text").alias("source_text"),
        text.clean_or_empty("mt_text").alias("target_text"),
    )


def stratified_sample(items: DataFrame, per_direction: int, seed: int,
                      positive: str, direction: str = "direction",
                      label: str = "answer", key: str = "item_id") -> DataFrame:
    """At most ``per_direction`` items a direction, keeping its label share.

    k+ = min(pos, round_half_even(min(N, n) * (pos / n))), k- = min(neg, min(N, n) - k+).
    Members are the k smallest ``md5(seed|id)`` of each side. The literal bound
    ``rn <= N`` lets Spark plan a WindowGroupLimit, so each map task ships at
    most N rows per (direction, label) before the shuffle. 0 keeps everything."""
    if not per_direction:
        return items
    y = F.col(label) == F.lit(positive)
    n_cap = F.lit(int(per_direction))
    quota = (items.groupBy(direction)
             .agg(F.count(F.lit(1)).alias("_n"), F.count_if(y).alias("_pos"))
             .withColumn("_wanted", F.least(n_cap, F.col("_n")))
             .withColumn("_kpos", F.least(
                 F.col("_pos"),
                 F.bround(F.col("_wanted") * (F.col("_pos") / F.col("_n")), 0).cast("long")))
             .withColumn("_kneg", F.least(F.col("_n") - F.col("_pos"),
                                          F.col("_wanted") - F.col("_kpos")))
             .select(direction, "_kpos", "_kneg"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    w = Window.partitionBy(direction, label).orderBy(order, F.col(key))
    ranked = items.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n_cap)
    # One quota row per direction; AQE broadcasts it once its size is known.
    return (ranked.join(quota, direction)
            .filter(F.col("_rn") <= F.when(y, F.col("_kpos")).otherwise(F.col("_kneg")))
            .drop("_rn", "_kpos", "_kneg"))


def _draw_order(seed: int, key: str) -> list[F.Column]:
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]


def sample_state(items: DataFrame, per_direction: int, seed: int, direction: str = "direction",
                 label: str = "answer", key: str = "item_id") -> DataFrame:
    """W2 as a state to keep beside the items: of each (direction, label) the
    ``per_direction`` first items in draw order, and how many there are
    (``_count``, on the first of them). States of parts of a corpus merge, so a
    corpus that grows is drawn from again without being read again."""
    if per_direction < 1:
        raise ValueError("a state holds a bounded number of items a direction")
    w = Window.partitionBy(direction, label).orderBy(*_draw_order(seed, key))
    first = items.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= F.lit(int(per_direction)))
    counts = items.groupBy(direction, label).agg(F.count(F.lit(1)).alias("_n"))
    return (first.join(counts, [direction, label])
            .withColumn("_count", F.when(F.col("_rn") == 1, F.col("_n")).otherwise(F.lit(0)).cast("long")).drop("_n", "_rn"))


def merge_sample_states(states: list[DataFrame], per_direction: int, seed: int, direction: str = "direction",
                        label: str = "answer", key: str = "item_id") -> DataFrame:
    """The state of all parts together; a group has at most ``per_direction``
    rows of each state."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    group = Window.partitionBy(direction, label)
    ranked = both.withColumns({"_all": F.sum("_count").over(group), "_rn": F.row_number().over(group.orderBy(*_draw_order(seed, key)))})
    return (ranked.filter(F.col("_rn") <= F.lit(int(per_direction)))
            .withColumn("_count", F.when(F.col("_rn") == 1, F.col("_all")).otherwise(F.lit(0)).cast("long")).drop("_all", "_rn"))


def sample_from_state(state: DataFrame, per_direction: int, seed: int, positive: str, direction: str = "direction",
                      label: str = "answer", key: str = "item_id") -> DataFrame:
    """The draw of ``stratified_sample`` over every item the state stands for
    (or a smaller one: any number up to the state's own)."""
    y = F.col(label) == F.lit(positive)
    quota = state.groupBy(direction).agg(F.sum("_count").alias("_n"), F.sum(F.when(y, F.col("_count")).otherwise(F.lit(0))).alias("_pos"))
    quota = quota.selectExpr(f"`{direction}`", "_n", "_pos", f"least({int(per_direction)}, _n) AS _wanted")
    quota = quota.selectExpr(f"`{direction}`", "_n", "_pos", "_wanted", "least(_pos, CAST(bround(_wanted * (_pos / _n), 0) AS BIGINT)) AS _kpos")
    quota = quota.selectExpr(f"`{direction}`", "_kpos", "least(_n - _pos, _wanted - _kpos) AS _kneg")
    w = Window.partitionBy(direction, label).orderBy(*_draw_order(seed, key))
    return (state.withColumn("_rn", F.row_number().over(w)).join(quota, direction)
            .filter(F.col("_rn") <= F.when(y, F.col("_kpos")).otherwise(F.col("_kneg"))).drop("_rn", "_kpos", "_kneg", "_count"))


def direction_balance(items: DataFrame, positive: str) -> DataFrame:
    """M8 + M15: items and hallucinated share per direction, and the number of
    distinct directions: a scalar subquery counting the aggregated rows (one
    per direction), whose aggregate Spark reuses rather than recomputes."""
    y = F.col("answer") == F.lit(positive)
    per = items.groupBy("direction").agg(
        F.count(F.lit(1)).alias("items"),
        (F.count_if(y) / F.count(F.lit(1))).alias("hallucinated"))
    return per.withColumn("directions", per.select(F.count(F.lit(1))).scalar())


def severity_counts(items: DataFrame) -> DataFrame:
    """Items per grade."""
    return items.groupBy("grade").agg(F.count(F.lit(1)).alias("items"))


def sample_preview(items: DataFrame, n: int = 3, seed: int = 1,
                   width: int = 110) -> DataFrame:
    """W5 + P23: a seeded n-row sample with text previews (TakeOrdered, no
    global sort)."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("item_id").cast("string")))
    return (items.orderBy(order, F.col("item_id")).limit(n)
            .select("item_id", "direction", "answer",
                    text.preview("source_text", width).alias("source_preview"),
                    text.preview("target_text", width).alias("target_preview")))
