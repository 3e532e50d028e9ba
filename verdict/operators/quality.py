"""Data and settings checks that a build must pass.

Each check is a count of offending rows (0 = pass), returned as one table
``(check, failures)``; ``assert_clean`` raises on any failure. The data
checks are aggregations; the settings checks run over the small dimension
tables. A build counts most of them while it writes (``Watch``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import dimensions
from ..config import Settings


def _row(name: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(name).alias("check"), F.col("failures").cast("long"))


def duplicated(df: DataFrame, key: str) -> DataFrame:
    """Q-1: keys that occur more than once."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.count_if(F.col("_n") > 1).alias("failures")))


def empties(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q-2: empty values per column, in one pass. Null counts as empty."""
    return df.agg(*[F.count_if(F.coalesce(F.col(c), F.lit("")) == "").alias(c) for c in cols])


def unknown_references(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Q-3 / J8: distinct child keys with no parent row."""
    missing = child.select(key).join(parent.select(key), key, "left_anti").distinct()
    return missing.agg(F.count(F.lit(1)).alias("failures"))


def methods_without_format(prompts: DataFrame, marker: str = "Label:") -> DataFrame:
    """Q-4: methods with a prompt that does not ask for the answer format."""
    per = prompts.groupBy("method").agg(F.bool_and(F.contains("prompt", F.lit(marker)))
                                        .alias("_ok"))
    return per.agg(F.count_if(~F.col("_ok")).alias("failures"))


def settings_checks(spark, settings: Settings) -> list[DataFrame]:
    """Q-5: direction listed twice, grade both positive and negative, method
    without a token cap or shots, over the dimension tables."""
    d = dimensions.directions(spark, settings)
    twice = (d.groupBy("source_language", "target_language").agg(F.count(F.lit(1)).alias("_n"))
             .agg(F.count_if(F.col("_n") > 1).alias("failures")))
    g = dimensions.grades(spark, settings)
    both = (g.groupBy("grade").agg(F.count_distinct("positive").alias("_k"))
            .agg(F.count_if(F.col("_k") > 1).alias("failures")))
    m = dimensions.methods(spark, settings)
    bad = m.agg(F.count_if(F.col("max_tokens").isNull() | F.col("shots").isNull()
                           | (F.col("max_tokens") <= 0)).alias("failures"))
    return [_row("direction_listed_twice", twice), _row("grade_both_ways", both),
            _row("method_without_cap_or_shots", bad)]


def _unpivot(one_row: DataFrame, names: list[str]) -> DataFrame:
    """A one-row table of counts -> (check, failures) rows."""
    return one_row.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("failures"))
        for n in names])).alias("_c")).select("_c.*")


def item_checks(items: DataFrame) -> DataFrame:
    """Q-1 + Q-2 on items in one pass: repeated ids and empty texts."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    per = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"),
                                       F.count_if(empty("source_text")).alias("_s"),
                                       F.count_if(empty("target_text")).alias("_t"))
    return _unpivot(per.agg(F.count_if(F.col("_n") > 1).alias("item_id_repeated"),
                            F.sum("_s").alias("item_without_source"),
                            F.sum("_t").alias("item_without_translation")),
                    ["item_id_repeated", "item_without_source", "item_without_translation"])


def prompt_checks(prompts: DataFrame) -> DataFrame:
    """Q-1 + Q-2 on prompts in one pass: repeated ids and empty renderings."""
    empty = F.coalesce(F.col("prompt"), F.lit("")) == ""
    per = prompts.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("_n"),
                                           F.count_if(empty).alias("_e"))
    return _unpivot(per.agg(F.count_if(F.col("_n") > 1).alias("prompt_id_repeated"),
                            F.sum("_e").alias("prompt_rendered_empty")),
                    ["prompt_id_repeated", "prompt_rendered_empty"])


def quality_checks(items: DataFrame, prompts: DataFrame, settings: Settings) -> DataFrame:
    """Q-1..Q-5 and J8 as one table of (check, failures). Items are read in
    one aggregation, prompts in one aggregation plus a partial-only pass per
    method (Q-4), and the reference check is one anti-join."""
    spark = items.sparkSession
    parts = [
        item_checks(items),
        prompt_checks(prompts),
        _row("prompt_with_unknown_item", unknown_references(prompts, items, "item_id")),
        _row("method_without_answer_format", methods_without_format(prompts)),
        *settings_checks(spark, settings),
    ]
    return reduce(DataFrame.unionByName, parts)


class Watch:
    """Q-1..Q-5 and J8 counted while a build writes its tables: the same table
    as ``quality_checks`` without reading a text again.

    Texts and answer formats are observed on the rows as they go to the sink.
    Observed counts come from the writing stage itself, whose tasks count once
    each, retries included. Items sorted by id have equal ids side by side, so
    repeats are numbered on the sort's own exchange; else, and for prompts, which
    no exchange precedes, a later pass reads the id column alone. A prompt is
    made from one of the items row by row, so only a null id names no item."""

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings = spark, settings
        self._seen: list[Observation] = []
        self._later: list[DataFrame] = []

    def _observe(self, df: DataFrame, counts: dict) -> DataFrame:
        seen = Observation()
        self._seen.append(seen)
        return df.observe(seen, *[c.alias(n) for n, c in counts.items()])

    def items(self, items: DataFrame, by_id: bool) -> DataFrame:
        """The items to write; ``by_id`` if they come sorted by ``item_id``."""
        empty = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) == "")
        counts = {"item_without_source": empty("source_text"), "item_without_translation": empty("target_text")}
        if not by_id:
            return self._observe(items, counts)
        nth = F.row_number().over(Window.partitionBy("item_id").orderBy("item_id"))
        return self._observe(items.withColumn("_nth", nth),
                             counts | {"item_id_repeated": F.count_if(F.col("_nth") == 2)}).drop("_nth")

    def prompts(self, prompts: DataFrame, marker: str = "Label:") -> DataFrame:
        """The prompts to write, of the settings' methods."""
        unasked = ~F.contains("prompt", F.lit(marker))
        methods = sorted({m for m, _ in self.settings.prompt_methods()})
        wrong = [F.max(F.when((F.col("method") == m) & unasked, 1).otherwise(0)) for m in methods]
        total = reduce(lambda a, b: a + b, wrong) if wrong else F.max(F.lit(0))
        return self._observe(prompts, {
            "prompt_rendered_empty": F.count_if(F.coalesce(F.col("prompt"), F.lit("")) == ""),
            "prompt_with_unknown_item": F.max(F.when(F.col("item_id").isNull(), 1).otherwise(0)),
            "method_without_answer_format": total})

    def ids(self, written: DataFrame, key: str) -> None:
        """Has the ids of a written table counted, by their column alone."""
        self._later.append(_row(f"{key}_repeated", duplicated(written, key)))

    def checks(self) -> DataFrame:
        """(check, failures), once the watched tables are written."""
        counted = [(n, int(v or 0)) for seen in self._seen for n, v in seen.get.items()]
        rows = self.spark.createDataFrame(counted, "check string, failures long")
        return reduce(DataFrame.unionByName, [rows, *self._later, *settings_checks(self.spark, self.settings)])


def assert_clean(checks: DataFrame) -> None:
    """Raise listing every failed check (the result is a handful of rows)."""
    failed = [(r["check"], r["failures"]) for r in checks.filter(F.col("failures") > 0).collect()]
    if failed:
        raise AssertionError("quality checks failed: " + ", ".join(f"{c}={n}" for c, n in failed))
