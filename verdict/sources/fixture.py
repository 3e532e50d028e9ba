"""The evaluation fixture derived from the driver's tables (FIXTURES.md §3).

documents + labels become a labelled translation corpus; items x (method,
shots) x models x replicates become a reply log whose replies cover every
parsing case. Everything is derived by Spark from the given tables, so the work
grows with them. Expansions use ``explode`` over lists fixed by the settings;
there is no join to a generated table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FIXTURE, Settings
from ..dimensions import literal
from ..functions import text
from ..operators import items as item_ops
from ..operators import prompts as prompt_ops
from ..session import parallelism

# Fixed values of the fixture: method and model numbers used in the reply
# selector b, and the texts of the non-label replies.
METHOD_NUMBERS = {"baseline": 1, "fewshot": 2, "translate": 3, "span": 4}
MODEL_NUMBERS = {"org/alpha": 1, "org/beta": 2}
ERROR_TEXT = "RuntimeError: 503"
REFUSAL_TEXT = "I cannot assist with that."
HEDGED_TEXT = "I am unable to be sure.\nLabel: Hallucination"
SHOUTED_TEXT = "LABEL :  NO   HALLUCINATION"
MARKDOWN_TEXT = "**Label:** Hallucination"
TWO_LABELS_TEXT = "Label: Hallucination?\nLabel: No hallucination"


#: The tables read here; stating them saves a job that reads file footers.
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """documents x labels as a corpus: ordinal, src_lang, tgt_lang, class_hall,
    src_text (first half of the document), mt_text (second half). ``tasks``
    fixes the number of tasks it is spread over, by another hash than the join's:
    an exchange like the join's would be left out and its tasks merged by bytes."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    # Every document is used whole: its first half (by characters) is the
    # source, the rest the translation. A driver table may be a single row group
    # (one scan task); the corpus is spread before anything is multiplied out
    # of it, over as many tasks as its bytes ask for.
    return d.join(lab, "doc_id").selectExpr(
        "doc_id AS ordinal", "lang AS src_lang",
        "CASE WHEN lang <> 'en' THEN 'en' WHEN doc_id % 3 = 0 THEN 'de' WHEN doc_id % 3 = 1 THEN 'es' ELSE 'fr' END AS tgt_lang",
        "CASE WHEN quality = 1 AND toxic = 0 THEN '1_No_hallucination' WHEN doc_id % 3 = 0 THEN '2_Small_hallucination' "
        "WHEN doc_id % 3 = 1 THEN '3_Partial_hallucination' ELSE '4_Full_hallucination' END AS class_hall",
        "left(text, CAST(floor(length(text) / 2) AS INT)) AS src_text",
        "substr(text, CAST(floor(length(text) / 2) AS INT) + 1) AS mt_text").repartition(*([tasks, F.xxhash64("ordinal")] if tasks else ["ordinal"]))


def items(spark: SparkSession, sf_dir: str, settings: Settings = FIXTURE) -> DataFrame:
    """The items: item_id is the document id."""
    return item_ops.build_items(corpus(spark, sf_dir), settings, item_ids="ordinal")


def prompts(spark: SparkSession, sf_dir: str, settings: Settings = FIXTURE,
            items_table: DataFrame | None = None) -> DataFrame:
    """Prompt keys only (no rendered text), of ``items_table`` where a query has it."""
    own = items(spark, sf_dir, settings) if items_table is None else items_table
    return prompt_ops.prompt_spec(own, settings)


#: The reply selector b: which of the replies below a (prompt, model, replicate) gets.
SELECTOR = "(item_id * 31 + replicate * 17 + shots * 7 + _mno * 3 + _pno * 5) % 20"


def replies(spark: SparkSession, sf_dir: str, settings: Settings = FIXTURE,
            keep_selector: bool = False, spec: DataFrame | None = None) -> DataFrame:
    """The reply log: items x 6 (method, shots) x 2 models x 3 replicates, over
    the prompt keys ``spec`` where a query has them."""
    spec = prompts(spark, sf_dir, settings) if spec is None else spec
    q = literal
    mno = "map(" + ", ".join(f"{q(k)}, {v}" for k, v in METHOD_NUMBERS.items()) + ")"
    models = "array(" + ", ".join(
        f"named_struct('model', {q(m.id)}, 'runtime', {q(m.runtime)}, 'pno', {MODEL_NUMBERS[m.id]})" for m in settings.models) + ")"
    rows = (spec.selectExpr("*", f"try_element_at({mno}, method) AS _mno", f"explode({models}) AS _p")
            .selectExpr("*", "_p.pno AS _pno", f"explode(sequence(1, {settings.replicates})) AS replicate")
            .selectExpr("*", f"{SELECTOR} AS _b"))
    positive, negative = q(settings.positive_label), q(settings.negative_label)
    response = (f"CASE WHEN _b = 0 THEN '' WHEN _b = 1 THEN {q(REFUSAL_TEXT)} WHEN _b = 2 THEN {q(HEDGED_TEXT)} "
                f"WHEN _b = 3 THEN {q(SHOUTED_TEXT)} WHEN _b = 4 THEN {q(MARKDOWN_TEXT)} WHEN _b = 5 THEN {q(TWO_LABELS_TEXT)} "
                f"WHEN _b = 6 THEN NULL WHEN _b <= 15 THEN concat('Label: ', answer) "
                f"ELSE concat('Label: ', CASE WHEN answer = {positive} THEN {negative} ELSE {positive} END) END")
    rows = rows.selectExpr("*", f"{response} AS response")
    return rows.selectExpr(
        "prompt_id", "_p.model AS model", "method", "replicate", "_p.runtime AS runtime",
        f"CAST({settings.temperature} AS DOUBLE) AS temperature",
        f"CASE WHEN _b = 6 THEN {q(ERROR_TEXT)} ELSE '' END AS error", "'' AS refusal",
        "coalesce(NOT contains(response, 'Label:'), false) AS truncated", "response",
        *(["_b AS b", "item_id", "shots"] if keep_selector else []))


def collected(spark: SparkSession, sf_dir: str, settings: Settings = FIXTURE,
              spec: DataFrame | None = None) -> DataFrame:
    """The part of the log already written (b < 12)."""
    r = replies(spark, sf_dir, settings, keep_selector=True, spec=spec)
    return r.filter(F.col("b") < 12).drop("b", "item_id", "shots")


def response_bodies(spark: SparkSession, sf_dir: str, settings: Settings = FIXTURE) -> DataFrame:
    """Raw chat-completions bodies for every reply: b=6 a non-JSON error page,
    b=0 an empty choice list, b=1 no usage block, otherwise content padded with
    whitespace. Token counts: prompt_tokens = length(prompt_id),
    completion_tokens = words in the reply. Each item makes dozens of bodies to
    write and read, which its keys' few bytes do not show, so the items are
    spread over a stated number of tasks, not by their bytes."""
    tasks = max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = item_ops.build_items(corpus(spark, sf_dir, tasks), settings, item_ids="ordinal")
    r = replies(spark, sf_dir, settings, keep_selector=True, spec=prompts(spark, sf_dir, settings, items_table=own))
    b = F.col("b")
    content = F.concat(F.lit("  "), F.coalesce("response", F.lit("")), F.lit("\n"))
    usage = F.struct(F.length("prompt_id").cast("long").alias("prompt_tokens"),
                     text.word_count(F.coalesce("response", F.lit(""))).cast("long")
                     .alias("completion_tokens"))
    choice = F.array(F.struct(F.struct(content.alias("content")).alias("message")))
    body = (F.when(b == 6, F.lit("<html><body>503 Service Unavailable</body></html>"))
            .when(b == 0, F.to_json(F.struct(F.array().cast("array<string>").alias("choices"),
                                             usage.alias("usage"))))
            .when(b == 1, F.to_json(F.struct(choice.alias("choices"))))
            .otherwise(F.to_json(F.struct(choice.alias("choices"), usage.alias("usage")))))
    return r.select("prompt_id", "model", "method", "replicate", body.alias("body"))
