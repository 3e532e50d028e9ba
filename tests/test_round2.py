"""Rows with nulls, damaged bodies, unknown methods, owed limits, logs with
scores and times, checks that fail, plans over narrow rows."""

import pytest
from pyspark.sql import functions as F

from verdict import schemas
from verdict.config import DEFAULT, FIXTURE
from verdict.functions import payloads, text
from verdict.operators import items, judge, metrics, prompts, quality, replies
from verdict.plans import stages
from verdict.plans.queries import stub_judge
from verdict.sources import fixture as fx
from verdict.sources import tables

from .conftest import SF_SMALL


def test_null_turns_and_ids_keep_their_rows(spark):
    rows = [(1, 1, "user", "a"), (1, None, "user", "b"), (1, 2, "user", "c"), (None, 1, "user", "d")]
    out = prompts.chat_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for conv in (1, None):
        mine = [r for r in out if r.conv_id == conv]
        assert len(mine) == mine[0].n_messages
        assert sorted(r.position for r in mine) == list(range(len(mine)))
    numbered = items.position_within(spark.createDataFrame([(None, 1), ("g", None), ("g", 5)], "g string, o long"), ["g"], "o")
    assert sorted((r.g or "", r.position) for r in numbered.collect()) == [("", 0), ("g", 0), ("g", 1)]


@pytest.mark.parametrize("body, good", [
    ('{"choices": [{"message": {"content": "x"}}]}', True), ('{"choices": [{"message": {"content": "Label: Hal', False),
    ('{"choices": "x"}', False), ("<html>", False), ("", False), (None, False), ("{}", True)])
def test_damaged_bodies_are_errors(spark, body, good):
    df = spark.createDataFrame([(body,)], "b string").withColumn("p", payloads.parse_body("b"))
    assert (df.select(payloads.body_error("b", "p").alias("e")).first().e == "") == good


def test_a_method_without_a_cap_fails(spark):
    df = spark.createDataFrame([("nonesuch", "m")], "method string, model string")
    with pytest.raises(Exception, match="has no token cap"):
        df.select(replies.answer_budget(F.col("method"), F.col("model"), DEFAULT)).collect()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_examples_are_drawn_on_keys_alone(spark):
    corpus = "item_id long, answer string, direction string, source_language string, target_language string, source_text string, target_text string"
    stored = items.build_items(fx.corpus(spark, SF_SMALL), FIXTURE, item_ids="ordinal")
    drawn = _plan(prompts._draw(stored, FIXTURE))
    assert "SortAggregate" in drawn  # of ids
    below = drawn[drawn.index("SortAggregate"):].split("SortAggregate")[-1].splitlines()[0]
    assert "source_text" not in below and "target_text" not in below
    one = (1, FIXTURE.positive_label, "A to B", "a", "b", "s", "t")
    twice = spark.createDataFrame([one, one[:5] + ("r", "t"), (2, FIXTURE.negative_label, "A to B", "a", "b", "x", "y")], corpus)
    got = prompts.draw_examples(twice, FIXTURE).orderBy("shots", "slot").collect()
    assert {(r.item_id, r.source_text) for r in got} == {(1, "r"), (2, "x")}
    assert len(got) == len({(r.shots, r.slot) for r in got}) == sum(s for _, s in FIXTURE.prompt_methods())


def test_agreement_compares_bytes_and_refuses_unknown_labels(spark):
    j = judge.judgements(fx.replies(spark, SF_SMALL), fx.prompts(spark, SF_SMALL), FIXTURE)
    assert "SortAggregate" not in _plan(metrics.replicate_agreement(j))
    odd = spark.createDataFrame([("p", "m", "Maybe")], "prompt_id string, model string, observed string")
    with pytest.raises(Exception, match="not a label"):
        metrics.replicate_agreement(odd).collect()


def test_partition_function_answers_like_single_calls(spark):
    w = replies.wanted_replies(fx.prompts(spark, SF_SMALL), FIXTURE).filter(F.col("method") == "span")
    work = replies.attach_prompts(w, prompts.build_prompts(fx.items(spark, SF_SMALL), FIXTURE))

    def whole(frames):
        for pdf in frames:
            out, err = [], []
            for text_ in pdf["prompt"]:
                try:
                    out.append(stub_judge({"prompt": text_}))
                    err.append("")
                except RuntimeError as problem:
                    out.append(None)
                    err.append(f"RuntimeError: {problem}")
            yield pdf.assign(response=out, error=err)

    one = sorted(map(str, replies.call_judge(work, stub_judge).collect()))
    assert one == sorted(map(str, replies.call_judge_partitions(work, whole).collect())) and one

    def silent(frames):
        for pdf in frames:
            yield pdf[list(schemas.WORK_KEYS)].assign(response=None)

    lost = replies.call_judge_partitions(work, silent)
    assert lost.where("response is null and error = 'no reply' and not truncated").count() == w.count()


def test_logs_with_scores_and_times(spark, scratch):
    p = fx.prompts(spark, SF_SMALL)
    tables.write_table(p, f"{scratch}/prompts")
    log = f"{scratch}/log"
    r = fx.replies(spark, SF_SMALL).where("method = 'baseline'")
    tables.append_replies(r, log)  # no scores: the patterns decide
    plain = stages.evaluate(spark, log, f"{scratch}/prompts", FIXTURE, f"{scratch}/e1", refusal_score="refusal_score")
    before = spark.read.parquet(plain["judgements"]).where("refusal").count()
    tables.append_replies(r.withColumn("refusal_score", F.lit(0.9)), log)
    scored = stages.evaluate(spark, log, f"{scratch}/prompts", FIXTURE, f"{scratch}/e2", refusal_score="refusal_score")
    j = spark.read.parquet(scored["judgements"])
    assert j.where("refusal").count() == before + r.where("error = ''").count()

    # A reply logged twice is reviewed once, and the later one.
    tables.write_table(fx.items(spark, SF_SMALL), f"{scratch}/items")
    heard = tables.append_replies(r.withColumn("response", F.lit("later\nLabel: Hallucination")).withColumn("error", F.lit("")), log)
    first = tables.read_replies(spark, heard, schema=schemas.LOG)
    rounds = replies.review_prompts(p, fx.items(spark, SF_SMALL), first, FIXTURE, model="org/beta", reviewer="org/alpha", order_col="logged_at")
    assert rounds.count() == rounds.select("prompt_id", "replicate").distinct().count()
    assert rounds.where("contains(prompt, 'later')").count() == rounds.count() > 0
    assert stages.review(spark, f"{scratch}/items", f"{scratch}/prompts", log, FIXTURE, lambda _: "Label: Hallucination",
                         model="org/beta", reviewer="org/alpha", buckets=2, limit=3) > 0
    assert tables.read_replies(spark, log, method="debate").count() == 3


def test_owed_limit_takes_the_first(spark, scratch):
    tables.write_table(prompts.build_prompts(fx.items(spark, SF_SMALL), FIXTURE), f"{scratch}/prompts")
    log = f"{scratch}/log"
    for want in (5, 10):
        stages.generate(spark, f"{scratch}/prompts", log, FIXTURE, stub_judge, "org/alpha", buckets=2, limit=5)
        assert tables.read_replies(spark, log).count() == want


def test_quality_checks_count_each_fault(spark):
    i = fx.items(spark, SF_SMALL)
    ids = sorted(r.item_id for r in i.select("item_id").collect())
    blank = F.col("item_id") == ids[1]
    bad = (i.unionAll(i.where(F.col("item_id") == ids[0]))
           .withColumn("source_text", F.when(blank, "").otherwise(F.col("source_text")))
           .withColumn("target_text", F.when(blank, F.lit(None)).otherwise(F.col("target_text"))))
    p = prompts.build_prompts(i, FIXTURE)
    lost = p.where((F.col("item_id") == ids[2]) & (F.col("method") == "span"))
    bad_p = (p.unionAll(lost)
             .unionAll(lost.withColumns({"item_id": F.lit(-1).cast("long"), "prompt_id": F.lit("x"), "prompt": F.lit("")}))
             .withColumn("prompt", F.when(F.col("method") == "translate", F.lit("Say so.")).otherwise(F.col("prompt"))))
    got = {r.check: r.failures for r in quality.quality_checks(bad, bad_p, FIXTURE).collect()}
    assert got == {"item_id_repeated": 1, "item_without_source": 1, "item_without_translation": 1, "prompt_id_repeated": 1,
                   "prompt_rendered_empty": 1, "prompt_with_unknown_item": 1, "method_without_answer_format": 2,
                   "direction_listed_twice": 0, "grade_both_ways": 0, "method_without_cap_or_shots": 0}
    torn = FIXTURE.with_(positive_grades=(*FIXTURE.positive_grades, FIXTURE.negative_grade))
    assert {r.check for r in quality.quality_checks(i, p, torn).where("failures > 0").collect()} == {"grade_both_ways"}
    with pytest.raises(AssertionError, match="item_id_repeated=1"):
        quality.assert_clean(quality.quality_checks(bad, bad_p, FIXTURE))


def test_model_names_with_suffixes(spark):
    rows = spark.createDataFrame([("org/Some-7B-Instruct-4bit",), ("a/b:free",)], "m string")
    got = [tuple(r) for r in rows.select(text.model_slug("m"), text.short_name("m")).collect()]
    assert got == [("Some-7B-Instruct-4bit", "Some-7B"), ("b-free", "b-free")]
