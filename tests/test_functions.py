"""Scalar Column functions against literal tables and plain-Python brute force."""


import pytest
from pyspark.sql import functions as F

from verdict.config import FIXTURE, NEGATIVE_LABEL, POSITIVE_LABEL
from verdict.functions import ids, labels, text

NBSP = " "

# (reply, label, is_refusal): FIXTURES.md §4.
REPLY_TABLE = [
    ("Label: Hallucination", POSITIVE_LABEL, False),
    ("Label: No hallucination", NEGATIVE_LABEL, False),
    ("label :\n no   hallucination", NEGATIVE_LABEL, False),
    (f"Label:{NBSP}No{NBSP}hallucination", NEGATIVE_LABEL, False),
    ("Label:\x1cHallucination", POSITIVE_LABEL, False),
    ("Label: Hallucination or Label: No hallucination.", NEGATIVE_LABEL, False),
    ("Label: Hallucinations", POSITIVE_LABEL, False),
    ("**Label:** Hallucination", "", False),
    ("Label: **No hallucination**", "", False),
    ("none", "", False),
    ("", "", False),
    ("I cannot assist with that.", "", True),
    ("Sorry, but I can't", "", True),
    ("I must decline.", "", True),
    ("I am unable to say. Label: Hallucination", POSITIVE_LABEL, False),
    ("I can’t help", "", False),
]


def test_parse_and_refusal(spark):
    df = spark.createDataFrame([(r,) for r, _, _ in REPLY_TABLE] + [(None,)], "r string")
    out = df.select("r", labels.parse_label("r").alias("label"),
                    labels.is_refusal("r").alias("refusal")).collect()
    got = {row["r"]: (row["label"], row["refusal"]) for row in out}
    for reply, label, refusal in REPLY_TABLE:
        assert got[reply] == (label, refusal), reply
    assert got[None] == ("", False)


def test_dotless_i_and_long_s_follow_python(spark):
    for reply, label in [("label: hallucınation", POSITIVE_LABEL), ("Label: no hallucination", NEGATIVE_LABEL),
                         ("LABEL:HALLUCINATION", POSITIVE_LABEL)]:
        got = spark.range(1).select(labels.parse_label(F.lit(reply))).first()[0]
        assert got == label, reply


def test_judged_equals_parsed_without_scores(spark):
    """Q6: a pattern refusal requires no label, so parsed & ~refusal = parsed."""
    df = spark.createDataFrame([(r,) for r, _, _ in REPLY_TABLE], "r string")
    bad = df.filter((labels.parse_label("r") != "") & labels.is_refusal("r")).count()
    assert bad == 0


def test_refusal_score_threshold(spark):
    df = spark.createDataFrame([(True, 0.9), (True, 0.1), (False, 0.5), (False, None)],
                               "p boolean, s double")
    got = [r[0] for r in df.select(labels.refusal_with_score("p", "s", 0.5)).collect()]
    assert got == [True, True, True, False]


def test_truncated_is_case_sensitive(spark):
    df = spark.createDataFrame([("Label: x",), ("label: x",), (None,)], "r string")
    assert [r[0] for r in df.select(labels.truncated("r")).collect()] == [False, True, False]


STRINGS = ["  a b  ", "\n\tx\r\n", "  y　", "\x1cz\x1f", "\x85q ",
           "", "   ", "inner    space", "​zero-width​"]


def test_clean_matches_python_strip(spark):
    df = spark.createDataFrame([(s,) for s in STRINGS], "s string")
    got = [r[0] for r in df.select(text.clean("s")).collect()]
    assert got == [s.strip() for s in STRINGS]


def test_words_match_python_split(spark):
    df = spark.createDataFrame([(s,) for s in STRINGS + ["a\x1cb c"]], "s string")
    got = [r[0] for r in df.select(text.word_count("s")).collect()]
    assert got == [len(s.split()) for s in STRINGS + ["a\x1cb c"]]


@pytest.mark.parametrize("s", ["a\nb", "a\r\nb", "a\rb\x1ec", "one", "x y\n\nz",
                               "  padded\nlast  ", "", "   "])
def test_last_line_matches_splitlines(spark, s):
    got = spark.range(1).select(text.last_line(F.lit(s))).first()[0]
    want = s.strip().splitlines()[-1] if s.strip() else ""
    assert got == want


def test_slugs(spark):
    ids_ = ["mlx-community/Meta-Llama-3-8B-Instruct-4bit", "deepseek-v4-flash", "a/b/c:d"]
    df = spark.createDataFrame([(i,) for i in ids_], "m string")
    out = df.select(text.model_slug("m"), text.short_name("m")).collect()
    assert [tuple(r) for r in out] == [
        ("Meta-Llama-3-8B-Instruct-4bit", "Meta-Llama-3-8B"),
        ("deepseek-v4-flash", "deepseek-v4-flash"), ("c-d", "c-d")]


def test_ids(spark):
    df = spark.createDataFrame([("spa_Latn", "yor_Latn", 7, "baseline", 0),
                                ("eng_Latn", "deu_Latn", 12345, "fewshot", 2)],
                               "s string, t string, i int, m string, k int")
    out = df.select(ids.item_id("s", "t", "i").alias("item"),
                    ids.method_label("m", "k").alias("label")).collect()
    assert [tuple(r) for r in out] == [("spayor-0007", "baseline"), ("engdeu-12345", "fewshot2")]
    pid = df.select(ids.prompt_id(F.lit("x-0001"), "m", "k")).collect()
    assert [r[0] for r in pid] == ["x-0001-baseline", "x-0001-fewshot2"]


def test_language_name_falls_back_to_code(spark):
    names = {"de": "German"}
    out = spark.createDataFrame([("de",), ("xx",)], "c string").select(
        ids.language_name("c", names)).collect()
    assert [r[0] for r in out] == ["German", "xx"]


def test_format_percent(spark):
    got = spark.createDataFrame([(0.25,), (0.125,), (1.0,)], "x double").select(
        text.format_percent("x")).collect()
    assert [r[0] for r in got] == ["25%", "12%", "100%"]


def test_directions_order_and_partitions():
    from verdict.config import DEFAULT
    from verdict.session import shuffle_partitions_for
    d = DEFAULT.directions()
    assert d[:2] == [("arb_Arab", "eng_Latn"), ("eng_Latn", "arb_Arab")]
    assert d[-2:] == [("spa_Latn", "yor_Latn"), ("yor_Latn", "spa_Latn")] and len(d) == 18
    assert shuffle_partitions_for(5 * 1024 ** 4, 8000) == 20480
    assert shuffle_partitions_for(1024, 8) == 16


def test_directions_dimension(spark):
    from verdict import dimensions
    got = [tuple(r) for r in dimensions.directions(spark, FIXTURE).orderBy("position").collect()]
    assert [(s, t) for _, s, t in got] == FIXTURE.directions()
