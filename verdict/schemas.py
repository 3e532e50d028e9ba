"""Explicit schemas of every table. Nothing is inferred at read time."""

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType,
                               LongType, StringType, StructField, StructType, TimestampType)


def _s(*fields) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


CORPUS = _s(("src_lang", StringType()), ("tgt_lang", StringType()),
            ("class_hall", StringType()), ("src_text", StringType()),
            ("mt_text", StringType()), ("ordinal", LongType()))

ITEM_COLUMNS = ["item_id", "source_language", "target_language", "direction",
                "grade", "answer", "source_text", "target_text"]

PROMPT_COLUMNS = ["prompt_id", "item_id", "method", "shots", "direction",
                  "answer", "prompt"]

REPLIES = _s(("prompt_id", StringType()), ("model", StringType()),
             ("method", StringType()), ("replicate", IntegerType()),
             ("runtime", StringType()), ("temperature", DoubleType()),
             ("error", StringType()), ("refusal", StringType()),
             ("truncated", BooleanType()), ("response", StringType()))

# What a log may hold besides: a classifier's refusal score (F2) and the time a
# reply was appended (Q15). Both read as null from logs without them.
LOG = StructType(REPLIES.fields + _s(("refusal_score", DoubleType()),
                                     ("logged_at", TimestampType())).fields)

JUDGEMENT_COLUMNS = ["prompt_id", "model", "replicate", "method", "shots",
                     "direction", "answer", "observed", "parsed", "refusal"]

SCORE_COLUMNS = ["model", "method", "shots", "direction", "view", "refusals",
                 "unparsed", "n", "mcc", "precision", "recall", "f1",
                 "accuracy"]

WORK_KEYS = ["model", "method", "prompt_id", "replicate"]

MESSAGE = StructType([StructField("role", StringType()),
                      StructField("content", StringType())])
MESSAGES = ArrayType(MESSAGE)

# Chat-completions response body: only the fields that are read.
RESPONSE_BODY = StructType([
    StructField("choices", ArrayType(StructType([
        StructField("message", StructType([
            StructField("content", StringType())]))]))),
    StructField("usage", StructType([
        StructField("prompt_tokens", LongType()),
        StructField("completion_tokens", LongType())])),
])
