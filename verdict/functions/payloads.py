"""Request and response bodies of a chat-completions call, as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import RESPONSE_BODY
from .templates import as_messages
from .text import _col, clean_or_empty


def request_body(model, max_tokens, prompt, takes_sampling, temperature,
                 top_p) -> Column:
    """The JSON body; temperature and top_p only when the model takes them
    (``to_json`` leaves null fields out)."""
    ts = _col(takes_sampling)
    return F.to_json(F.struct(
        _col(model).alias("model"),
        _col(max_tokens).alias("max_tokens"),
        as_messages(_col(prompt)).alias("messages"),
        F.when(ts, _col(temperature)).alias("temperature"),
        F.when(ts, _col(top_p)).alias("top_p")))


_DAMAGED = "_corrupt_record"


def parse_body(body) -> Column:
    """The body's fields; ``_corrupt_record`` holds a text that is cut off,
    damaged or wrongly typed."""
    return F.from_json(_col(body), StructType([*RESPONSE_BODY.fields, StructField(_DAMAGED, StringType())]),
                       {"columnNameOfCorruptRecord": _DAMAGED})


def reply_text(parsed) -> Column:
    """First choice's content, stripped; '' when there is no choice."""
    first = F.try_element_at(_col(parsed).getField("choices"), F.lit(1))
    return clean_or_empty(first.getField("message").getField("content"))


def usage_tokens(parsed, field: str) -> Column:
    return F.coalesce(_col(parsed).getField("usage").getField(field), F.lit(0).cast("long"))


def body_error(body, parsed) -> Column:
    """A body that is not a whole, rightly typed JSON object is an error row:
    it counts as no call and can be owed again."""
    b = _col(body)
    ok = F.coalesce(_col(parsed).isNotNull() & _col(parsed).getField(_DAMAGED).isNull()
                    & clean_or_empty(b).startswith("{"), F.lit(False))
    return F.when(ok, F.lit("")).otherwise(F.lit("JSONDecodeError: body is not a JSON object"))
