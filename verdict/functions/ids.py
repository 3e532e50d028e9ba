"""Identifiers and display labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dimensions import literal
from .text import _col


def item_id(source, target, index) -> Column:
    """First three characters of each code, '-', the index zero-padded to four
    (wider numbers are kept whole), all lower case."""
    return F.lower(F.concat(F.left(_col(source), F.lit(3)), F.left(_col(target), F.lit(3)),
                            F.lit("-"), F.format_string("%04d", _col(index))))


def prompt_id(item, method, shots) -> Column:
    """``item-method``, followed by the shot count when it is not zero."""
    if all(isinstance(c, str) for c in (item, method, shots)):
        # The same as SQL text: one call to the JVM for the whole expression.
        return F.expr(f"concat(CAST({item} AS STRING), '-', {method}, "
                      f"CASE WHEN {shots} IS NOT NULL AND {shots} <> 0 THEN CAST({shots} AS STRING) ELSE '' END)")
    s = _col(shots)
    return F.concat(_col(item).cast("string"), F.lit("-"), _col(method),
                    F.when(s.isNotNull() & (s != 0), s.cast("string")).otherwise(F.lit("")))


def prompt_suffix(method: str, shots: int) -> str:
    """What ``prompt_id`` puts after the item's id."""
    return f"-{method}{int(shots) if shots else ''}"


def method_label(method, shots) -> Column:
    """Method and shot count, a zero count shown as nothing (``fewshot2``,
    ``baseline``)."""
    s = _col(shots).cast("string")
    return F.concat(_col(method), F.when(s == "0", F.lit("")).otherwise(s))


def direction_name(source_name, target_name) -> Column:
    return F.concat(_col(source_name), F.lit(" to "), _col(target_name))


def language_name_sql(code: str, names: dict[str, str]) -> str:
    """Lookup in a literal map built from the settings, as SQL text; the code
    itself when unknown. No join: the map is part of the expression."""
    pairs = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in sorted(names.items()))
    return f"coalesce(try_element_at(map({pairs}), {code}), {code})"


def language_name(code: str, names: dict[str, str]) -> Column:
    return F.expr(language_name_sql(code, names))
