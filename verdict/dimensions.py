"""Small dimension DataFrames derived from ``Settings``.

Their row counts are fixed by the settings (languages, directions, methods,
models), never by the data, which is what makes broadcasting them safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .config import Settings


def literal(value) -> str:
    """A value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def _values(rows: list[tuple], schema: str) -> str:
    """A SELECT over literal rows, typed by ``schema``. No rows: none of them."""
    fields = StructType.fromDDL(schema).fields
    names = ", ".join(f"`{f.name}`" for f in fields)
    typed = ", ".join(f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in fields)
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows or [(None,) * len(fields)])
    return f"SELECT {typed} FROM VALUES {body} AS t({names})" + ("" if rows else " WHERE false")


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table held in the plan itself (LocalTableScan): no RDD and no
    Python worker when it is scanned. One SQL text, as a call per value costs
    more than the table."""
    return spark.sql(_values(rows, schema))


def directions(spark: SparkSession, settings: Settings) -> DataFrame:
    """G1: every language against the anchor both ways, union the extra pairs,
    in configuration order (``position``)."""
    anchor = literal(settings.anchor[0])
    langs = _values([(i, code) for i, (code, _) in enumerate(settings.languages)], "i int, code string")
    base = 2 * len(settings.languages)
    extra = _values([(base + j, s, t) for j, (s, t) in enumerate(settings.extra_pairs)],
                    "position int, source_language string, target_language string")
    pair = "named_struct('source_language', {}, 'target_language', {})".format
    return spark.sql(f"SELECT 2 * i + k AS position, pair.* FROM ({langs}) LATERAL VIEW "
                     f"posexplode(array({pair('code', anchor)}, {pair(anchor, 'code')})) AS k, pair "
                     f"UNION ALL {extra}")


def methods(spark: SparkSession, settings: Settings) -> DataFrame:
    """One row per (method, shots) with the method's token cap."""
    rows = [(m.name, m.title, int(s), int(m.max_tokens))
            for m in settings.methods for s in m.shots]
    return local_table(spark, rows, "method string, title string, shots int, max_tokens int")


def grades(spark: SparkSession, settings: Settings) -> DataFrame:
    rows = [(settings.negative_grade, False)] + [(g, True) for g in settings.positive_grades]
    return local_table(spark, rows, "grade string, positive boolean")
