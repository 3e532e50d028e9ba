"""Prompt templates and their rendering as ``concat`` expressions.

A template is a Python format string. It is split once, on the driver, into
literal and field parts; a row renders as ``concat(lit, col, lit, ...)``. The
same split renders the SQL oracle's ``||`` expression.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dimensions import literal


# ---------------------------------------------------------------------------
# The wording every prompt is rendered from. They must equal the
# evaluated pipeline's templates, character for character, or the replies are
# not replies to the same question.
# ---------------------------------------------------------------------------
ANSWER_FORMAT = ("End your reply with exactly one line:\n"
                 "Label: Hallucination\n"
                 "or\n"
                 "Label: No hallucination")

SYSTEM = ("You judge machine translations. A hallucination is content in the "
          "translation that the source does not support. Omission alone is not "
          "a hallucination.")

TEMPLATES = {
    "baseline": ("Source ({source}): {source_text}\n"
                 "Translation ({target}): {target_text}\n\n"
                 "Does the translation contain hallucinated content?\n\n"
                 + ANSWER_FORMAT),
    "fewshot": ("{examples}"
                "Source ({source}): {source_text}\n"
                "Translation ({target}): {target_text}\n\n"
                "Does the translation contain hallucinated content?\n\n"
                + ANSWER_FORMAT),
    "translate": ("Source ({source}): {source_text}\n"
                  "Translation ({target}): {target_text}\n\n"
                  "First, translate both the source and the translation into English.\n"
                  "Then compare them and decide whether the translation introduces "
                  "content the source does not support.\n\n"
                  + ANSWER_FORMAT),
    "span": ("Source ({source}): {source_text}\n"
             "Translation ({target}): {target_text}\n\n"
             "List every span of the translation that is not supported by the "
             'source, one per line, prefixed with "Span:". If there are none, write '
             '"Span: none".\n'
             "Then give your label.\n\n"
             + ANSWER_FORMAT),
    "debate": ("Source ({source}): {source_text}\n"
               "Translation ({target}): {target_text}\n\n"
               "Another reviewer judged this as: {other_label}\n"
               "Their reasoning: {other_reasoning}\n\n"
               "Do you agree? Judge it yourself, saying briefly where you differ if "
               "you do.\n\n"
               + ANSWER_FORMAT),
}

EXAMPLE = ("Example\n"
           "Source ({source}): {source_text}\n"
           "Translation ({target}): {target_text}\n"
           "Label: {answer}\n\n")


def parts(template: str) -> list[tuple[str, str | None]]:
    """[(literal, field or None), ...] of a format string."""
    return [(lit, field) for lit, field, _, _ in string.Formatter().parse(template)]


def fields_of(template: str) -> set[str]:
    return {f for _, f in parts(template) if f}


def _render_sql(template: str, fields: dict[str, str]) -> str:
    pieces = [x for lit, field in parts(template)
              for x in ([literal(lit)] if lit else []) + ([f"coalesce({fields[field]}, '')"] if field else [])]
    return f"concat({', '.join(pieces)})"


def _as_text(fields: dict) -> bool:
    return all(isinstance(f, str) for f in fields.values())


def render(template: str, fields: dict[str, Column] | dict[str, str]) -> Column:
    """``concat`` of the template's literals and the given columns, or SQL texts
    of them (one call to the JVM then). Every column is coalesced to '' because
    ``concat`` is null if any part is."""
    if _as_text(fields):
        return F.expr(_render_sql(template, fields))
    pieces = []
    for lit, field in parts(template):
        if lit:
            pieces.append(F.lit(lit))
        if field:
            pieces.append(F.coalesce(fields[field], F.lit("")))
    return F.concat(*pieces)


def render_by_method(method: Column, fields: dict[str, Column] | dict[str, str],
                     templates: dict[str, str] = TEMPLATES) -> Column:
    """One prompt per row, the template chosen by the row's method. An unknown
    method fails the job, as it fails the evaluated pipeline."""
    expr = None
    for name in sorted(templates):
        branch = render(templates[name], fields)
        expr = F.when(method == name, branch) if expr is None else expr.when(method == name, branch)
    known = ", ".join(sorted(templates))
    return expr.otherwise(F.raise_error(F.concat(
        F.coalesce(method, F.lit("null")), F.lit(f": no prompt template has this name; known are {known}"))))


def as_messages(prompt: Column, system: str = SYSTEM) -> Column:
    """System + user message array."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), prompt.alias("content")))


# -- SQL rendering for the oracle ------------------------------------------

def sql_literal(s: str) -> str:
    """A DuckDB string expression for ``s``: quotes doubled, newlines as
    chr(10) (DuckDB does not unescape backslashes)."""
    chunks = s.split("\n")
    quoted = ["'" + c.replace("'", "''") + "'" for c in chunks]
    return " || chr(10) || ".join(quoted)


def sql_render(template: str, fields: dict[str, str]) -> str:
    pieces = []
    for lit, field in parts(template):
        if lit:
            pieces.append(sql_literal(lit))
        if field:
            pieces.append(f"coalesce({fields[field]}, '')")
    return "(" + " || ".join(pieces) + ")"
