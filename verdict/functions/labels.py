"""Reading a reply: the label it gave, whether it declined, whether it was cut.

Patterns are kept as text in two dialects of one body: Java regex for Spark
(``(?iu)``: Unicode-aware case folding) and RE2 for the SQL oracle (``(?i)``).
Python's ``\\s`` is spelled as an explicit character class (``text.WS``) so both
engines see the same whitespace as the evaluated pipeline, including the
no-break space and the information separators \\x1c-\\x1f.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NEGATIVE_LABEL, POSITIVE_LABEL
from ..dimensions import literal
from .text import WS, _col, clean, clean_or_empty

# ---------------------------------------------------------------------------
# The label line and the refusal forms of the evaluated
# pipeline, as written there, with \s standing for WS.
# ---------------------------------------------------------------------------
LABEL_BODY = r"label\s*:\s*(no\s+hallucination|hallucination)"
REFUSAL_BODIES = (
    r"\bi can(?:not|'t)\s+(?:assist|help|comply|provide|do that)\b",
    r"\bi(?:'m| am)\s+(?:unable|not able)\s+to\b",
    r"\bi\s+must\s+(?:decline|refuse)\b",
    r"\bi\s+won't\s+(?:assist|help|provide)\b",
    r"\b(?:sorry|apolog\w+)[, ]+but\s+i\s+can(?:not|'t)\b",
)


def _ws(body: str) -> str:
    return body.replace(r"\s", WS)


def label_pattern(dialect: str = "java") -> str:
    flags = "(?iu)" if dialect == "java" else "(?i)"
    return flags + _ws(LABEL_BODY)


def refusal_pattern(dialect: str = "java", bodies=REFUSAL_BODIES) -> str:
    # (?U) makes Java's \b and \w Unicode-aware like Python's.
    flags = "(?iU)" if dialect == "java" else "(?i)"
    return flags + "|".join(_ws(b) for b in bodies)


def binary_label(grade, negative_grade: str, positive: str = POSITIVE_LABEL,
                 negative: str = NEGATIVE_LABEL) -> Column:
    """Negative grade -> negative label; anything else, null included, is
    positive."""
    g = _col(grade)
    return F.when(g == F.lit(negative_grade), F.lit(negative)).otherwise(F.lit(positive))


def parse_label(reply, positive: str = POSITIVE_LABEL,
                negative: str = NEGATIVE_LABEL) -> Column:
    """The last label line in the reply; '' when there is none."""
    # A match starts with 'no' or 'ha' (any case); one lookup on those two
    # letters, so the regex runs once per reply.
    if isinstance(reply, str):
        return F.expr(f"coalesce(try_element_at(map('no', {literal(negative)}, 'ha', {literal(positive)}), lower(left(try_element_at("
                      f"regexp_extract_all(coalesce({reply}, ''), {literal(label_pattern())}, 1), -1), 2))), '')")
    found = F.regexp_extract_all(F.coalesce(reply, F.lit("")),
                                 F.lit(label_pattern()), F.lit(1))
    last = F.try_element_at(found, F.lit(-1))
    kind = F.create_map(F.lit("no"), F.lit(negative), F.lit("ha"), F.lit(positive))
    return F.coalesce(F.try_element_at(kind, F.lower(F.left(last, F.lit(2)))), F.lit(""))


def is_refusal(reply, observed=None, bodies=REFUSAL_BODIES) -> Column:
    """A refusal form matched and no label was parsed; blank is never one."""
    text = clean_or_empty(reply)
    obs = parse_label(reply) if observed is None else _col(observed)
    hit = F.coalesce(text.rlike(refusal_pattern("java", bodies)), F.lit(False))
    # No label first: the refusal regex only runs on replies without one.
    return (obs == "") & (text != "") & hit


def refusal_with_score(pattern_refusal, score, threshold: float = 0.5) -> Column:
    """A classifier score decides when it is at or above the threshold; below
    it, or when absent, the patterns decide."""
    s = _col(score)
    return F.when(s >= F.lit(threshold), F.lit(True)).otherwise(_col(pattern_refusal))


def truncated(reply) -> Column:
    """Case-sensitive: the reply never wrote 'Label:'. No reply (a failed
    call) is not a cut-off reply: false, as the evaluated pipeline counts it."""
    return F.coalesce(~F.contains(_col(reply), F.lit("Label:")), F.lit(False))


def has_error(error) -> Column:
    return clean_or_empty(error) != ""


__all__ = ["binary_label", "parse_label", "is_refusal", "refusal_with_score",
           "truncated", "has_error", "label_pattern", "refusal_pattern", "clean"]
