"""Text helpers as Column expressions: trimming, slugs, lines, word counts.

All of them are built-in Spark functions, so they stay inside whole-stage
codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The characters Python's str.isspace() accepts (what the
# evaluated pipeline's strip() and split() remove), and its line boundaries
# (str.splitlines()). Listed as code points.
# ---------------------------------------------------------------------------
WHITESPACE_CODEPOINTS = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0,
     0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
LINE_BREAK_CODEPOINTS = [0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x85,
                         0x2028, 0x2029]

WHITESPACE_CHARS = "".join(chr(c) for c in WHITESPACE_CODEPOINTS)


def _class(codepoints) -> str:
    """A regex character class of the code points, consecutive runs written as
    ranges (fewer alternatives for the matcher to test per character)."""
    cps = sorted(set(codepoints))
    runs, start, prev = [], cps[0], cps[0]
    for c in cps[1:] + [None]:
        if c is not None and c == prev + 1:
            prev = c
            continue
        runs.append(f"\\x{{{start:04X}}}" if start == prev
                    else f"\\x{{{start:04X}}}-\\x{{{prev:04X}}}")
        if c is not None:
            start = prev = c
    return "[" + "".join(runs) + "]"


# One character class, valid in Java regex and in RE2 alike.
WS = _class(WHITESPACE_CODEPOINTS)
# \r\n first so it splits once, then any single boundary.
LINE_BREAK = "\\x{000D}\\x{000A}|" + _class(LINE_BREAK_CODEPOINTS)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c) -> Column:
    """Python ``str(x).strip()`` for a non-null string: trims every Unicode
    whitespace character from both ends (plain ``trim`` only trims spaces)."""
    return F.btrim(_col(c), F.lit(WHITESPACE_CHARS))


def clean_or_empty(c) -> Column:
    """``str(x or '').strip()``: null becomes ''."""
    return clean(F.coalesce(_col(c), F.lit("")))


def words(c) -> Column:
    """Whitespace-separated words (Python ``str.split()``), '' gives none."""
    return F.filter(F.split(_col(c), WS + "+"), lambda w: w != F.lit(""))


def word_count(c) -> Column:
    return F.size(words(c))


def preview(c, n: int = 110) -> Column:
    return F.left(_col(c), F.lit(n))


def lines(c) -> Column:
    return F.split(_col(c), LINE_BREAK)


def last_line(c) -> Column:
    """Last line of the stripped text; '' when the text is blank or null."""
    text = clean_or_empty(c)
    return F.when(text == "", F.lit("")).otherwise(
        F.try_element_at(lines(text), F.lit(-1)))


def model_slug(c) -> Column:
    """Text after the last '/', with ':' replaced by '-'."""
    return F.translate(F.substring_index(_col(c), "/", -1), ":", "-")


# The suffixes dropped when a model is named on an axis.
SHORT_NAME_DROPS = ("-Instruct", "-4bit")


def short_name(c) -> Column:
    out = model_slug(c)
    for s in SHORT_NAME_DROPS:
        out = F.replace(out, F.lit(s), F.lit(""))
    return out


def format_percent(c) -> Column:
    """Display only: a share as a whole percent, e.g. 0.25 -> '25%'."""
    return F.format_string("%.0f%%", F.bround(_col(c) * 100, 0))
