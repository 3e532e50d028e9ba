"""DuckDB SQL of the fixture (FIXTURES.md §3) and shared expressions.

The oracle side of every registered query is plain SQL over the driver's
tables; these fragments are the common table expressions it starts from.
They state the logic anew (CASE expressions, ``unnest`` lists) but take the
fixed values (patterns, prompt wording, white space) from the library; the
tests pin those by literal expected text.
"""

from __future__ import annotations

from ..config import FIXTURE, Settings
from ..functions import labels, templates, text
from ..sources import fixture

WS_SQL = " || ".join(f"chr({c})" for c in text.WHITESPACE_CODEPOINTS)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(expr: str) -> str:
    """Python str.strip(): every Unicode whitespace character off both ends."""
    return f"trim({expr}, {WS_SQL})"


def strip_or_empty(expr: str) -> str:
    return strip(f"coalesce({expr}, '')")


def word_count(expr: str) -> str:
    return (f"CAST(len(list_filter(string_split_regex({expr}, {q(text.WS + '+')}), "
            f"lambda w: w <> '')) AS BIGINT)")


def lang_name(expr: str, settings: Settings = FIXTURE) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}"
                     for k, v in sorted(settings.language_names().items()))
    return f"CASE {expr} {cases} ELSE {expr} END"


def parse_label(expr: str, settings: Settings = FIXTURE) -> str:
    pat = q(labels.label_pattern("re2"))
    last = f"regexp_extract_all(coalesce({expr}, ''), {pat}, 1)[-1]"
    return (f"CASE WHEN {last} IS NULL THEN '' WHEN lower({last}) LIKE 'no%' "
            f"THEN {q(settings.negative_label)} ELSE {q(settings.positive_label)} END")


def is_refusal(expr: str, observed: str) -> str:
    pat = q(labels.refusal_pattern("re2"))
    t = strip_or_empty(expr)
    return f"({t} <> '' AND coalesce(regexp_matches({t}, {pat}), false) AND {observed} = '')"


def has_error(expr: str) -> str:
    return f"({strip_or_empty(expr)} <> '')"


def prompt_id(item: str, method: str, shots: str) -> str:
    return (f"CAST({item} AS VARCHAR) || '-' || {method} || "
            f"CASE WHEN {shots} <> 0 THEN CAST({shots} AS VARCHAR) ELSE '' END")


def method_list(settings: Settings = FIXTURE) -> str:
    return "[" + ", ".join(
        f"{{'method': {q(m)}, 'shots': {int(s)}}}" for m, s in settings.prompt_methods()) + "]"


def directions_values(settings: Settings = FIXTURE) -> str:
    return ", ".join(f"({q(s)}, {q(t)})" for s, t in settings.directions())


def fixture_ctes(settings: Settings = FIXTURE) -> dict[str, str]:
    neg, pos = q(settings.negative_label), q(settings.positive_label)
    ctes = {}
    ctes["corpus"] = """
  SELECT d.doc_id AS ordinal, d.lang AS src_lang,
         CASE WHEN d.lang <> 'en' THEN 'en' WHEN d.doc_id % 3 = 0 THEN 'de'
              WHEN d.doc_id % 3 = 1 THEN 'es' ELSE 'fr' END AS tgt_lang,
         CASE WHEN l.quality = 1 AND l.toxic = 0 THEN '1_No_hallucination'
              WHEN d.doc_id % 3 = 0 THEN '2_Small_hallucination'
              WHEN d.doc_id % 3 = 1 THEN '3_Partial_hallucination'
              ELSE '4_Full_hallucination' END AS class_hall,
         left(d.text, length(d.text) // 2) AS src_text,
         substr(d.text, length(d.text) // 2 + 1) AS mt_text
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
    ctes["items"] = f"""
  SELECT c.ordinal AS item_id, c.src_lang AS source_language, c.tgt_lang AS target_language,
         ({lang_name('c.src_lang', settings)}) || ' to ' || ({lang_name('c.tgt_lang', settings)}) AS direction,
         c.class_hall AS grade,
         CASE WHEN c.class_hall = {q(settings.negative_grade)} THEN {neg} ELSE {pos} END AS answer,
         {strip_or_empty('c.src_text')} AS source_text,
         {strip_or_empty('c.mt_text')} AS target_text
  FROM corpus c
  WHERE EXISTS (SELECT 1 FROM (VALUES {directions_values(settings)}) w(s, t)
                WHERE w.s = c.src_lang AND w.t = c.tgt_lang)"""
    ctes["prompts"] = f"""
  SELECT {prompt_id('x.item_id', 'x.m.method', 'x.m.shots')} AS prompt_id,
         x.item_id, x.m.method AS method, CAST(x.m.shots AS INTEGER) AS shots,
         x.direction, x.answer
  FROM (SELECT i.*, unnest({method_list(settings)}) AS m FROM items i) x"""
    models = "[" + ", ".join(
        f"{{'model': {q(m.id)}, 'runtime': {q(m.runtime)}, 'pno': {fixture.MODEL_NUMBERS[m.id]}}}"
        for m in settings.models) + "]"
    mno = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in fixture.METHOD_NUMBERS.items())
    ctes["reply_keys"] = f"""
  SELECT y.prompt_id, y.item_id, y.method, y.shots, y.answer, y.p.model AS model,
         y.p.runtime AS runtime, CAST(y.replicate AS INTEGER) AS replicate,
         (y.item_id * 31 + y.replicate * 17 + y.shots * 7
          + (CASE y.method {mno} END) * 3 + y.p.pno * 5) % 20 AS b
  FROM (SELECT x.*, unnest(generate_series(1, {settings.replicates})) AS replicate
        FROM (SELECT p.*, unnest({models}) AS p FROM prompts p) x) y"""
    resp = f"""CASE WHEN b = 0 THEN ''
              WHEN b = 1 THEN {templates.sql_literal(fixture.REFUSAL_TEXT)}
              WHEN b = 2 THEN {templates.sql_literal(fixture.HEDGED_TEXT)}
              WHEN b = 3 THEN {templates.sql_literal(fixture.SHOUTED_TEXT)}
              WHEN b = 4 THEN {templates.sql_literal(fixture.MARKDOWN_TEXT)}
              WHEN b = 5 THEN {templates.sql_literal(fixture.TWO_LABELS_TEXT)}
              WHEN b = 6 THEN NULL
              WHEN b <= 15 THEN 'Label: ' || answer
              ELSE 'Label: ' || CASE WHEN answer = {pos} THEN {neg} ELSE {pos} END END"""
    ctes["replies_b"] = f"""
  SELECT prompt_id, model, method, replicate, runtime,
         CAST({settings.temperature} AS DOUBLE) AS temperature,
         CASE WHEN b = 6 THEN {q(fixture.ERROR_TEXT)} ELSE '' END AS error,
         '' AS refusal, coalesce(NOT contains(response, 'Label:'), false) AS truncated, response,
         b, item_id, shots
  FROM (SELECT *, {resp} AS response FROM reply_keys) r"""
    ctes["replies"] = """
  SELECT prompt_id, model, method, replicate, runtime, temperature, error, refusal,
         truncated, response FROM replies_b"""
    ctes["judgements"] = f"""
  SELECT r.prompt_id, r.model, r.replicate, r.method, p.shots, p.direction, p.answer,
         r.observed, r.observed <> '' AS parsed, {is_refusal('r.response', 'r.observed')} AS refusal,
         p.item_id
  FROM (SELECT *, {parse_label('response', settings)} AS observed
        FROM replies WHERE NOT {has_error('error')}) r
  JOIN prompts p ON r.prompt_id = p.prompt_id"""
    return ctes


def with_ctes(select: str, names: list[str], extra: dict[str, str] | None = None,
              settings: Settings = FIXTURE) -> str:
    """``WITH`` the named fixture CTEs (in dependency order) and any extra ones."""
    ctes = fixture_ctes(settings)
    order = ["corpus", "items", "prompts", "reply_keys", "replies_b", "replies", "judgements"]
    need = set(names)
    deps = {"items": {"corpus"}, "prompts": {"items"}, "reply_keys": {"prompts"},
            "replies_b": {"reply_keys"}, "replies": {"replies_b"},
            "judgements": {"replies", "prompts"}}
    changed = True
    while changed:
        changed = False
        for n in list(need):
            for d in deps.get(n, ()):
                if d not in need:
                    need.add(d)
                    changed = True
    parts = [f"{n} AS ({ctes[n]})" for n in order if n in need]
    parts += [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + select


# -- scoring in SQL -----------------------------------------------------------

def confusion_select(group: str, settings: Settings = FIXTURE) -> str:
    pos, neg = q(settings.positive_label), q(settings.negative_label)
    y = f"(answer = {pos})"
    pred_all = f"(CASE WHEN observed = {pos} THEN true WHEN observed = {neg} THEN false ELSE NOT {y} END)"
    pred = f"(observed = {pos})"
    views = {"all": ("true", pred_all), "parsed": ("parsed", pred),
             "judged": ("(parsed AND NOT refusal)", pred)}
    cols = []
    for v, (m, p) in views.items():
        cols += [f"count(*) FILTER (WHERE {m} AND {y} AND {p}) AS {v}_tp",
                 f"count(*) FILTER (WHERE {m} AND NOT {y} AND {p}) AS {v}_fp",
                 f"count(*) FILTER (WHERE {m} AND {y} AND NOT {p}) AS {v}_fn",
                 f"count(*) FILTER (WHERE {m} AND NOT {y} AND NOT {p}) AS {v}_tn"]
    cols += ["count(*) FILTER (WHERE refusal) AS refusals",
             "count(*) FILTER (WHERE NOT parsed) AS unparsed"]
    return ", ".join(cols)


def metrics_select(group_cols: list[str], source: str, views=("all", "parsed", "judged")) -> str:
    """Unpack the view columns of ``source`` and compute the metrics."""
    unions = []
    g = ", ".join(group_cols)
    for v in views:
        unions.append(f"SELECT {g}, '{v}' AS view, refusals, unparsed, "
                      f"CAST({v}_tp AS DOUBLE) AS tp, CAST({v}_fp AS DOUBLE) AS fp, "
                      f"CAST({v}_fn AS DOUBLE) AS fn, CAST({v}_tn AS DOUBLE) AS tn FROM {source}")
    body = " UNION ALL ".join(unions)
    return f"""SELECT {g}, view, CAST(refusals AS BIGINT) AS refusals,
       CAST(unparsed AS BIGINT) AS unparsed, CAST(tp + fp + fn + tn AS BIGINT) AS n,
       (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc,
       tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
       (2.0 * tp) / (2.0 * tp + fp + fn) AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy
FROM ({body}) u
WHERE tp + fn > 0 AND tn + fp > 0 AND tp + fp > 0 AND tn + fn > 0"""


# -- prompts, examples, owed replies ------------------------------------------

def shot_values(settings: Settings = FIXTURE) -> list[int]:
    return sorted({s for _, s in settings.prompt_methods() if s})


def render_ctes(settings: Settings = FIXTURE) -> dict[str, str]:
    pos = q(settings.positive_label)
    slot_vals = ", ".join(f"({s}, {k}, {'true' if k % 2 == 0 else 'false'})"
                          for s in shot_values(settings) for k in range(s))
    example = templates.sql_render(templates.EXAMPLE, {
        "source": lang_name("x.source_language", settings),
        "target": lang_name("x.target_language", settings),
        "source_text": "x.source_text", "target_text": "x.target_text",
        "answer": "x.answer"})
    fields = {"source": lang_name("i.source_language", settings),
              "target": lang_name("i.target_language", settings),
              "source_text": "i.source_text", "target_text": "i.target_text",
              "examples": "t.examples", "other_label": "''", "other_reasoning": "''"}
    by_method = " ".join(f"WHEN {q(m)} THEN {templates.sql_render(tpl, fields)}"
                         for m, tpl in sorted(templates.TEMPLATES.items()))
    return {
        "slots": f"SELECT * FROM (VALUES {slot_vals}) v(shots, slot, positive)",
        "candidates": f"""
  SELECT s.shots, s.slot, i.item_id, i.direction,
         md5(concat_ws('|', '{settings.example_seed}', i.direction, CAST(s.shots AS VARCHAR),
                       CAST(s.slot AS VARCHAR), CAST(i.item_id AS VARCHAR))) AS h
  FROM items i JOIN slots s ON (i.answer = {pos}) = s.positive""",
        "examples": """
  SELECT direction, shots, slot, first(item_id ORDER BY h, item_id) AS item_id
  FROM candidates GROUP BY direction, shots, slot""",
        "example_text": f"""
  SELECT p.prompt_id, string_agg({example}, '' ORDER BY e.slot) AS examples,
         count(*) AS shown
  FROM prompts p
  JOIN examples e ON e.direction = p.direction AND e.shots = p.shots AND e.item_id <> p.item_id
  JOIN items x ON x.item_id = e.item_id
  GROUP BY p.prompt_id""",
        "rendered": f"""
  SELECT p.prompt_id, p.item_id, p.method, p.shots, p.direction, p.answer,
         CASE p.method {by_method} END AS prompt,
         CAST(coalesce(t.shown, 0) AS INTEGER) AS examples_shown
  FROM prompts p JOIN items i ON i.item_id = p.item_id
  LEFT JOIN example_text t ON t.prompt_id = p.prompt_id""",
    }


def budget(method: str, model: str, settings: Settings = FIXTURE) -> str:
    caps = " ".join(f"WHEN {q(m.name)} THEN {int(m.max_tokens)}" for m in settings.methods)
    room = " ".join(f"WHEN {q(m.id)} THEN {int(m.reasoning_headroom)}" for m in settings.models)
    return (f"(CAST(CASE {method} {caps} END AS INTEGER) + "
            f"CAST(CASE {model} {room} ELSE 0 END AS INTEGER))")


def wanted_cte(settings: Settings = FIXTURE) -> str:
    return f"""
  SELECT prompt_id, model, method, replicate, runtime,
         CAST({settings.temperature} AS DOUBLE) AS temperature,
         {budget('method', 'model', settings)} AS max_tokens
  FROM reply_keys"""


def scores_ctes() -> dict[str, str]:
    """by_dir / grouped / scores: the full scores table (score_directions)."""
    from ..operators import metrics
    by_dir = (f"SELECT model, method, shots, direction, {confusion_select('')} "
              "FROM judgements GROUP BY model, method, shots, direction")
    overall = ("SELECT model, method, shots, 'overall' AS direction, "
               + ", ".join(f"sum({v}_{c}) AS {v}_{c}" for v in metrics.VIEWS
                           for c in metrics.CELLS)
               + ", sum(refusals) AS refusals, sum(unparsed) AS unparsed "
               "FROM by_dir GROUP BY model, method, shots")
    return {"by_dir": by_dir, "grouped": f"SELECT * FROM by_dir UNION ALL {overall}",
            "scores": metrics_select(["model", "method", "shots", "direction"], "grouped")}


def last_line(expr: str) -> str:
    s = strip_or_empty(expr)
    return (f"CASE WHEN {s} = '' THEN '' "
            f"ELSE string_split_regex({s}, {q(text.LINE_BREAK)})[-1] END")
