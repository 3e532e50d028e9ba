"""The registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes (spark, sf_dir) and returns a DataFrame over the driver's
tables (documents, labels, conversations) through the derived fixture; those
that scan a written corpus or stream a written log run jobs as they are built.
Each oracle is SQL over the same parquet views.
Computed columns carry the same alias on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dimensions
from ..config import FIXTURE
from ..functions import ids, labels, text
from ..operators import items as item_ops
from ..operators import judge, metrics, quality, replies, reports
from ..operators import prompts as prompt_ops
from ..session import files_cleared, scratch_dir
from ..sources import fixture as fx
from ..sources import tables
from ..sources.reply_log import ReplyLog
from ..streaming import replies as streaming
from . import sql as S

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}

CFG = FIXTURE
POS, NEG = S.q(CFG.positive_label), S.q(CFG.negative_label)


def register(name: str, oracle: str | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def _log(spark, sf_dir):
    """The reply log and the prompt keys it answers, built once."""
    spec = fx.prompts(spark, sf_dir)
    return fx.replies(spark, sf_dir, spec=spec), spec


def _judged(spark, sf_dir, keep=()):
    return judge.judgements(*_log(spark, sf_dir), CFG, keep=keep)


# ---------------------------------------------------------------------------
# Reading replies
# ---------------------------------------------------------------------------

@register("parse_label", S.with_ctes(
    f"SELECT prompt_id, model, method, replicate, {S.parse_label('response')} AS observed "
    "FROM replies", ["replies"]))
def q_parse_label(spark, sf_dir):
    r = fx.replies(spark, sf_dir)
    return r.select("prompt_id", "model", "method", "replicate",
                    labels.parse_label("response").alias("observed"))


@register("detect_refusal", S.with_ctes(
    "SELECT prompt_id, model, method, replicate, "
    f"{S.is_refusal('response', S.parse_label('response'))} AS refusal FROM replies",
    ["replies"]))
def q_detect_refusal(spark, sf_dir):
    r = fx.replies(spark, sf_dir)
    return r.select("prompt_id", "model", "method", "replicate",
                    labels.is_refusal("response").alias("refusal"))


@register("truncated_flag", S.with_ctes(
    "SELECT prompt_id, model, method, replicate, "
    "coalesce(NOT contains(response, 'Label:'), false) AS truncated "
    "FROM replies", ["replies"]))
def q_truncated_flag(spark, sf_dir):
    r = fx.replies(spark, sf_dir)
    return r.select("prompt_id", "model", "method", "replicate",
                    labels.truncated("response").alias("truncated"))


@register("judgements", S.with_ctes(
    "SELECT prompt_id, model, replicate, method, shots, direction, answer, observed, "
    "parsed, refusal FROM judgements", ["judgements"]))
def q_judgements(spark, sf_dir):
    return _judged(spark, sf_dir)


# ---------------------------------------------------------------------------
# Scores
# ---------------------------------------------------------------------------

_BY_DIR = (f"SELECT model, method, shots, direction, {S.confusion_select('')} "
           "FROM judgements GROUP BY model, method, shots, direction")
_OVERALL = ("SELECT model, method, shots, 'overall' AS direction, "
            + ", ".join(f"sum({v}_{c}) AS {v}_{c}" for v in metrics.VIEWS for c in metrics.CELLS)
            + ", sum(refusals) AS refusals, sum(unparsed) AS unparsed "
            "FROM by_dir GROUP BY model, method, shots")


@register("score_directions", S.with_ctes(
    S.metrics_select(["model", "method", "shots", "direction"], "grouped"), ["judgements"],
    {"by_dir": _BY_DIR, "grouped": f"SELECT * FROM by_dir UNION ALL {_OVERALL}"}))
def q_score_directions(spark, sf_dir):
    return metrics.score_replies(*_log(spark, sf_dir), CFG)


@register("score_views", S.with_ctes(
    S.metrics_select(["model", "method", "shots"], "c"), ["judgements"],
    {"c": f"SELECT model, method, shots, {S.confusion_select('')} FROM judgements "
          "GROUP BY model, method, shots"}))
def q_score_views(spark, sf_dir):
    return metrics.score_replies(*_log(spark, sf_dir), CFG,
                                 group_cols=metrics.GROUP)


@register("score_overall", S.with_ctes(
    S.metrics_select(["model"], "c"), ["judgements"],
    {"c": f"SELECT model, {S.confusion_select('')} FROM judgements GROUP BY model"}))
def q_score_overall(spark, sf_dir):
    return metrics.score_replies(*_log(spark, sf_dir), CFG,
                                 group_cols=["model"])


# ---------------------------------------------------------------------------
# Items
# ---------------------------------------------------------------------------

MODELS = [m.id for m in CFG.models]
ALPHA, BETA = MODELS[0], MODELS[1]
RENDER = S.render_ctes(CFG)


def _items(spark, sf_dir):
    return fx.items(spark, sf_dir, CFG)


def _prompts_full(spark, sf_dir):
    return prompt_ops.build_prompts(_items(spark, sf_dir), CFG)


@register("scan_items", S.with_ctes(
    "SELECT item_id, source_language, target_language, direction, grade, answer, "
    "source_text, target_text FROM items", ["items"]))
def q_scan_items(spark, sf_dir):
    """A1 + J1: the corpus written as TSV (quoted multi-line fields) to the
    shared scratch folder, scanned back with an explicit schema, then built
    into items."""
    path = scratch_dir(spark, "corpus") + "/corpus.tsv"
    tables.write_table(fx.corpus(spark, sf_dir), path,
                       columns=["src_lang", "tgt_lang", "class_hall", "src_text", "mt_text",
                                "ordinal"], fmt="tsv")
    scanned = tables.read_corpus(spark, path, fmt="csv")
    return item_ops.build_items(scanned, CFG, item_ids="ordinal")


@register("binary_label", S.with_ctes("SELECT item_id, grade, answer FROM items", ["items"]))
def q_binary_label(spark, sf_dir):
    return _items(spark, sf_dir).select("item_id", "grade", "answer")


@register("clean_text", f"SELECT doc_id, {S.strip_or_empty('text')} AS text_clean, "
          f"CAST(length({S.strip_or_empty('text')}) AS INTEGER) AS n_chars_clean FROM documents")
def q_clean_text(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    c = text.clean_or_empty("text")
    return d.select("doc_id", c.alias("text_clean"), F.length(c).alias("n_chars_clean"))


@register("direction_names", S.with_ctes(
    f"SELECT item_id, {S.lang_name('source_language')} AS source_name, "
    f"{S.lang_name('target_language')} AS target_name, direction FROM items", ["items"]))
def q_direction_names(spark, sf_dir):
    names = CFG.language_names()
    i = _items(spark, sf_dir)
    return i.select("item_id", ids.language_name("source_language", names).alias("source_name"),
                    ids.language_name("target_language", names).alias("target_name"),
                    "direction")


@register("item_ids", S.with_ctes(
    "SELECT ordinal AS doc_id, lower(left(src_lang, 3) || left(tgt_lang, 3) || '-' || "
    "printf('%04d', pos)) AS item_code, CAST(pos AS BIGINT) AS position FROM ("
    "SELECT c.*, row_number() OVER (PARTITION BY src_lang, tgt_lang ORDER BY ordinal) - 1 AS pos "
    "FROM corpus c WHERE EXISTS (SELECT 1 FROM (VALUES " + S.directions_values(CFG) + ") w(s, t) "
    "WHERE w.s = c.src_lang AND w.t = c.tgt_lang)) z", ["corpus"]))
def q_item_ids(spark, sf_dir):
    """W1 + P5: per-pair position in file order, as the item id."""
    corpus = fx.corpus(spark, sf_dir)
    pos = item_ops.position_within(
        corpus.join(F.broadcast(dimensions.local_table(spark, CFG.directions(),
                                                       "src_lang string, tgt_lang string")),
                    ["src_lang", "tgt_lang"], "left_semi"),
        ["src_lang", "tgt_lang"], "ordinal", "position")
    return pos.select(F.col("ordinal").alias("doc_id"),
                      ids.item_id("src_lang", "tgt_lang", "position").alias("item_code"),
                      F.col("position").cast("long").alias("position"))


_SAMPLED = S.with_ctes(
    "SELECT item_id, direction, answer FROM ("
    " SELECT i.*, q.kpos, q.kneg, row_number() OVER (PARTITION BY i.direction, i.answer "
    f"  ORDER BY md5(concat_ws('|', '{CFG.sample_seed}', CAST(i.item_id AS VARCHAR))), i.item_id) AS rn"
    " FROM items i JOIN quota q ON q.direction = i.direction) r"
    f" WHERE rn <= CASE WHEN answer = {POS} THEN kpos ELSE kneg END",
    ["items"], {
        "counts": f"SELECT direction, count(*) AS n, count(*) FILTER (WHERE answer = {POS}) AS pos, "
                  f"least({CFG.items_per_direction}, count(*)) AS wanted FROM items GROUP BY direction",
        "quota0": "SELECT direction, n, pos, wanted, least(pos, CAST(round_even(wanted * "
                  "(CAST(pos AS DOUBLE) / n), 0) AS BIGINT)) AS kpos FROM counts",
        "quota": "SELECT direction, kpos, least(n - pos, wanted - kpos) AS kneg FROM quota0"})


@register("stratified_sample", _SAMPLED)
def q_stratified_sample(spark, sf_dir):
    s = item_ops.stratified_sample(_items(spark, sf_dir), CFG.items_per_direction,
                                   CFG.sample_seed, CFG.positive_label)
    return s.select("item_id", "direction", "answer")


@register("sample_merged", _SAMPLED)
def q_sample_merged(spark, sf_dir):
    """W2 from states of three parts of the corpus, merged."""
    i = _items(spark, sf_dir).select("item_id", "direction", "answer")
    how = (CFG.items_per_direction, CFG.sample_seed)
    states = [item_ops.sample_state(i.where(F.pmod(F.xxhash64("item_id"), F.lit(3)) == k), *how) for k in range(3)]
    return item_ops.sample_from_state(item_ops.merge_sample_states(states, *how), *how, CFG.positive_label)


@register("direction_balance", S.with_ctes(
    f"SELECT direction, count(*) AS items, count(*) FILTER (WHERE answer = {POS}) / count(*) "
    "AS hallucinated, count(*) OVER () AS directions FROM items GROUP BY direction", ["items"]))
def q_direction_balance(spark, sf_dir):
    return item_ops.direction_balance(_items(spark, sf_dir), CFG.positive_label).orderBy(
        F.desc("items"), "direction")


@register("severity_counts", S.with_ctes(
    "SELECT grade, count(*) AS items FROM items GROUP BY grade", ["items"]))
def q_severity_counts(spark, sf_dir):
    return item_ops.severity_counts(_items(spark, sf_dir))


@register("sample_preview", S.with_ctes(
    "SELECT item_id, direction, answer, left(source_text, 110) AS source_preview, "
    "left(target_text, 110) AS target_preview FROM items "
    "ORDER BY md5(concat_ws('|', '1', CAST(item_id AS VARCHAR))), item_id LIMIT 3", ["items"]))
def q_sample_preview(spark, sf_dir):
    return item_ops.sample_preview(_items(spark, sf_dir), n=3, seed=1)


@register("direction_pairs", S.with_ctes(
    "SELECT w.position, w.s AS source_language, w.t AS target_language, "
    f"({S.lang_name('w.s')}) || ' to ' || ({S.lang_name('w.t')}) AS direction, "
    "coalesce(c.items, 0) AS items FROM (VALUES "
    + ", ".join(f"({i}, {S.q(s)}, {S.q(t)})" for i, (s, t) in enumerate(CFG.directions()))
    + ") w(position, s, t) LEFT JOIN (SELECT src_lang, tgt_lang, count(*) AS items FROM corpus "
    "GROUP BY src_lang, tgt_lang) c ON c.src_lang = w.s AND c.tgt_lang = w.t", ["corpus"]))
def q_direction_pairs(spark, sf_dir):
    """G1: the configured directions and how many corpus rows each has."""
    names = CFG.language_names()
    dirs = dimensions.directions(spark, CFG)
    counts = (fx.corpus(spark, sf_dir).groupBy("src_lang", "tgt_lang")
              .agg(F.count(F.lit(1)).alias("items"))
              .withColumnRenamed("src_lang", "source_language")
              .withColumnRenamed("tgt_lang", "target_language"))
    return (dirs.join(counts, ["source_language", "target_language"], "left")
            .select("position", "source_language", "target_language",
                    ids.direction_name(ids.language_name("source_language", names),
                                       ids.language_name("target_language", names))
                    .alias("direction"),
                    F.coalesce("items", F.lit(0).cast("long")).alias("items")))


# ---------------------------------------------------------------------------
# Prompts
# ---------------------------------------------------------------------------

@register("prompt_expansion", S.with_ctes(
    "SELECT prompt_id, item_id, method, shots, direction, answer FROM prompts", ["prompts"]))
def q_prompt_expansion(spark, sf_dir):
    return fx.prompts(spark, sf_dir, CFG)


@register("draw_examples", S.with_ctes(
    "SELECT e.direction, e.shots, e.slot, e.item_id, i.answer FROM examples e "
    "JOIN items i ON i.item_id = e.item_id", ["prompts"], RENDER))
def q_draw_examples(spark, sf_dir):
    ex = prompt_ops.draw_examples(_items(spark, sf_dir), CFG)
    return ex.select("direction", "shots", "slot", "item_id", "answer")


@register("render_prompts", S.with_ctes(
    "SELECT prompt_id, item_id, method, shots, direction, answer, prompt FROM rendered",
    ["prompts"], RENDER))
def q_render_prompts(spark, sf_dir):
    return _prompts_full(spark, sf_dir).drop("examples_shown")


@register("render_fewshot", S.with_ctes(
    "SELECT prompt_id, item_id, shots, direction, prompt, examples_shown FROM rendered "
    "WHERE method = 'fewshot'", ["prompts"], RENDER))
def q_render_fewshot(spark, sf_dir):
    p = prompt_ops.build_prompts(_items(spark, sf_dir), CFG, methods=["fewshot"])
    return p.select("prompt_id", "item_id", "shots", "direction", "prompt", "examples_shown")


@register("prompt_counts", S.with_ctes(
    "SELECT method, shots, count(*) AS prompts, "
    "CAST(sum(count(*)) OVER (PARTITION BY method) AS BIGINT) AS method_prompts "
    "FROM prompts GROUP BY method, shots", ["prompts"]))
def q_prompt_counts(spark, sf_dir):
    return prompt_ops.prompt_counts(fx.prompts(spark, sf_dir, CFG))


@register("prompt_lengths", S.with_ctes(
    "SELECT method, round_even(avg(w), 0) AS mean_words, "
    "round_even(quantile_cont(w, 0.5), 0) AS median_words, max(w) AS max_words "
    f"FROM (SELECT method, {S.word_count('prompt')} AS w FROM rendered) z GROUP BY method",
    ["prompts"], RENDER))
def q_prompt_lengths(spark, sf_dir):
    return prompt_ops.prompt_lengths(_prompts_full(spark, sf_dir))


@register("first_per_method", S.with_ctes(
    "SELECT method, prompt_id, shots, answer, prompt FROM ("
    " SELECT r.*, row_number() OVER (PARTITION BY method ORDER BY shots, item_id) AS rn "
    " FROM rendered r) z WHERE rn = 1", ["prompts"], RENDER))
def q_first_per_method(spark, sf_dir):
    return prompt_ops.first_per_method(_prompts_full(spark, sf_dir))


@register("inspect_prompt", S.with_ctes(
    "SELECT r.prompt_id, r.method, r.shots, r.direction, i.grade, r.answer, r.prompt "
    "FROM (SELECT * FROM rendered WHERE method = 'span' ORDER BY shots, item_id, prompt_id "
    "LIMIT 1) r JOIN items i ON i.item_id = r.item_id", ["prompts"], RENDER))
def q_inspect_prompt(spark, sf_dir):
    i = _items(spark, sf_dir)
    return prompt_ops.inspect_prompt(prompt_ops.build_prompts(i, CFG), i, method="span")


@register("chat_messages",
          f"SELECT conv_id, CAST(0 AS BIGINT) AS position, 'system' AS role, "
          f"{S.templates.sql_literal(S.templates.SYSTEM)} AS content, count(*) + 1 AS n_messages "
          "FROM conversations GROUP BY conv_id UNION ALL "
          "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, "
          "coalesce(role, ''), coalesce(text, '')) AS position, coalesce(role, '') AS role, "
          "coalesce(text, '') AS content, count(*) OVER (PARTITION BY conv_id) + 1 AS n_messages "
          "FROM conversations")
def q_chat_messages(spark, sf_dir):
    return prompt_ops.chat_messages(fx.table(spark, sf_dir, "conversations"))


# ---------------------------------------------------------------------------
# Owed replies, calls, responses
# ---------------------------------------------------------------------------

def _wanted(spark, sf_dir):
    return replies.wanted_replies(fx.prompts(spark, sf_dir, CFG), CFG)


WANTED = {"wanted": S.wanted_cte(CFG)}
COLLECTED = {"collected": "SELECT * FROM replies_b WHERE b < 12"}


@register("wanted_replies", S.with_ctes(
    "SELECT prompt_id, model, method, replicate, runtime, temperature, max_tokens FROM wanted",
    ["reply_keys"], WANTED))
def q_wanted_replies(spark, sf_dir):
    return _wanted(spark, sf_dir)


@register("answer_budget", S.with_ctes(
    "SELECT model, method, max_tokens, count(*) AS calls FROM wanted "
    "GROUP BY model, method, max_tokens", ["reply_keys"], WANTED))
def q_answer_budget(spark, sf_dir):
    return _wanted(spark, sf_dir).groupBy("model", "method", "max_tokens").agg(
        F.count(F.lit(1)).alias("calls"))


_OUTSTANDING = {**WANTED, **COLLECTED, **RENDER,
                "owed": "SELECT w.* FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM collected c "
                        "WHERE c.model = w.model AND c.method = w.method AND "
                        "c.prompt_id = w.prompt_id AND c.replicate = w.replicate)",
                "owed_text": "SELECT o.*, r.prompt FROM owed o JOIN rendered r "
                             "ON r.prompt_id = o.prompt_id"}


def _owed(spark, sf_dir):
    """The items and what is owed on them, keys only."""
    i = _items(spark, sf_dir)
    spec = fx.prompts(spark, sf_dir, CFG, items_table=i)
    return i, replies.outstanding(replies.wanted_replies(spec, CFG), fx.collected(spark, sf_dir, CFG, spec=spec))


def _owed_text(spark, sf_dir):
    i, owed = _owed(spark, sf_dir)
    return prompt_ops.attach_rendered(owed, i, CFG, prompt_ops.kept_example_maps(i, CFG))


_OWED_TEXT = S.with_ctes(
    "SELECT model, method, prompt_id, replicate, runtime, temperature, max_tokens, prompt "
    "FROM owed_text", ["replies_b"], _OUTSTANDING)


@register("outstanding_replies", _OWED_TEXT)
def q_outstanding_replies(spark, sf_dir):
    return _owed_text(spark, sf_dir).select("model", "method", "prompt_id", "replicate",
                                             "runtime", "temperature", "max_tokens", "prompt")


@register("outstanding_indexed", _OWED_TEXT)
def q_outstanding_indexed(spark, sf_dir):
    """J3 from the committed log's key index: the collected replies go into a
    log, and what is owed is found without reading them again."""
    log = ReplyLog(spark, scratch_dir(spark, "log"), buckets=4)
    log.load(fx.collected(spark, sf_dir, CFG))
    i = _items(spark, sf_dir)
    owed = log.outstanding(replies.wanted_replies(fx.prompts(spark, sf_dir, CFG, items_table=i), CFG))
    return prompt_ops.attach_rendered(owed, i, CFG, prompt_ops.kept_example_maps(i, CFG)).select(
        "model", "method", "prompt_id", "replicate", "runtime", "temperature", "max_tokens", "prompt")


_SAMPLING = " OR ".join(f"model = {S.q(m.id)}" for m in CFG.models if m.takes_sampling) or "false"


@register("request_bodies", S.with_ctes(
    "SELECT model, method, prompt_id, replicate, CAST(CASE WHEN " + _SAMPLING + " THEN "
    "to_json({'model': model, 'max_tokens': max_tokens, 'messages': [{'role': 'system', "
    f"'content': {S.templates.sql_literal(S.templates.SYSTEM)}}}, {{'role': 'user', 'content': prompt}}], "
    f"'temperature': temperature, 'top_p': CAST({CFG.top_p} AS DOUBLE)}}) ELSE "
    "to_json({'model': model, 'max_tokens': max_tokens, 'messages': [{'role': 'system', "
    f"'content': {S.templates.sql_literal(S.templates.SYSTEM)}}}, {{'role': 'user', 'content': prompt}}]}}) "
    "END AS VARCHAR) AS body FROM owed_text", ["replies_b"], _OUTSTANDING))
def q_request_bodies(spark, sf_dir):
    return replies.request_bodies(_owed_text(spark, sf_dir), CFG)


_READ_ERR = S.q("JSONDecodeError: body is not a JSON object")


@register("response_bodies", S.with_ctes(
    "SELECT prompt_id, model, method, replicate, "
    f"CASE WHEN b IN (0, 6) THEN '' ELSE {S.strip_or_empty('response')} END AS reply, "
    "CAST(CASE WHEN b IN (1, 6) THEN 0 ELSE length(prompt_id) END AS BIGINT) AS prompt_tokens, "
    f"CASE WHEN b IN (1, 6) THEN CAST(0 AS BIGINT) ELSE {S.word_count("coalesce(response, '')")} END "
    "AS completion_tokens, "
    f"CASE WHEN b = 6 THEN {_READ_ERR} ELSE '' END AS error FROM replies_b", ["replies_b"]))
def q_response_bodies(spark, sf_dir):
    return replies.read_responses(fx.response_bodies(spark, sf_dir, CFG))


@register("token_usage", S.with_ctes(
    "SELECT model, count(*) AS calls, "
    "CAST(sum(CASE WHEN b = 1 THEN 0 ELSE length(prompt_id) END) AS BIGINT) AS input_tokens, "
    f"CAST(sum(CASE WHEN b = 1 THEN 0 ELSE {S.word_count("coalesce(response, '')")} END) "
    "AS BIGINT) AS output_tokens FROM replies_b WHERE b <> 6 GROUP BY model", ["replies_b"]))
def q_token_usage(spark, sf_dir):
    return replies.token_usage(replies.read_responses(fx.response_bodies(spark, sf_dir, CFG)))


@register("pass_cost", S.with_ctes(
    "SELECT unnest([" + ", ".join(S.q(m) for m in MODELS) + "]) AS model, prompts, "
    + str(CFG.replicates) + " AS replicates, prompts * " + str(CFG.replicates) + " AS calls "
    f"FROM (SELECT count(*) AS prompts FROM prompts WHERE method <> {S.q(CFG.review_method)}) c",
    ["prompts"]))
def q_pass_cost(spark, sf_dir):
    return replies.pass_cost(fx.prompts(spark, sf_dir, CFG), CFG)


@register("completeness", S.with_ctes(
    "SELECT coalesce(w.model, c.model) AS model, coalesce(w.method, c.method) AS method, "
    "coalesce(w.n, 0) AS wanted, coalesce(c.n, 0) AS collected, "
    "coalesce(w.n, 0) = coalesce(c.n, 0) AS ok FROM "
    "(SELECT model, method, count(*) AS n FROM wanted GROUP BY model, method) w FULL OUTER JOIN "
    "(SELECT model, method, count(*) AS n FROM collected GROUP BY model, method) c "
    "ON c.model = w.model AND c.method = w.method", ["replies_b"], {**WANTED, **COLLECTED}))
def q_completeness(spark, sf_dir):
    return replies.completeness(_wanted(spark, sf_dir), fx.collected(spark, sf_dir, CFG))


@register("reply_coverage", S.with_ctes(
    "SELECT model, method, count(*) AS replies, count(*) FILTER (WHERE coalesce(truncated, false)) "
    f"AS truncated, count(*) FILTER (WHERE {S.has_error('error')}) AS errored FROM replies "
    "GROUP BY model, method", ["replies"]))
def q_reply_coverage(spark, sf_dir):
    return replies.reply_coverage(fx.replies(spark, sf_dir, CFG))


_REVIEW_FIELDS = {"source": S.lang_name("i.source_language"),
                  "target": S.lang_name("i.target_language"),
                  "source_text": "i.source_text", "target_text": "i.target_text",
                  "other_label": S.last_line("f.response"),
                  "other_reasoning": S.strip_or_empty("f.response"), "examples": "''"}


@register("review_prompts", S.with_ctes(
    f"SELECT {S.q(BETA)} AS model, {S.q(CFG.review_method)} AS method, p.prompt_id, "
    "f.replicate, "
    f"{S.budget(S.q(CFG.review_method), S.q(BETA))} AS max_tokens, "
    f"{S.last_line('f.response')} AS other_label, "
    f"{S.templates.sql_render(S.templates.TEMPLATES[CFG.review_method], _REVIEW_FIELDS)} AS prompt "
    "FROM prompts p JOIN replies f ON f.prompt_id = p.prompt_id "
    "JOIN items i ON i.item_id = p.item_id "
    f"WHERE p.method = 'baseline' AND f.replicate BETWEEN 1 AND {CFG.replicates} "
    f"AND f.model = {S.q(ALPHA)} AND f.method = 'baseline' "
    f"AND NOT {S.has_error('f.error')} AND f.response IS NOT NULL",
    ["replies"]))
def q_review_prompts(spark, sf_dir):
    i = _items(spark, sf_dir)
    p = fx.prompts(spark, sf_dir, CFG)
    return replies.review_prompts(p, i, fx.replies(spark, sf_dir, CFG), CFG, model=BETA,
                                  reviewer=ALPHA, collected=fx.collected(spark, sf_dir, CFG))


def stub_judge(record: dict) -> str:
    """A deterministic stand-in for a model call: the prompt's length picks
    the answer, and one length in three fails like an unavailable service."""
    k = len(record["prompt"]) % 3
    if k == 0:
        raise RuntimeError("stub judge unavailable")
    return "Label: Hallucination" if k == 1 else "Label: No hallucination"


_GENERATED = S.with_ctes(
    "SELECT prompt_id, model, method, replicate, runtime, temperature, "
    "CASE WHEN length(prompt) % 3 = 0 THEN 'RuntimeError: stub judge unavailable' ELSE '' END AS error, "
    "CASE WHEN length(prompt) % 3 = 0 THEN NULL ELSE '' END AS refusal, "
    "false AS truncated, "
    f"CASE length(prompt) % 3 WHEN 1 THEN 'Label: ' || {POS} WHEN 2 THEN 'Label: ' || {NEG} END "
    "AS response FROM owed_text", ["replies_b"], _OUTSTANDING)


@register("generate_replies", _GENERATED)
def q_generate_replies(spark, sf_dir):
    """F1 with a deterministic stub in place of the model."""
    return replies.call_judge(_owed_text(spark, sf_dir), stub_judge)


@register("committed_replies", _GENERATED)
def q_committed_replies(spark, sf_dir):
    """F1 + A6: the owed replies collected in batches into a committed log, by
    a first run over one model and a second one over all that is still owed."""
    log = ReplyLog(spark, scratch_dir(spark, "log"), buckets=2)
    i, work = _owed(spark, sf_dir)
    # Each slice reads the items: written once, with their examples, and not derived each time.
    at = scratch_dir(spark, "items")
    with files_cleared(spark):
        i.write.parquet(at)
    i = spark.read.schema(i.schema).parquet(at)
    examples = prompt_ops.kept_example_maps(i, CFG)

    def ask(records):
        return [_or_error(stub_judge, r) for r in records]

    def attach(part, tasks):
        return prompt_ops.attach_rendered(part, i, CFG, examples, tasks)
    replies.collect_committed(work.where(F.col("model") == MODELS[0]), log, ask, attach=attach)
    replies.collect_committed(work, log, ask, slices=2, attach=attach)
    return log.read().select("prompt_id", "model", "method", "replicate", "runtime", "temperature",
                             "error", "refusal", "truncated", "response")


def _or_error(produce, record):
    try:
        return produce(record)
    except Exception as e:  # noqa: BLE001 - becomes the record's error
        return e


# ---------------------------------------------------------------------------
# Judgements: summaries, reading, classifier scores, severity
# ---------------------------------------------------------------------------

@register("judge_summary", S.with_ctes(
    "SELECT model, method, count(*) AS replies, count(*) FILTER (WHERE NOT parsed) AS unparsed, "
    "count(*) FILTER (WHERE refusal) AS refusals FROM judgements GROUP BY model, method",
    ["judgements"]))
def q_judge_summary(spark, sf_dir):
    return judge.judge_summary(_judged(spark, sf_dir))


@register("refusal_crosstab", S.with_ctes(
    "SELECT direction, count(*) FILTER (WHERE NOT refusal) AS refusal_false, "
    "count(*) FILTER (WHERE refusal) AS refusal_true FROM judgements "
    f"WHERE model = {S.q(ALPHA)} AND method = 'baseline' GROUP BY direction", ["judgements"]))
def q_refusal_crosstab(spark, sf_dir):
    return judge.refusal_crosstab(_judged(spark, sf_dir), model=ALPHA, method="baseline")


@register("inspect_replies", S.with_ctes(
    "SELECT r.prompt_id, r.replicate, p.direction, p.answer, r.response FROM replies r "
    f"JOIN prompts p ON p.prompt_id = r.prompt_id WHERE r.model = {S.q(ALPHA)} "
    "AND r.method = 'baseline' ORDER BY r.prompt_id, r.replicate LIMIT 5", ["replies"]))
def q_inspect_replies(spark, sf_dir):
    return judge.inspect_replies(fx.replies(spark, sf_dir, CFG), fx.prompts(spark, sf_dir, CFG),
                                 model=ALPHA, method="baseline", n=5)


_SCORE = "(((replicate * 37 + length(prompt_id)) % 10) / 10.0)"


@register("refusal_with_score", S.with_ctes(
    S.metrics_select(["model", "method", "shots"], "c"), ["replies", "prompts"], {
        "scored": "SELECT r.prompt_id, r.model, r.replicate, r.method, p.shots, p.direction, "
                  "p.answer, r.observed, r.observed <> '' AS parsed, "
                  f"CASE WHEN {_SCORE.replace('replicate', 'r.replicate').replace('prompt_id', 'r.prompt_id')} "
                  f">= {CFG.refusal_threshold} THEN true ELSE {S.is_refusal('r.response', 'r.observed')} END AS refusal "
                  f"FROM (SELECT *, {S.parse_label('response')} AS observed FROM replies "
                  f"WHERE NOT {S.has_error('error')}) r JOIN prompts p ON r.prompt_id = p.prompt_id",
        "c": f"SELECT model, method, shots, {S.confusion_select('')} FROM scored "
             "GROUP BY model, method, shots"}))
def q_refusal_with_score(spark, sf_dir):
    """F2: a classifier score (here a deterministic stand-in column) decides
    refusals at or above the threshold; the patterns decide below it. The
    judged view then differs from the parsed one."""
    r = fx.replies(spark, sf_dir, CFG).withColumn(
        "refusal_score", ((F.col("replicate") * 37 + F.length("prompt_id")) % 10) / 10.0)
    return metrics.score_replies(r, fx.prompts(spark, sf_dir, CFG), CFG,
                                 group_cols=metrics.GROUP, refusal_score="refusal_score")


@register("severity_recall", S.with_ctes(
    "SELECT j.model, i.grade, count(*) AS n, "
    f"count(*) FILTER (WHERE j.observed = {POS}) AS said_positive, "
    f"count(*) FILTER (WHERE j.observed = {POS}) / count(*) AS share_positive "
    "FROM judgements j JOIN items i ON i.item_id = j.item_id GROUP BY j.model, i.grade",
    ["judgements"]))
def q_severity_recall(spark, sf_dir):
    j = _judged(spark, sf_dir, keep=("item_id",))
    return metrics.severity_recall(j, _items(spark, sf_dir), CFG)


_AGREEMENT = S.with_ctes(
    "SELECT count(*) AS cells, count(*) FILTER (WHERE same) AS agreed, "
    "count(*) FILTER (WHERE same) / count(*) AS agreement FROM ("
    "SELECT prompt_id, model, min(observed) = max(observed) AS same FROM judgements "
    "GROUP BY prompt_id, model) c", ["judgements"])


@register("replicate_agreement", _AGREEMENT)
def q_replicate_agreement(spark, sf_dir):
    # min/max of the label per cell are the same over the collapsed rows.
    return metrics.replicate_agreement(
        metrics.judged_counts(*_log(spark, sf_dir), CFG))


# ---------------------------------------------------------------------------
# Reports (from the scores table)
# ---------------------------------------------------------------------------

def _scores(spark, sf_dir):
    return metrics.score_replies(*_log(spark, sf_dir), CFG)


def _pivot_cols(col: str, value: str, keys: list[str]) -> str:
    return ", ".join(f"max(CASE WHEN {col} = {S.q(k)} THEN {value} END) AS \"{k}\"" for k in keys)


@register("report_headline", S.with_ctes(
    f"SELECT method, shots, {_pivot_cols('model', 'mcc', MODELS)} FROM scores "
    "WHERE direction = 'overall' AND view = 'judged' GROUP BY method, shots",
    ["judgements"], S.scores_ctes()))
def q_report_headline(spark, sf_dir):
    return reports.report_headline(_scores(spark, sf_dir), MODELS)


@register("report_views", S.with_ctes(
    f"SELECT model, {_pivot_cols('view', 'mcc', ['all', 'parsed', 'judged'])} FROM scores "
    "WHERE direction = 'overall' AND method = 'baseline' GROUP BY model",
    ["judgements"], S.scores_ctes()))
def q_report_views(spark, sf_dir):
    return reports.report_views(_scores(spark, sf_dir))


@register("report_directions", S.with_ctes(
    f"SELECT direction, {_pivot_cols('model', 'mcc', MODELS)}, avg(mcc) AS mean_mcc FROM scores "
    "WHERE direction <> 'overall' AND view = 'judged' AND method = 'baseline' GROUP BY direction",
    ["judgements"], S.scores_ctes()))
def q_report_directions(spark, sf_dir):
    return reports.report_directions(_scores(spark, sf_dir), MODELS)


@register("report_methods", S.with_ctes(
    "SELECT label, " + ", ".join(
        f"coalesce(max(CASE WHEN model = {S.q(m)} THEN mcc END), 0.0) AS \"{m}\"" for m in MODELS)
    + " FROM (SELECT *, method || CASE WHEN shots = 0 THEN '' ELSE CAST(shots AS VARCHAR) END "
    "AS label FROM scores WHERE direction = 'overall' AND view = 'judged') s GROUP BY label",
    ["judgements"], S.scores_ctes()))
def q_report_methods(spark, sf_dir):
    return reports.report_methods(_scores(spark, sf_dir), MODELS)


@register("report_shots", S.with_ctes(
    "SELECT model, shots, mcc FROM scores WHERE direction = 'overall' AND view = 'judged' "
    "AND method IN ('baseline', 'fewshot')", ["judgements"], S.scores_ctes()))
def q_report_shots(spark, sf_dir):
    return reports.report_shots(_scores(spark, sf_dir))


@register("model_slugs", S.with_ctes(
    "SELECT model, translate(string_split(model, '/')[-1], ':', '-') AS slug, "
    "replace(replace(translate(string_split(model, '/')[-1], ':', '-'), '-Instruct', ''), "
    "'-4bit', '') AS short FROM (SELECT DISTINCT model FROM replies) m", ["replies"]))
def q_model_slugs(spark, sf_dir):
    m = fx.replies(spark, sf_dir, CFG).select("model").distinct()
    return m.select("model", text.model_slug("model").alias("slug"),
                    text.short_name("model").alias("short"))


# ---------------------------------------------------------------------------
# Data quality
# ---------------------------------------------------------------------------

@register("quality_checks", S.with_ctes(
    "SELECT 'item_id_repeated' AS \"check\", (SELECT count(*) FROM (SELECT item_id FROM items "
    "GROUP BY item_id HAVING count(*) > 1)) AS failures "
    "UNION ALL SELECT 'prompt_id_repeated', (SELECT count(*) FROM (SELECT prompt_id FROM rendered "
    "GROUP BY prompt_id HAVING count(*) > 1)) "
    "UNION ALL SELECT 'item_without_source', (SELECT count(*) FROM items WHERE coalesce(source_text, '') = '') "
    "UNION ALL SELECT 'item_without_translation', (SELECT count(*) FROM items WHERE coalesce(target_text, '') = '') "
    "UNION ALL SELECT 'prompt_rendered_empty', (SELECT count(*) FROM rendered WHERE coalesce(prompt, '') = '') "
    "UNION ALL SELECT 'prompt_with_unknown_item', (SELECT count(DISTINCT item_id) FROM rendered r "
    "WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.item_id = r.item_id)) "
    "UNION ALL SELECT 'method_without_answer_format', (SELECT count(*) FROM (SELECT method FROM rendered "
    "GROUP BY method HAVING NOT bool_and(contains(prompt, 'Label:')))) "
    "UNION ALL SELECT 'direction_listed_twice', (SELECT count(*) FROM (SELECT s, t FROM (VALUES "
    + S.directions_values(CFG) + ") d(s, t) GROUP BY s, t HAVING count(*) > 1)) "
    "UNION ALL SELECT 'grade_both_ways', CAST(" + str(int(CFG.negative_grade in CFG.positive_grades))
    + " AS BIGINT) UNION ALL SELECT 'method_without_cap_or_shots', CAST(0 AS BIGINT)",
    ["prompts"], RENDER))
def q_quality_checks(spark, sf_dir):
    i = _items(spark, sf_dir)
    return quality.quality_checks(i, prompt_ops.build_prompts(i, CFG), CFG)


# ---------------------------------------------------------------------------
# Streaming (run to completion with an availableNow trigger, then read back)
# ---------------------------------------------------------------------------

def _write_log(spark, sf_dir, root):
    log = f"{root}/log"
    (fx.replies(spark, sf_dir, CFG)
     .write.mode("overwrite").json(log))
    return log


def _write_prompt_keys(spark, sf_dir, root):
    """The static side of the stream join, derived once and not per batch."""
    path = tables.write_table(fx.prompts(spark, sf_dir, CFG), f"{root}/prompts")
    return spark.read.parquet(path)


@register("log_quarantine", S.with_ctes(
    "SELECT CASE WHEN b = 0 THEN 'not JSON' WHEN b = 1 THEN 'wrong type' WHEN b = 2 THEN 'no key' ELSE 'read' END AS reason, "
    "count(*) AS lines FROM replies_b GROUP BY 1", ["replies_b"]))
def q_log_quarantine(spark, sf_dir):
    """A3: the reply log as JSON lines, some cut short, some with a value of
    the wrong type, some without a key; what is read and what is set aside."""
    root = scratch_dir(spark, "damaged-log")
    r = fx.replies(spark, sf_dir, CFG, keep_selector=True).drop("item_id", "shots")
    line = F.to_json(F.struct(*[c for c in r.columns if c != "b"]))
    spoiled = (F.when(F.col("b") == 0, F.left(line, F.length(line) - 5))
               .when(F.col("b") == 1, F.regexp_replace(line, '"replicate":', '"replicate":"x","was":'))
               .when(F.col("b") == 2, F.regexp_replace(line, '"model":', '"molde":')).otherwise(line))
    r.select(spoiled.alias("value")).write.text(f"{root}/log")
    good, damaged = tables.read_log_lines(spark, f"{root}/log")
    tables.quarantine(damaged, f"{root}/quarantine")
    set_aside = spark.read.schema(damaged.schema).parquet(f"{root}/quarantine").select("reason")
    return good.select(F.lit("read").alias("reason")).unionAll(set_aside).groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


@register("stream_judgements", S.with_ctes(
    "SELECT prompt_id, model, replicate, method, shots, direction, answer, observed, "
    "parsed, refusal FROM judgements", ["judgements"]))
def q_stream_judgements(spark, sf_dir):
    """The reply log as a file stream, one file per micro-batch."""
    root = scratch_dir(spark, "stream-judgements")
    log = _write_log(spark, sf_dir, root)
    q = streaming.stream_judgements(spark, log, _write_prompt_keys(spark, sf_dir, root), CFG,
                                    f"{root}/judgements", f"{root}/checkpoint",
                                    max_files_per_trigger=1)
    q.awaitTermination()
    return spark.read.parquet(f"{root}/judgements")


@register("stream_counts", S.with_ctes(
    f"SELECT model, method, shots, direction, {S.confusion_select('')} FROM judgements "
    "GROUP BY model, method, shots, direction", ["judgements"]))
def q_stream_counts(spark, sf_dir):
    """Running confusion counts kept as streaming state across batches."""
    root = scratch_dir(spark, "stream-counts")
    log = _write_log(spark, sf_dir, root)
    q = streaming.stream_counts(spark, log, _write_prompt_keys(spark, sf_dir, root), CFG,
                                f"{root}/counts", f"{root}/checkpoint",
                                max_files_per_trigger=1)
    q.awaitTermination()
    return streaming.Published(spark, f"{root}/counts").read()


@register("stream_agreement", _AGREEMENT)
def q_stream_agreement(spark, sf_dir):
    """M6 on the stream: cells finished one by one as their replies come in."""
    root = scratch_dir(spark, "stream-agreement")
    log = _write_log(spark, sf_dir, root)
    q = streaming.stream_agreement(spark, log, CFG, f"{root}/cells", f"{root}/checkpoint")
    q.awaitTermination()
    return streaming.agreement_from_cells(spark.read.parquet(f"{root}/cells"))


def queries() -> dict[str, Builder]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
