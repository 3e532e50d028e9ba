"""Prompts -> owed replies -> calls -> the reply log.

The owed list is a generator over the prompts (one row per prompt, model and
replicate; keys only, no prompt text); what is owed minus what the log holds is
an anti-join on typed keys; the prompt text is attached only to what is still
owed. Calling a judge is the one place Python runs per row: a caller-supplied
function inside ``mapInPandas``, one failure recorded per row.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..config import Settings
from ..dimensions import literal
from ..functions import ids, labels, payloads, templates, text
from ..schemas import WORK_KEYS
from ..sources.reply_log import ReplyLog


def _lookup(mapping: dict, key: F.Column, default=None) -> F.Column:
    m = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    v = F.try_element_at(m, key)
    return v if default is None else F.coalesce(v, F.lit(default))


def answer_budget(method: F.Column, model: F.Column, settings: Settings) -> F.Column:
    """The method's token cap plus the model's reasoning headroom (0 when
    it has none). A method without a cap fails the job: no call goes uncapped."""
    caps = {m.name: int(m.max_tokens) for m in settings.methods}
    room = {m.id: int(m.reasoning_headroom) for m in settings.models}
    unknown = F.raise_error(F.concat(F.coalesce(method, F.lit("null")), F.lit(" has no token cap")))
    return F.coalesce(_lookup(caps, method), unknown.cast("int")) + _lookup(room, model, 0)


def wanted_replies(prompts: DataFrame, settings: Settings, models: list[str] | None = None,
                   method: str | None = None, replicates: int | None = None,
                   temperature: float | None = None) -> DataFrame:
    """Every reply owed: prompts x models x replicate 1..n, key columns
    only. ``method`` renames the method of the owed rows (a review round owes
    'debate' replies on baseline prompt ids)."""
    panel = [settings.model(m) for m in models] if models else list(settings.models)
    reps = replicates or settings.replicates
    temp = settings.temperature if temperature is None else temperature
    arr = ", ".join(f"named_struct('model', {literal(m.id)}, 'runtime', {literal(m.runtime)})" for m in panel)
    meth = literal(method) if method else "method"
    per_model = prompts.selectExpr("prompt_id", f"{meth} AS method", f"explode(array({arr})) AS _p")
    rows = per_model.selectExpr("prompt_id", "method", "_p.model AS model", "_p.runtime AS runtime",
                                f"explode(sequence(1, {int(reps)})) AS replicate")
    return rows.select(
        *map(F.expr, ("prompt_id", "model", "method", "replicate", "runtime", f"CAST({float(temp)} AS DOUBLE) AS temperature")),
        answer_budget(F.col("method"), F.col("model"), settings).alias("max_tokens"))


def outstanding(wanted: DataFrame, collected: DataFrame, retry_failed: bool = False,
                keys: list[str] = WORK_KEYS) -> DataFrame:
    """Owed minus collected on (model, method, prompt_id, replicate).

    By default a logged failure counts as collected (it is in the log);
    ``retry_failed`` owes it again. The log grows with the run, and the planner's
    size of rows made by ``explode`` leaves out how many it makes, so the keys
    are merged and never sent whole through the driver by a broadcast."""
    have = collected
    if retry_failed:
        have = have.filter(~labels.has_error("error"))
    return wanted.join(have.select(*keys).hint("merge"), keys, "left_anti")


def attach_prompts(work: DataFrame, prompts: DataFrame) -> DataFrame:
    """The prompt text, for what is still owed only. Both sides grow with
    the items: merged, not broadcast (see ``outstanding``)."""
    return work.join(prompts.select("prompt_id", "prompt").hint("merge"), "prompt_id")


def request_bodies(work: DataFrame, settings: Settings) -> DataFrame:
    """The request body of each owed call. Sampling fields are sent only
    to models that take them."""
    takes = {m.id: m.takes_sampling for m in settings.models}
    body = payloads.request_body(
        F.col("model"), F.col("max_tokens"), F.col("prompt"),
        _lookup(takes, F.col("model"), True), F.col("temperature"),
        F.lit(float(settings.top_p)))
    return work.select(*WORK_KEYS, body.alias("body"))


def read_responses(bodies: DataFrame) -> DataFrame:
    """P19 + P20: reply text and token usage out of raw response bodies; a
    body that is not JSON becomes an error row with no reply."""
    staged = bodies.select(*[c for c in bodies.columns if c != "body"], "body",
                           payloads.parse_body("body").alias("_b"))
    e = payloads.body_error("body", F.col("_b"))
    ok = e == ""
    return staged.select(
        *[c for c in bodies.columns if c != "body"],
        F.when(ok, payloads.reply_text("_b")).otherwise(F.lit("")).alias("reply"),
        F.when(ok, payloads.usage_tokens("_b", "prompt_tokens")).otherwise(F.lit(0).cast("long"))
        .alias("prompt_tokens"),
        F.when(ok, payloads.usage_tokens("_b", "completion_tokens"))
        .otherwise(F.lit(0).cast("long")).alias("completion_tokens"),
        e.alias("error"))


def token_usage(responses: DataFrame) -> DataFrame:
    """Calls and tokens per model, successful calls only. They are told
    apart inside the aggregate: a filter before it would be pushed below the
    reading of the bodies and read each of them again."""
    ok = F.col("error") == ""
    return responses.groupBy("model").agg(
        F.count_if(ok).alias("calls"),
        F.sum(F.when(ok, F.col("prompt_tokens"))).alias("input_tokens"),
        F.sum(F.when(ok, F.col("completion_tokens"))).alias("output_tokens")).filter(F.col("calls") > 0)


def pass_cost(prompts: DataFrame, settings: Settings) -> DataFrame:
    """Prompts x replicates = calls, for each model of the panel. The
    count is one aggregate; the panel is a literal list exploded on it."""
    n = prompts.filter(F.col("method") != settings.review_method).agg(
        F.count(F.lit(1)).alias("prompts"))
    arr = F.array(*[F.lit(m.id) for m in settings.models])
    return n.select(F.explode(arr).alias("model"), "prompts",
                    F.lit(settings.replicates).alias("replicates"),
                    (F.col("prompts") * settings.replicates).alias("calls"))


def completeness(wanted: DataFrame, collected: DataFrame) -> DataFrame:
    """Owed vs collected counts per (model, method), and whether they
    agree. Both sides are aggregated first; the join is of small rows."""
    w = wanted.groupBy("model", "method").agg(F.count(F.lit(1)).alias("wanted"))
    c = collected.groupBy("model", "method").agg(F.count(F.lit(1)).alias("collected"))
    j = w.join(c, ["model", "method"], "full_outer")
    return j.select("model", "method",
                    F.coalesce("wanted", F.lit(0).cast("long")).alias("wanted"),
                    F.coalesce("collected", F.lit(0).cast("long")).alias("collected"),
                    (F.coalesce("wanted", F.lit(0)) == F.coalesce("collected", F.lit(0)))
                    .alias("ok"))


def reply_coverage(replies: DataFrame) -> DataFrame:
    """Replies, truncated and errored per (model, method)."""
    return replies.groupBy("model", "method").agg(
        F.count(F.lit(1)).alias("replies"),
        F.count_if(F.coalesce(F.col("truncated"), F.lit(False))).alias("truncated"),
        F.count_if(labels.has_error("error")).alias("errored"))


def review_prompts(prompts: DataFrame, items: DataFrame, first_round: DataFrame,
                   settings: Settings, model: str, reviewer: str,
                   collected: DataFrame | None = None, order_col: str | None = None,
                   base_method: str = "baseline") -> DataFrame:
    """J5 + P21: the review round. ``model`` reads ``reviewer``'s first-round
    reply to the same baseline prompt and replicate and judges again.

    Owed review replies (baseline prompt ids, method 'debate') minus those
    collected, inner-joined to the reviewer's usable first-round replies, then
    to the prompt's item for the texts. The reviewer's label is the last line
    of its stripped reply, its reasoning the whole stripped reply. When
    ``order_col`` is given, a repeated (prompt, replicate) keeps its latest
    reply."""
    base = prompts.filter(F.col("method") == base_method)
    owed = wanted_replies(base, settings, models=[model], method=settings.review_method)
    if collected is not None:
        owed = outstanding(owed, collected)
    first = first_round.filter((F.col("model") == reviewer) & (F.col("method") == base_method)
                               & ~labels.has_error("error") & F.col("response").isNotNull())
    if order_col:
        first = first.groupBy("prompt_id", "replicate").agg(
            F.max_by("response", order_col).alias("response"))
    else:
        first = first.select("prompt_id", "replicate", "response")
    joined = (owed.join(first, ["prompt_id", "replicate"])
              .join(base.select("prompt_id", "item_id"), "prompt_id")
              .join(items.select("item_id", "source_language", "target_language",
                                 "source_text", "target_text"), "item_id"))
    names = settings.language_names()
    fields = {
        "source": ids.language_name("source_language", names),
        "target": ids.language_name("target_language", names),
        "source_text": F.col("source_text"), "target_text": F.col("target_text"),
        "other_label": text.last_line("response"),
        "other_reasoning": text.clean_or_empty("response"),
        "examples": F.lit(""),
    }
    return joined.select(*WORK_KEYS, "max_tokens",
                         text.last_line("response").alias("other_label"),
                         templates.render(templates.TEMPLATES[settings.review_method], fields)
                         .alias("prompt"))


# ---------------------------------------------------------------------------
# calling the judge
# ---------------------------------------------------------------------------

REPLY_OUT = schemas.REPLIES


Ask = Callable[[list[dict]], list]
#: Rows of replies that a task hands on at a time.
FRAME_ROWS = 1000


def settle(ask: Ask, group: list[dict]) -> list[tuple[str | None, str]]:
    """(reply, error) of every record of a group. A reply that is an exception
    is that record's failure. If the whole call fails, its halves are asked
    anew down to single records, so one bad record costs no other its reply."""
    try:
        replies = list(ask(group))
        if len(replies) != len(group):
            raise ValueError(f"{len(replies)} replies to {len(group)} records")
    except Exception as e:  # noqa: BLE001 - recorded with the record
        replies = [e]
        if len(group) > 1:
            half = len(group) // 2
            return settle(ask, group[:half]) + settle(ask, group[half:])
    return [(None, f"{type(r).__name__}: {r}") if isinstance(r, BaseException) else (r, "" if r is not None else "no reply")
            for r in replies]


def in_order(ask: Ask, groups: Iterator[list[dict]], in_flight: int) -> Iterator[tuple[list[dict], list]]:
    """Groups with their settled replies, in order, with at most ``in_flight``
    of them asked at a time."""
    if in_flight < 2:
        for g in groups:
            yield g, settle(ask, g)
        return
    with ThreadPoolExecutor(in_flight) as threads:
        waiting: deque = deque()
        for g in groups:
            waiting.append((g, threads.submit(settle, ask, g)))
            if len(waiting) >= in_flight:
                first, answer = waiting.popleft()
                yield first, answer.result()
        for g, answer in waiting:
            yield g, answer.result()


def call_judge_batches(work: DataFrame, ask: Ask, size: int = 32, in_flight: int = 1,
                       system: str = templates.SYSTEM) -> DataFrame:
    """F1 in batches: ``ask(records) -> replies`` gets up to ``size`` owed
    records at a time, ``in_flight`` such calls at once in each task, and gives
    a reply, or an exception in its place, for each. A record carries the work
    keys, the prompt, ``messages`` and ``max_tokens``. Failures are kept per
    row as 'Type: message' without a reply; the pass goes on. Spark may re-run
    a task, so consumers de-duplicate on the reply key."""
    names = REPLY_OUT.fieldNames()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def groups() -> Iterator[list[dict]]:
            held: list[dict] = []
            for frame in frames:
                for rec in frame.to_dict("records"):
                    rec["messages"] = [dict(role="system", content=system), dict(role="user", content=rec.get("prompt") or "")]
                    held.append(rec)
                    if len(held) == size:
                        yield held
                        held = []
            if held:
                yield held

        def table(asked: list[dict], answers: list) -> pd.DataFrame:
            rows = pd.DataFrame(asked, columns=names)
            rows["response"] = pd.Series([r for r, _ in answers], dtype=object)
            rows["error"] = [e for _, e in answers]
            rows["refusal"] = pd.Series([None if e else "" for _, e in answers], dtype=object)
            # A failed call has no reply, so it was not cut off.
            rows["truncated"] = [not e and "Label:" not in r for r, e in answers]
            return rows

        # Calls of few records share a frame: one for each would cost more than the call's rows.
        done: tuple[list[dict], list] = [], []
        for asked, answers in in_order(ask, groups(), in_flight):
            done[0].extend({k: rec.get(k) for k in names} for rec in asked)
            done[1].extend(answers)
            if len(done[0]) >= FRAME_ROWS:
                yield table(*done)
                done = [], []
        if done[0]:
            yield table(*done)

    needed = [c for c in ("prompt_id", "model", "method", "replicate", "runtime",
                          "temperature", "max_tokens", "prompt") if c in work.columns]
    return work.select(*needed).mapInPandas(run, REPLY_OUT)


def call_judge(work: DataFrame, produce: Callable[[dict], str],
               system: str = templates.SYSTEM, workers: int = 1) -> DataFrame:
    """``produce(record) -> reply text`` over the owed rows, one record a
    call and ``workers`` calls in flight per task (they wait on the network,
    not the CPU)."""
    return call_judge_batches(work, lambda records: [produce(r) for r in records], 1, workers, system)


def call_judge_partitions(work: DataFrame,
                          answer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
                          ) -> DataFrame:
    """F1 with a partition function, for batched inference: ``answer`` gets the
    owed rows of a partition as frames and yields frames with the work keys,
    ``response`` (None where a call failed) and, optionally, ``error``. It may
    cut its batches as it likes; runtime and temperature come back by the work
    keys it returns."""
    cols = [f.name for f in REPLY_OUT.fields]

    def run(batches):
        for pdf in answer(batches):
            pdf = pdf.copy()
            failed = pdf["response"].isna()
            pdf["response"] = pdf["response"].astype(object).where(~failed, None)
            if "error" not in pdf:
                pdf["error"] = ""
            pdf["error"] = pdf["error"].fillna("").mask(failed & (pdf["error"].fillna("") == ""), "no reply")
            pdf["refusal"] = pd.Series("", index=pdf.index, dtype=object).where(~failed, None)
            pdf["truncated"] = [r is not None and "Label:" not in r for r in pdf["response"]]
            for c in ("runtime", "temperature"):
                if c not in pdf:
                    pdf[c] = None
            yield pdf[cols]

    return work.mapInPandas(run, REPLY_OUT)


def collect_replies(work: DataFrame, produce: Callable[[dict], str], log_path: str,
                    buckets: int = 16, retry_failed: bool = False, workers: int = 1,
                    staging: str | None = None, tasks: int | None = None,
                    owed: bool = False) -> int:
    """F1 + A6, durable: what is still owed is computed once, in one read of
    the log (not at all if ``owed`` says that ``work`` holds just that), and
    written to the shared folder in ``buckets`` hash buckets of the reply key;
    each bucket is then one appending job that reads only its own partition. A
    failure loses at most one bucket's calls and a rerun owes only what no
    committed bucket holds. Each bucket's calls are spread over ``tasks``
    partitions by the reply key (default: the cluster's parallelism, as calls
    take time whatever their bytes). Returns the number of buckets written."""
    from ..session import parallelism, scratch_dir
    from ..sources import tables
    spark = work.sparkSession
    staging = staging or scratch_dir(spark, "owed")
    if not owed:
        work = outstanding(work, tables.read_replies(spark, log_path), retry_failed)
    staged = work.withColumn("_bucket", F.pmod(F.xxhash64(*WORK_KEYS), F.lit(buckets)))
    staged.write.mode("overwrite").partitionBy("_bucket").parquet(staging)
    # The schema is known: an empty owed list writes no file to infer from.
    todo = spark.read.schema(staged.schema).parquet(staging)
    # At most one row per bucket: which of them hold work.
    filled = [r[0] for r in todo.select("_bucket").distinct().orderBy("_bucket").collect()]
    for b in filled:
        spread = todo.filter(F.col("_bucket") == b).drop("_bucket").repartition(
            tasks or parallelism(spark), *WORK_KEYS)
        tables.append_replies(call_judge(spread, produce, workers=workers), log_path)
    return len(filled)


#: Attaches the prompts to owed rows: (rows without prompts, tasks to deal them to) -> rows with prompts.
Attach = Callable[[DataFrame, int], DataFrame]


def collect_committed(work: DataFrame, log: ReplyLog, ask: Ask, size: int = 32, in_flight: int = 1,
                      slices: int = 1, retry_failed: bool = False, tasks: int | None = None,
                      attach: Attach | None = None) -> int:
    """F1 + A6 + J3, exactly once: what of ``work`` the log's index does not
    hold is written to the shared folder by bucket and slice, and each slice is
    asked in batches by one job and committed. A run that ends early keeps
    every committed slice and owes the rest, within a bucket, too; whatever a
    killed job wrote stays invisible; a second writer doubles nothing. Records
    that fail are logged with their error. Returns the replies committed.

    ``work`` carries its prompts, or ``attach`` adds them: then keys alone are
    looked up, written and dealt out, and a slice's prompts are made while it
    is asked. Of several slices' shuffle files one slice's lie on disk."""
    from ..session import files_cleared, parallelism, scratch_dir
    spark = work.sparkSession
    tasks = tasks or parallelism(spark)
    attach = attach or (lambda part, n: part.repartition(n, *WORK_KEYS))
    commits = log.commits()
    since = {b: cs[-1]["version"] for b, cs in commits.items()}
    todo_at = scratch_dir(spark, "owed")
    with files_cleared(spark):
        todo = log.outstanding(work, retry_failed, commits).withColumns({
            "_bucket": log.bucket_of("prompt_id"),
            "_slice": F.pmod(F.xxhash64(F.lit("slice"), *WORK_KEYS), F.lit(slices)).cast("int")})
        todo.write.partitionBy("_bucket", "_slice").parquet(todo_at)
        todo = spark.read.schema(todo.schema).parquet(todo_at)
        units = todo.select("_bucket", "_slice").distinct().orderBy("_bucket", "_slice").collect()  # at most buckets x slices
        done = 0
        for u in units:
            part = todo.where((F.col("_bucket") == u["_bucket"]) & (F.col("_slice") == u["_slice"])).drop("_bucket", "_slice")
            done += log.append(call_judge_batches(attach(part, tasks), ask, size, in_flight), u["_bucket"], since.get(u["_bucket"], 0))
            since[u["_bucket"]] = log.version(u["_bucket"])
    return done
