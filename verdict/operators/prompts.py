"""Items -> prompts: method expansion, worked examples, rendering, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..config import Settings
from ..dimensions import literal
from ..functions import ids, templates, text
from ..session import files_cleared, scratch_dir


def prompt_spec(items: DataFrame, settings: Settings, keep: tuple[str, ...] = ()) -> DataFrame:
    """G2 + P6: one row per item per (method, shots), review method excluded.

    The (method, shots) list comes from the settings and is exploded per item:
    a generator, no join."""
    methods = ", ".join(f"named_struct('method', {literal(m)}, 'shots', {int(s)})" for m, s in settings.prompt_methods())
    expanded = items.selectExpr("*", f"explode(array({methods})) AS _m")
    return expanded.select(
        ids.prompt_id("item_id", "_m.method", "_m.shots").alias("prompt_id"),
        F.expr("item_id"), F.expr("_m.method AS method"), F.expr("_m.shots AS shots"),
        F.expr("direction"), F.expr("answer"), *keep)


def _shot_values(settings: Settings) -> list[int]:
    return sorted({s for _, s in settings.prompt_methods() if s})


_EXAMPLE_FIELDS = ("item_id", "answer", "source_language", "target_language",
                   "source_text", "target_text")


#: Drawn rows that may be broadcast: keys of about 100 bytes each.
MAX_DRAWN = 1_000_000


def _draw(items: DataFrame, settings: Settings) -> DataFrame:
    """W3 core: (direction, shots, slot, item_id), one row per filled slot.

    Slot k takes the positive label when k is even, the negative when odd, and
    is an independent draw with replacement: the item of that label with the
    smallest ``md5(seed|direction|shots|slot|id)``. Only ids, directions and
    labels are read; each is exploded into the shot counts the settings use,
    and every slot is a conditional ``min(struct(hash, id))`` in one
    aggregation: decomposable, so the partial aggregate leaves one row per
    group per task before the shuffle. A slot whose label has no item is
    absent."""
    shot_values = _shot_values(settings)
    y = F.col("answer") == F.lit(settings.positive_label)
    # Every direction the items hold takes examples, configured or not.
    exploded = items.select("item_id", "answer", "direction",
                            F.explode(F.array(*[F.lit(int(s)) for s in shot_values]))
                            .alias("shots"))
    slots = []
    for k in range(max(shot_values, default=0)):
        h = F.md5(F.concat_ws("|", F.lit(str(settings.example_seed)), F.col("direction"),
                              F.col("shots").cast("string"), F.lit(str(k)),
                              F.col("item_id").cast("string")))
        fits = (F.lit(k) < F.col("shots")) & (y == F.lit(k % 2 == 0))
        slots.append(F.min(F.when(fits, F.struct(h.alias("h"), "item_id"))).alias(f"_s{k}"))
    drawn = exploded.groupBy("direction", "shots").agg(*slots)
    rows = drawn.select("direction", "shots", F.posexplode(
        F.array(*[F.col(f"_s{k}") for k in range(len(slots))])).alias("slot", "_b"))
    return rows.filter(F.col("_b").isNotNull()).select("direction", "shots", "slot", "_b.item_id")


def draw_examples(items: DataFrame, settings: Settings) -> DataFrame:
    """The worked examples, one row per (direction, shots, slot).

    The texts of the drawn items come by a broadcast of the drawn keys, so no
    text is sorted or shuffled. Their number is checked while the query runs;
    beyond ``MAX_DRAWN`` it fails and asks for one call per part of the
    directions, which gives the same draws. Of items that repeat an id the
    least row is shown."""
    drawn = _draw(items, settings)
    fits = drawn.agg(F.count(F.lit(1))).scalar() <= F.lit(MAX_DRAWN)
    checked = drawn.filter(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit(
        f"more than {MAX_DRAWN} drawn examples: build prompts for some directions at a time")).cast("boolean")))
    keys = checked.select("shots", "slot", F.col("direction").alias("_dir"), F.col("item_id").alias("_id"))
    y = F.col("answer") == F.lit(settings.positive_label)
    found = items.select(*_EXAMPLE_FIELDS, "direction").join(
        F.broadcast(keys), (F.col("direction") == F.col("_dir")) & F.col("item_id").eqNullSafe(F.col("_id"))
        & (y == (F.col("slot") % 2 == 0)))
    one = found.groupBy("direction", "shots", "slot").agg(F.min(F.struct(*_EXAMPLE_FIELDS)).alias("_b"))
    return one.select("direction", "shots", "slot", "_b.*")


def example_sets(items: DataFrame, settings: Settings) -> DataFrame:
    """P15 input: per (direction, shots) the slot-ordered array of rendered
    examples. At most (directions x shot values) rows of at most max(shots)
    entries each."""
    names = settings.language_names()
    rendered = templates.render(templates.EXAMPLE, {
        "source": ids.language_name_sql("source_language", names),
        "target": ids.language_name_sql("target_language", names),
        "source_text": "source_text", "target_text": "target_text", "answer": "answer"})
    return draw_examples(items, settings).groupBy("direction", "shots").agg(
        F.sort_array(F.collect_list(F.struct("slot", "item_id", rendered.alias("text")))).alias("examples"))


def _rendered(method: Column, settings: Settings) -> Column:
    """P14 of a row that holds an item's texts and its examples as ``_shown``."""
    names = settings.language_names()
    return templates.render_by_method(method, {
        "source": ids.language_name_sql("source_language", names),
        "target": ids.language_name_sql("target_language", names),
        "source_text": "source_text", "target_text": "target_text",
        "examples": "array_join(transform(_shown, e -> e.text), '')",
        "other_label": "''", "other_reasoning": "''",
    })


def build_prompts(items: DataFrame, settings: Settings,
                  methods: list[str] | None = None) -> DataFrame:
    """G2 + J4 + P14 + P15: the prompt table, with the rendered text and the
    number of examples actually shown (an item drawn as its own example is
    left out of its prompt, so few-shot prompts may show fewer). Examples are
    drawn from the items given (sample first, then draw)."""
    sets = example_sets(items, settings)
    spec = prompt_spec(items, settings, keep=("source_language", "target_language",
                                              "source_text", "target_text"))
    if methods:
        spec = spec.filter(F.col("method").isin(methods))
    # The example table has a row per direction and shot value. Its texts
    # have no proven size, so the planner decides by what it measures: a
    # broadcast while small, else a shuffle join that splits skewed directions.
    joined = spec.join(sets, ["direction", "shots"], "left")
    shown = F.expr("filter(coalesce(examples, array()), e -> e.item_id <> item_id)")
    return (joined.withColumn("_shown", shown)
            .select("prompt_id", "item_id", "method", "shots", "direction", "answer",
                    _rendered(F.col("method"), settings).alias("prompt"),
                    F.size("_shown").alias("examples_shown")))


#: Characters of examples that are sent to every executor.
MAX_SENT = 8 * 1024 * 1024


def example_maps(items: DataFrame, settings: Settings) -> DataFrame:
    """``example_sets`` by direction: a map from shots to the examples."""
    return example_sets(items, settings).groupBy(F.col("direction").alias("_direction")).agg(
        F.map_from_entries(F.collect_list(F.struct("shots", "examples"))).alias("_sets"))


def kept_example_maps(items: DataFrame, settings: Settings) -> DataFrame:
    """``example_maps`` drawn once and written to the shared folder, so that
    their size is known before a plan is made: up to ``MAX_SENT`` characters
    they are broadcast and the items stay where they lie, else the planner
    joins them."""
    spark = items.sparkSession
    at = scratch_dir(spark, "examples")
    maps = example_maps(items, settings)
    with files_cleared(spark):
        maps.write.parquet(at)
    kept = spark.read.schema(maps.schema).parquet(at)
    chars = kept.select(F.explode(F.flatten(F.map_values("_sets"))).alias("e")).agg(F.sum(F.length("e.text"))).first()[0]
    return F.broadcast(kept) if (chars or 0) <= MAX_SENT else kept


def attach_rendered(work: DataFrame, items: DataFrame, settings: Settings,
                    examples: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """J6 over ``build_prompts`` of the items: every row of ``work`` (keys with
    a ``prompt_id``, no text) once for each prompt of its id, with the text.

    A prompt repeats its item's texts, and a few-shot prompt whole other items,
    so no prompt is shuffled, sorted or written: an id names its item and kind
    (``ids.prompt_id`` read backwards), the owed rows are gathered by item, and
    each item's texts meet them once. Prompts are rendered after the last
    exchange. ``examples`` are the items' ``example_maps`` where the caller
    keeps them; ``tasks`` fixes the number of tasks the items are dealt to (it
    holds while the examples are broadcast)."""
    examples = example_maps(items, settings) if examples is None else examples
    kinds = ", ".join(f"named_struct('method', {literal(m)}, 'shots', {int(s)}, 'suffix', {literal(ids.prompt_suffix(m, s))})"
                      for m, s in settings.prompt_methods())
    # An id may end like several kinds (methods 'a' and 'b-a'): each names another item.
    named = work.select(F.struct(*work.columns).alias("_work"), "prompt_id", F.expr(
        f"explode(filter(array({kinds}), k -> endswith(prompt_id, k.suffix))) AS _kind"))
    item = F.expr("left(prompt_id, length(prompt_id) - length(_kind.suffix))")
    # Ids that are whole numbers are joined as such: the items may lie by them already.
    kind = items.schema["item_id"].dataType
    whole = isinstance(kind, IntegralType)
    named = named.select("_work", "_kind.method", "_kind.shots", item.alias("_text"), (item.try_cast(kind) if whole else item).alias("_item"))
    if whole:
        named = named.filter(F.col("_item").cast("string") == F.col("_text"))
    own = items.select("item_id", "direction", "source_language", "target_language", "source_text", "target_text",
                       (F.col("item_id") if whole else F.col("item_id").cast("string")).alias("_id"))
    if tasks:
        named, own = named.repartition(tasks, "_item"), own.repartition(tasks, "_id")
    owed = named.groupBy("_item").agg(F.collect_list(F.struct("_work", "method", "shots")).alias("_owed"))
    texts = own.join(owed.hint("merge"), F.col("_id") == F.col("_item"))
    # J4 as in ``build_prompts``, but once an item and not once a prompt.
    rows = (texts.join(examples, F.col("direction") == F.col("_direction"), "left")
            .select("item_id", "source_language", "target_language", "source_text", "target_text", "_sets",
                    F.explode("_owed").alias("_o"))
            .withColumn("_shown", F.expr("filter(coalesce(try_element_at(_sets, _o.shots), array()), e -> e.item_id <> item_id)")))
    return rows.select(*[F.col(f"_o._work.{c}").alias(c) for c in work.columns],
                       _rendered(F.col("_o.method"), settings).alias("prompt"))


def prompt_counts(prompts: DataFrame) -> DataFrame:
    """M9 + M10: prompts per (method, shots), and per method."""
    per = prompts.groupBy("method", "shots").agg(F.count(F.lit(1)).alias("prompts"))
    return per.withColumn("method_prompts",
                          F.sum("prompts").over(Window.partitionBy("method")))


def prompt_lengths(prompts: DataFrame, approx_accuracy: int | None = None) -> DataFrame:
    """M12 + P22: mean, median and max words per method, the first two
    rounded half-even to whole words. The median is exact (interpolated) by
    default; its buffer holds one count per distinct length. Pass
    ``approx_accuracy`` for a bounded-memory quantile sketch instead."""
    w = text.word_count("prompt").cast("long")
    median = (F.percentile(F.col("_w"), F.lit(0.5)) if approx_accuracy is None
              else F.percentile_approx(F.col("_w"), 0.5, approx_accuracy).cast("double"))
    return (prompts.select("method", w.alias("_w")).groupBy("method")
            .agg(F.bround(F.avg("_w"), 0).alias("mean_words"),
                 F.bround(median, 0).alias("median_words"),
                 F.max("_w").alias("max_words")))


#: Size of a length sketch: the median's rank is off by 0.9 % at most, 99 times of 100.
SKETCH_K = 400


def length_state(prompts: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """M12 as a state to keep beside a part of the prompts: per method the
    number, the words in all, the longest, and a quantile sketch of bounded
    size (some kilobytes) in which any number of prompts fits."""
    return (prompts.select("method", text.word_count("prompt").cast("long").alias("_w")).groupBy("method")
            .agg(F.count(F.lit(1)).alias("prompts"), F.sum("_w").alias("words"), F.max("_w").alias("longest"),
                 F.kll_sketch_agg_bigint("_w", F.lit(k)).alias("sketch")))


def merge_length_states(states: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """One state for all parts, from the rows of their states."""
    return states.groupBy("method").agg(
        F.sum("prompts").alias("prompts"), F.sum("words").alias("words"), F.max("longest").alias("longest"),
        F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"))


def lengths_from_state(state: DataFrame) -> DataFrame:
    """The profile of ``prompt_lengths``: mean and longest exact, the median
    from the sketch."""
    return state.select(
        "method", F.bround(F.col("words") / F.col("prompts"), 0).alias("mean_words"),
        F.kll_sketch_get_quantile_bigint("sketch", F.lit(0.5)).cast("double").alias("median_words"),
        F.col("longest").alias("max_words"))


def first_per_method(prompts: DataFrame) -> DataFrame:
    """The first prompt of each method, in table order (shots, then item).
    The first is found on keys alone; its text comes by a broadcast of those
    keys, one per method of the settings."""
    keys = ["shots", "item_id", "prompt_id"]
    first = prompts.groupBy("method").agg(F.min(F.struct(*keys)).alias("_k"))
    first = first.select("method", "_k.*")
    rows = prompts.join(F.broadcast(first), ["method", *keys])
    one = rows.groupBy("method").agg(F.min(F.struct("prompt_id", "shots", "answer", "prompt")).alias("_r"))
    return one.select("method", "_r.*")


def inspect_prompt(prompts: DataFrame, items: DataFrame, method: str | None = None,
                   prompt_id: str | None = None) -> DataFrame:
    """One prompt chosen by method and/or id, with its item's grade."""
    chosen = prompts
    if method:
        chosen = chosen.filter(F.col("method") == method)
    if prompt_id:
        chosen = chosen.filter(F.col("prompt_id") == prompt_id)
    one = chosen.orderBy("shots", "item_id", "prompt_id").limit(1)
    return (one.join(items.select("item_id", "grade"), "item_id")
            .select("prompt_id", "method", "shots", "direction", "grade", "answer", "prompt"))


def chat_messages(conversations: DataFrame, system: str = templates.SYSTEM,
                  bucket_width: int = 1 << 16) -> DataFrame:
    """Each conversation as the message list a chat call sends, one row
    per message: the system message at position 0, then the turns in order
    (turn, then role and text for equal turns), with the list's length.

    Positions and lengths come from ``position_within`` (bounded tasks, no
    window over a whole conversation), so no conversation is ever gathered into
    one task, however long it is; the first turn brings the system message."""
    from .items import position_within
    turns = conversations.select("conv_id", "turn",
                                 F.coalesce("role", F.lit("")).alias("role"),
                                 F.coalesce("text", F.lit("")).alias("content"))
    numbered = position_within(turns, ["conv_id"], "turn", "_pos", bucket_width,
                               tie_break=("role", "content"), total="_n")
    head = F.struct(F.lit(0).cast("long").alias("position"), F.lit("system").alias("role"),
                    F.lit(system).alias("content"))
    body = F.struct((F.col("_pos") + 1).cast("long").alias("position"), "role", "content")
    listed = F.when(F.col("_pos") == 0, F.array(head, body)).otherwise(F.array(body))
    return (numbered.select("conv_id", (F.col("_n") + 1).alias("n_messages"), F.explode(listed).alias("_m"))
            .select("conv_id", "_m.position", "_m.role", "_m.content", "n_messages"))
