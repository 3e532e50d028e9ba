"""Prompts: expansion, examples, rendering against Python str.format."""

import hashlib

from verdict.config import FIXTURE
from verdict.functions import templates
from verdict.operators import prompts as prompt_ops
from verdict.sources import fixture as fx

from .conftest import SF_SMALL


def _py_examples(items, settings):
    """W3 in plain Python: per (direction, shots, slot) the smallest hash."""
    out = {}
    shot_values = sorted({s for _, s in settings.prompt_methods() if s})
    for d in {i["direction"] for i in items}:
        for s in shot_values:
            for k in range(s):
                want_pos = k % 2 == 0
                pool = [i for i in items if i["direction"] == d
                        and (i["answer"] == settings.positive_label) == want_pos]
                if not pool:
                    continue
                best = min(pool, key=lambda i: (hashlib.md5(
                    f"{settings.example_seed}|{d}|{s}|{k}|{i['item_id']}".encode()).hexdigest(),
                    i["item_id"]))
                out[(d, s, k)] = best
    return out


def _py_prompt(row, item, examples, names):
    shown = [e for e in examples if e["item_id"] != item["item_id"]]
    ex_text = "".join(templates.EXAMPLE.format(
        source=names.get(e["source_language"], e["source_language"]),
        target=names.get(e["target_language"], e["target_language"]),
        source_text=e["source_text"], target_text=e["target_text"], answer=e["answer"])
        for e in shown)
    return templates.TEMPLATES[row["method"]].format(
        source=names.get(item["source_language"], item["source_language"]),
        target=names.get(item["target_language"], item["target_language"]),
        source_text=item["source_text"], target_text=item["target_text"],
        examples=ex_text if shown else "", other_label="", other_reasoning=""), len(shown)


def test_prompts_match_python_rendering(spark):
    items_df = fx.items(spark, SF_SMALL)
    items = [r.asDict() for r in items_df.collect()]
    by_id = {i["item_id"]: i for i in items}
    ex = _py_examples(items, FIXTURE)
    got_ex = {(r["direction"], r["shots"], r["slot"]): r["item_id"]
              for r in prompt_ops.draw_examples(items_df, FIXTURE).collect()}
    assert got_ex == {k: v["item_id"] for k, v in ex.items()}

    names = FIXTURE.language_names()
    prompts = prompt_ops.build_prompts(items_df, FIXTURE).collect()
    assert len(prompts) == len(items) * len(FIXTURE.prompt_methods())
    for r in prompts:
        exs = [ex[(r["direction"], r["shots"], k)] for k in range(r["shots"])
               if (r["direction"], r["shots"], k) in ex]
        text, shown = _py_prompt(r, by_id[r["item_id"]], exs, names)
        assert r["prompt"] == text, r["prompt_id"]
        assert r["examples_shown"] == shown


def test_prompt_ids_unique_and_review_excluded(spark):
    p = fx.prompts(spark, SF_SMALL)
    assert p.count() == p.select("prompt_id").distinct().count()
    assert p.filter(p.method == "debate").count() == 0


def test_example_join_is_broadcast(spark):
    p = prompt_ops.build_prompts(fx.items(spark, SF_SMALL), FIXTURE)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_unknown_method_fails(spark):
    from pyspark.sql import functions as F
    bad = spark.range(1).select(templates.render_by_method(F.lit("nope"), {
        f: F.lit("") for f in ["source", "target", "source_text", "target_text", "examples",
                               "other_label", "other_reasoning"]}).alias("p"))
    import pytest
    with pytest.raises(Exception) as e:
        bad.collect()
    assert "no prompt template has this name" in str(e.value)


def test_lengths_counts_first(spark):
    p = prompt_ops.build_prompts(fx.items(spark, SF_SMALL), FIXTURE)
    pdf = p.toPandas()
    lens = {r["method"]: r for r in prompt_ops.prompt_lengths(p).collect()}
    import numpy as np
    for m, g in pdf.groupby("method"):
        w = g["prompt"].str.split().str.len()
        assert lens[m]["max_words"] == w.max()
        assert lens[m]["median_words"] == np.round(w.median(), 0)
        assert lens[m]["mean_words"] == np.round(w.mean(), 0)
    counts = {(r["method"], r["shots"]): r["prompts"] for r in prompt_ops.prompt_counts(p).collect()}
    assert counts == pdf.groupby(["method", "shots"]).size().to_dict()
    first = {r["method"]: r["prompt_id"] for r in prompt_ops.first_per_method(p).collect()}
    for m, g in pdf.groupby("method"):
        assert first[m] == g.sort_values(["shots", "item_id"]).iloc[0]["prompt_id"]


def test_chat_messages(spark):
    conv = fx.table(spark, SF_SMALL, "conversations")
    pdf = conv.toPandas()
    got = prompt_ops.chat_messages(conv, bucket_width=2).toPandas()
    for cid, g in pdf.groupby("conv_id"):
        g = g.sort_values(["turn", "role", "text"])
        mine = got[got["conv_id"] == cid].sort_values("position")
        assert list(mine["position"]) == list(range(len(g) + 1))
        assert set(mine["n_messages"]) == {len(g) + 1}
        assert list(mine["role"]) == ["system"] + list(g["role"])
        assert list(mine["content"]) == [templates.SYSTEM] + list(g["text"])


def test_lengths_approx_median_close(spark):
    p = prompt_ops.build_prompts(fx.items(spark, SF_SMALL), FIXTURE)
    exact = {r["method"]: r["median_words"] for r in prompt_ops.prompt_lengths(p).collect()}
    approx = {r["method"]: r["median_words"]
              for r in prompt_ops.prompt_lengths(p, approx_accuracy=100000).collect()}
    for m in exact:
        assert abs(exact[m] - approx[m]) <= max(2.0, 0.05 * exact[m])


def test_length_states_merge_within_the_sketch_bound(spark):
    import bisect
    import random
    from verdict.operators import prompts as prompt_ops
    rng = random.Random(4)
    rows = [(m, k % 5, int(rng.expovariate(1 / 60)) + (1000 if k % 17 == 0 else 0)) for m in ("baseline", "span") for k in range(12_000)]
    df = (spark.createDataFrame(rows, "method string, part int, n int")
          .selectExpr("method", "part", "array_join(array_repeat('w', n), ' ') AS prompt"))
    exact = {r["method"]: r for r in prompt_ops.prompt_lengths(df).collect()}
    # Parts come one after another, each kept as two rows.
    state = prompt_ops.length_state(df.where("part = 0"))
    for part in range(1, 5):
        state = prompt_ops.merge_length_states(state.unionByName(prompt_ops.length_state(df.where(f"part = {part}"))))
    for r in prompt_ops.lengths_from_state(state).collect():
        want = exact[r["method"]]
        assert (r["mean_words"], r["max_words"]) == (want["mean_words"], want["max_words"])
        own = sorted(n for m, _, n in rows if m == r["method"])
        low, high = bisect.bisect_left(own, r["median_words"]) / len(own), bisect.bisect_right(own, r["median_words"]) / len(own)
        assert low - 0.03 <= 0.5 <= high + 0.03
    assert state.selectExpr("max(octet_length(sketch))").first()[0] < 50_000
