"""Sources and sinks; streaming equals batch and resumes from its checkpoint."""

from pyspark.sql import functions as F

from verdict import schemas
from verdict.config import FIXTURE
from verdict.operators import judge, items as item_ops
from verdict.sources import fixture as fx
from verdict.sources import tables
from verdict.streaming import replies as streaming

from .conftest import SF_SMALL


def test_corpus_tsv_round_trip(spark, scratch):
    corpus = spark.createDataFrame(
        [("de", "en", "1_No_hallucination", 'say "hi"\n\tthere', "x\ty", 0),
         ("en", "de", "2_Small_hallucination", "", None, 1)],
        "src_lang string, tgt_lang string, class_hall string, src_text string, "
        "mt_text string, ordinal long")
    path = f"{scratch}/corpus.tsv"
    tables.write_table(corpus, path, fmt="tsv")
    back = tables.read_corpus(spark, path).orderBy("ordinal").collect()
    assert back[0]["src_text"] == 'say "hi"\n\tthere' and back[0]["mt_text"] == "x\ty"
    built = item_ops.build_items(tables.read_corpus(spark, path), FIXTURE).orderBy("item_id")
    assert [r["target_text"] for r in built.collect()] == ["x\ty", ""]


def test_read_table_keeps_empty_as_empty(spark, scratch):
    df = spark.createDataFrame([("a", None), ("b", "x")], "k string, v string")
    path = f"{scratch}/t.csv"
    tables.write_table(df, path, fmt="csv")
    got = {r["k"]: r["v"] for r in tables.read_table(spark, path, ["k", "v"]).collect()}
    assert got == {"a": "", "b": "x"}


def test_read_replies_absent_is_empty(spark, scratch):
    df = tables.read_replies(spark, f"{scratch}/nothing-here")
    assert df.count() == 0 and df.schema == schemas.REPLIES


def test_stream_judgements_equal_batch_and_resume(spark, scratch):
    log = f"{scratch}/log"
    r = fx.replies(spark, SF_SMALL)
    r.filter(F.col("replicate") == 1).write.json(log, mode="append")
    prompts = fx.prompts(spark, SF_SMALL)
    sink, ckpt = f"{scratch}/judged", f"{scratch}/ckpt"
    streaming.stream_judgements(spark, log, prompts, FIXTURE, sink, ckpt).awaitTermination()
    first = spark.read.parquet(sink).count()
    # More replies arrive; a restart reads only the new files.
    r.filter(F.col("replicate") != 1).write.json(log, mode="append")
    streaming.stream_judgements(spark, log, prompts, FIXTURE, sink, ckpt).awaitTermination()
    got = spark.read.parquet(sink)
    want = judge.judgements(r, prompts, FIXTURE)
    assert 0 < first < got.count()
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_stream_counts(spark, scratch):
    log = f"{scratch}/log"
    fx.replies(spark, SF_SMALL).repartition(3, "prompt_id").write.json(log)
    prompts = fx.prompts(spark, SF_SMALL)
    q = streaming.stream_counts(spark, log, prompts, FIXTURE, f"{scratch}/counts",
                                f"{scratch}/ckpt", max_files_per_trigger=1)
    q.awaitTermination()
    counts = streaming.Published(spark, f"{scratch}/counts").read()
    # Scores derived from the running counts equal scoring every reply at once.
    from verdict.operators import metrics
    got = streaming.scores_from_counts(counts)
    want = metrics.score_everything(judge.judgements(fx.replies(spark, SF_SMALL), prompts,
                                                     FIXTURE), FIXTURE)
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == \
        sorted(map(tuple, want.select(cols).collect()))


def test_stream_from_partitioned_parquet_log(spark, scratch):
    """The log as ``append_replies`` writes it (Parquet, method=/model= folders)."""
    log = f"{scratch}/log"
    r = fx.replies(spark, SF_SMALL)
    tables.append_replies(r.filter(F.col("method") == "baseline"), log)
    prompts = fx.prompts(spark, SF_SMALL)
    sink, ckpt = f"{scratch}/judged", f"{scratch}/ckpt"
    streaming.stream_judgements(spark, log, prompts, FIXTURE, sink, ckpt,
                                fmt="parquet").awaitTermination()
    tables.append_replies(r.filter(F.col("method") != "baseline"), log)
    streaming.stream_judgements(spark, log, prompts, FIXTURE, sink, ckpt,
                                fmt="parquet").awaitTermination()
    got = spark.read.parquet(sink)
    want = judge.judgements(r, prompts, FIXTURE)
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_parquet_corpus_gets_file_order_ordinal(spark, scratch):
    from verdict.operators import items as item_ops
    corpus = fx.corpus(spark, SF_SMALL).drop("ordinal").orderBy("src_text")
    path = f"{scratch}/corpus_pq"
    corpus.repartition(3).write.parquet(path)
    read = tables.read_corpus(spark, path, fmt="parquet")
    rows = read.select("ordinal").collect()
    assert len(rows) == len({r[0] for r in rows}) == corpus.count()
    # Ordinal order is file order: file path, then row index within the file.
    raw = spark.read.parquet(path).select(
        "src_text", "mt_text", F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.row_index").alias("i")).toPandas().sort_values(["f", "i"])
    by_ordinal = read.orderBy("ordinal").select("src_text", "mt_text").toPandas()
    assert list(zip(raw["src_text"], raw["mt_text"])) == \
        list(zip(by_ordinal["src_text"], by_ordinal["mt_text"]))
    built = item_ops.build_items(read, FIXTURE, item_ids="make")
    assert built.select("item_id").distinct().count() == corpus.count()


def test_bucketed_log_and_prompts_score_without_shuffling_replies(spark):
    from verdict.operators import metrics
    spark.sql("DROP TABLE IF EXISTS t_replies")
    spark.sql("DROP TABLE IF EXISTS t_prompt_keys")
    r = tables.save_bucketed(fx.replies(spark, SF_SMALL), "t_replies", buckets=8)
    p = tables.save_bucketed(fx.prompts(spark, SF_SMALL), "t_prompt_keys", buckets=8)
    # As at scale: neither side small enough to broadcast.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counted = metrics.judged_counts(r, p, FIXTURE)
        plan = counted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
    got = metrics.score_replies(r, p, FIXTURE)
    want = metrics.score_replies(fx.replies(spark, SF_SMALL), fx.prompts(spark, SF_SMALL), FIXTURE)
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def repeated(spark, replies, seconds):
    """The log with a time of logging; some replies are logged again."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.lit(seconds))
    return replies.withColumn("logged_at", at)


def test_a_reply_logged_twice_counts_once_across_a_restart(spark, scratch):
    r = fx.replies(spark, SF_SMALL)
    log, prompts = f"{scratch}/log", fx.prompts(spark, SF_SMALL)
    sink, ckpt = f"{scratch}/judged", f"{scratch}/ckpt"

    def run():
        streaming.stream_judgements(spark, log, prompts, FIXTURE, sink, ckpt, dedupe_within="10 minutes").awaitTermination()
    half = r.filter(F.col("replicate") == 1)
    repeated(spark, half, 0).unionByName(repeated(spark, half.filter("method = 'span'"), 5)).write.json(log, mode="append")
    run()
    repeated(spark, r, 60).write.json(log, mode="append")  # all again, after a restart
    run()
    got, want = spark.read.parquet(sink), judge.judgements(r, prompts, FIXTURE)
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    # Once the time has moved past the keys, they are let go and a repeat is a new reply.
    repeated(spark, half.limit(1).withColumn("prompt_id", F.lit("later")), 10_000).write.json(log, mode="append")
    run()
    repeated(spark, half, 10_060).write.json(log, mode="append")
    run()
    assert spark.read.parquet(sink).count() == want.count() + judge.judgements(half, prompts, FIXTURE).count()


def test_published_tables_are_whole_and_replay_changes_nothing(spark, scratch):
    import pytest
    p = streaming.Published(spark, f"{scratch}/table")
    with pytest.raises(FileNotFoundError):
        p.read()
    assert p.publish(spark.range(3), 0) and p.read().count() == 3
    held = p.read()
    assert not p.publish(spark.range(99), 0) and p.read().count() == 3
    # A write that dies leaves the pointer where it was.
    spark.range(50).write.parquet(f"{scratch}/table/epochs/1")
    assert p.read().count() == 3 and p.current() == 0
    assert p.publish(spark.range(5), 1) and p.read().count() == 5
    assert held.count() == 3  # a reader of the epoch before goes on
    assert p.publish(spark.range(7), 2) and p.current() == 2 and p.read().count() == 7


def test_agreement_of_the_stream_equals_batch(spark, scratch):
    from verdict.operators import metrics
    log, r = f"{scratch}/log", fx.replies(spark, SF_SMALL)
    cells, ckpt = f"{scratch}/cells", f"{scratch}/ckpt"

    def run():
        streaming.stream_agreement(spark, log, FIXTURE, cells, ckpt, dedupe_within="1 hour", expiry="1 hour").awaitTermination()
    repeated(spark, r.filter("replicate < 3"), 0).write.json(log, mode="append")
    run()
    assert spark.read.schema(streaming.CELLS).parquet(cells).count() == 0  # nothing is complete yet
    repeated(spark, r.filter("replicate > 1 and not (model = 'org/beta' and replicate = 3)"), 30).write.json(log, mode="append")
    run()
    done = spark.read.parquet(cells)
    assert done.where("complete").count() == done.count() == r.filter("model = 'org/alpha'").select("prompt_id").distinct().count()
    # Late enough, what is incomplete expires; the last file only moves the time on.
    for hours in (9, 18):
        repeated(spark, r.limit(1).withColumn("prompt_id", F.lit(f"later-{hours}")), hours * 3600).write.json(log, mode="append")
        run()
    got = spark.read.parquet(cells).where("prompt_id not like 'later%'")
    assert got.where("not complete").select("model").distinct().collect()[0][0] == "org/beta"
    seen = r.filter("not (model = 'org/beta' and replicate = 3)")
    want = metrics.replicate_agreement(judge.judgements(seen, fx.prompts(spark, SF_SMALL), FIXTURE), settings=FIXTURE)
    assert streaming.agreement_from_cells(got).collect() == want.collect()


def test_agreement_cells_of_one_bucket_wait_and_expire_each_alone(spark, scratch):
    """All cells in one bucket: keys null, replies over the number, expiry of a cell while others of its bucket get replies."""
    from pyspark.sql import Row
    log, sink = f"{scratch}/log", f"{scratch}/cells"
    good, bad = "Label: Hallucination", "Label: No hallucination"

    def run(*rows):
        made = [Row(prompt_id=p, model=m, replicate=1, response=r, error=e, logged_at=f"2026-01-01T{h:02d}:00:00Z") for h, p, m, r, e in rows]
        spark.createDataFrame(made, "prompt_id string, model string, replicate int, response string, error string, logged_at string").write.json(log, mode="append")
        stream = streaming.reply_stream(spark, log).withWatermark("logged_at", "1 hour")
        (streaming.agreement_cells(stream, FIXTURE, "2 hours", buckets=1).writeStream.format("parquet").outputMode("append")
         .option("path", sink).option("checkpointLocation", f"{scratch}/ckpt").trigger(availableNow=True).start().awaitTermination())
        return sorted((r[:] for r in spark.read.schema(streaming.CELLS).parquet(sink).collect()), key=str)

    # Four replies of one micro-batch are one cell; a failed reply counts, but not as judged.
    assert run(*[(0, "a", "m", good, "")] * 3, *[(0, None, "m", bad, "")] * 3, *[(0, "b", "m", x, "") for x in (good, good, bad, good)],
               *[(0, "c", "m", None, "503")] * 3, (0, "d", "m", good, ""), (0, "e", None, good, ""), (0, "f", "m", bad, "")) == sorted([
                   ("a", "m", 3, 3, True, True), (None, "m", 3, 3, True, True), ("b", "m", 4, 4, False, True), ("c", "m", 3, 0, None, True)], key=str)
    before = run((2, "d", "m", good, ""), (2, "e", None, None, "503"))
    assert len(before) == 4
    # The last time is 5, so f's two hours end (at 0 + 2 < 5 - 1); d and e began to wait at 2 and end at 4, not before.
    after = run((5, "g", "m", good, ""))
    assert [r for r in after if r not in before] == [("f", "m", 1, 1, True, False)]
    last = run((9, "g", "m", bad, ""))
    assert [r for r in last if r not in after] == sorted([("d", "m", 2, 2, True, False), ("e", None, 2, 1, True, False)], key=str)
    assert [r for r in run((9, "g", "m", bad, "")) if r not in last] == [("g", "m", 3, 3, False, True)]


def test_agreement_calls_python_by_bucket_not_by_cell(spark):
    rows = spark.readStream.format("rate").load().selectExpr(
        "string(value) AS prompt_id", "'m' AS model", "'' AS error", "'' AS response", "timestamp AS logged_at")
    cells = streaming.agreement_cells(rows.withWatermark("logged_at", "1 day"), FIXTURE)
    spark.conf.set("spark.sql.debug.maxToStringFields", 100)
    plan = cells._jdf.queryExecution().analyzed().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "_bucket#" in next(x for x in plan.split("\n") if "FlatMapGroupsInPandasWithState" in x)


def test_damaged_log_lines_are_set_aside(spark, scratch, tmp_path):
    good = '{"prompt_id":"p%d","model":"m","method":"baseline","replicate":1,"response":"Label: x","extra":[1]}'
    lines = [good % 0, "", good % 1, '{"prompt_id":"p2","mod', '{"prompt_id":"p3","model":"m","method":"span","replicate":"one"}',
             '{"prompt_id":"p4","model":"m","replicate":2}', "[]", "   ", '"text"', good % 5]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("oops\n" + good % 6)
    replies, damaged = tables.read_log_lines(spark, str(tmp_path))
    assert sorted(r["prompt_id"] for r in replies.collect()) == ["p0", "p1", "p5", "p6"]
    got = sorted((r["file"][-7:], r["line"], r["reason"]) for r in damaged.collect())
    assert got == [("a.jsonl", 3, "not JSON"), ("a.jsonl", 4, "wrong type"), ("a.jsonl", 5, "no key"),
                   ("a.jsonl", 6, "not JSON"), ("a.jsonl", 8, "not JSON"), ("b.jsonl", 0, "not JSON")]
    assert all(r["value"] == lines[r["line"]] for r in damaged.where("file like '%a.jsonl'").collect())
    for _ in range(2):  # again in place of the first account
        assert tables.quarantine(damaged, f"{scratch}/q") == 6
    assert replies.count() + 6 == sum(bool(x.strip()) for x in lines) + 2
