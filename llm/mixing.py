"""Mixing sources to target weights.

A source's documents, in a seeded order, form one stream of words that is
packed into blocks of ``BLOCK`` words. Every output shard of ``SLOTS`` slots
draws how many of its slots each source fills: multinomial counts, conditioned
on the sources' totals (so the targets are met exactly), by splitting the
totals down a tree of shard ranges. A source's k-th slot is slot k mod n of
epoch k div n over its n blocks and goes through that (source, epoch)'s
pseudorandom permutation, a Feistel network with cycle walking; slots and
blocks then join on (source, block). Within an epoch no block comes twice; the
last block drawn from a source is cut where the target is met.

Sources sorted by code point, null last, weigh ``weights`` in turn and share
``share`` of all words; no target exceeds ``most`` times its source's words,
what is above goes to the others by weight. One row per source comes to the
driver (the mixture's plan), nothing that grows with the documents.

A null text has no words. Rows with equal doc_id are separate documents.
Sources without words get target 0. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Words of a block, slots of an output shard, children of a tree node.
BLOCK, SLOTS, FANOUT = 256, 4096, 64
#: Slots that one task draws, about.
TASK_SLOTS = 1 << 16
SEED = 20
_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Shares by weight of share * total, none above most times its size."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * unit > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        free -= over
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (murmur3's constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permute(i: np.ndarray, n: int, key: list[int], inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, or its inverse, evaluated at i."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, x = np.uint64((1 << half) - 1), i.astype(np.uint64)
    keys = [np.uint64(int(k)) for k in np.random.SeedSequence(key).generate_state(4, np.uint64)]
    todo = np.ones(len(x), bool)
    while todo.any():
        y = x[todo]
        left, right = y >> np.uint64(half), y & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (_mix(right ^ k) & mask)
        x[todo] = left << np.uint64(half) | right
        todo &= x >= np.uint64(n)
    return x.astype(np.int64)


def _epoch_key(sid: int, epoch: int, seed: int) -> list[int]:
    return [seed, sid, epoch]


def _plan(sid: int, size: int, target: float, block: int, seed: int) -> tuple[int, int, int]:
    """(blocks, slots, words of the last slot) of a source."""
    words, n = int(target), -(-size // block)
    if not words:
        return n, 0, 0
    full, rest = divmod(words, size)
    if not rest:
        return n, full * n, 0  # 0: the last slot is whole
    short = size - (n - 1) * block
    # The slots of the begun epoch until `rest` words are reached; the slot of
    # the source's short block may be among them.
    at_short = int(permute(np.array([n - 1]), n, _epoch_key(sid, full, seed), inverse=True)[0])
    r = -(-rest // block)
    lost = block - short if at_short < r else 0
    if r * block - lost < rest:
        r += 1
        lost = block - short if at_short < r else 0
    last = rest - (r * block - lost - (short if at_short == r - 1 else block))
    return n, full * n + r, last


def _without_replacement(rng: np.random.Generator, good: int, rest: int, k: int) -> int:
    """How many of k slots, drawn from good + rest, are good (hypergeometric), by
    inversion: the weights come from the exact ratios of neighbours, summed from
    12 standard deviations and 64 below the mode to as much above, beyond which
    less lies than a double resolves."""
    total = good + rest
    mode, p = (k + 1) * (good + 1) // (total + 2), good / total
    width = int(12 * (k * p * (1 - p) * (total - k) / max(1, total - 1)) ** 0.5) + 64
    lo, hi = max(0, k - rest, mode - width), min(good, k, mode + width)
    x = np.arange(lo, hi, dtype=np.float64)
    step = np.log(good - x) + np.log(k - x) - np.log(x + 1) - np.log(rest - k + x + 1)
    weight = np.concatenate([[0.0], np.cumsum(step)])
    below = np.cumsum(np.exp(weight - weight.max()))
    return lo + min(int(np.searchsorted(below, rng.random() * below[-1], "right")), hi - lo)


def _hyper(rng: np.random.Generator, counts: np.ndarray, k: int) -> np.ndarray:
    """k slots drawn without replacement from the sources' counts: a
    multinomial draw given the totals."""
    out, left = np.zeros_like(counts), int(counts.sum())
    for s, c in enumerate(counts.tolist()):
        if not k:
            break
        left -= c
        if c:
            out[s] = _without_replacement(rng, c, left, k)
            k -= int(out[s])
    return out


def _split(seed: int, slots: int, total: int):
    """Nodes (first shard, end, counts, starts) into up to FANOUT children."""
    def run(frames):
        for pdf in frames:
            out = []
            for lo, hi, c, s in zip(pdf.lo, pdf.hi, pdf.counts, pdf.starts):
                if hi - lo <= 1:
                    out.append((lo, hi, c, s))
                    continue
                rng = np.random.default_rng([seed, 1, int(lo), int(hi)])
                counts, starts = np.frombuffer(c, np.int64).copy(), np.frombuffer(s, np.int64).copy()
                step = -(-(hi - lo) // FANOUT)
                for a in range(lo, hi, step):
                    b = min(hi, a + step)
                    mine = _hyper(rng, counts, min(b * slots, total) - a * slots)
                    out.append((a, b, mine.tobytes(), starts.tobytes()))
                    counts -= mine
                    starts += mine
            yield pd.DataFrame(out, columns=["lo", "hi", "counts", "starts"])
    return run


def _draw(plan: list[tuple], seed: int, block: int):
    """Shards into slots: (shard, position, sid, epoch, block, words taken)."""
    def run(frames):
        for pdf in frames:
            for shard, c, s in zip(pdf.lo, pdf.counts, pdf.starts):
                counts, starts = np.frombuffer(c, np.int64), np.frombuffer(s, np.int64)
                parts = []
                for sid in np.flatnonzero(counts):
                    size, n, slots, last = plan[sid]
                    k = np.arange(starts[sid], starts[sid] + counts[sid])
                    epoch, at = np.divmod(k, n)
                    for e in np.unique(epoch):
                        sel = epoch == e
                        got = permute(at[sel], n, _epoch_key(int(sid), int(e), seed))
                        words = np.where(got == n - 1, size - (n - 1) * block, block)
                        if last:
                            words[k[sel] == slots - 1] = last
                        parts.append((np.full(len(got), sid), np.full(len(got), e), got, words))
                if not parts:
                    continue
                cols = [np.concatenate(x) for x in zip(*parts)]
                order = np.random.default_rng([seed, 2, int(shard)]).permutation(len(cols[0]))
                yield pd.DataFrame({"shard": int(shard), "position": order, "sid": cols[0], "epoch": cols[1],
                                    "block": cols[2], "words": cols[3]})
    return run


def pack(docs: DataFrame, seed: int = SEED, numbered: bool = False) -> tuple[DataFrame, list]:
    """(rows, sources): rows is doc_id, source and ``size`` (words) of docs with
    ``uid`` and ``start``, the place of its first word in its source's stream,
    and ``sid``. Equal rows are told apart by uid only; ``numbered`` docs bring
    a fixed one along.

    A source's order is by a hash of (doc_id, size), then uid. Places are running
    sums in three steps, so neither a source nor a repeated (doc_id, size) meets
    in one task: within the rows that share the hash and the partition they came
    from, over such groups within hash buckets, and over the buckets."""
    spark = docs.sparkSession
    uid = F.col("uid") if numbered else F.monotonically_increasing_id()
    docs = docs.select("doc_id", "source", "size", uid.alias("uid"))
    rows = common.stage(docs.withColumn("mix_h", F.xxhash64(F.lit(seed), "doc_id", "size")), "mix")
    per = (rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
           .orderBy(F.col("source").asc_nulls_last()).collect())
    buckets = common.ordered(spark, sum(r.n for r in per))
    names = spark.createDataFrame([(i, r.source) for i, r in enumerate(per)], "sid int, source_name string")
    rows = rows.join(names, F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name")
    group = ["sid", "mix_h", "came"]
    rows = rows.withColumn("came", F.shiftright("uid", 33))  # the partition, by the id's upper bits
    groups = (rows.groupBy(*group).agg(F.sum("size").alias("s"))
              .withColumn("bucket", F.pmod("mix_h", F.lit(buckets)).cast("int")))
    earlier = Window.partitionBy("sid", "bucket").orderBy("mix_h", "came").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("s").over(earlier), F.lit(0))
    offs = (groups.groupBy("sid", "bucket").agg(F.sum("s").alias("s"))
            .select("sid", "bucket", F.coalesce(F.sum("s").over(
                Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")))
    groups = groups.withColumn("before", before).join(offs, ["sid", "bucket"]).select(*group, (F.col("base") + F.col("before")).alias("first"))
    inner = Window.partitionBy(*group).orderBy("uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (rows.withColumn("run", F.sum("size").over(inner)).join(groups, group)
              .withColumn("start", F.col("first") + F.col("run") - F.col("size"))
              .drop("first", "run", "mix_h", "came"))
    return placed, per


def draw(spark, plan: list[tuple], seed: int = SEED, slots: int = SLOTS, block: int = BLOCK) -> DataFrame:
    """The mix: one row per output slot. plan: (size, blocks, slots, last) per source."""
    total = sum(p[2] for p in plan)
    shards = -(-total // slots)
    counts, zero = np.array([p[2] for p in plan], np.int64), np.zeros(len(plan), np.int64)
    kind = "lo long, hi long, counts binary, starts binary"
    root = [(0, shards, counts.tobytes(), zero.tobytes())] if total else []
    # A node is a few bytes and unfolds to many slots, so the number of tasks is
    # stated: some TASK_SLOTS each, more where that makes over `most` of them.
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (TASK_SLOTS << 6)))
    tasks = min(-(-total // TASK_SLOTS), most)
    nodes, width, made = spark.createDataFrame(root, kind), shards, 1
    while width > 1:
        made = min(shards, made * FANOUT)
        nodes = nodes.mapInPandas(_split(seed, slots, total), kind).repartition(max(1, min(made, tasks)), "lo")
        width = -(-width // FANOUT)
    return nodes.mapInPandas(_draw(plan, seed, block),
                             "shard long, position long, sid int, epoch int, block long, words int")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST,
        block: int = BLOCK, seed: int = SEED, numbered: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces): rows as ``pack`` gives them plus ``source_size`` and
    ``target``; pieces has one row per run of a document's words in a slot of
    the mix: uid, shard, position, epoch, first (word of the document), n."""
    spark = docs.sparkSession
    placed, per = pack(docs, seed, numbered)
    sizes = [int(r["size"] or 0) for r in per]
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(per))], share, most)
    plan = [(s, *_plan(i, s, t, block, seed)) for i, (s, t) in enumerate(zip(sizes, goal))]
    known = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(zip(sizes, goal))],
                                  "sid int, source_size long, target double")
    rows = common.stage(placed.join(known, "sid"), "packed")
    end = F.col("start") + F.col("size")
    segments = (rows.where("size > 0")
                .select("uid", "sid", "start", "size",
                        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block")))
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(end, F.col("block") * block + F.col("words"))
    # Written first: a plan can't know the size of what Python makes, and would
    # broadcast the slots, which grow with the mix.
    slots = common.stage(draw(spark, plan, seed, block=block), "slots")
    pieces = (segments.join(slots, ["sid", "block"])
              .select("uid", "shard", "position", "epoch", (lo - F.col("start")).alias("first"), (hi - lo).alias("n"))
              .where("n > 0"))
    return rows, pieces


def taken(docs: DataFrame, **how) -> DataFrame:
    """rows of ``mix`` with ``taken``: the words of each that the mix takes."""
    rows, pieces = mix(docs, **how)
    got = pieces.groupBy("uid").agg(F.sum("n").alias("taken"))
    return rows.join(got, "uid", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents with the columns of docs: for each epoch, a row for
    each unbroken run of a document's words taken in it. A run of all words is
    the text as it is; another is cut out of the text from its first word to
    its last, with the white space between. So a source above its size repeats
    its documents, one below gives parts; documents without words, and those of
    which nothing was drawn, are not in the mix."""
    cols = docs.columns
    whole = common.stage(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*cols).alias("row")), "whole")
    # Places and draws run on narrow rows; the texts move once, to be cut.
    rows, pieces = mix(whole.select("uid", "row.doc_id", "row.source", common.word_count(F.col("row.text")).alias("size")), numbered=True, **how)
    # Runs that touch have the same distance from the words taken before them.
    before = Window.partitionBy("uid", "epoch").orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = (pieces.withColumn("gap", F.col("first") + F.col("n") - F.sum("n").over(before))
            .groupBy("uid", "epoch", "gap").agg(F.min("first").alias("first"), F.sum("n").alias("n")))
    per = (runs.groupBy("uid", "epoch").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("runs"))
           .join(rows.select("uid", "size"), "uid"))
    all_words = F.col("runs")[0]["n"] == F.col("size")
    ws = F.when(~all_words, F.regexp_extract_all("row.text", F.lit(common.WORD + "[\\x20\\x09-\\x0D]*"), F.lit(0)))
    parts = F.transform("runs", lambda r: F.regexp_replace(
        F.array_join(F.slice("ws", r["first"].cast("int") + 1, r["n"].cast("int")), ""), "[\\x20\\x09-\\x0D]+\\z", ""))
    out = (whole.join(per, "uid").select("row", "runs", "size", ws.alias("ws"))
           .select("row", F.explode(F.when(all_words, F.array("row.text")).otherwise(parts)).alias("new")))
    put = {"text": F.col("new"), "n_chars": F.char_length("new").cast("long")}
    return out.select(*[put[c].alias(c) if c in put else F.col("row").getField(c).alias(c) for c in cols])
