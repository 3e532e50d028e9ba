"""Approximate nearest neighbours by learned partitions.

Fitting, on at most ``FIT_ROWS`` distinct vectors: the neighbour graph of the
sample is split into balanced parts by recursive spectral bisection with swaps
across the cut, and a small two-layer network learns, from the vector alone,
how a point's neighbours spread over the parts. Index: every row goes to its
most probable part. Search: a query goes to the most probable parts until they
hold ``MASS`` of the probability, as measured on the sample, and is reranked
against all their vectors by exact double-precision distance.

Equal vectors are one entry with its ``K`` + 1 smallest ids, so copies cost
nothing however many; parts are compared in blocks of at most about ``BLOCK``
vectors with blocks of queries.

Vectors that are null, empty, all zero, or hold a null, NaN or infinity take
no part, nor do vectors whose length is not the sample's commonest. Repeated
rows (equal id and vector) are one candidate. Ties go to the smaller id. An
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K, EVERY = 10, 100
FIT_ROWS, PART, NEIGHBOURS = 4096, 256, 12
MASS, HIDDEN, EPOCHS, SEED = 0.97, 96, 80, 5
BLOCK, QUERY_BLOCK = 512, 128


def usable(e) -> F.Column:
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(e, lambda x: x != 0), F.lit(False))


def entries(rows: DataFrame, k: int = K) -> DataFrame:
    """(h, embedding, ids): each distinct vector with its k + 1 smallest ids.
    The rank limit applies before the exchange, so no hot vector moves."""
    w = Window.partitionBy("h", "embedding").orderBy("vec_id")
    return (rows.distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
            .groupBy("h", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest others of each row."""
    sq = (x * x).sum(1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        d = sq[None, :] - 2 * x[i:i + 512] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i:i + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, size: int) -> np.ndarray:
    """Part of each vertex: halves until at most ``size`` vertices, each half
    along the graph's second eigenvector, then swaps that lower the cut."""
    n = len(graph)
    adj = np.zeros((n, n), np.float32)
    adj[np.repeat(np.arange(n), graph.shape[1]), graph.ravel()] = 1
    adj = np.maximum(adj, adj.T)
    part, todo, made = np.zeros(n, np.int64), [np.arange(n)], 0
    while todo:
        own = todo.pop()
        if len(own) <= size:
            part[own], made = made, made + 1
            continue
        a = adj[np.ix_(own, own)]
        deg = np.maximum(a.sum(1), 1)
        root = np.sqrt(deg / deg.sum())
        v = np.random.default_rng(SEED).normal(size=len(own))
        for _ in range(60):
            v -= root * (root @ v)
            v = (a @ (v / np.sqrt(deg)).astype(np.float32)) / np.sqrt(deg) + v
            v /= np.linalg.norm(v) or 1
        side = np.zeros(len(own), bool)
        side[np.argsort(v / np.sqrt(deg), kind="stable")[len(own) // 2:]] = True
        for _ in range(20):
            to_right = a @ side.astype(np.float32)
            gain = np.where(side, deg - 2 * to_right, 2 * to_right - deg)
            left, right = (np.flatnonzero(side == s) for s in (False, True))
            left, right = (g[np.argsort(-gain[g], kind="stable")] for g in (left, right))
            m = min(len(left), len(right), max(1, len(own) // 50))
            swap = [(x, y) for x, y in zip(left[:m], right[:m]) if gain[x] + gain[y] - 2 * a[x, y] > 0]
            if not swap:
                break
            for x, y in swap:
                side[x], side[y] = True, False
        todo += [own[~side], own[side]]
    return part


class Router:
    """A two-layer network from a vector to its neighbours' parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray):
        rng = np.random.default_rng(SEED)
        d, p = x.shape[1], target.shape[1]
        self.scale = float(np.sqrt((x * x).mean())) if x.any() else 1.0
        self.w = [rng.normal(0, d ** -0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, (HIDDEN, p)), np.zeros(p)]
        m, v, k = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        for _ in range(EPOCHS if p > 1 else 0):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                z = x[at] / self.scale
                h = np.tanh(z @ self.w[0] + self.w[1])
                d_out = (self._soft(h @ self.w[2] + self.w[3]) - target[at]) / len(at)
                back = d_out @ self.w[2].T * (1 - h * h)
                grads = [z.T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ d_out + 1e-4 * self.w[2], d_out.sum(0)]
                k += 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - 0.005 * (m[i] / (1 - 0.9 ** k)) / (np.sqrt(v[i] / (1 - 0.999 ** k)) + 1e-8)

    @staticmethod
    def _soft(a):
        a = np.exp(a - a.max(axis=1, keepdims=True))
        return a / a.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(x / self.scale @ self.w[0] + self.w[1])
        return self._soft(h @ self.w[2] + self.w[3])


def fit(sample: np.ndarray) -> tuple[Router, float]:
    """(router, probability mass to visit). The mass is what finds ``MASS`` of
    the neighbours of points that the network was not fitted on."""
    n = len(sample)
    if n <= 2 * PART:
        return Router(sample, np.ones((n, 1))), 1.0
    graph = neighbour_graph(sample, NEIGHBOURS)
    part = balanced_parts(graph, PART)
    target = np.zeros((n, part.max() + 1))
    np.add.at(target, (np.repeat(np.arange(n), NEIGHBOURS), part[graph].ravel()), 1 / NEIGHBOURS)
    test = np.arange(n) % 5 == 0
    trial = Router(sample[~test], target[~test])
    p = trial.probabilities(sample[test])
    order = np.argsort(-p, axis=1, kind="stable")
    # A neighbour counts as found if the router itself files it in a part visited.
    filed = trial.probabilities(sample).argmax(1)
    place = np.argsort(order, axis=1)[np.arange(len(p))[:, None], filed[graph[test]]]
    before = np.cumsum(np.take_along_axis(p, order, 1), 1) - np.take_along_axis(p, order, 1)
    needed = np.take_along_axis(before, place, 1).ravel()
    return trial, float(np.quantile(needed, MASS)) + 1e-9


def _parts(router: Router, mass: float | None):
    """Adds the most probable part, or (mass given) all parts to visit."""
    def run(batches):
        for b in batches:
            x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float)
            p = router.probabilities(x.reshape(b.num_rows, -1)) if b.num_rows else np.zeros((0, 1))
            if mass is None:
                rows, parts = np.arange(b.num_rows), p.argmax(1)
            else:
                order = np.argsort(-p, axis=1, kind="stable")
                sorted_p = np.take_along_axis(p, order, 1)
                go = np.cumsum(sorted_p, 1) - sorted_p <= mass
                rows, parts = np.repeat(np.arange(b.num_rows), go.sum(1)), order[go]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(rows)) for c in ("vkey", "embedding", "ids")), pa.array(parts.astype(np.int32))],
                names=["vkey", "embedding", "ids", "part"])
    return run


_PARTED = "vkey long, embedding array<double>, ids array<long>, part int"


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(part, cells): packed blocks of about ``size`` entries of a part."""
    n = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per part
    blk = F.pmod(F.xxhash64("vkey", F.lit("block")), F.ceil(F.col("n") / size))
    return (rows.join(F.broadcast(n), "part").withColumn("blk", blk)
            .groupBy("part", "blk").agg(F.collect_list(F.struct("vkey", "embedding", "ids")).alias("cells")).drop("blk"))


def _nearest(k: int):
    """For each pair of blocks: the k + 1 best (distance, id) of every query."""
    def unpack(cells):
        v = cells.values
        n = len(v)
        x = v.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
        return v.field("vkey").to_pylist(), x, v.field("ids").to_pylist()

    def run(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                keys, q, _ = unpack(b.column("queries")[i])
                _, x, ids = unpack(b.column("cells")[i])
                low = np.array([a[0] for a in ids])
                for key, v in zip(keys, q):
                    d = np.sqrt(((x - v) ** 2).sum(axis=1))
                    best = np.lexsort((low, d))[:k + 1] if len(d) <= 4 * k else None
                    if best is None:
                        near = np.flatnonzero(d <= np.partition(d, k)[k])  # ties included
                        best = near[np.lexsort((low[near], d[near]))][:k + 1]
                    found = sorted((float(d[j]), a) for j in best for a in ids[j])[:k + 1]
                    out += [(key, a, s) for s, a in found]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))],
                                             names=["vkey", "vec_id", "score"])
    return run


def search(table: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for each row of (vec_id, embedding) whose
    id is divisible by ``every``, against all other rows."""
    good = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")) \
        .where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    good = good.withColumn("h", F.xxhash64("embedding"))
    named = common.stage(entries(good, k).select(F.monotonically_increasing_id().alias("vkey"), "h", "embedding", "ids"), "vectors")
    sample = [r.embedding for r in named.orderBy(F.xxhash64("h"), "h").select("embedding").limit(FIT_ROWS).collect()]
    dim = Counter(map(len, sample)).most_common(1)[0][0] if sample else 1
    router, mass = fit(np.array([v for v in sample if len(v) == dim], float).reshape(-1, dim))
    vectors = named.where(F.size("embedding") == dim)
    asked = (good.where((F.col("vec_id") % every == 0) & (F.size("embedding") == dim)).select(F.col("vec_id").alias("query_id"), "h", "embedding").distinct()
             .join(vectors.select("vkey", "h", "embedding"), ["h", "embedding"]).select("query_id", "vkey"))
    asked = common.stage(asked, "asked")
    parted = vectors.select("vkey", "embedding", "ids")
    cells = _blocks(parted.mapInArrow(_parts(router, None), _PARTED), BLOCK)
    wanted = parted.join(asked.select("vkey").distinct(), "vkey", "left_semi")
    queries = _blocks(wanted.mapInArrow(_parts(router, mass), _PARTED), QUERY_BLOCK).withColumnRenamed("cells", "queries")
    spark = table.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = queries.join(cells, "part").select("queries", "cells").repartition(n)
    found = pairs.mapInArrow(_nearest(k), "vkey long, vec_id long, score double")
    top = Window.partitionBy("vkey").orderBy("score", "vec_id")
    found = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).drop("r")
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (asked.join(found, "vkey").where("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
