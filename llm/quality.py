"""Quality by random-indexing word vectors and a small network.

Every word falls into one of ``BUCKETS`` buckets, and each bucket has a fixed
sparse index vector. One pass over all texts sums, for each bucket, the index
vectors of the words near its words: its word vector. A document pools its
words' vectors (their mean, and the mean step between neighbours, which is small
where words repeat) and its length. A two-layer network scores the pools; a
temperature fitted on a fold that the weights have not seen calibrates it.

Word vectors cover all documents; the driver holds their table, of fixed size.
The network is fitted on at most ``FIT_ROWS`` labelled rows outside fold 0.

Null and empty texts pool to zeros and are scored like any other. Repeated
rows get equal scores; a null doc_id is scored and not held out.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, labelled

BUCKETS, DIMS, NEAR, SPARSE = 8192, 24, 2, 4
HIDDEN, EPOCHS, SEED = 32, 60, 6
CALIBRATION_FOLD = 1
CUT = 0.3
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Buckets(dict):
    """word -> bucket for the words of late; bounded."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        b = self[w] = zlib.crc32(w.encode()) % BUCKETS
        return b


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIMS), np.int16)
    for row in out:
        row[rng.choice(DIMS, SPARSE, replace=False)] = rng.choice([-1, 1], SPARSE)
    return out


def _ids(text: str | None, buckets: Buckets) -> np.ndarray:
    found = _TOKEN.findall(text or "")
    return np.fromiter((buckets[t] for t in found), np.int32, len(found))


def _sums(batches):
    """One row per bucket seen in the partition: its words' neighbours, summed."""
    index, buckets = index_vectors(), Buckets()
    total = np.zeros((BUCKETS, DIMS), np.int64)
    blank = np.full(NEAR, BUCKETS, np.int32)  # between documents
    index = np.vstack([index, np.zeros((1, DIMS), np.int16)])
    for b in batches:
        part, size = [], 0
        texts = b.column("text").to_pylist()
        for k, t in enumerate(texts):
            ids = _ids(t, buckets)
            part += [ids, blank]
            size += len(ids)
            if size < 200_000 and k + 1 < len(texts):
                continue
            ids, part, size = np.concatenate(part), [], 0
            ctx = np.zeros((len(ids), DIMS), np.int16)
            vec = index[ids]
            for d in range(1, NEAR + 1):
                ctx[d:] += vec[:-d]
                ctx[:-d] += vec[d:]
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            first = first[ids[first] < BUCKETS]
            if len(first):
                end = np.searchsorted(ids, BUCKETS)
                total[ids[first]] += np.add.reduceat(ctx[order][:end].astype(np.int32), first, axis=0)
    at = np.flatnonzero(total.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[at, k]) for k in range(DIMS))],
                                     names=["bucket", *(f"c{k}" for k in range(DIMS))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIMS) unit vectors from all texts."""
    sums = (docs.select("text").mapInArrow(_sums, "bucket int, " + ", ".join(f"c{k} long" for k in range(DIMS)))
            .groupBy("bucket").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(DIMS))))
    out = np.zeros((BUCKETS, DIMS), np.float32)
    for r in sums.collect():  # BUCKETS rows at most
        v = np.array(r[1:], float)
        out[r.bucket] = v / (np.linalg.norm(v) or 1)
    return out


N_FEATURES = 2 * DIMS + 1


def pooled(text: str | None, vectors: np.ndarray, buckets: Buckets) -> np.ndarray:
    ids = _ids(text, buckets)
    out = np.zeros(N_FEATURES, np.float32)
    if len(ids):
        mean, step = np.zeros(DIMS), np.zeros(DIMS)
        for i in range(0, len(ids), 65_536):  # bounded memory for very long texts
            v = vectors[ids[i:i + 65_537]]
            mean += v[:65_536].sum(0)
            step += np.abs(v[1:] - v[:-1]).sum(0)
        out[:DIMS], out[DIMS:-1], out[-1] = mean / len(ids), step / len(ids), np.log1p(len(ids))
    return out


def _pool(vectors: np.ndarray):
    def run(batches):
        buckets = Buckets()
        for b in batches:
            f = np.array([pooled(t, vectors, buckets) for t in b.column("text").to_pylist()], np.float32).reshape(-1)
            f = pa.FixedSizeListArray.from_arrays(pa.array(f, pa.float32()), N_FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), f], names=["doc_id", "held_out", "f"])
    return run


class Network:
    """Two layers, tanh between, fitted by Adam; a temperature on top."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = (x.mean(0), np.maximum(x.std(0), 1e-3)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
        base = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        self.w = [rng.normal(0, N_FEATURES ** -0.5, (N_FEATURES, HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.array(np.log(base / (1 - base)))]
        self.temperature = 1.0
        own = ~calibrate if calibrate.any() and (~calibrate).any() else np.ones(len(x), bool)
        self._fit(self._z(x[own]), y[own], rng)
        if calibrate.any() and 0 < y[calibrate].mean() < 1:
            logit, t = self._logit(self._z(x[calibrate])), np.geomspace(0.25, 4, 33)
            loss = [np.logaddexp(0, np.where(y[calibrate] > 0, -1, 1) * logit / s).mean() for s in t]
            self.temperature = float(t[int(np.argmin(loss))])

    def _z(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logit(self, z):
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def _fit(self, z, y, rng, rate=0.01, decay=1e-4, size=256):
        if not len(z) or y.min() == y.max():
            return
        m, v, k = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        for _ in range(max(EPOCHS, min(400, 20_000 * EPOCHS // len(z) // 8)) if len(z) < 5000 else EPOCHS):
            for at in np.array_split(rng.permutation(len(z)), max(1, len(z) // size)):
                h = np.tanh(z[at] @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - y[at]) / len(at)
                back = np.outer(d, self.w[2]) * (1 - h * h)
                grads = [z[at].T @ back + decay * self.w[0], back.sum(0), h.T @ d + decay * self.w[2], np.array(d.sum())]
                k += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9 ** k)) / (np.sqrt(v[i] / (1 - 0.999 ** k)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit(self._z(x)) / self.temperature, -30, 30)))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score for every row of docs (doc_id, text)."""
    vectors = word_vectors(docs)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), labelled.held_out(F.col("doc_id")).alias("held_out"), "text")
    pools = common.stage(src.mapInArrow(_pool(vectors), "doc_id long, held_out boolean, f array<float>"), "pools")
    rows = (pools.select("doc_id", "f").join(F.broadcast(labelled.fit_rows(labels, "quality")), "doc_id")
            .groupBy("doc_id", "label", "fold").agg(F.min("f").alias("f"))  # one row of an id that repeats
            .orderBy("doc_id").collect())  # at most FIT_ROWS rows
    x = np.array([r.f for r in rows], float).reshape(len(rows), N_FEATURES)
    y, at = np.array([r.label for r in rows], float), np.array([r.fold for r in rows], int)
    net = Network(x, y, at == CALIBRATION_FOLD)

    def run(batches):
        yield from labelled.scored(batches, lambda b: net.score(
            b.column("f").flatten().to_numpy().astype(float).reshape(b.num_rows, N_FEATURES)))
    return pools.mapInArrow(run, labelled.SCORED)
