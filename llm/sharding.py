"""Sharding by a histogram sort: near-equal bytes, equal texts side by side.

Rows sort by (hash of the text, doc_id, a fixed row number). Splitters are
found by counting: every round counts the exact bytes and rows below a grid of
candidate keys, in every partition and then summed, and narrows the interval
around each target until it holds less than the tolerance. Probes fall between
text hashes first, so a group of equal texts stays whole; only a group larger
than the tolerance is cut, by doc_id and then by row number. Beside the seven
splitters between shards, the search finds those of ``RANGES`` ranges of near
equal row counts, so that one exchange deals out even pieces however many
copies a text has. A row's slot is its rank in its range plus the exact count
of the shard's rows before the range, known from the counting.

Law ``bytes``: the shards' sizes are near equal. A null text has no bytes and
the hash of null; a null doc_id sorts before others; repeated rows each get a
slot; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 8
#: Share of a shard's mean size by which a splitter may miss its target.
TOLERANCE = 0.005
#: Candidate keys in the first round, and around each target in later ones.
PROBES, REFINE = 4096, 32
RANGES = 512
_HASHES = 1 << 62
_NO_ID = -(1 << 62)


class _Keys:
    """Keys (h, d, u) as one integer line, so intervals can be halved exactly."""

    def __init__(self, d0: int, d1: int, u1: int):
        self.d0, self.per_d, self.per_h = d0, u1 + 1, (d1 - d0 + 1) * (u1 + 1)

    def unpack(self, x: int) -> tuple[int, int, int]:
        h, rest = divmod(x, self.per_h)
        d, u = divmod(rest, self.per_d)
        return h, d + self.d0, u

    def grid(self, lo: int, hi: int, n: int) -> set[int]:
        """Up to n keys inside (lo, hi), between texts while that is possible."""
        for unit in (self.per_h, self.per_d, 1):
            a, b = lo // unit + 1, -(-hi // unit)  # multiples a..b-1 lie inside
            if b > a:
                step = max(1, (b - a) // n)
                return {k * unit for k in range(a, b, step)}
        return set()


def _locate(splits: list[tuple], first: tuple) -> callable:
    """How many splitters are at or below each key: numpy on the hashes,
    bisection only for texts that a splitter cuts."""
    hs = np.array([s[0] for s in splits], np.int64)
    cut = np.array(sorted({s[0] for s in splits if s[1:] != first}), np.int64)

    def of(h, d, u):
        cell = np.searchsorted(hs, h, side="right")
        for i in np.flatnonzero(np.isin(h, cut)):
            cell[i] = bisect_right(splits, (int(h[i]), int(d[i]), int(u[i])))
        return cell
    return of


def _below(rows: DataFrame, splits: list[tuple], first: tuple) -> list[tuple[int, int]]:
    """Exact (bytes, rows) below each splitter: every partition counts its
    cells, Spark sums them; the driver gets len(splits) + 1 rows."""
    cells = len(splits) + 1

    def count(batches):
        of = _locate(splits, first)
        size, n = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for b in batches:
            h, d, u, s = (b.column(c).to_numpy() for c in ("h", "d", "u", "size"))
            cell = of(h, d, u)
            np.add.at(size, cell, s)
            n += np.bincount(cell, minlength=cells)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(size[at]), pa.array(n[at])],
                                         names=["cell", "size", "n"])

    out = np.zeros((cells, 2), np.int64)
    got = (rows.select("h", "d", "u", "size").mapInArrow(count, "cell long, size long, n long")
           .groupBy("cell").agg(F.sum("size").alias("size"), F.sum("n").alias("n")))
    for r in got.collect():
        out[r.cell] = r["size"], r.n
    return [tuple(map(int, x)) for x in np.cumsum(out, axis=0)[:-1]]


def _splitters(rows: DataFrame, keys: _Keys, shards: int, ranges: int, size: int, n: int) -> tuple[dict, dict]:
    """(shard splitter -> counts, range splitter -> counts) on the key line."""
    first = (keys.d0, 0)
    top = _HASHES * keys.per_h
    known = {0: (0, 0), top: (size, n)}
    goals = [(0, size * k / shards, size / shards * TOLERANCE) for k in range(1, shards)]
    goals += [(1, n * k / ranges, max(1, n / ranges / 2)) for k in range(1, ranges)]
    probes = keys.grid(0, top, PROBES)
    found: dict[tuple, int] = {}
    while True:
        new = sorted(probes - known.keys())
        if new:
            known.update(zip(new, _below(rows, [keys.unpack(x) for x in new], first)))
        line = sorted(known)
        by = [[known[x][m] for x in line] for m in (0, 1)]
        probes = set()
        for goal in goals:
            if goal in found:
                continue
            m, want, slack = goal
            i = bisect_right(by[m], want)
            lo, hi = line[i - 1], line[min(i, len(line) - 1)]
            inside = keys.grid(lo, hi, REFINE) - known.keys()
            if known[hi][m] - known[lo][m] > slack and inside:
                probes |= inside
            else:
                found[goal] = min((lo, hi), key=lambda x: abs(known[x][m] - want))
        if not probes:
            break
    pick = lambda m: {x: known[x] for g, x in found.items() if g[0] == m}
    # The splitter of shard k, also where two targets meet in one giant row.
    return {k: known_at for k, known_at in enumerate(
        [(0, (0, 0)), *((found[g], known[found[g]]) for g in goals if g[0] == 0)])}, pick(1)


def shard(df: DataFrame, text_hash: Column, size: Column, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """df with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 within
    the shard), both by the law ``bytes``; they replace columns so named. df needs ``doc_id``; its rows move
    once, so pass only the columns that the shards are to hold."""
    cols = [c for c in df.columns if c not in ("shard", "slot")]
    rows = common.stage(df.select(
        F.struct(*cols).alias("row"), F.shiftrightunsigned(text_hash, 2).alias("h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("d"),
        F.monotonically_increasing_id().alias("u"), size.cast("long").alias("size")), "shard")
    t = rows.agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.max("u").alias("u1"),
                 F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).first()
    keys = _Keys(t.d0 or 0, t.d1 or 0, t.u1 or 0)
    by_shard, by_range = _splitters(rows, keys, shards, ranges, t["size"] or 0, t.n) if t.n else ({0: (0, (0, 0))}, {})
    # Ranges begin at every splitter; each lies in one shard.
    begin = {0: (0, 0)} | by_range | {x: c for x, c in by_shard.values()}
    line = sorted(begin)
    starts = [x for x, _ in by_shard.values()]
    of_range = np.array([bisect_right(starts, x) - 1 for x in line], np.int32)
    base = np.array([begin[x][1] - by_shard[s][1][1] for x, s in zip(line, of_range.tolist())], np.int64)
    splits, first = [keys.unpack(x) for x in line[1:]], (keys.d0, 0)

    @F.pandas_udf("piece int, shard int, base long")
    def place(h: pd.Series, d: pd.Series, u: pd.Series) -> pd.DataFrame:
        at = _locate(splits, first)(h.to_numpy(), d.to_numpy(), u.to_numpy())
        return pd.DataFrame({"piece": at, "shard": of_range[at], "base": base[at]})

    rank = F.row_number().over(Window.partitionBy("at.piece").orderBy("h", "d", "u"))
    return (rows.select("row", "h", "d", "u", place("h", "d", "u").alias("at"))
            .select("row", F.col("at.shard").alias("shard"), (F.col("at.base") + rank - 1).alias("slot"))
            .select(*[F.col("row").getField(c).alias(c) for c in cols], "shard", "slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Whole documents with their shard and slot."""
    return shard(docs, F.xxhash64("text"), text_size(F.col("text")), shards)


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
