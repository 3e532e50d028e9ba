"""Best-fit packing of documents into sequences, with certified counts.

Documents become token ids and an end id; only those longer than a sequence are
cut, into whole sequences and a shorter last piece. Whole pieces are sequences
of their own. The others are dealt to partitions of some ``PART`` pieces by the
hash of a row id, and each partition is packed best-fit decreasing. Dual
feasible functions over the partition's lengths bound its sequences from below: a
partition whose count meets the bound is certified, no order of its own pieces
does better. It keeps all but its emptiest sequence (what rounding up left
open) if its volume makes the bound, and its full sequences if long pieces make
it, for shorter pieces of other partitions may fill the rest. A partition with
a gap gives up all. What is given up is exchanged: dealt anew over fewer and
larger partitions, and packed again. A round counts only if it needs fewer
sequences than it took apart; the rounds end there, or where the total meets
the bound over all lengths.

No partition grows with the input: their number does. The driver sees sums and
a histogram of at most ``capacity`` lengths.

A null text is an empty one: it has the end id alone. Rows with equal doc_id
are separate documents. Further columns are left aside by ``token_pieces`` and
carried along by ``pack``, whatever their names. Texts of any length are read
whole. Ties (equal lengths) fall to the smaller row id. An empty table gives no
rows.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, word_tokens

CAPACITY, END = 4096, 1
#: Pieces of a partition, about; each exchange doubles them, up to the second
#: number. Rounds at most.
PART, MOST_PART, ROUNDS = 4096, 65_536, 12
#: k of the rounding functions u(k) that bound a partition.
ROUNDINGS = range(1, 33)
SEED = 11
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- documents to pieces -----------------------------------------------------

def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids (n is 1 or more)."""
    return [(s, min(capacity, n - s)) for s in range(0, n, capacity)]


def _counter(spec: str) -> word_tokens.WordTokens:
    """One for each Python worker and vocabulary: its table of words stays warm."""
    home = sys.modules.setdefault("_llm_word_tokens", types.ModuleType("_llm_word_tokens")).__dict__
    if spec not in home:
        home[spec] = word_tokens.WordTokens(spec)
    return home[spec]


def _tokenize(spec, capacity: int, end: int, keep_ids: bool):
    last = np.array([end], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _counter(spec.value)
        for b in batches:
            ids, offs = words.batch(b.column("text"))
            ids = ids.astype("<u4", copy=False)
            rows, kept = [], []
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                own = ids[offs[i]:offs[i + 1]]
                for k, (s, n) in enumerate(piece_bounds(len(own) + 1, capacity)):
                    part, closes = own[s:s + n], s + n > len(own)
                    crc = zlib.crc32(part)
                    rows.append((doc, k, s, n, zlib.crc32(last, crc) if closes else crc))
                    if keep_ids:
                        kept.append(np.concatenate([part, last]) if closes else part)
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5,
                                                   (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def token_pieces(docs: DataFrame, spec: str, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32
    (crc32 of the ids as little-endian 32-bit words) and, if asked for, the
    ``ids`` themselves. spec: a tokenizers vocabulary as JSON, of fixed size."""
    given = docs.sparkSession.sparkContext.broadcast(spec)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .mapInArrow(_tokenize(given, capacity, end, ids), _PIECES + (", ids array<long>" if ids else "")))


# --- bounds and packing ------------------------------------------------------

def lower_bound(counts: np.ndarray) -> int:
    """Sequences that ``counts[x]`` pieces of length x (0 to the capacity) need
    at least: the largest bound by two families of dual feasible functions over
    lengths as shares of a sequence. f(a) takes lengths above 1 - a as whole
    and those below a as nothing; u(k) rounds to multiples of 1 / k unless
    (k + 1) times the length is whole."""
    cap = len(counts) - 1
    x = np.arange(cap + 1, dtype=np.int64)
    number = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])  # pieces of x or longer
    volume = np.concatenate([np.cumsum((counts * x)[::-1])[::-1], [0]])
    a = np.arange(0, cap // 2 + 1)
    whole = number[cap - a + 1]
    best = int((whole + -(-(volume[a] - volume[cap - a + 1]) // cap)).max())
    for k in ROUNDINGS:
        exact = (x * (k + 1)) % cap == 0
        share = np.where(exact, x * k, (x * (k + 1)) // cap * cap)  # times k * cap
        best = max(best, -(-int((counts * share).sum()) // (k * cap)))
    return best


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """A bin for each length, given in descending order: the fullest bin that
    still has room, else a new one. Bins wait in a list per room left; a mask
    of the non-empty lists gives the next one up at once."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, out = 0, 0, []
    for n in lengths:
        up = mask >> n
        if up:
            room = n + (up & -up).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, bins
            bins += 1
        out.append(b)
        room -= n
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return out


def _pack_part(part: int, lengths: np.ndarray, capacity: int, round_no: int):
    """(order, sequence_id, offset, open, bins, bound) of one partition."""
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    at = np.array(best_fit(size.tolist(), capacity), np.int64)
    bins = int(at.max()) + 1
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1))
    fill = np.bincount(at, size, bins).astype(np.int64)
    loose = np.ones(bins, bool)
    if bins == bound:
        loose = fill < capacity
        if bound == -(-int(size.sum()) // capacity):
            loose &= np.arange(bins) == fill.argmin()
    by_bin = np.argsort(at, kind="stable")
    before = np.cumsum(size[by_bin]) - size[by_bin]
    first = np.searchsorted(at[by_bin], np.arange(bins))
    offset = np.empty(len(at), np.int64)
    offset[by_bin] = before - before[first][at[by_bin]]
    ids = (np.int64(round_no) << 56) | (np.int64(part) << 20) | at
    return order, ids, offset, loose[at], bins, bound


def _packer(capacity: int, round_no: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pk_uid")
        part = rows.column("pk_part")[0].as_py()
        order, ids, offset, loose, bins, bound = _pack_part(part, rows.column("pk_length").to_numpy(), capacity, round_no)
        once = np.arange(len(order)) == 0  # a partition's counts stand in its first row
        rows = rows.take(pa.array(order))
        for name, values in (("pk_sequence", ids), ("pk_offset", offset), ("pk_open", loose),
                             ("pk_bins", once * bins), ("pk_bound", once * bound)):
            rows = rows.append_column(name, pa.array(values))
        return rows
    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, part: int = PART, rounds: int = ROUNDS, length: str = "length") -> DataFrame:
    """pieces (1 to ``capacity`` long by the column ``length``) with ``sequence_id`` and
    ``offset``, gapless from 0 within a sequence. Columns of these names, if any, are replaced."""
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    own = {f"pk_c{i}": c for i, c in enumerate(names)}
    rows = common.stage(pieces.select(F.monotonically_increasing_id().alias("pk_uid"), F.col(length).cast("long").alias("pk_length"),
                                      *(F.col(c).alias(k) for k, c in own.items())), "pieces")
    by_length = {r.pk_length: r.n for r in rows.groupBy("pk_length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 0 < (n or 0) <= capacity for n in by_length):
        raise ValueError(f"lengths must be 1 to {capacity}")
    need = np.zeros(capacity + 1, np.int64)
    for n, count in by_length.items():
        need[n] = count
    target = lower_bound(np.concatenate([need[:capacity], [0]]))
    whole = rows.where(F.col("pk_length") == capacity).select(*own, (-1 - F.col("pk_uid")).alias("pk_sequence"), F.lit(0).cast("long").alias("pk_offset"))
    todo, left = rows.where(F.col("pk_length") < capacity), int(need[:capacity].sum())
    done, loose, taken, closed = [whole], None, None, 0
    for k in range(rounds):
        if not left:
            break
        packed = _round(todo, left, capacity, max(part, min(part << k, MOST_PART)), k)
        got = packed.agg(F.sum("pk_bins").alias("bins"), F.sum(F.col("pk_open").cast("long")).alias("left"),
                         F.count_distinct(F.when(F.col("pk_open"), F.col("pk_sequence"))).alias("open")).first()
        if loose is not None and got.bins >= taken:
            break  # the exchange did not pay: what it took apart stays as it was
        done.append(packed.where(~F.col("pk_open")))
        loose, taken, left = packed.where("pk_open"), got.open, got.left
        closed += got.bins - got.open
        if closed + taken <= target:
            break
        todo = loose.select("pk_uid", "pk_length", *own)
    out = [d.select(*own, "pk_sequence", "pk_offset") for d in [*done, *([loose] if loose is not None else [])]]
    both = out[0]
    for d in out[1:]:
        both = both.unionAll(d)
    return both.select(*(F.col(k).alias(c) for k, c in own.items()), F.col("pk_sequence").alias("sequence_id"), F.col("pk_offset").alias("offset"))


def _round(todo: DataFrame, left: int, capacity: int, part: int, k: int) -> DataFrame:
    parts = -(-left // part)
    dealt = todo.withColumn("pk_part", F.pmod(F.xxhash64(F.lit(SEED + k), "pk_uid"), F.lit(parts)))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return common.stage(dealt.groupBy("pk_part").applyInArrow(
        _packer(capacity, k), kind + ", pk_sequence long, pk_offset long, pk_open boolean, pk_bins long, pk_bound long"), "packed")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences, lower bound over all lengths) of what ``pack`` returned."""
    need = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most capacity rows
        need[r.length] = r.n
    return packed.select("sequence_id").distinct().count(), lower_bound(need)
