"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of word shingles. Documents with the same word sequence
are one class first. Each class has ``TOKENS`` minwise tokens (minhash values)
that steer it and a sketch of ``SKETCH`` one-byte minhashes to compare by.

Each of ``TREES`` trees branches recursively: at each node a document follows
``CHILDREN`` minwise tokens that the node's path chooses from the ``POOL`` of
its level (the roots have their own), so two documents of similarity s meet in
a child with probability s for each. Nodes of at most
``LEAF`` members, and larger ones that hardly shrink any more (one family of
near copies), are compared exhaustively by sketch, the larger ones in pairs of
blocks. All four trees miss a pair at 0.85 in 0.3 of a million cases where the
nodes below the roots are small, 1.9 of a million at depth 2 and 3.3 at depth
8; a pair at 0.80 in 2.6, 20 and 49 of a million (computed for independent
minhashes; nodes of a level that share tokens are part of the figures).

A leaf reports a spanning forest of its candidates, not all pairs. A candidate
is a pair whose sketch estimate is above a cut that all trees share; it refuses
at most ``REFUSED`` (1 of 10 million) of the pairs at the threshold, fewer
above it, which adds to what the trees miss. Every reported
pair is confirmed on the full shingle sets. Where a forest edge fails, its leaf
is looked at again: the members that still have a candidate in another
component come together with their sets and are compared exactly, best
estimate first, each pair in one leaf only and only while it is unconnected. So
every candidate is confirmed, refused on full sets, or inside one component.

Nulls and texts without words: no shingles, linked with nothing, kept. Fewer
words than a shingle: the whole sequence is one shingle. Null doc_ids: an
all-null group has component null. Repeated rows are copies of each other.
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE, THRESHOLD = 5, 80  # defaults; percent of the union
TREES, CHILDREN, LEAF = 4, 2, 512
#: Levels of a tree, and tokens from which the nodes of a level below the roots choose.
DEPTH, POOL = 8, 16
TOKENS, SKETCH = TREES * CHILDREN + (DEPTH - 1) * POOL, 128
#: A child that holds this share of its parent is one family, not a crowd.
FAMILY = 0.6
#: Share of the pairs at the threshold that the sketch may refuse unseen.
REFUSED = 1e-7
_SEED = 8


class WordHashes(dict):
    """64-bit hashes of words, kept for the words of late; bounded."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def shingles(words: list, width: int, hashes: dict) -> np.ndarray:
    """The distinct 64-bit hashes of runs of ``width`` words, sorted."""
    if not words:
        return np.empty(0, np.uint64)
    a = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    k = min(width, len(a))
    h = np.full(len(a) - k + 1, 0x9E3779B97F4A7C15 * k & (1 << 64) - 1, np.uint64)
    for i in range(k):
        h = (h ^ a[i:len(a) - k + 1 + i]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def _words(text: str | None) -> list:
    return (text or "").encode().lower().split()  # ASCII white space and letters only


def _minhashes(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    out = np.full(len(mul), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(s), 512):  # bounded memory for very long texts
        x = mul[:, None] * s[i:i + 512]
        x += add[:, None]
        np.minimum(out, x.min(axis=1), out=out)
    return out >> np.uint64(32)


def _signatures(width: int):
    def run(batches):
        hashes = WordHashes()
        rng = np.random.default_rng(_SEED)
        mul = rng.integers(0, 1 << 63, TOKENS + SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 1 << 63, TOKENS + SKETCH, np.uint64)
        for b in batches:
            n, c1, c2, tok, sk, last = [], [], [], [], [], {}
            for t in b.column("text").to_pylist():
                words = _words(t)
                key = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                if key not in last:
                    s = shingles(words, width, hashes)
                    m = _minhashes(s, mul, add)
                    last[key] = (len(s), m[:TOKENS].astype(np.uint32).view(np.int32).tolist(),
                                 (m[TOKENS:] & np.uint64(255)).astype(np.uint8).tobytes())
                for out, x in zip((n, tok, sk), last[key]):
                    out.append(x)
                for out, x in zip((c1, c2), struct.unpack("<qq", key)):
                    out.append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(c1, pa.int64()),
                 pa.array(c2, pa.int64()), pa.array(tok, pa.list_(pa.int32())), pa.array(sk, pa.binary())],
                names=["doc_id", "th", "n", "c1", "c2", "tok", "sk"])
    return run


def _children(depth: int, path=None):
    """The paths a document takes from a node of ``depth`` (0: the roots)."""
    if path is None:  # the roots of all trees
        return F.array(*[F.struct(F.lit(i // CHILDREN).alias("tree"), F.xxhash64(F.lit(i), F.get("tok", F.lit(i))).alias("path"))
                         for i in range(TREES * CHILDREN)])
    # Each node draws distinct tokens of its level by its path, so that the
    # nodes of a level do not all lose a pair on the same tokens.
    first = TREES * CHILDREN + (depth - 1) * POOL
    start = F.pmod(F.col(path), F.lit(POOL))
    step = F.pmod(F.shiftrightunsigned(F.col(path), 32), F.lit(POOL - 1)) + 1
    return F.array(*[F.struct(F.col("tree"), F.xxhash64(F.col(path), F.lit(j), F.get(
        F.col("tok"), (F.pmod(start + step * j, F.lit(POOL)) + first).cast("int"))).alias("path")) for j in range(CHILDREN)])


def _leaves(reps: DataFrame) -> DataFrame:
    """(leaf, members): groups of at most two blocks to compare exhaustively."""
    count = reps.count()
    level = reps.select("rid", F.explode(_children(0)).alias("c")).select("rid", "c.*")
    done = []
    for depth in range(1, DEPTH + 1):
        level = common.stage(level, "level")
        sizes = (level.groupBy("tree", "path", *(["parent"] if depth > 1 else [])).agg(F.count(F.lit(1)).alias("size"))
                 .where("size > 1"))
        sizes = sizes if depth > 1 else sizes.withColumn("parent", F.lit(count).cast("long"))
        crowd = (F.col("size") > LEAF) & (F.col("size") < FAMILY * F.col("parent")) & F.lit(depth < DEPTH)
        sizes = common.stage(sizes.withColumn("crowd", crowd).drop("parent"), "sizes")
        done.append(level.select("rid", "tree", "path").join(sizes.where("not crowd"), ["tree", "path"]).select("rid", "path", "size"))
        if not sizes.where("crowd").limit(1).count():
            break
        level = (level.select("rid", "tree", "path").join(sizes.where("crowd").drop("crowd"), ["tree", "path"])
                 .join(reps.select("rid", "tok"), "rid")
                 .select("rid", F.col("size").alias("parent"), F.explode(_children(depth, "path")).alias("c"))
                 .select("rid", "parent", "c.*"))
    members = done[0]
    for x in done[1:]:
        members = members.unionAll(x)
    blocks = F.ceil(F.col("size") / LEAF).cast("int")
    mine = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda j: F.xxhash64(F.col("path"), F.least(F.col("mine"), j), F.greatest(F.col("mine"), j)))
    placed = (members.withColumn("blocks", blocks).withColumn("mine", mine)
              .select("rid", F.explode(pairs).alias("leaf")))
    return (placed.join(reps.select("rid", "n", "sk"), "rid")
            .groupBy("leaf").agg(F.collect_list(F.struct("rid", "n", "sk")).alias("members"))
            .where(F.size("members") > 1))


def _find(up, i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def _similar(n: np.ndarray, sk: np.ndarray, least: float, ratio: float):
    """Index pairs (i < j) whose estimate reaches ``least``, best first."""
    out_i, out_j, out_e = [], [], []
    for i in range(len(n) - 1):
        est = (sk[i + 1:] == sk[i]).mean(axis=1)
        ok = (est >= least) & (np.minimum(n[i + 1:], n[i]) >= ratio * np.maximum(n[i + 1:], n[i]))
        j = np.flatnonzero(ok)
        out_i.append(np.full(len(j), i))
        out_j.append(j + i + 1)
        out_e.append(est[j])
    i, j, e = (np.concatenate(x) for x in (out_i, out_j, out_e))
    order = np.lexsort((j, i, -e))
    return i[order], j[order]


def _estimates(percent: int) -> tuple[float, float]:
    """(least estimate of a candidate, least ratio of the set sizes). The
    estimate is the lowest that leaves a binomial tail of at most ``REFUSED``."""
    p = percent / 100
    agree = p + (1 - p) / 256  # other minhashes share a byte by chance
    least, tail = 0, 0.0
    while least < SKETCH:
        tail += math.comb(SKETCH, least) * agree ** least * (1 - agree) ** (SKETCH - least)
        if tail > REFUSED:
            break
        least += 1
    return least / SKETCH, p - 1e-9


def _unpack(members, extra: tuple = ()) -> list:
    """Columns rid, n, sketch and extra ones of a leaf, by rid."""
    rid, n = (members.field(x).to_numpy(zero_copy_only=False) for x in ("rid", "n"))
    sk = np.frombuffer(b"".join(members.field("sk").to_pylist()), np.uint8).reshape(len(rid), SKETCH)
    order = np.argsort(rid)
    more = [members.field(x).to_pylist() for x in extra]
    return [rid[order], n[order], sk[order], *([m[i] for i in order] for m in more)]


def _forest(percent: int):
    """Leaves to the edges of a best spanning forest of their candidates."""
    least, ratio = _estimates(percent)

    def run(batches):
        for b in batches:
            leaf, left, right = [], [], []
            for k in range(b.num_rows):
                rid, n, sk = _unpack(b.column("members")[k].values)
                up = list(range(len(rid)))
                for i, j in zip(*_similar(n, sk, least, ratio)):
                    x, y = _find(up, int(i)), _find(up, int(j))
                    if x != y:
                        leaf.append(b.column("leaf")[k].as_py())
                        left.append(int(rid[i]))
                        right.append(int(rid[j]))
                        up[x] = y
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (leaf, left, right)], names=["leaf", "a", "b"])
    return run


_EDGE = "leaf long, a long, b long"


def _open_pairs(leaf: int, rid, n, sk, root, homes, failed: set, percent: int) -> list[tuple[int, int]]:
    """A leaf's candidates between components that were not refused, best
    first; of a pair's common leaves only the least looks at it."""
    homes = [set(h) for h in homes]
    return [(i, j) for i, j in zip(*(x.tolist() for x in _similar(n, sk, *_estimates(percent))))
            if root[i] != root[j] and (int(rid[i]), int(rid[j])) not in failed and min(homes[i] & homes[j]) == leaf]


def _still_open(percent: int):
    """Leaves to the members that their open pairs need."""
    def run(batches):
        for b in batches:
            leaf, out = [], []
            for k in range(b.num_rows):
                rid, n, sk, root, homes = _unpack(b.column("members")[k].values, ("root", "homes"))
                f = b.column("failed")[k].values
                failed = set(zip(f.field("a").to_pylist(), f.field("b").to_pylist()))
                here = b.column("leaf")[k].as_py()
                need = sorted({x for p in _open_pairs(here, rid, n, sk, root, homes, failed, percent) for x in p})
                leaf += [here] * len(need)
                out += [int(rid[x]) for x in need]
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(out, pa.int64())], names=["leaf", "rid"])
    return run


def _same(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _settle(percent: int):
    """One leaf's needed members with their sets to the links it finds."""
    least, ratio = _estimates(percent)

    def run(key, pdf):
        pdf = pdf.sort_values("rid").reset_index(drop=True)
        rid, root = pdf["rid"].to_numpy(), pdf["root"].to_numpy()
        sk = np.frombuffer(b"".join(pdf["sk"]), np.uint8).reshape(len(rid), SKETCH)
        sets = [np.frombuffer(x, np.uint64) for x in pdf["s"]]
        homes = [set(h) for h in pdf["homes"]]
        up = {r: r for r in root.tolist()}
        out = []
        for i, j in zip(*_similar(pdf["n"].to_numpy(), sk, least, ratio)):
            x, y = _find(up, int(root[i])), _find(up, int(root[j]))
            if x != y and min(homes[i] & homes[j]) == key[0] and _same(sets[i], sets[j], percent):
                up[x] = y
                out.append((int(rid[i]), int(rid[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def _sets(width: int):
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            sets = [(shingles(_words(t), width, hashes)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(sets, pa.binary())], names=["rid", "s"])
    return run


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist()):
                ok.append(_same(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok)], names=["a", "b", "ok"])
    return run


def _shingle_sets(rids: DataFrame, docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(rid, s): the shingle sets of the classes asked for. Only their texts
    move: a fixed-size Bloom filter drops most others at the scan, and a join on
    (doc_id, hash of the text) is exact."""
    ends = common.stage(rids.distinct().join(reps.select("rid", "doc", "th"), "rid"), "ends")
    texts = docs.select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc"), F.xxhash64("text").alias("th"), "text")
    texts = texts.where(common.bloom_udf(ends.select(F.col("th").alias("h")))(F.col("th")))
    return (texts.join(ends, ["doc", "th"]).select("rid", "text")
            .mapInArrow(_sets(width), "rid long, s binary").dropDuplicates(["rid"]))


def _confirmed(edges: DataFrame, docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, ok) for distinct edges, on the full shingle sets of both ends."""
    edges = edges.select("a", "b").distinct()
    ends = edges.select(F.col("a").alias("rid")).unionAll(edges.select(F.col("b").alias("rid")))
    sets = _shingle_sets(ends, docs, reps, width)
    a, b = (sets.select(F.col("rid").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    return edges.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "a long, b long, ok boolean")


def _more_links(leaves: DataFrame, forest: DataFrame, first: DataFrame, docs: DataFrame, reps: DataFrame,
                width: int, percent: int) -> DataFrame:
    """(a, b): links that join components which failed forest edges left apart."""
    failed = forest.join(first.where("not ok").drop("ok"), ["a", "b"]).groupBy("leaf").agg(
        F.collect_list(F.struct("a", "b")).alias("failed"))
    members = leaves.join(failed.select("leaf"), "leaf", "left_semi").select("leaf", F.explode("members").alias("m")).select("leaf", "m.*")
    roots = components(first.where("ok")).select(F.col("v").alias("rid"), F.col("u").alias("root"))
    homes = members.groupBy("rid").agg(F.collect_list("leaf").alias("homes"))
    homes = homes.join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    members = common.stage(members.join(homes, "rid"), "again")
    again = members.groupBy("leaf").agg(F.collect_list(F.struct("rid", "n", "sk", "root", "homes")).alias("members"))
    need = common.stage(again.join(failed, "leaf").mapInArrow(_still_open(percent), "leaf long, rid long"), "open")
    sets = _shingle_sets(need.select("rid"), docs, reps, width)
    return (members.join(need, ["leaf", "rid"]).join(sets, "rid").select("leaf", "rid", "n", "sk", "root", "homes", "s")
            .groupBy("leaf").applyInPandas(_settle(percent), "a long, b long"))


_NULL = (1 << 63) - 1


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, th (hash of the text),
    n_shingles, component_id (the smallest doc_id linked with it over any
    number of links, itself included), kept (no text in its group has a smaller
    doc_id, ids before none, or of equal ones a smaller th)."""
    with common.scope(docs.sparkSession):
        return common.stage(_near_duplicates(docs, width, percent), "components", keep=True)


def _near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    rows = common.stage(src.mapInArrow(
        _signatures(width), "doc_id long, th long, n long, c1 long, c2 long, tok array<int>, sk binary"), "signed")
    own = F.struct(F.coalesce("doc_id", F.lit(_NULL)).alias("doc"), "th")
    reps = (rows.where("n > 0").groupBy("c1", "c2")
            .agg(F.min(own).alias("own"), F.first("n").alias("n"), F.first("tok").alias("tok"), F.first("sk").alias("sk")))
    reps = common.stage(reps.select(F.monotonically_increasing_id().alias("rid"), "c1", "c2", "own.doc", "own.th", "n", "tok", "sk"), "reps")
    leaves = common.stage(_leaves(reps), "leaves")
    forest = common.stage(leaves.mapInArrow(_forest(percent), _EDGE), "forest")
    first = common.stage(_confirmed(forest, docs, reps, width, percent), "confirmed")
    links = first.where("ok").drop("ok")
    if first.where("not ok").limit(1).count():
        links = links.unionAll(common.stage(_more_links(leaves, forest, first, docs, reps, width, percent), "more"))
    roots = components(links.select("a", "b"))
    named = (reps.select("rid", "c1", "c2", F.struct("doc", "th").alias("own")).join(roots.withColumnRenamed("v", "rid"), "rid", "left")
             .withColumn("root", F.coalesce("u", "rid")))
    group = named.groupBy("root").agg(F.min("own").alias("least"))
    classes = named.join(group, "root").select("c1", "c2", "least")
    out = rows.select("doc_id", "th", "n", "c1", "c2").join(classes, ["c1", "c2"], "left")
    alone = F.col("n") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.nullif("least.doc", F.lit(_NULL)))
    kept = alone | ((F.coalesce("doc_id", F.lit(_NULL)) == F.col("least.doc")) & (F.col("th") == F.col("least.th")))
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def kept_documents(docs: DataFrame, width: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """docs without near duplicates: of each group one row stays, that with the
    smallest doc_id (rows without one come last), then the smallest hash of the
    text; equal rows are one. Texts without words all stay."""
    keys = ["d", "t"]
    flags = common.stage(near_duplicates(docs, width, percent).where("n_shingles > 0").select(
        F.coalesce("doc_id", F.lit(_NULL)).alias("d"), F.col("th").alias("t"), "kept"), "flags")
    drop = flags.where(~F.col("kept")).select(*keys).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("d"), F.xxhash64("text").alias("t"))
    again = common.stage(flags.where("kept").groupBy(*keys).count().where("count > 1").select(*keys), "again")
    if not again.limit(1).count():
        return keyed.join(drop, keys, "left_anti").select("row.*")
    one = keyed.join(again, keys, "left_semi").dropDuplicates(keys)
    return keyed.join(drop.unionAll(again), keys, "left_anti").unionAll(one).select("row.*")
