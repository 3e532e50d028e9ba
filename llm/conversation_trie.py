"""Conversation prefix trie: shared beginnings of conversations as tree nodes.

A turn's id is the first 16 bytes of the SHA-256 of its role and text, so texts
are read once and never shuffled. A rebuilt conversation is the key of its turn
ids in order; equal keys are counted before anything else, so a conversation
that a third of all others repeat is one key. Keys are range-partitioned and
sorted, and each block of some ``BLOCK`` keys goes into an adaptive radix tree
(``radix``): branches by byte, one edge per unbranched run. Only byte depths
that are whole turns are nodes of the trie.

A node that lies on the path of neither the first nor the last key of its block
is in no other block: its row is final. The others are open: their parts are
summed by node id, and what they count of each other (children, leaves, saved
tokens) is added along their ancestors. A block has at most two paths of open
nodes, however many share a first turn.

Long conversations are cut into segments of ``SEGMENT`` turns: a key is then
the id of the node where the segment begins, and the segment's turns. Segments
are counted deepest first, each handing what lies below it to the node it hangs
from, so no row or group grows with a conversation.

Positions come from a range-partitioned sort by (conv_id, turn, id), with one
note a partition for a conversation that crosses its border. The conv_ids that
end at a node are hashed in sorted runs; a node that many end at is hashed from
bounded pieces of text in order.

Null role or text read as ''; a null turn comes first; equal turns are ordered
by their ids, so repeated rows are repeated turns. Rows without a conv_id
belong to no conversation. Further columns are left aside. An empty table has
no root and gives no rows. Texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, radix

WIDTH = 16
#: Turns of a segment; keys and bytes of a block; conv_ids of a piece of text.
SEGMENT, BLOCK, BLOCK_BYTES, RUN = 256, 20_000, 8 << 20, 4096
#: The rebuilding rule (fixed values of the task).
GROUP, HEADS = 20, 4
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """32 hex digits; the length of the role keeps it apart from the text."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.left(F.sha2(whole.cast("binary"), 256), F.lit(2 * WIDTH))


def _parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- positions ---------------------------------------------------------------

def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with their place within its run of one conv_id."""
    piece, last, count = TaskContext.get().partitionId(), None, 0
    for b in batches:
        conv = b.column("conv_id").to_numpy()
        if not len(conv):
            continue
        new = np.concatenate([[True], conv[1:] != conv[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
        pos = np.arange(len(conv)) - start
        if last == conv[0]:
            pos[start == 0] += count
        last, count = conv[-1], int(pos[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id"), pa.array(pos, pa.int64()), b.column("tid"), b.column("words"), pa.array(np.full(len(conv), piece), pa.int32())],
            names=["conv_id", "pos", "tid", "words", "piece"])


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, tid, words) with pos from 0 in each conversation."""
    spark = turns.sparkSession
    narrow = common.stage(turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        turn_id(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("tid"),
        common.word_count(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("uid")), "turns")
    order = ["conv_id", "turn", "tid", "uid"]  # uid: equal rows are split, too
    rows = common.stage(narrow.repartitionByRange(_parts(spark), *order).sortWithinPartitions(*order)
                        .mapInArrow(_number, "conv_id long, pos long, tid string, words long, piece int"), "numbered")
    notes = (rows.groupBy("piece").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos")).alias("last"))
             .orderBy("piece").collect())  # one a partition
    offsets, conv, count = [], None, 0
    for r in notes:
        offset = count if conv == r.first else 0
        if offset:
            offsets.append((r.piece, r.first, offset))
        count = r.last.pos + 1 + (offset if r.first == r.last.conv_id else 0)
        conv = r.last.conv_id
    moved = spark.createDataFrame(offsets, "piece int, conv_id long, moved long")
    return (rows.join(F.broadcast(moved), ["piece", "conv_id"], "left")
            .select("conv_id", (F.col("pos") + F.coalesce("moved", F.lit(0))).alias("pos"), "tid", "words"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, tid, words) of the rebuilt conversations, and one row
    without a tid for every conversation, turnless ones included."""
    rows = common.stage(numbered(turns), "positions")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = (rows.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS - 1)).groupBy(F.col("conv_id").alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", "tid", "words"))).alias("head")))
    kept = rows.select("conv_id", "pos", "tid", "words", h.alias("h"), base.alias("base"))
    own = (kept.where(F.col("pos") >= F.col("h")).join(heads.select("base", F.size("head").alias("n")), "base", "left")
           .select("conv_id", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0)))).alias("pos"), "tid", "words"))
    convs = kept.where("pos = 0")
    lent = (convs.join(heads, "base").select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("h").cast("int"))).alias("t"))
            .select("conv_id", "t.pos", "t.tid", "t.words"))
    none = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("tid"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(lent).unionByName(none)


# --- keys --------------------------------------------------------------------

def _node_id(root: Column, ids: Column) -> Column:
    return F.left(F.unhex(F.sha2(F.concat(root, F.unhex(F.sha2(ids, 256))), 256)), F.lit(WIDTH))


def _path_ids(root: bytes, ids: bytes) -> list[bytes]:
    """Node ids at turn depths 0, 1, ... of a key (the same rule in Python);
    depth 0 of a later segment is the node that it hangs from."""
    def node(digest: bytes) -> bytes:
        return hashlib.sha256(root + digest).digest()[:WIDTH]
    h = hashlib.sha256()
    out = [root or node(h.digest())]
    for i in range(0, len(ids), WIDTH):
        h.update(ids[i:i + WIDTH])
        out.append(node(h.copy().digest()))
    return out


def _segments(rows: DataFrame, segment: int) -> DataFrame:
    """(conv_id, seg, ids, words, ends): ids as one binary of fixed-width ids."""
    turn = F.when(F.col("tid").isNotNull(), F.struct("pos", "tid", "words"))
    segs = (rows.withColumn("seg", F.floor(F.col("pos") / segment).cast("int")).groupBy("conv_id", "seg")
            .agg(F.array_sort(F.collect_list(turn)).alias("ts"))
            .select("conv_id", "seg", F.unhex(F.array_join(F.transform("ts", lambda t: t["tid"]), "")).alias("ids"),
                    F.transform("ts", lambda t: t["words"]).alias("words")))
    segs = common.stage(segs, "segments")
    more = segs.where("seg > 0").select("conv_id", (F.col("seg") - 1).alias("seg"), F.lit(False).alias("ends"))
    return segs.join(more, ["conv_id", "seg"], "left").withColumn("ends", F.coalesce("ends", F.lit(True)))


# --- conv_ids that end at a node -----------------------------------------------

_ENDS = "nid binary, first long, ids string, sha string"


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (nid, conv_id) sorted: the hash of each node's ids. Those of the
    partition's first and last node, and of nodes with many, go on as pieces
    of text with their first conv_id."""
    node, held, pieces, count = None, [], True, 0

    def out(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, (pa.binary(), pa.int64(), pa.string(), pa.string()))],
            names=["nid", "first", "ids", "sha"])

    def text(ids):
        return ",".join(map(str, ids))

    for b in batches:
        rows = []
        for nid, conv in zip(b.column("nid").to_pylist(), b.column("conv_id").to_pylist()):
            if nid != node:
                if held:
                    rows.append((node, held[0], text(held), None) if pieces else
                                (node, None, None, hashlib.sha256(text(held).encode()).hexdigest()))
                pieces = count == 0
                node, held, count = nid, [], count + 1
            held.append(conv)
            if len(held) >= RUN:
                rows.append((node, held[0], text(held), None))
                held, pieces = [], True
        yield out(rows)
    if held:
        yield out([(node, held[0], text(held), None)])


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of text, by node and in order, to the node's hash."""
    node, sha = None, None
    for b in batches:
        done = []
        for nid, ids in zip(b.column("nid").to_pylist(), b.column("ids").to_pylist()):
            if nid != node:
                if sha is not None:
                    done.append((node, sha.hexdigest()))
                node, sha = nid, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield _digests(done)
    if sha is not None:
        yield _digests([(node, sha.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    nid, sha = list(zip(*rows)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(nid, pa.binary()), pa.array(sha, pa.string())], names=["nid", "sha"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(nid, sha): SHA-256 of each node's conv_ids, ascending, comma-joined."""
    n = _parts(ends.sparkSession)
    order = ["nid", "conv_id"]
    runs = common.stage(ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_hash_runs, _ENDS), "ends")
    joined = (runs.where("sha is null").select("nid", "first", "ids").repartition(n, "nid").sortWithinPartitions("nid", "first")
              .mapInArrow(_join_runs, "nid binary, sha string"))
    return runs.where("sha is not null").select("nid", "sha").unionAll(joined)


# --- blocks to nodes -----------------------------------------------------------

_NODES = ("open boolean, conv_id long, depth int, parent_conv_id long, parent_nid binary, nid binary, n_convs long, "
          "n_children long, n_leaves long, saved long, words long, above array<binary>, sha string")
_NODE_TYPES = (pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.list_(pa.binary()), pa.string())


class _Row:
    """A node of the trie, within one block."""

    __slots__ = ("open", "conv", "depth", "parent_conv", "parent_nid", "nid", "n", "children", "leaves", "saved", "words", "above", "sha")

    def cells(self) -> tuple:
        return (self.open, self.conv, self.depth, self.parent_conv, self.parent_nid, self.nid, self.n, self.children,
                self.leaves, self.saved, self.words, self.above, self.sha)


def block_nodes(keys: list[tuple], root_bytes: int, segment: int) -> list[_Row]:
    """The nodes of one block of sorted distinct keys, each
    (key, words, n, conv, sha, below children, below leaves, below saved).
    ``root_bytes`` at a key's start name the node that its segment hangs from.

    Depth first over the radix tree, children before their node. On its way up
    a subtree is (convs, smallest conv, closed leaves, closed saved, rows
    without a parent yet, words of one of its keys)."""
    tree = radix.Tree()
    for k in keys:
        tree.insert(k[0], k)
    rows: list[_Row] = []
    first, last = keys[0][0], keys[-1][0]
    paths = [_path_ids(k[:root_bytes], k[root_bytes:]) for k in (first, last)]

    def node(path: bytes, state: list, value, on_first: bool, on_last: bool) -> None:
        """Closes the turn depth at the end of ``path``."""
        t = (len(path) - root_bytes) // WIDTH
        r = _Row()
        r.open = on_first or on_last or (root_bytes > 0 and t == 0)
        r.depth, r.n, r.conv, r.sha = t, state[0], state[1], value[4] if value else None
        r.words = state[5][t - 1] if t else 0
        r.parent_conv = r.parent_nid = r.nid = r.above = None
        below = value[5] if value else 0
        if r.open:
            mine = paths[0] if on_first else paths[1] if on_last else [path[:root_bytes]]
            r.nid, r.above = mine[t], mine[:t + 1]
            r.parent_nid = mine[t - 1] if t else None
            r.children = sum(not x.open for x in state[4]) + below
            r.leaves, r.saved = state[2], state[3]
            for x in state[4]:
                if not x.open:
                    x.parent_nid = r.nid
        else:
            r.children = len(state[4]) + below
            state[2] += r.children == 0
            state[3] += (r.n - 1) * r.words
            r.leaves, r.saved = state[2], state[3]
            if t == segment:
                r.nid = _path_ids(path[:root_bytes], path[root_bytes:])[-1]
            for x in state[4]:
                x.parent_conv = r.conv
        rows.append(r)
        state[4] = [r]

    def edge(path: bytes, state: list, stop: int, on_first: bool, on_last: bool) -> None:
        """Turn depths within an edge, from its end up to byte depth ``stop``."""
        d = len(path) - 1
        d -= (d - root_bytes) % WIDTH
        while d >= stop and d >= root_bytes:
            node(path[:d], state, None, on_first, on_last)
            d -= WIDTH

    # (node, its path, first byte depth of its edge, flags, state, children left)
    def enter(n: radix.Node, above: bytes, on_first: bool, on_last: bool):
        v = n.value
        state = [v[2], v[3], v[6], v[7], [], v[1]] if v else [0, None, 0, 0, [], None]
        kids = list(n.children())
        return n, above + n.edge, len(above), on_first, on_last, state, kids, [0]

    stack = [enter(tree.root, b"", True, True)]
    while stack:
        n, path, stop, on_first, on_last, state, kids, at = stack[-1]
        if at[0] < len(kids):
            byte, kid = kids[at[0]]
            # The byte that picks the child belongs to its edge.
            stack.append(enter(kid, path + bytes([byte]), on_first and at[0] == 0 and n.value is None, on_last and at[0] == len(kids) - 1))
            at[0] += 1
            continue
        stack.pop()
        if len(path) >= root_bytes and (len(path) - root_bytes) % WIDTH == 0:
            node(path, state, n.value, on_first, on_last)
        edge(path, state, stop, on_first, on_last)
        if stack:
            up = stack[-1][5]
            up[0] += state[0]
            up[1] = state[1] if up[1] is None else min(up[1], state[1])
            up[2] += state[2]
            up[3] += state[3]
            up[4] += state[4]
            up[5] = up[5] if up[5] is not None and len(up[5]) >= len(path) // WIDTH else state[5]
    return rows


def _blocks(level: int, segment: int, keys: int, most_bytes: int):
    root_bytes = WIDTH if level else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("key", "words", "n", "conv", "sha", "children", "leaves", "saved")]
            for k in zip(*cols):
                held.append(k)
                size += len(k[0])
                if len(held) >= keys or size >= most_bytes:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def flush(held):
        rows = block_nodes(held, root_bytes, segment)
        for i in range(0, len(rows), 10_000):
            cols = zip(*(r.cells() for r in rows[i:i + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _NODE_TYPES)],
                                             names=[f.split()[0] for f in _NODES.split(", ")])
    return run


def _merged(found: DataFrame) -> DataFrame:
    """Open nodes with their parts summed over blocks, and what open nodes
    count of each other added along their ancestors."""
    parts = found.where("open").groupBy("nid").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.first("parent_nid").alias("parent_nid"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")),
        F.first("words").alias("words"), F.first("above").alias("above"), F.max("sha").alias("sha"))
    parts = common.stage(parts, "open")
    kids = parts.where("parent_nid is not null").groupBy(F.col("parent_nid").alias("nid")).agg(F.count(F.lit(1)).alias("open_kids"))
    full = (parts.join(kids, "nid", "left")
            .withColumn("n_children", F.col("n_children") + F.coalesce("open_kids", F.lit(0))).drop("open_kids"))
    full = common.stage(full, "open")
    along = (full.select(F.explode("above").alias("nid"), (F.col("n_children") == 0).cast("long").alias("leaf"),
                         ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
             .groupBy("nid").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own")))
    return common.stage(full.join(along, "nid").withColumns({
        "n_leaves": F.col("n_leaves") + F.col("leaf"), "saved": F.col("saved") + F.col("own")}).drop("leaf", "own", "above", "words"), "open")


def trie(turns: DataFrame, segment: int = SEGMENT, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. turns: conv_id, turn, role, text."""
    spark = turns.sparkSession
    segs = common.stage(_segments(rebuilt(turns), segment), "keys")
    deepest = segs.agg(F.max("seg")).first()[0]
    if deepest is None:
        deepest = 0
    levels, above = [], None
    for k in range(deepest + 1):  # the node that each segment hangs from
        rows = segs.where(F.col("seg") == k).drop("seg")
        rows = rows.withColumn("root", F.lit(b"")) if above is None else rows.join(above, "conv_id")
        rows = common.stage(rows.withColumn("nid", _node_id(F.col("root"), F.col("ids"))), "level")
        above = rows.where(~F.col("ends")).select("conv_id", F.col("nid").alias("root"))
        levels.append(rows)
    ends = levels[0].where("ends").select("nid", "conv_id")
    for rows in levels[1:]:
        ends = ends.unionAll(rows.where("ends").select("nid", "conv_id"))
    hashes = common.stage(end_hashes(ends), "hashes")
    zero = F.lit(0).cast("long")
    below, done, names = None, [], []
    for k in range(deepest, -1, -1):
        keys = levels[k].groupBy("nid").agg(F.first("root").alias("root"), F.first("ids").alias("ids"), F.first("words").alias("words"),
                                            F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"))
        keys = keys.join(hashes, "nid", "left")
        if below is None:
            keys = keys.withColumns({c: zero for c in ("children", "leaves", "saved")})
        else:
            keys = keys.join(below, "nid", "left").withColumns({c: F.coalesce(c, zero) for c in ("children", "leaves", "saved")})
        keys = keys.select(F.concat("root", "ids").alias("key"), "words", "n", "conv", "sha", "children", "leaves", "saved")
        found = common.stage(keys.repartitionByRange(_parts(spark), "key").sortWithinPartitions("key")
                             .mapInArrow(_blocks(k, segment, block, block_bytes), _NODES), "nodes")
        opened = _merged(found)
        closed = found.where(~F.col("open"))
        if k:  # depth 0 is a node of the segment above
            tops = F.col("depth") == 0
            below = opened.where(tops).select("nid", F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), "saved")
            below = common.stage(below, "below")
            opened = opened.where(~tops)
        names.append(opened.select("nid", "conv_id"))
        names.append(closed.where("nid is not null").select("nid", "conv_id"))
        cols = ["conv_id", (F.col("depth") + k * segment).cast("long").alias("depth"), "parent_nid", "n_convs", "n_children", "n_leaves",
                F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256")]
        done.append((closed.where("parent_nid is null").select(*cols, "parent_conv_id"), "final"))
        done.append((closed.where("parent_nid is not null").select(*cols), "under"))
        done.append((opened.select(*cols), "under"))
    known = _union(names).select(F.col("nid").alias("parent_nid"), F.col("conv_id").alias("parent_conv_id"))
    under = _union([d for d, kind in done if kind == "under"]).join(known, "parent_nid", "left")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return _union([*(d.select(*out) for d, kind in done if kind == "final"), under.select(*out)])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out
