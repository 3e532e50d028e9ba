"""The trie and its radix tree against dictionaries."""

import collections
import hashlib
import random
import zlib

import pytest

from llm import conversation_trie as ct
from llm import radix


def plain(turns):
    """turns: (conv_id, turn, role, text) -> rows as the operator gives them."""
    def tid(role, text):
        r, t = (role or "").encode(), (text or "").encode()
        return hashlib.sha256(str(len(r)).encode() + b":" + r + t).hexdigest()[:32]
    own = collections.defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, tid(role, text), len((text or "").encode().split())))
    for ts in own.values():
        ts.sort()
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = tuple((x[2], x[3]) for x in own.get(base, [])[:h] + ts[h:])
    nodes = collections.defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes[ts[:d]].append(c)
    kids = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, cs in nodes.items():
        for a in range(len(k) + 1):
            leaves[k[:a]] += not kids[k]
            saved[k[:a]] += (len(cs) - 1) * (k[-1][1] if k else 0)
    return sorted(((min(cs), len(k), min(nodes[k[:-1]]) if k else None, len(cs), kids[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(str(c) for c in sorted(cs) if built[c] == k).encode()).hexdigest())
                   for k, cs in nodes.items()), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                               "saved_tokens", "ends_sha256").collect()), key=repr)


def frame(spark, turns):
    return spark.createDataFrame([(*t, "z", 1) for t in turns], "conv_id long, turn long, role string, text string, words string, pos int")


def made(seed, convs, most, vocabulary):
    rng = random.Random(seed)
    return [(c, rng.choice([t, t, t, None]) if rng.random() < 0.05 else t, rng.choice(["user", None]), "w " * rng.randrange(1, vocabulary))
            for c in range(convs) for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("seed,segment,block", [(1, 256, 20_000), (2, 2, 3), (3, 3, 1), (4, 4, 7), (5, 1, 5)])
def test_trie(spark, seed, segment, block):
    turns = made(seed, 90, 9, 3)
    assert rows(ct.trie(frame(spark, turns), segment=segment, block=block)) == plain(turns)


def test_one_long_conversation_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ct, "RUN", 5)
    turns = [(7, t, "user", f"t{t}") for t in range(60)] + [(c, t, "user", f"t{t}") for c in range(100, 160) for t in range(4)]
    turns += [(40, 0, "user", "x")] * 50 + [(None, 0, "user", "x")] * 30
    for segment in (8, 256):
        assert rows(ct.trie(frame(spark, turns), segment=segment, block=10)) == plain(turns)


def test_no_conversations(spark):
    assert rows(ct.trie(frame(spark, []).where("false"))) == []


def test_radix_tree():
    rng = random.Random(6)
    tree, want = radix.Tree(), {}
    for _ in range(4000):
        key = bytes(rng.randrange(256 if rng.random() < 0.3 else 6) for _ in range(rng.randrange(7)))
        want[key] = rng.random()
        tree.insert(key, want[key])
    got, layouts = {}, collections.Counter()

    def walk(node, above):
        path, kids = above + node.edge, list(node.children())
        layouts[node.layout] += 1
        assert [b for b, _ in kids] == sorted({b for b, _ in kids}) and len(kids) <= node.layout
        assert node.value is not None or len(kids) > 1  # every run without a branch is one edge
        if node.value is not None:
            got[path] = node.value
        for b, k in kids:
            assert node.child(b) is k
            walk(k, path + bytes([b]))
    walk(tree.root, b"")
    assert got == want and set(layouts) == {radix.SMALL, radix.MEDIUM, radix.INDEXED, radix.DIRECT}
