"""The audit against a plain Python version, over widths, paths and tiles."""

import collections
import random
import re

import pytest

from llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, top):
    """docs: (lang, source, text)."""
    docs = [tuple(x or "" for x in d) for d in docs]
    terms = [TERM.findall(t.translate(AZ)) for _, _, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        df, count = collections.Counter(), collections.defaultdict(collections.Counter)
        for (g, s, _), ts in zip(docs, terms):
            if g == lang:
                df.update(set(ts))
                count[s].update(ts)
        kept = [t for t, n in df.items() if n >= least]
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}
        p = {s: shares(c) for s, c in count.items()}
        q = shares(sum(count.values(), collections.Counter()))

        def f(a, b):
            return (a - b) * (a - b) // (a + b)
        for s in p:
            for part, rows in (("pair", [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s]),
                               ("term", [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]])):
                rows.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(rows[:None if part == "pair" else top])]
    return sorted(out)


def made(seed, sources, n=120):
    rng = random.Random(seed)
    stems = ["a", "ab", "abc", "abcd", "abcdefgh", "abcdefghi", "Élan", "日本語", "straße", "internationalisation",
             "internationalisierung", "internationalization" * 3, "x" * 40, "x" * 41]
    docs = []
    for i in range(n):
        words = [rng.choice(stems) + rng.choice(["", "", "s", "Er", str(i)]) for _ in range(rng.randrange(30))]
        docs.append((rng.choice(["en", "de", None]), f"src{rng.randrange(sources)}", rng.choice([" ", "\n", "-", "7"]).join(words)))
    return docs + [("fr", "only", None), ("fr", "other", "!!"), ("en", None, ""), ("es", "lone", "un deux")]


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, "z") for d in docs], "lang string, source string, text string, n int, term string")


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("first,left_bytes,block", [(1, 32 << 20, 2048), (8, 32 << 20, 3), (3, 0, 7), (64, 32 << 20, 2048)])
def test_audit(spark, first, left_bytes, block):
    docs = made(first, 5)
    assert rows(divergence.audit(frame(spark, docs), least=3, top=4, first=first, left_bytes=left_bytes, block=block)) == plain(docs, 3, 4)


def test_many_sources(spark):
    docs = made(9, 150, 600)  # more than two tiles
    assert rows(divergence.audit(frame(spark, docs), least=4, block=8)) == plain(docs, 4, 10)


def test_long_texts_in_slices(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 200)
    docs = made(5, 3, 60) + [("en", "long", " ".join(f"abcdefghi{k % 9} x{'y' * (k % 300)}" for k in range(400)))] * 3
    assert rows(divergence.audit(frame(spark, docs), least=3, first=2)) == plain(docs, 3, 10)


def test_one_hot_source_and_repeated_rows(spark):
    docs = [("en", "hot", "same words again and again")] * 400 + made(3, 4, 200)
    assert rows(divergence.audit(frame(spark, docs))) == plain(docs, 10, 10)


def test_shares_beyond_64_bits():
    import numpy as np
    n, total, v = 10**13 + 7, 3 * 10**14 + 1, 12345
    assert divergence._shares(np.array([[n]]), np.array([[total]]), v)[0, 0] == 1 + 10**9 * (n + 2) // (total + 2 * v)
