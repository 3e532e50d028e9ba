import re

import __spark_entry__ as entry
import corpus_pipeline as cp
from llm import decontaminate, near_dedup, toxicity

from tests.conftest import SF_SMALL


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_near(rows):
    """Indices of the rows that stay: one of each group of near copies."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near, up = {}, list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, s in enumerate(sets):
        for j in {k for x in s for k in near.get(x, ())}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                up[find(i)] = find(j)
        for x in s:
            near.setdefault(x, []).append(i)
    groups = {}
    for i, s in enumerate(sets):
        groups.setdefault(find(i) if s else -1 - i, []).append(i)
    return groups.values()


def brute_leaks(rows, items):
    windows = set()
    for t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    lengths = {len(w) for w in windows}
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        out.append(any(tuple(w[i:i + n]) in windows for n in lengths for i in range(len(w) - n + 1)))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def order(rows):
    return sorted(rows, key=repr)


def test_first_stages_against_brute_force(spark, odd):
    for folder in (SF_SMALL, odd):
        docs = cp.common.table(spark, folder, "documents")
        model = toxicity.fit(docs, cp.common.table(spark, folder, "labels"))
        g, lex, (w, mean, scale) = toxicity.Grammar(), toxicity.Lexicon(model[0]), model[1]
        clean = [r for r in pairs(docs) if (toxicity.document_features(r[1], g, lex) - mean) / scale @ w[:-1] + w[-1] < 0]
        assert 0 < len(clean) < docs.count() or folder == odd
        docs = cp.common.stage(cp.drop_toxic(spark, docs, folder), "t")
        assert order(pairs(docs)) == order(clean)

        docs = cp.common.stage(cp.drop_near_duplicates(spark, docs, folder), "n")
        one, left = pairs(docs), []
        for group in brute_near(clean):
            least = min((clean[i][0] is None, clean[i][0] or 0) for i in group)
            stay = [r for r in dict.fromkeys(clean[i] for i in group) if (r[0] is None, r[0] or 0) == least]
            found = [r for r in stay if r in one]
            assert len(found) == 1, group
            left += found
        assert order(one) == order(left)

        items = [r.text for r in cp.common.table(spark, folder, "benchmark").collect()]
        want = [r for r, bad in zip(one, brute_leaks(one, items)) if not bad]
        assert order(pairs(cp.drop_benchmark(spark, docs, folder))) == order(want)


def test_one_of_a_group_stays(spark):
    """Near copies that share the smallest doc_id, or have none."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:60 - k]) for k in range(3)]
    other = [" ".join(w + "x" for w in t.split()) for t in texts]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (None, texts[0]), *((None, t) for t in other), (None, other[0]), (7, ""), (7, "")]
    kept = pairs(near_dedup.kept_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(d == 1 for d, _ in kept) == 1 and sum(d is None for d, _ in kept) == 1 and kept.count((7, "")) == 2 and len(kept) == 4


def test_clashing_columns(spark):
    rows = [(1, "a b c", "s", 1, 2, 3, 4, 5, 6, 7, 8, 9)]
    names = "doc_id long, text string, source string, row int, d int, t int, _row int, kept int, uid int, size int, ws int, runs int"
    docs = spark.createDataFrame(rows, names)
    bench = spark.createDataFrame([(1, "zz")], "item_id long, text string")
    for out in (near_dedup.kept_documents(docs), decontaminate.drop_contaminated(docs, bench)):
        assert out.columns == docs.columns and out.collect() == docs.collect()
    mixed = cp.mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {r[2:] for r in mixed.collect()} == {rows[0][2:]}


def test_stages_carry_all(spark, odd):
    for folder in (SF_SMALL, odd):
        docs = cp.common.table(spark, folder, "documents")
        given = [c for c in docs.columns if c not in ("shard", "slot")]
        texts = [r.text for r in docs.select("text").collect() if r.text]
        out = cp.run(spark, folder)
        assert out.columns == [*given, "shard", "slot"]
        assert all(any(r.text in t for t in texts) for r in out.collect())  # cut out of one text each


def test_empty(spark, empty):
    assert cp.run(spark, empty).count() == 0
