"""Words hit by overlapping windows, against marking every word."""

import random

from llm import decontaminate


def brute(text, items):
    ws = decontaminate_words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = decontaminate_words(t)
        for s in range(max(1, len(iw) - 9) if iw else 0):
            w = iw[s:s + 10]
            for i in range(len(ws) - len(w) + 1):
                if ws[i:i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(item)
    return len(ws), len(hit), len(found), sorted(map(str, found - {None}))


def decontaminate_words(t):
    import re
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))


def test_overlapping_runs_count_each_word_once(spark):
    r = random.Random(5)
    word = lambda: r.choice("a b c".split())  # noqa: E731 - few words, so windows overlap everywhere
    items = [(1, " ".join(word() for _ in range(10))), (2, "a b"), (3, "c"), (None, "b b b b"), (4, "a " * 14), (5, None), (6, "?")]
    docs = [(i, " ".join(word() for _ in range(r.randrange(60)))) for i in range(60)]
    docs += [(100, "a " * 40 + "b " + "a " * 12), (101, None), (102, ""), (None, items[0][1] + " " + items[0][1]), (0, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(x.doc_id, x.n_words, x.n_hit, x.n_items, x["items"], x.contaminated) for x in decontaminate.contamination(d, b).collect()]
    want = [(i, *(w := brute(t, items)), w[1] > 0) for i, t in docs]
    assert sorted(got, key=str) == sorted(want, key=str)
