"""Fits take one row per labelled doc_id, however often it repeats."""

import numpy as np

from llm import labelled, quality, toxicity

from .conftest import prose


def tables(spark, copies: int):
    ids = [i for i in range(60)]
    docs = [(i, prose(i, 20) + (" you stupid idiot" if i % 2 else "")) for i in ids]
    docs += [docs[3], (4, prose(4, 20))] * copies
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame([(i, i % 2, i % 2) for i in ids], "doc_id long, quality int, toxic int"))


def test_one_row_per_id(spark):
    docs, labels = tables(spark, 0)
    more = docs.unionAll(spark.createDataFrame([(1, f"other {k}") for k in range(300)], docs.schema))
    rows = labelled.fit_texts(more, labelled.fit_rows(labels, "toxic")).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == labelled.fit_rows(labels, "toxic").count()


def test_copies_do_not_change_the_fits(spark, monkeypatch):
    seen, init = [], quality.Network.__init__
    monkeypatch.setattr(quality.Network, "__init__", lambda self, x, y, c: (seen.append(len(x)), init(self, x, y, c))[1])
    fits = []
    for copies in (0, 200):
        docs, labels = tables(spark, copies)
        fits.append(toxicity.fit(docs, labels))
        quality.scores(docs, labels)
    assert fits[0][0] == fits[1][0] and all(np.allclose(a, b) for a, b in zip(fits[0][1], fits[1][1]))
    assert seen[0] == seen[1] <= 60
