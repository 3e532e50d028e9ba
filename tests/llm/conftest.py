import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    import random
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def write(folder, docs, labels=(), bench=(), vectors=(), turns=()):
    """Tables as Parquet; documents carry extra columns with clashing names."""
    extra = ["row", "size", "uid", "h", "th", "n", "part", "score", "slot", "shard", "label"]
    base = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()),
                      ("n_chars", pa.int64()), *((c, pa.string()) for c in extra)])
    rows = [{"doc_id": d, "text": t, "lang": "en", "source": s, "n_chars": len(t or ""), **dict.fromkeys(extra, "x")} for d, t, s in docs]
    pq.write_table(pa.Table.from_pylist(rows, base), f"{folder}/documents.parquet")
    for name, cols, kinds, data in (("labels", ["doc_id", "quality", "toxic"], [pa.int64(), pa.int32(), pa.int32()], labels),
                                    ("benchmark", ["item_id", "text"], [pa.int64(), pa.string()], bench),
                                    ("conversations", ["conv_id", "turn", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string()], turns),
                                    ("embeddings", ["vec_id", "embedding", "label"], [pa.int64(), pa.list_(pa.float32()), pa.int32()], vectors)):
        pq.write_table(pa.Table.from_pylist([dict(zip(cols, r)) for r in data], pa.schema(list(zip(cols, kinds)))), f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    """Nulls, empty and long texts, ties, repeated rows, a null id."""
    p = prose(1, 60)
    long = prose(2, 6_000)
    docs = [(1, p, "b"), (2, p, "b"), (2, p, "b"), (3, p + " one more", "a"), (4, None, "a"), (5, "", None), (6, " \n\t ", None),
            (7, long, "a"), (8, long + " end", "a"), (None, prose(3, 30), "c"), (None, prose(3, 30), "c"), (9, "two words", "b"),
            (10, "Shared Line here now\nown " + prose(4, 20), "b"), (11, "  shared line HERE now \nother " + prose(5, 20), None),
            (12, prose(6, 15) + " " + prose(7, 10) + " tail", "a"), (13, "É è ß 日本 ١٢ x\x00y 😀", "c"), (14, "x" * 50_000, "a"),
            (15, "you stupid idiot, pathetic loser. password=4c8f8006a3af39d897 end", "a")]
    labels = [(1, 1, 0), (3, 1, None), (15, 0, 1), (15, 0, 1), (None, 1, 1), (99, 1, 0), (7, 1, 0)]
    bench = [(1, prose(7, 10)), (2, None), (3, ""), (4, "two words"), (5, prose(7, 10)), (6, "!!"), (None, "x")]
    unit = [[float(i), 1.0, 0.5] for i in range(30)]
    vectors = [(100 * i, unit[i], 0) for i in range(15)] + [(i + 1, unit[i], 0) for i in range(30)] + [(1, unit[0], 0)]
    vectors += [(5000, None, 0), (5100, [], 0), (5200, [0.0, 0.0, 0.0], 0), (5300, [1.0, float("nan"), 0.0], 0),
                (5400, [1.0, None, 0.0], 0), (5500, [1.0, float("inf"), 2.0], 0), (None, unit[3], 0)]
    talk = [("user", "hello there"), ("assistant", "hello, you"), ("user", None), (None, "what?"), ("user", p)]
    turns = [(c, t, *talk[(t + c // 7) % 5]) for c in range(45) if c not in (20, 33) for t in range(c % 6 + 1)]
    turns += [(20, None, "user", "null turn"), (20, 0, "user", "x y"), (20, 0, "user", "x y"), (20, 0, "user", "a b"), (20, 9, "", ""),
              (-7, 1, "user", "below zero"), (-20, 1, "user", "base"), (-20, 2, "user", "more"), (None, 0, "user", "nobody"), (None, None, None, None)]
    return write(tmp_path_factory.mktemp("odd"), docs, labels, bench, vectors, turns)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [])


def duck(folder):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(folder, t)}.parquet')")
    return con
