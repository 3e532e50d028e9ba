"""One file read by many tasks, at borders that fall anywhere."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from verdict.sources import splittable, tables
from verdict.sources.ordinals import totals_before

SCHEMA = StructType([StructField(c, StringType()) for c in ("a", "b", "c")])


@pytest.fixture()
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    yield lambda size: [spark.conf.set(n, str(v)) for n, v in zip(names, (size, 0))]
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def one_task(spark, path):
    return spark.read.schema(SCHEMA).options(sep="\t", header=True, multiLine=True, escape='"').csv(path)


def cell(rng):
    text = "".join(rng.choice(["x", "é", "\t", "\n", '"', " ", "\r\n", "long " * 5, "'", "\\"]) for _ in range(rng.randrange(6)))
    if any(s in text for s in '\t\n"\r') or rng.random() < 0.3:
        return '"' + text.replace('"', '""') + '"'
    return text if text == text.strip() else "y"


def made(seed, rows, end="\n"):
    rng = random.Random(seed)
    lines = ["\t".join(cell(rng) or "z" for _ in range(3)) for _ in range(rows)]
    return "a\tb\tc" + end + "".join(x + end + (end if rng.random() < 0.1 else "") for x in lines)


@pytest.mark.parametrize("seed,size,limit", [(1, 61, 1 << 18), (2, 250, 0)])
def test_rows_and_order_equal_the_one_task_read(spark, tmp_path, tiny_splits, seed, size, limit):
    path = tmp_path / "corpus.tsv"
    path.write_bytes(made(seed, 30).encode())
    want = [tuple(r) for r in one_task(spark, str(path)).collect()]
    tiny_splits(size)
    assert spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions() > 2
    got = splittable.read_delimited(spark, str(path), SCHEMA, ordinal="at", broadcast_ranges=limit).orderBy("at").collect()
    assert [tuple(r)[:3] for r in got] == want
    assert [r["at"] for r in got] == list(range(len(want)))


TRICKY = 'a\tb\tc\n"1\n\n""\n2"\t"x"\t""\n5" disk\tp"q\t"\n"\nlast\t"a\tb"\t"end"'
RECORDS = ["a\tb\tc", '"1\n\n""\n2"\t"x"\t""', '5" disk\tp"q\t"\n"', 'last\t"a\tb"\t"end"']


def test_records_of_tricky_text_in_spark(spark, tmp_path, tiny_splits):
    path = tmp_path / "one.tsv"
    path.write_text(TRICKY)
    want = [tuple(r) for r in one_task(spark, str(path)).collect()]
    assert want[0][0] == '1\n\n"\n2' and want[1][0] == '5" disk' and len(want) == 3
    tiny_splits(17)
    got = splittable.read_delimited(spark, str(path), SCHEMA, ordinal="at").orderBy("at").collect()
    assert [tuple(r)[:3] for r in got] == want


def test_quotes_at_every_border():
    """The three steps by hand, with range borders at every set of lines."""
    lines = TRICKY.split("\n")
    for mask in range(1 << (len(lines) - 1)):
        owner = [0]
        for i in range(1, len(lines)):
            owner.append(i if mask >> (i - 1) & 1 else owner[-1])
        def batch(**cols):
            return iter([pa.RecordBatch.from_pydict({"file": ["f"] * len(lines), "range": owner, **cols})])
        ranges = pa.Table.from_batches(list(splittable._compose("\t")(batch(
            quoted=[x if '"' in x else None for x in lines], empty=[x == "" for x in lines]))))
        told = {r["range"]: r for r in splittable._settle(ranges).to_pylist()}
        cut = pa.Table.from_batches(list(splittable._cut("\t")(batch(
            value=lines, case=[told[o]["case"] for o in owner], number=[told[o]["number"] for o in owner])))).to_pylist()
        found = {}
        for r in sorted(cut, key=lambda r: r["range"]):
            assert r["whole"] <= (r["number"] not in found)
            found.setdefault(r["number"], []).append(r["record"])
        assert ["\n".join(found[k]) for k in sorted(found)] == RECORDS, mask


def test_windows_line_ends_and_empty_files(spark, tmp_path, tiny_splits):
    tiny_splits(20)
    (tmp_path / "a.tsv").write_bytes(b'a\tb\tc\r\n1\t2\t3\r\n\r\n"4\r\n4"\t5\t6\r\n')
    (tmp_path / "b.tsv").write_bytes(b"")
    (tmp_path / "c.tsv").write_bytes(b"a\tb\tc\n")
    got = splittable.read_delimited(spark, str(tmp_path), SCHEMA, ordinal="at").orderBy("at").collect()
    assert [tuple(r) for r in got] == [("1", "2", "3", 0), ("4\r\n4", "5", "6", 1)]


def test_ordinals_follow_the_paths_of_many_files(spark, tmp_path, tiny_splits):
    tiny_splits(50)
    want = []
    for k in range(9):
        text = made(100 + k, k % 4)
        (tmp_path / f"part-{k:03d}.tsv").write_text(text)
        if k % 4:
            want += [tuple(r) for r in one_task(spark, str(tmp_path / f"part-{k:03d}.tsv")).collect()]
    df = splittable.read_delimited(spark, str(tmp_path), SCHEMA, ordinal="at")
    got = df.orderBy("at").collect()
    assert [tuple(r)[:3] for r in got] == want and [r["at"] for r in got] == list(range(len(want)))
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_line_end_by_characters():
    def slow(line, case):
        state = "Q" if case else "S"
        for ch in line.removesuffix("\r"):
            state = {"S": {'"': "Q", "\t": "S"}.get(ch, "U"), "U": "S" if ch == "\t" else "U", "Q": "E" if ch == '"' else "Q",
                     "E": {'"': "Q", "\t": "S"}.get(ch, "U")}[state]
        return int(state == "Q")
    rng = random.Random(5)
    for _ in range(20_000):
        line = "".join(rng.choice('"\tab"') for _ in range(rng.randrange(9))) + rng.choice(["", "\r"])
        for case in (0, 1):
            assert splittable.line_end(line, case, "\t") == slow(line, case), (line, case)


def test_totals_before(spark, scratch):
    rng = random.Random(6)
    rows = [(f"k{i:04d}", rng.randrange(5)) for i in range(500)]
    got = totals_before(spark.createDataFrame(rows, "k string, n long"), ["k"], "n", "before", f"{scratch}/t").collect()
    total = 0
    for (k, n), r in zip(rows, sorted(got, key=lambda r: r["k"])):
        assert (r["k"], r["n"], r["before"]) == (k, n, total)
        total += n


def test_parquet_ordinals_over_many_files(spark, tmp_path):
    path = str(tmp_path / "pq")
    spark.range(200).select(F.col("id").cast("string").alias("v")).repartition(17).write.parquet(path)
    df = tables.with_file_ordinal(spark.read.parquet(path))
    rows = df.select("ordinal", "v", F.col("ordinal").cast(LongType()).alias("o")).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(200))
    raw = sorted((r.f, r.i, r.v) for r in spark.read.parquet(path).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"), "v").collect())
    assert [r["v"] for r in rows] == [v for _, _, v in raw]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
