"""Benchmark decontamination as a prefix-filtered set join.

A benchmark window is ten consecutive words of an item (a shorter item is one
window). Its shingles are its three-word runs (the whole window where it is
shorter). Exact containment needs every shingle of the window, so by the
prefix-filter argument a prefix of one shingle, the rarest over the corpus,
is enough: only documents that hold it are candidates. Length and position
bounds follow from the shingle's place in the window, and the words around the
candidate decide.

One pass over the texts keeps, for each position whose shingle may occur in
the benchmark, the words around it; rarity, the join and the check run on
those narrow rows. Texts are never shuffled. Only DataFrame functions.

Nulls: a null text has no words; a null doc_id is a row like any other, and
repeated rows each get their own result. An empty benchmark hits nothing, and
an empty table gives no rows. Texts of any length are read whole, in one task
each. Of windows that tie in rarity the one that begins first is the prefix;
the result is the same for any. Further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(common.ascii_lower(text), F.lit(WORDS), F.lit(0)),
                      F.array().cast("array<string>"))


def _shingle_at(ws: Column, i: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(ws, i + k) for k in range(width)])


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, ws): the distinct windows of each item."""
    b = benchmark.select("item_id", words(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))
    return (b.select("item_id", "all", F.explode(starts).alias("s"))
            .select("item_id", F.slice("all", F.col("s"), size).alias("ws")).distinct())


def _window_shingles(windows: DataFrame, width: int) -> DataFrame:
    """(ws, off, h) for each shingle of each distinct window."""
    w = F.least(F.size("ws"), F.lit(width))
    offs = F.explode(F.sequence(F.lit(0), F.size("ws") - w)).alias("off")
    at = windows.select("ws").distinct().select("ws", w.alias("w"), offs)
    h = F.coalesce(*[F.when(F.col("w") == k, _shingle_at(F.col("ws"), F.col("off"), k))
                     for k in range(1, width + 1)])
    return at.select("ws", "off", "w", h.alias("h"))


def _candidates(ws: Column, width: int, known: Callable, reach: int) -> Column:
    """Positions whose shingle may be the benchmark's, with the words around.
    Each shingle is hashed once."""
    def at(i: Column) -> Column:
        return F.struct(i.alias("pos"), _shingle_at(ws, i, width).alias("h"))

    def row(c: Column) -> Column:
        first = F.greatest(c["pos"] - (reach - width), F.lit(0))
        return F.struct(c["pos"].alias("pos"), c["h"].alias("h"), first.alias("first"),
                        F.slice(ws, first + 1, 2 * reach).alias("around"))

    places = F.when(F.size(ws) >= width, F.sequence(F.lit(0), F.size(ws) - width)) \
        .otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(F.transform(places, at), lambda c: known(c["h"])), row)


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, width: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): rows is docs without text plus ``uid`` and ``n_words``;
    hits is (uid, item_id, start, len), one row per occurrence of an item's
    window in a document."""
    windows = common.stage(benchmark_windows(benchmark, size), "windows")
    shingles = common.stage(_window_shingles(windows, width), "shingles")
    known = common.bloom(shingles.select("h"))
    widths = [r.w for r in shingles.select("w").distinct().collect()]  # at most `width` rows
    spread = docs.withColumn("_ws", words(F.col("text"))).drop("text")
    found = [_candidates(F.col("_ws"), w, known, size) for w in sorted(widths)]
    none = F.array().cast("array<struct<pos:int,h:bigint,first:int,around:array<string>>>")
    kept = [c for c in spread.columns if c != "_ws"]
    seen = common.stage(spread.select(
        *kept, F.monotonically_increasing_id().alias("uid"), F.size("_ws").cast("long").alias("n_words"),
        (F.concat(*found) if found else none).alias("cands")), "seen")
    cands = seen.select("uid", "n_words", F.explode("cands").alias("c")).select("uid", "n_words", "c.*")
    freq = cands.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    # The rarest shingle of each window, found in the corpus at all. A window
    # with a shingle that never occurs can't occur itself.
    rare = (shingles.join(freq, "h", "left")
            .groupBy("ws").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "h")).alias("p"))
            .where("p.df > 0").select("ws", F.col("p.off").alias("off"), F.col("p.h").alias("h"),
                                      F.size("ws").alias("len")))
    rare = common.stage(rare, "prefixes")
    start = F.col("pos") - F.col("off")
    hits = (cands.join(rare, "h")
            .where((start >= 0) & (start + F.col("len") <= F.col("n_words"))
                   & (F.slice("around", start - F.col("first") + 1, F.col("len")) == F.col("ws")))
            .select("uid", start.alias("start"), "len", "ws"))
    hits = hits.join(windows, "ws").select("uid", "item_id", "start", "len")
    return seen.drop("cands"), hits


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, width: int = SHINGLE,
                  key: str = "doc_id") -> DataFrame:
    """Per row of docs (an id column and text): the id, n_words, n_hit (words inside an
    occurrence), n_items, items (sorted ids of the items found; an item without
    an id counts but has no name), contaminated."""
    rows, hits = find(docs.select(key, "text"), benchmark, size, width)
    hits = common.stage(hits, "hits")
    # The union of a document's runs: in order of their starts, each adds what
    # lies beyond the ends before it. No run is unfolded into its words.
    ends = hits.groupBy("uid", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    before = Window.partitionBy("uid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    covered = ends.select("uid", fresh.alias("fresh")).groupBy("uid").agg(F.sum("fresh").alias("n_hit"))
    named = (hits.select("uid", "item_id").distinct().groupBy("uid")
             .agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items")))
    return (rows.join(covered.join(named, "uid"), "uid", "left")
            .withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_hit", "n_items")})
            .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
            .withColumn("contaminated", F.col("n_hit") > 0))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, with their own columns. Rows
    meet their verdict by the md5 of id and text: equal rows share one."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    named = docs.select(key.alias("_row"), F.struct(*docs.columns).alias("row"))
    bad = (contamination(named.select("_row", "row.text"), benchmark, key="_row")
           .where("contaminated").select("_row").distinct())
    return named.join(bad, "_row", "left_anti").select("row.*")
