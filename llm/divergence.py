"""Source divergence audit over the terms that enough documents share.

Terms are runs of letters (``LETTERS``), A-Z lowered. The kept terms of each
language are found by iceberg prefix refinement: a level counts, per language,
the distinct documents that hold a term with each byte prefix of the level's
width; prefixes in fewer than ``least`` documents go, and with them every term
they begin. The next level is twice as wide and looks only at longer terms
whose prefix is left. A term no longer than the width is complete there: its
count is the term's own. Refinement ends at the level that leaves no prefix to
extend.

Documents are counted in each task before anything is shuffled, so a frequent
prefix or a large source is a few rows a task. The prefixes that are left go to
the tasks as sorted hashes if they fit ``LEFT_BYTES``; beyond that the counts
of a level are joined with them instead, with the same result.

Each (lang, source) group and each language is then a smoothed distribution in
whole billionths over the language's V kept terms,
p = 1 + floor(10^9 * (count + 2) / (N + 2 V)), and two distributions differ at
a term by floor((p - q)^2 / (p + q)). Pairs of sources are summed term block by
term block, in tiles of ``TILE`` sources; terms that neither source of a tile
pair holds add one known value each. All arithmetic is exact (N + 2 V below
9 * 10^15).

Null text, lang and source read as ''. Rows with equal doc_id are separate
documents. Texts are read whole, long ones in slices that cut no term; further
columns are left aside. A language without kept terms gives pairs of value 0;
groups without terms take part. Ties rank by the item's UTF-8 bytes. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, word_runs

LEAST, TOP = 10, 10
#: Bytes of the first level's prefixes.
FIRST = 8
#: Broadcast the prefixes left up to this many bytes of hashes; join beyond.
LEFT_BYTES = 32 << 20
#: Bytes of text that a task counts at once.
CHUNK = 8 << 20
#: Terms of a block, sources of a tile.
BLOCK, TILE = 2048, 64
#: Smoothing and scale of the distributions (fixed values of the audit).
PLUS, SCALE = 2, 1_000_000_000


def _letters() -> np.ndarray:
    t = np.zeros(256, bool)
    t[0x41:0x5B] = t[0x61:0x7B] = True
    t[0x80:] = True
    return t


#: Bytes of a term: A-Z, a-z and every byte of a code point beyond ASCII.
LETTERS = _letters()


# --- refinement --------------------------------------------------------------

def _slices(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about CHUNK bytes that cut no term."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + CHUNK)
        while hi < len(data) and LETTERS[data[hi]]:
            more = np.flatnonzero(~LETTERS[data[hi:hi + CHUNK]])
            hi = hi + int(more[0]) if len(more) else min(len(data), hi + CHUNK)
        yield data[lo:hi]
        lo = hi


def _tails(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, width: int) -> np.ndarray:
    """Codes of the bytes from KEY up to ``width`` of runs (rare: level by
    level only the terms that still have a long shared prefix come here)."""
    seen: dict[bytes, int] = {}
    out = np.zeros(len(starts), np.uint64)
    for i in np.flatnonzero(lens > word_runs.KEY):
        a = starts[i]
        out[i] = seen.setdefault(data[a + word_runs.KEY:a + min(lens[i], width)].tobytes(), len(seen) + 1)
    return out


def _prefixes(data, starts, lens, width: int):
    """The prefixes of runs as columns: two words, a code for what lies beyond
    them, and whether the run goes on after ``width`` bytes."""
    hi, lo = word_runs.packed(data, starts, np.minimum(lens, width))
    tail = _tails(data, starts, lens, width) if width > word_runs.KEY else np.zeros(len(starts), np.uint64)
    return hi, lo, tail, (lens > width).astype(np.uint64)


def _parent_keys(hi: np.ndarray, lo: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the first ``width`` bytes (KEY at most). Two prefixes may
    share one; a term let through by that is still counted out by its own
    documents, of which no more hold it than hold its prefix."""
    return word_runs.mixed(*word_runs.cut(hi, lo, width))


def _left_keys(alive: DataFrame, width: int) -> dict[str, np.ndarray]:
    """The hashes of the prefixes left, by language."""
    found = alive.select("lang", "prefix").toArrow().combine_chunks()
    out = {}
    for lang in found.column("lang").unique().to_pylist():
        mine = found.filter(pc.equal(found.column("lang"), lang)).column("prefix").combine_chunks()
        data, offs = word_runs.column_bytes(mine)
        out[lang] = np.unique(_parent_keys(*word_runs.packed(data, offs[:-1], np.diff(offs)), width))
    return out


def _count_level(before: int, width: int, left):
    """mapInArrow: (lang, source, prefix, whole, docs, n) over each chunk."""
    def chunk(texts: list[np.ndarray], groups: list[tuple[str, str]]):
        data = np.concatenate([*texts, np.zeros(0, np.uint8)])
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        low = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(0x20), data)
        a, b, row = word_runs.runs(np.zeros(len(data), bool), LETTERS[data], offs)
        long = b - a > before
        return low, a[long], (b - a)[long], row[long]

    def counted(low, a, lens, row, groups):
        """The distinct prefixes of a chunk (bytes, whether more follows) and
        its (document, prefix) pairs with their occurrences."""
        cols = _prefixes(low, a, lens, width)
        at, code = word_runs.distinct(*cols)
        if left is not None and before and len(at):
            lang_of = np.array([g[2] for g in groups], np.int64)
            ok = np.zeros((int(lang_of.max()) + 1, len(at)), bool)
            parent = _parent_keys(cols[0][at], cols[1][at], before)
            for lang, i in {g[0]: g[2] for g in groups}.items():
                ok[i] = np.isin(parent, left.value[lang]) if lang in left.value else False
            some = ok[lang_of[row], code]
            row, code = row[some], code[some]
        pair, n = np.unique(row * np.int64(len(at)) + code, return_counts=True)
        if width <= word_runs.KEY:
            names = word_runs.unpacked(cols[0][at], cols[1][at]).tolist()
        else:
            names = [low[a[i]:a[i] + min(lens[i], width)].tobytes() for i in at]
        return names, cols[3][at].astype(bool), pair // max(1, len(at)), pair % max(1, len(at)), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, groups, size = [], [], 0
        for b in batches:
            data, offs = word_runs.column_bytes(b.column("text"))
            for i, g in enumerate(zip(b.column("lang").to_pylist(), b.column("source").to_pylist())):
                t = data[offs[i]:offs[i + 1]]
                if len(t) > CHUNK:
                    yield _rows(*long_text(t, g))
                    continue
                texts.append(t)
                groups.append(g)
                size += len(t)
                if size >= CHUNK:
                    yield _rows(*flush(texts, groups))
                    texts, groups, size = [], [], 0
        if texts:
            yield _rows(*flush(texts, groups))

    def flush(texts, groups):
        langs: dict[str, int] = {}
        own = [(lang, source, langs.setdefault(lang, len(langs))) for lang, source in groups]
        names, goes_on, doc, code, n = counted(*chunk(texts, own), own)
        # A prefix that goes on is counted for its language, a term by source.
        ids: dict[tuple[str, str | None], int] = {}
        by_source = np.array([ids.setdefault(g, len(ids)) for g in groups], np.int64)
        by_lang = np.array([ids.setdefault((g[0], None), len(ids)) for g in groups], np.int64)
        return names, goes_on, np.where(goes_on[code], by_lang[doc], by_source[doc]), code, n, list(ids)

    def long_text(text, g):
        names: dict[tuple[bytes, bool], int] = {}
        total: dict[int, int] = {}
        for part in _slices(text):
            some, goes_on, _, code, n = counted(*chunk([part], [(*g, 0)]), [(*g, 0)])
            for c, k in zip(code.tolist(), n.tolist()):
                i = names.setdefault((some[c], bool(goes_on[c])), len(names))
                total[i] = total.get(i, 0) + k
        goes_on = np.array([k[1] for k in names], bool)
        return ([k[0] for k in names], goes_on, goes_on.astype(np.int64), np.arange(len(names)),
                np.array([total[i] for i in range(len(names))], np.int64), [g, (g[0], None)])

    return run


def _rows(names, goes_on, group, code, n, groups) -> pa.RecordBatch:
    """Pairs summed over the documents of each (group, prefix)."""
    key, back = np.unique(group * np.int64(max(1, len(names))) + code, return_inverse=True)
    docs = np.bincount(back, minlength=len(key))
    words = np.zeros(len(key), np.int64)
    np.add.at(words, back, n)
    g, c = key // max(1, len(names)), key % max(1, len(names))
    lang, source = ([x[i] for x in groups] for i in (0, 1))
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()).take(pa.array(g)), pa.array(source, pa.string()).take(pa.array(g)),
         pa.array(names, pa.binary()).take(pa.array(c)), pa.array(~goes_on[c] if len(names) else np.zeros(0, bool)),
         pa.array(docs, pa.int64()), pa.array(words, pa.int64())],
        names=["lang", "source", "prefix", "whole", "docs", "n"])


_COUNTS = "lang string, source string, prefix binary, whole boolean, docs long, n long"


def kept_counts(docs: DataFrame, least: int = LEAST, first: int = FIRST, left_bytes: int = LEFT_BYTES) -> DataFrame:
    """(lang, source, term, n): occurrences of each kept term in the groups that
    hold it. docs: lang, source, text without nulls."""
    spark = docs.sparkSession
    found, before, width, left, alive = None, 0, first, None, None
    while True:
        rows = docs.select("lang", "source", "text").mapInArrow(_count_level(before, width, left), _COUNTS)
        rows = rows.groupBy("lang", "source", "prefix", "whole").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
        if before and left is None:
            parent = alive.select("lang", F.col("prefix").alias("parent"))
            rows = (rows.withColumn("parent", F.substring("prefix", 1, before))
                    .join(parent, ["lang", "parent"], "left_semi").drop("parent"))
        rows = common.stage(rows, "prefixes")
        enough = common.stage(rows.groupBy("lang", "prefix", "whole").agg(F.sum("docs").alias("docs"))
                              .where(F.col("docs") >= least).drop("docs"), "enough")
        terms = (rows.where("whole").join(enough.where("whole").drop("whole"), ["lang", "prefix"])
                 .select("lang", "source", F.col("prefix").cast("string").alias("term"), "n"))
        found = terms if found is None else found.unionAll(terms)
        alive = enough.where(~F.col("whole")).drop("whole")
        n = alive.count()
        if not n:
            return found
        left = spark.sparkContext.broadcast(_left_keys(alive, width)) if 8 * n <= left_bytes else None
        before, width = width, 2 * width


# --- distributions -----------------------------------------------------------

def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a term that occurs n times among ``total`` of ``terms`` kept terms."""
    big = (n + PLUS).cast("decimal(20,0)") * F.lit(SCALE)
    return F.lit(1).cast("long") + F.call_function("div", big, (total + PLUS * terms).cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """The same in numpy: long division by thousands keeps to 64 bits."""
    d = total + PLUS * terms
    q, r = np.divmod(n + PLUS, d)
    for _ in range(3):
        step, r = np.divmod(r * 1000, d)
        q = q * 1000 + step
    return q + 1


_PAIRS = "lang string, a int, b int, value long, seen long"


def _pair_sums(rows: pa.Table) -> pa.Table:
    """One block of terms, one pair of tiles: sums over its terms for each pair
    of sources. Rows without a term bring each source's total."""
    lang, i, j, terms = (rows.column(c)[0].as_py() for c in ("lang", "ti", "tj", "terms"))
    sid, term, n = rows.column("sid").to_numpy(), rows.column("term"), rows.column("n").to_numpy()
    bare = np.array(term.is_null())
    sids, total = sid[bare], n[bare]
    order = np.argsort(sids)
    sids, total = sids[order], total[order]
    code = term.filter(pa.array(~bare)).combine_chunks()
    code = code.dictionary_encode().indices.to_numpy() if len(code) else np.zeros(0, np.int64)
    seen = int(code.max()) + 1 if len(code) else 0
    count = np.zeros((len(sids), seen), np.int64)
    count[np.searchsorted(sids, sid[~bare]), code] = n[~bare]
    p = _shares(count, total[:, None], terms) if terms else count
    out = []
    for x in range(len(sids)):
        if sids[x] // TILE != i:
            continue
        others = np.flatnonzero((sids > sids[x]) & (sids // TILE == j))
        diff = p[others] - p[x]
        values = (diff * diff // (p[others] + p[x])).sum(1) if seen else np.zeros(len(others), np.int64)
        out += [(lang, int(sids[x]), int(sids[y]), int(v), seen) for y, v in zip(others, values)]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], names=["lang", "a", "b", "value", "seen"])


def _pairs(counts: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of a language's sources."""
    own = groups.select("lang", "source", "sid", "total", "terms", "tiles")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / block)).cast("int")
    term_rows = (counts.join(own, ["lang", "source"])
                 .select("lang", "sid", "term", "n", "terms", "tiles", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block")))
    bare = own.select("lang", "sid", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), "terms", "tiles",
                      F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    tile = F.floor(F.col("sid") / TILE).cast("int")
    dealt = (term_rows.unionByName(bare).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumns({"ti": F.least(tile, F.col("other")), "tj": F.greatest(tile, F.col("other"))}))
    sums = (dealt.groupBy("lang", "block", "ti", "tj").applyInArrow(_pair_sums, _PAIRS)
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")))
    a = groups.select("lang", F.col("sid").alias("a"), F.col("source").alias("source_a"), F.col("total").alias("total_a"), "terms")
    b = groups.select("lang", F.col("sid").alias("b"), F.col("source").alias("source_b"), F.col("total").alias("total_b"))
    zero = F.lit(0).cast("long")
    unseen = F.when(F.col("terms") > F.col("seen"), (F.col("terms") - F.col("seen")) * apart(
        share(zero, F.col("total_a"), F.col("terms")), share(zero, F.col("total_b"), F.col("terms")))).otherwise(zero)
    named = sums.join(a, ["lang", "a"]).join(b, ["lang", "b"]).withColumn("value", F.col("value") + unseen)
    return named.select("lang", "value", F.explode(F.array(
        F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
        F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("p")).select("lang", "p.source", "p.item", "value")


def _terms(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for the terms a group has above its language's share."""
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    both = (counts.join(whole, ["lang", "term"]).join(groups, ["lang", "source"])
            .select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")))
    return both.where("p > q").select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, first: int = FIRST, left_bytes: int = LEFT_BYTES,
          block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source stands from
    the others of its language (part ``pair``), and its ``top`` terms above the
    language's share (part ``term``)."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = common.stage(kept_counts(docs, least, first, left_bytes), "terms")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"))
    terms = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    zero = F.lit(0).cast("long")
    groups = (docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
              .join(by_lang, "lang", "left").join(terms, "lang", "left")
              .select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "terms"))))
    whole = Window.partitionBy("lang")
    groups = common.stage(groups.withColumns({
        "sid": F.row_number().over(whole.orderBy("source")) - 1,
        "tiles": F.ceil(F.count(F.lit(1)).over(whole) / TILE).cast("int")}), "groups")
    ranks = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pairs = _pairs(counts, groups, block).withColumn("rank", F.row_number().over(ranks))
    best = _terms(counts, groups).withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top)
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumn("part", F.lit("pair")).select(*cols)
            .unionAll(best.withColumn("part", F.lit("term")).select(*cols)))
