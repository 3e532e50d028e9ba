"""Packing and its token ids against the library and exact optima."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import packing, queries, word_tokens
from tests.conftest import SF_SMALL

SPEC = open(public_tokenizers.path(queries.WORD_TOKENIZER), encoding="utf-8").read()
SIGNS = ["a", "B", "é", "É", "ß", "ÿ", "Ÿ", "×", "÷", "'", "'s", "'Re", "<|endoftext|>", "<", "|", ">", " ", "\n", "\t", "\x1c", "\x85",
         "\xa0", "́", " ", "1", "23", "!", "...", "中", "日本", "😀", "ü", "Σ", "σ", "İ", "ﬁ", "²", "Ⅷ", "\x00", "_", "-", "​", "ก็", "가",
         "Ö", "œ", "aaaa", "the", "THE", "ing", "x" * 20]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(SPEC)


def test_ids_equal_the_library(library):
    words = word_tokens.WordTokens(SPEC, slots=64)  # so few slots that words displace each other
    rng = random.Random(1)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [r for r in pq.read_table(f"{SF_SMALL}/documents.parquet").column("text").to_pylist() if r]
    for lo in range(0, len(texts), 500):
        part = texts[lo:lo + 500]
        ids, offs = words.batch(pa.array(part, pa.string()))
        for i, e in enumerate(library.encode_batch(part, add_special_tokens=False)):
            assert ids[offs[i]:offs[i + 1]].tolist() == e.ids, part[i]


def test_other_vocabularies_go_to_the_library(library):
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words = word_tokens.WordTokens(other.to_str())
    assert words.merges is None
    ids, offs = words.batch(pa.array(["Hello  there", "", "x"], pa.string()))
    assert ids[offs[0]:offs[1]].tolist() == other.encode("Hello  there", add_special_tokens=False).ids and offs[1] == offs[2]


def fewest(sizes, cap):
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= cap:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])
    go(0, [])
    return best[0]


def test_bound_and_best_fit_enclose_the_optimum():
    rng = random.Random(2)
    for _ in range(300):
        cap = rng.choice([7, 10, 12, 30])
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(1, 9))]
        bins = packing.best_fit(sorted(sizes, reverse=True), cap)
        fill = collections.Counter()
        for b, n in zip(bins, sorted(sizes, reverse=True)):
            fill[b] += n
        assert max(fill.values()) <= cap
        assert packing.lower_bound(np.bincount(sizes, minlength=cap + 1)) <= fewest(sizes, cap) <= len(fill)


def check(rows, cap):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= cap
    return len(by)


def test_exchange_closes_gaps(spark):
    rng = random.Random(3)
    sizes = [rng.randint(1, 100) for _ in range(3000)]
    df = spark.createDataFrame([(i, n, "x", 7) for i, n in enumerate(sizes)], "pk_uid long, length long, pk_part string, sequence_id int")
    one = packing.pack(df, capacity=100, part=100, rounds=1).collect()
    more = packing.pack(df, capacity=100, part=100).collect()
    assert sorted((r.pk_uid, r.length, r.pk_part) for r in more) == sorted((i, n, "x") for i, n in enumerate(sizes))
    bound = packing.lower_bound(np.bincount(sizes, minlength=101))
    alone = max(packing.best_fit(sorted(sizes, reverse=True), 100)) + 1
    print(bound, alone, check(one, 100), check(more, 100))
    assert bound <= check(more, 100) < check(one, 100) and check(more, 100) <= 1.02 * alone


def test_packing_of_one_length(spark):
    """Ties: a third of all lengths alike, none of which fit together."""
    df = spark.createDataFrame([(60,)] * 400 + [(30,)] * 200, "length long")
    assert check(packing.pack(df, capacity=100, part=64).collect(), 100) == 400
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(0,)], "length long"), capacity=10)


@pytest.mark.parametrize("small", [False, True])
def test_query_against_the_library(spark, odd, library, small):
    folder = SF_SMALL if small else odd
    docs = [(r["doc_id"], r["text"] or "") for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()]
    want = collections.Counter()
    total = 0
    for (doc, _), e in zip(docs, library.encode_batch([t for _, t in docs], add_special_tokens=False)):
        ids = np.array([*e.ids, 1], "<u4")
        total += len(ids)
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[doc, k, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes())] += 1
    rows = queries.op11_packing(spark, folder).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert check(rows, 4096) == -(-total // 4096)


def test_pieces_with_their_ids(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    rows = packing.pack(packing.token_pieces(docs, SPEC, capacity=64, ids=True), capacity=64).collect()
    assert check(rows, 64) and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    made = packing.pack(packing.token_pieces(docs.where(F.lit(False)), SPEC)).collect()
    assert made == []
