"""Line dedup: keep every shared line in the smallest doc_id only.

Each line's key (ASCII white space stripped, A-Z lowered) is hashed to 128
bits. The occurrences are range-partitioned by (hash, document, position), so
that even a line that half of all documents hold is spread over many
partitions, and sorted; one stream over each partition tells first occurrences
from later ones. What belongs to a partition's first key waits: its run may
have begun in the partition before. Each partition also notes the first
document of its first and its last key, and these notes (two rows a partition)
settle the waiting rows. The result per document is a compressed bitmap of
kept lines, not text; only documents that lose a line have one.

Nulls: a null text is one empty line. A null doc_id counts as one document
that sorts after all others. Rows with equal doc_id are one document for the
question of who holds a line; each row gets its own result. Keys of fewer than
``min_chars`` code points always stay.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 10
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_LAST = (1 << 63) - 1  # a null doc_id sorts last


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _occurrences(min_chars: int):
    def run(batches):
        for b in batches:
            ids, texts = b.column("doc").to_pylist(), b.column("th").to_pylist()
            hi, lo, doc, th, pos = [], [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                for k, line in enumerate((t or "").encode().split(b"\n")):
                    key = line_key(line)
                    if _long_enough(key, min_chars):
                        a, c = struct.unpack("<qq", hashlib.blake2b(key, digest_size=16).digest())
                        hi.append(a)
                        lo.append(c)
                        doc.append(ids[i])
                        th.append(texts[i])
                        pos.append(k)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in (hi, lo, doc, th)), pa.array(pos, pa.int32())],
                names=["hi", "lo", "doc", "th", "pos"])
    return run


_KINDS = {"later": 0, "waits": 1, "note": 2}
_MARKS = "kind int, hi long, lo long, doc long, th long, pos int"


def _stream(batches):
    """Over one sorted partition: later occurrences, those of the first key
    (they wait), and a note of the first and the last key's first document."""
    lead = key = first = None
    for b in batches:
        out = []
        for hi, lo, doc, th, pos in zip(*(b.column(c).to_pylist() for c in ("hi", "lo", "doc", "th", "pos"))):
            if key is None:
                lead = (hi, lo)
                out.append((_KINDS["note"], hi, lo, doc, 0, 0))
            if key != (hi, lo):
                key, first = (hi, lo), doc
            if key == lead:
                out.append((_KINDS["waits"], hi, lo, doc, th, pos))
            elif doc != first:
                out.append((_KINDS["later"], 0, 0, doc, th, pos))
        yield _marks(out)
    if key is not None and key != lead:
        yield _marks([(_KINDS["note"], *key, first, 0, 0)])


def _marks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 4, pa.int32()]
    cols = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      names=["kind", "hi", "lo", "doc", "th", "pos"])


def pack_bitmap(dropped: list[int]) -> bytes:
    """Compressed keep bits up to the last dropped line; later lines are kept."""
    bits = bytearray(b"\xff") * ((max(dropped) >> 3) + 1)
    for p in dropped:
        bits[p >> 3] &= ~(1 << (p & 7))
    return zlib.compress(bytes(bits), 6)


def kept_lines(lines: list, bitmap: bytes | None) -> list:
    if bitmap is None:
        return lines
    bits = zlib.decompress(bitmap)
    return [x for p, x in enumerate(lines) if p >> 3 >= len(bits) or bits[p >> 3] >> (p & 7) & 1]


def _pack(batches):
    for b in batches:
        packed = [pack_bitmap(p) for p in b.column("dropped").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("th"), pa.array(packed, pa.binary())],
                                         names=["doc", "th", "bitmap"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"doc": F.coalesce("doc_id", F.lit(_LAST)).cast("long"),
                             "th": F.xxhash64("text")})


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, th, bitmap) for each text that loses a line: ``doc`` is its
    doc_id (null: the largest long), ``th`` the text's hash. docs needs doc_id and text."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    occ = _keyed(docs).select("doc", "th", "text").mapInArrow(
        _occurrences(min_chars), "hi long, lo long, doc long, th long, pos int")
    order = ["hi", "lo", "doc", "th", "pos"]
    marks = common.stage(occ.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .mapInArrow(_stream, _MARKS), "lines")
    notes = (marks.where(F.col("kind") == _KINDS["note"])  # two rows a partition at most
             .groupBy("hi", "lo").agg(F.min("doc").alias("first")))
    waited = (marks.where(F.col("kind") == _KINDS["waits"]).join(F.broadcast(notes), ["hi", "lo"])
              .where(F.col("doc") != F.col("first")).select("doc", "th", "pos"))
    dropped = marks.where(F.col("kind") == _KINDS["later"]).select("doc", "th", "pos").unionAll(waited)
    return (dropped.groupBy("doc", "th").agg(F.collect_set("pos").alias("dropped"))
            .mapInArrow(_pack, "doc long, th long, bitmap binary"))


def _digest(batches):
    for b in batches:
        n, gone, sha = [], [], []
        for t, bitmap in zip(b.column("text").to_pylist(), b.column("bitmap").to_pylist()):
            lines = (t or "").encode().split(b"\n")
            left = kept_lines(lines, bitmap)
            n.append(len(lines))
            gone.append(len(lines) - len(left))
            sha.append(hashlib.sha256(b"\n".join(left)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def with_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with ``bitmap``: null where a document keeps every line."""
    found = keep_bitmaps(docs, min_chars)
    return _keyed(docs).join(found, ["doc", "th"], "left").drop("doc", "th")


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the sha256 of the lines kept, joined."""
    return with_bitmaps(docs.select("doc_id", "text"), min_chars).select("doc_id", "text", "bitmap").mapInArrow(
        _digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
