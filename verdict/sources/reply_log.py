"""A reply log whose appends are seen whole, once, or not at all.

    <log>/files/commit=<token>/method=…/model=…   replies of one commit
    <log>/index/<token>                           keys of a bucket, as of that commit
    <log>/commits/<bucket>-<version>              one small file per commit

A prompt's replies belong to one bucket, by the hash of its id. An append
writes its files first and then publishes the next version of its bucket by
renaming a finished file into ``commits``, which fails if that version is
there. Readers see published commits only: a job that dies before it publishes
leaves nothing visible and its replies are owed again. Of two writers that
began from the same version one publishes; the other drops what the first has
collected and publishes the rest as the version after it.

Beside each commit lies an index of all keys of its bucket: for every model and
method the prompts' 64-bit hashes, sorted, with a bit per replicate (one set
for logged, one for logged without error), compressed. What is still owed is
found from it without reading the log: one row per (bucket, model, method),
whatever the log holds. Two prompt ids would have to share a hash and a bucket
for an owed reply to be missed (some 5 * 10^-14 for a million keys a row). A
missing index is rebuilt from the bucket's replies.

The file system must rename without overwriting (HDFS and its like, local
disks). Replicates run from 1 to 63.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import labels
from ..schemas import WORK_KEYS
from ..session import scratch_dir

_INDEX = "bucket int, model string, method string, prompts binary, logged binary, fine binary"
_KEYS = ["bucket", "model", "method"]


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<i8").tobytes(), 6)


def _unpack(data: bytes | None) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i8") if data else np.zeros(0, np.int64)


def _merge(keys: pa.Table) -> pa.Table:
    """One (bucket, model, method): index rows and new keys to one index row."""
    hashes, logged, fine = [], [], []
    for r in keys.to_pylist():
        if r["prompts"] is not None:
            hashes.append(_unpack(r["prompts"]))
            logged.append(_unpack(r["logged"]))
            fine.append(_unpack(r["fine"]))
    new = keys.filter(pa.array(np.array(keys.column("prompts").is_null())))
    hashes.append(new.column("hash").to_numpy())
    logged.append(new.column("bits").to_numpy())
    fine.append(new.column("fine_bits").to_numpy())
    h, l, f = (np.concatenate(x).astype(np.int64) for x in (hashes, logged, fine))
    one, at = np.unique(h, return_inverse=True)
    both = [np.zeros(len(one), np.int64) for _ in range(2)]
    for out, bits in zip(both, (l, f)):
        np.bitwise_or.at(out, at, bits)
    first = {k: [keys.column(k)[0].as_py()] for k in _KEYS}
    return pa.table({"bucket": pa.array(first["bucket"], pa.int32()), "model": pa.array(first["model"], pa.string()),
                     "method": pa.array(first["method"], pa.string()), "prompts": pa.array([_pack(one)], pa.binary()),
                     "logged": pa.array([_pack(both[0])], pa.binary()), "fine": pa.array([_pack(both[1])], pa.binary())})


#: Parts of a (bucket, model, method) by hash, each looked up by itself: wanted rows may carry prompts.
PARTS = 64
_INDEX_PARTS = f"{_INDEX}, _part int"


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows cut into their parts."""
    for batch in batches:
        for row in batch.to_pylist():
            hashes, logged, fine = (_unpack(row[c]) for c in ("prompts", "logged", "fine"))
            part = hashes % PARTS
            for k in np.unique(part):
                here = part == k
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["bucket"]], pa.int32()), pa.array([row["model"]], pa.string()), pa.array([row["method"]], pa.string()),
                     *(pa.array([_pack(x[here])], pa.binary()) for x in (hashes, logged, fine)), pa.array([k], pa.int32())],
                    names=[*_KEYS, "prompts", "logged", "fine", "_part"])


def _still_owed(bits: str):
    def run(wanted: pa.Table, index: pa.Table) -> pa.Table:
        if not index.num_rows or not wanted.num_rows:
            return wanted
        row = index.to_pylist()[0]
        known, have = _unpack(row["prompts"]), _unpack(row[bits])
        hashes, reps = wanted.column("_hash").to_numpy(), wanted.column("replicate").to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
        there = (known[at] == hashes) & ((have[at] >> reps) & 1 == 1) if len(known) else np.zeros(len(hashes), bool)
        return wanted.filter(pa.array(~there))
    return run


class ReplyLog:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """Opens the log at ``path``, or begins one; an existing log keeps its
        own number of buckets."""
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)
        self.buckets = buckets
        if not self._publish("layout", {"buckets": buckets}):
            self.buckets = self._read("layout")["buckets"]

    # -- small files -------------------------------------------------------

    def _commit_file(self, name: str):
        return self._path(f"{self.path}/commits/{name}")

    def _publish(self, name: str, content: dict) -> bool:
        """Puts a finished file in place unless its name is taken."""
        if self._fs.exists(self._commit_file(name)):
            return False
        draft = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        self._fs.mkdirs(self._path(f"{self.path}/commits"))
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(draft, self._commit_file(name), no_overwrite)
        except Exception as e:  # noqa: BLE001 - py4j wraps the file system's own
            if "FileAlreadyExists" not in str(e) and "rename destination" not in str(e):
                raise
            self._fs.delete(draft, False)
            return False
        return True

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._commit_file(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    # -- reading -----------------------------------------------------------

    def _names(self) -> list[tuple[int, int, str]]:
        """(bucket, version, name) of the published commits, in order."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/commits"))]
        return sorted((*map(int, n.split("-")), n) for n in names if "-" in n)

    def commits(self, bucket: int | None = None) -> dict[int, list[dict]]:
        """Published commits by bucket (or of one bucket), oldest first; one
        small file each."""
        found: dict[int, list[dict]] = {}
        for b, version, name in self._names():
            if bucket is None or b == bucket:
                found.setdefault(b, []).append({"version": version, **self._read(name)})
        return found

    def version(self, bucket: int) -> int:
        return max((v for b, v, _ in self._names() if b == bucket), default=0)

    def read(self, model: str | None = None, method: str | None = None, commits: dict[int, list[dict]] | None = None) -> DataFrame:
        """The replies of all published commits; filters prune folders."""
        tokens = [c["token"] for cs in (self.commits() if commits is None else commits).values() for c in cs]
        df = self._replies(tokens)
        for name, value in (("model", model), ("method", method)):
            df = df if value is None else df.where(F.col(name) == value)
        return df

    def _replies(self, tokens: list[str]) -> DataFrame:
        if not tokens:
            return self.spark.createDataFrame([], schemas.LOG)
        return (self.spark.read.schema(schemas.LOG).option("basePath", f"{self.path}/files")
                .parquet(*[f"{self.path}/files/commit={t}" for t in tokens]).select(*schemas.LOG.fieldNames()))

    # -- the index ---------------------------------------------------------

    def bucket_of(self, prompt_id: Column | str) -> Column:
        return F.pmod(F.xxhash64(prompt_id), F.lit(self.buckets)).cast("int")

    def _key_rows(self, replies: DataFrame) -> DataFrame:
        """New keys, a row per (model, method, prompt), as _merge takes them."""
        none = F.lit(None).cast("binary")
        # Scala's << shifts by an int; a replicate is one bit of a long.
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("replicate"))
        ok = F.when(labels.has_error("error"), F.lit(0).cast("long")).otherwise(bit)
        return (replies.groupBy(self.bucket_of("prompt_id").alias("bucket"), "model", "method", F.xxhash64("prompt_id").alias("hash"))
                .agg(F.bit_or(bit).alias("bits"), F.bit_or(ok).alias("fine_bits"))
                .select(*_KEYS, none.alias("prompts"), none.alias("logged"), none.alias("fine"), "hash", "bits", "fine_bits"))

    def _has_index(self, commit: dict) -> bool:
        return self._fs.exists(self._path(f"{self.path}/index/{commit['token']}/_SUCCESS"))

    def index(self, commits: dict[int, list[dict]] | None = None) -> DataFrame:
        """One row per (bucket, model, method): the newest of every bucket. A
        bucket whose newest index is gone is read again and indexed anew."""
        commits = self.commits() if commits is None else commits
        lost = {b: cs for b, cs in commits.items() if not self._has_index(cs[-1])}
        for b, cs in lost.items():
            self._write_index(b, cs[-1]["token"], self._replies([c["token"] for c in cs]), None)
        at = [f"{self.path}/index/{cs[-1]['token']}" for cs in commits.values()]
        return self.spark.read.schema(_INDEX).parquet(*at) if at else self.spark.createDataFrame([], _INDEX)

    def _write_index(self, bucket: int, token: str, new: DataFrame, before: dict | None) -> None:
        keys = self._key_rows(new)
        if before is not None:
            old = self.index({bucket: [before]})
            zero = F.lit(0).cast("long")
            keys = keys.unionByName(old.select(*_KEYS, "prompts", "logged", "fine", zero.alias("hash"), zero.alias("bits"), zero.alias("fine_bits")))
        keys.groupBy(*_KEYS).applyInArrow(_merge, _INDEX).write.mode("overwrite").parquet(f"{self.path}/index/{token}")

    def outstanding(self, wanted: DataFrame, retry_failed: bool = False, commits: dict[int, list[dict]] | None = None) -> DataFrame:
        """J3 from the index: what of ``wanted`` no published commit holds (or,
        with ``retry_failed``, none holds without error)."""
        cols = wanted.columns
        keyed = wanted.withColumns({"bucket": self.bucket_of("prompt_id"), "_hash": F.xxhash64("prompt_id")})
        keyed = keyed.withColumn("_part", F.pmod("_hash", F.lit(PARTS)).cast("int"))
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields)
        index = self.index(commits).mapInArrow(_in_parts, _INDEX_PARTS)
        return (keyed.groupBy(*_KEYS, "_part").cogroup(index.groupBy(*_KEYS, "_part"))
                .applyInArrow(_still_owed("fine" if retry_failed else "logged"), kind).select(*cols))

    # -- appending ---------------------------------------------------------

    def append(self, replies: DataFrame, bucket: int, since: int) -> int:
        """Commits replies of one bucket that were owed as of version ``since``.
        Returns how many were published: fewer than given if another writer
        has collected some of them in the meantime."""
        if "logged_at" not in replies.columns:
            replies = replies.withColumn("logged_at", F.current_timestamp())
        token = self._write(replies)
        while True:
            mine = self.commits(bucket).get(bucket, [])
            newer = [c for c in mine if c["version"] > since]
            if newer:  # another writer was here: keep what it does not have
                rest = self._replies([token]).join(self._replies([c["token"] for c in newer]).select(*WORK_KEYS), WORK_KEYS, "left_anti")
                token, since = self._write(rest), newer[-1]["version"]
            rows = self._replies([token])
            n = rows.count()
            if not n:
                return 0
            self._write_index(bucket, token, rows, mine[-1] if mine else None)
            if self._publish(f"{bucket:06d}-{since + 1:08d}", {"token": token, "rows": n}):
                return n

    def load(self, replies: DataFrame) -> int:
        """Takes in replies from elsewhere, one commit a bucket. Returns their number."""
        since = {b: v for b, v, _ in self._names()}
        at = scratch_dir(self.spark, "load")
        staged = replies.withColumn("_bucket", self.bucket_of("prompt_id"))
        staged.write.partitionBy("_bucket").parquet(at)
        staged = self.spark.read.schema(staged.schema).parquet(at)
        filled = [r[0] for r in staged.select("_bucket").distinct().orderBy("_bucket").collect()]  # at most one a bucket
        return sum(self.append(staged.where(F.col("_bucket") == b).drop("_bucket"), b, since.get(b, 0)) for b in filled)

    def _write(self, replies: DataFrame) -> str:
        token = uuid.uuid4().hex
        cols = [c for c in schemas.LOG.fieldNames() if c in replies.columns]
        (replies.select(*cols).write.partitionBy("method", "model").parquet(f"{self.path}/files/commit={token}"))
        self._fs.mkdirs(self._path(f"{self.path}/files/commit={token}"))  # of no rows Spark may write no folder
        return token

    def vacuum(self) -> int:
        """Deletes files of commits never published. Not while a writer is at
        work: its files are not published yet."""
        kept = {c["token"] for cs in self.commits().values() for c in cs}
        gone = 0
        for folder in ("files", "index"):
            at = self._path(f"{self.path}/{folder}")
            for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if s.getPath().getName().removeprefix("commit=") not in kept:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        return gone
