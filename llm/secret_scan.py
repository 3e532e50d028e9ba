"""Secret scans: candidates by pattern, false positives removed by a random
forest trained from labelled findings.

Candidates: runs of 8 or more key characters with a digit, or of ``LONG`` or
more with a letter, and every value assigned to the name of a secret, whatever
its signs, digits or length (between quotes, or up to white space or another
name assigned after ``&``, ``;`` or ``,``, without closing signs at its end;
names inside such a value do not count anew). Of two that start together the
longer stands; others may overlap. Features: length, shares of letter kinds and
their transitions, entropy, dictionary coverage (the share of its four-letter
runs that are usual in the corpus' words, from one count over all texts in a
table of fixed size), the path (the name it is assigned to, or what precedes it
in a URL) and the words beside it. The forest is fitted on at most
``FIT_ROWS`` labelled findings and sent with the tasks.

Nulls and empty texts have no candidates. A null doc_id is a row like any
other; repeated rows each get their result. Without labelled findings of both
kinds the forest says the share it has seen, or one half.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, labelled

FIT_ROWS = 20_000
GRAMS, USUAL = 1 << 16, 1e-6
TREES, DEPTH, LEAF, SEED = 25, 9, 4, 7
CUT = 0.5
_RUN = re.compile(r"\S{8,}")
_VALUE = re.compile(r"[A-Za-z0-9+/_\-]{8,}={0,2}")
_ASSIGNED = re.compile(r"([A-Za-z_][\w.\-]*)[\"']?\s*[:=]\s*[\"']?$")
#: An assignment's sign and its value, quoted or not.
_SIGN = re.compile(r"[:=]+>?")
_NAME = re.compile(r"([A-Za-z_][\w.\-]*)[\"']?\s*$")
_GIVEN = re.compile(r"""\s*(?:"([^"\n]+)"|'([^'\n]+)'|["']?((?:(?![&;,][\w.\-]+[:=])\S)+))""")
_CLOSING = ".,;:)]}>\"'`"
LONG = 20
_WORD = re.compile(r"[^\W\d_]+")
_BESIDE = 48  # characters looked at on either side for words and names
_PATH = 256  # characters of a longer path kept as they are
#: Names that secrets are assigned to (general vocabulary).
SECRET_NAMES = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "credential", "private"]
#: Names too short to be looked for inside others.
SHORT_NAMES = ["pw"]
BUCKETS = 8
#: Formats that mark a finding as a true one when no human labels are given.
KNOWN_FORMATS = re.compile(r"AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}")


def _paths(run: str):
    """Place in a run to what precedes it. Of a long one the end stays, after
    the signs and names that ``features`` looks for in the rest: the copies of
    one run's paths would grow with its square."""
    marks = {}

    def path(at: int) -> str:
        if at <= _PATH:
            return run[:at]
        if not marks:
            low = run.lower() if run.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in run)
            marks.update((m, k + len(m)) for m in ("/", "@", *SECRET_NAMES) if (k := low.find(m)) >= 0)
            marks.setdefault("", 0)
        return " ".join(m for m, end in marks.items() if end <= at) + " " + run[at - _PATH:at]
    return path


def is_secret_name(path: str) -> bool:
    low = path.lower()
    return any(s in low for s in SECRET_NAMES) or low in SHORT_NAMES


def _assigned(text: str):
    """(start, end, name) of every value assigned to the name of a secret."""
    taken = 0  # so that values never overlap, which could grow with the square
    for m in _SIGN.finditer(text):
        if m.start() < taken:
            continue
        left = text[max(0, m.start() - _BESIDE):m.start()]
        low = left.lower()
        if not any(s in low for s in (*SECRET_NAMES, *SHORT_NAMES)):
            continue
        name = _NAME.search(left)
        value = _GIVEN.match(text, m.end()) if name and is_secret_name(name.group(1)) else None
        if value:
            at, end = value.span(value.lastindex)
            taken = end
            if value.lastindex == 3:
                end = at + (len(value.group(3).rstrip(_CLOSING)) or end - at)
            yield at, end, name.group(1)


def candidates(text: str | None) -> list[tuple[int, str, str, str, str]]:
    """(start, value, path, word before, word after) of each candidate, in order."""
    text, spans = text or "", {}
    for m in _RUN.finditer(text):
        path_to = _paths(m.group())
        for v in _VALUE.finditer(m.group()):
            value = v.group()
            if any(c.isdigit() for c in value) or len(value) >= LONG and any(c.isalpha() for c in value):
                spans[m.start() + v.start()] = m.start() + v.end(), path_to(v.start())
    for at, end, name in _assigned(text):
        if at not in spans or end > spans[at][0]:
            spans[at] = end, name
    out = []
    for at, (end, path) in sorted(spans.items()):
        left, right = text[max(0, at - _BESIDE):at], text[end:end + _BESIDE]
        name = _ASSIGNED.search(left)
        before = _WORD.findall(left[:name.start()] if name else left)
        after = _WORD.findall(right)
        out.append((at, text[at:end], name.group(1) if name else path, before[-1] if before else "", after[0] if after else ""))
    return out


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _grams(data: bytes) -> np.ndarray:
    """Hashes of the four-letter runs (a-z, lowered)."""
    b = np.frombuffer(data.lower(), np.uint8)
    if len(b) < 4:
        return np.empty(0, np.int64)
    letter = (b >= 97) & (b <= 122)
    ok = letter[:-3] & letter[1:-2] & letter[2:-1] & letter[3:]
    x = b.astype(np.uint32)
    code = ((x[:-3] * 26 + x[1:-2]) * 26 + x[2:-1]) * 26 + x[3:]
    return ((code[ok] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def features(value: str, path: str, before: str, after: str, usual: np.ndarray) -> list[float]:
    kinds = [_kind(c) for c in value]
    n, moves = len(value), Counter(zip(kinds, kinds[1:]))
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    grams = _grams(value.encode())
    covered = float(usual[grams].mean()) if len(grams) else 0.0
    low = path.lower()
    words = [float(low != ""), float(is_secret_name(path)), float("://" in low or "/" in low), float("@" in low)]
    near = [0.0] * (2 * BUCKETS)
    for k, w in enumerate((before, after)):
        if w:
            near[k * BUCKETS + zlib.crc32(w.lower().encode()) % BUCKETS] = 1.0
    hexed = all(c in "0123456789abcdef" for c in value.lower())
    return [float(n), *(kinds.count(k) / n for k in range(4)), *(moves[a, b] / max(1, n - 1) for a in range(4) for b in range(4)),
            entropy, float(hexed), covered, len(grams) / n, *words, *near]


N_FEATURES = 1 + 4 + 16 + 4 + 4 + 2 * BUCKETS


class Forest:
    """Trees on bootstrap rows, each split by the best of a few features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.base = float(y.mean()) if len(y) else 0.5
        both = len(y) and 0 < self.base < 1
        self.trees = [self._grow(x, y, rng.integers(0, len(y), len(y)), rng, DEPTH) for _ in range(TREES)] if both else []

    def _grow(self, x, y, rows, rng, depth):
        p = float(y[rows].mean())
        if depth == 0 or len(rows) < 2 * LEAF or p in (0.0, 1.0):
            return p
        best = (2 * p * (1 - p) - 1e-9, None, None)
        for f in rng.choice(x.shape[1], max(1, round(2 * x.shape[1] ** 0.5)), replace=False):
            v = x[rows, f]
            for t in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 12))):
                left = v <= t
                k = int(left.sum())
                if k < LEAF or len(rows) - k < LEAF:
                    continue
                a, b = y[rows[left]].mean(), y[rows[~left]].mean()
                g = (k * 2 * a * (1 - a) + (len(rows) - k) * 2 * b * (1 - b)) / len(rows)
                if g < best[0]:
                    best = (g, f, t)
        if best[1] is None:
            return p
        left = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, y, rows[left], rng, depth - 1), self._grow(x, y, rows[~left], rng, depth - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.base)
        out = np.zeros(len(x))

        def walk(tree, rows):
            if isinstance(tree, float):
                out[rows] += tree / TREES
            elif len(rows):
                left = x[rows, tree[0]] <= tree[1]
                walk(tree[2], rows[left])
                walk(tree[3], rows[~left])
        for t in self.trees:
            walk(t, np.arange(len(x)))
        return out


def usual_grams(docs: DataFrame) -> np.ndarray:
    """Which four-letter runs are usual, over all texts; GRAMS flags."""
    def count(batches):
        n = np.zeros(GRAMS, np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                n += np.bincount(_grams((t or "").encode()), minlength=GRAMS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["g", "n"])

    out = np.zeros(GRAMS)
    got = docs.select("text").mapInArrow(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n"))
    for r in got.collect():  # GRAMS rows at most
        out[r.g] = r.n
    return out >= max(2.0, USUAL * out.sum())


_FOUND = "doc_id long, found array<struct<start:long,value:string,path:string,before:string,after:string,label:int>>"


def findings(docs: DataFrame) -> DataFrame:
    """Each row of docs (doc_id, text) with its candidates. ``label`` is what
    known formats and the names of secrets say, for use where no one labelled."""
    kind = pa.list_(pa.struct([("start", pa.int64()), *((c, pa.string()) for c in ("value", "path", "before", "after")),
                               ("label", pa.int32())]))

    def run(batches):
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                out.append([{"start": at, "value": v, "path": p, "before": w, "after": z,
                             "label": int(bool(KNOWN_FORMATS.fullmatch(v)) or is_secret_name(p))}
                            for at, v, p, w, z in candidates(t)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, kind)], names=["doc_id", "found"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _FOUND)


def train(labelled_findings: DataFrame, usual: np.ndarray, most: int = FIT_ROWS) -> Forest:
    """A forest from (value, path, before, after, label), at most ``most`` of
    the distinct ones by hash."""
    cols = ["value", "path", "before", "after", "label"]
    one = labelled_findings.select(*cols).where("label in (0, 1)").distinct()
    rows = one.orderBy(F.xxhash64(*cols), *cols).limit(most).collect()
    x = np.array([features(*r[:4], usual) for r in rows], float).reshape(len(rows), N_FEATURES)
    return Forest(x, np.array([r.label for r in rows], float))


def scan(found: DataFrame, forest: Forest, usual: np.ndarray) -> DataFrame:
    """Rows of ``findings`` with n_candidates, n_secrets and the secrets'
    places as (start, length, score), in order."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            rows = b.column("found").to_pylist()
            flat = [features(c["value"], c["path"], c["before"], c["after"], usual) for r in rows for c in r]
            scores = iter(forest.score(np.array(flat, float).reshape(len(flat), N_FEATURES)))
            out = [[{"start": c["start"], "length": len(c["value"]), "score": float(s)}
                    for c in r if (s := next(scores)) >= CUT] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([len(x) for x in y], pa.int64()) for y in (rows, out)), pa.array(out, kind)],
                names=["doc_id", "n_candidates", "n_secrets", "secrets"])
    return found.mapInArrow(run, "doc_id long, n_candidates long, n_secrets long, "
                                 "secrets array<struct<start:long,length:long,score:double>>")


def secrets(docs: DataFrame) -> DataFrame:
    """``scan`` over docs (doc_id, text), the forest trained on the findings
    outside fold 0 as known formats and names label them."""
    usual = usual_grams(docs)
    found = common.stage(findings(docs), "findings")
    fit = found.where(F.coalesce(labelled.fold(F.col("doc_id")) != 0, F.lit(False))).select(F.explode("found").alias("c")).select("c.*")
    return scan(found, train(fit, usual), usual)
