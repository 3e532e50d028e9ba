"""Token counts of a BPE piece vocabulary by compiled finite-state transducers.

The tokenizer is compiled into a deterministic transducer over characters,
built as texts need it. Its state after a prefix is all that the future can
depend on: the places where a piece may have begun that is not yet complete,
each with the characters since, the last token before it and the token count
there relative to the newest. Its transitions carry the change in the number of
tokens. They follow from one fact of BPE: tokens are an encoding exactly if
each neighbouring pair is the encoding of its own two strings. So the last
token after one more character is the one that fits to the encoding before it.
Pairs are settled by merging, once.

A place between two characters that no piece spans cuts the text: the
transducer is back in its start state there. Words therefore have counts of
their own, kept in a bounded table of compiled runs.

A text is read in chunks of ``CHUNK`` characters. A chunk's state map says what
it does to any state it may be entered in: (head, count, tail, cut): the
characters it feeds to the state that comes in, then, behind its first cut, a
fixed count and the characters that the state at its end has read since its last
cut. Head and tail hold no cut, so in prose of any script, in code, base64 or
empty lines they are a word's length at most; only a run whose every two
neighbours stand together in some piece (one letter repeated) stays whole. Maps
compose associatively; the chunks of a long text are composed by a scan in
rounds of ``ROUND`` neighbours across tasks.

Nulls count as empty texts; an empty text has no tokens; a null doc_id stays
null; repeated rows each get a count. The model's path is a parameter.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, ROUND = 1 << 14, 64
SPACE = "▁"  # the vocabulary's mark for a space (fixed value)
_WORDS, _STATES = 1_000_000, 500_000


class Transducer:
    """Counts tokens of runs of characters; states appear on demand."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.pairs = {p[i:i + 2] for p in scores for i in range(len(p) - 1)}
        if any(b == SPACE and a != SPACE for a, b in self.pairs):
            raise ValueError("a piece spans the start of a word; words have no counts of their own")
        self.begun = {p[:i] for p in scores for i in range(1, len(p))}
        self._fits: dict[tuple[str, str], bool] = {}
        self._clear()

    def _clear(self) -> None:
        start = (("", "", 0),)
        self.keys, self.ids, self.step = [start], {start: 0}, [{}]

    def merge(self, run: str) -> list[str]:
        """The encoding by definition: join the best-scored, leftmost pair."""
        parts = list(run)
        while True:
            best = max(((self.scores[x], -i) for i in range(len(parts) - 1)
                        if (x := parts[i] + parts[i + 1]) in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, a: str, b: str) -> bool:
        """Whether a then b is the encoding of their string (a may be empty)."""
        ok = self._fits.get((a, b))
        if ok is None:
            if len(self._fits) > _WORDS:
                self._fits.clear()
            ok = self._fits[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return ok

    def _next(self, state: int, c: str) -> tuple[int, int]:
        places = self.keys[state]
        for open_, before, count in places:
            token = open_ + c
            if (not open_ or token in self.scores) and self.fits(before, token):
                gain = count + (1 if token in self.scores else len(token.encode()))
                break
        else:
            raise ValueError("no token fits")
        begun = self.begun
        key = (*[(o + c, t, n - gain) for o, t, n in places if o + c in begun], ("", token, 0))
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.step.append({})
        self.step[state][c] = (to, gain)
        return to, gain

    def cuts(self, run: str) -> list[str]:
        """run, divided wherever no piece spans two neighbours."""
        out, at, pairs = [], 0, self.pairs
        for i in range(1, len(run)):
            if run[i - 1:i + 1] not in pairs:
                out.append(run[at:i])
                at = i
        out.append(run[at:])
        return out

    def count(self, run: str) -> int:
        """Tokens of a run without cuts."""
        if len(self.keys) > _STATES:
            self._clear()
        state = total = 0
        step = self.step
        for c in run:
            to = step[state].get(c) or self._next(state, c)
            state = to[0]
            total += to[1]
        return total


def pieces(model: str) -> dict[str, float]:
    """Piece -> score of a model's ordinary pieces (no control or byte pieces)."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


class Counter:
    """Counts of words (a space mark and what follows) from the transducer."""

    def __init__(self, scores: dict[str, float]):
        self.machine, self.known = Transducer(scores), {}

    def parts(self, parts: list[str]) -> int:
        """Tokens of runs without cuts."""
        if len(self.known) > _WORDS:
            self.known.clear()
        known, count, n = self.known, self.machine.count, 0
        for p in parts:
            m = known.get(p)
            if m is None:
                m = count(p)
                if len(p) <= 64:
                    known[p] = m
            n += m
        return n

    def run(self, run: str) -> int:
        n = self.known.get(run)
        if n is None:
            n = self.parts(self.machine.cuts(run))
            if len(run) <= 64:
                self.known[run] = n
        return n

    def state_map(self, chunk: str) -> tuple[str, int, str, bool]:
        """(head, count, tail, cut) of a chunk in the vocabulary's alphabet."""
        parts = chunk.split(SPACE)
        # A cut lies before a space mark that follows another character, and
        # wherever else no piece spans two neighbours.
        runs, gap = [parts[0]], 0
        for p in parts[1:]:
            gap += 1
            if p:
                runs.append(SPACE * gap + p)
                gap = 0
        if gap:
            runs.append(SPACE * gap)
        if not parts[0]:  # begins with a space mark: nothing known of what is before
            runs = runs[1:] or [""]
        first = self.machine.cuts(runs[0])
        if len(runs) == 1:
            return (first[0], self.parts(first[1:-1]), first[-1], True) if len(first) > 1 else (runs[0], 0, "", False)
        last = self.machine.cuts(runs[-1])
        run, known = self.run, self.known
        total = self.parts(first[1:]) + self.parts(last[:-1])
        for r in runs[1:-1]:
            n = known.get(r)
            total += run(r) if n is None else n
        return first[0], total, last[-1], True

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of a, then b. Between them lies a cut if no piece spans a's
        last character and b's first."""
        if not a[0] and not a[3]:
            return b
        if not b[0] and not b[3]:
            return a
        open_end = a[2] if a[3] else a[0]
        # b[0] empty and cut: cannot be, a map with a cut has a head.
        if open_end[-1] + b[0][0] not in self.machine.pairs:
            if a[3]:
                done = (a[0], a[1] + self.run(open_end), b[0], True)
            else:
                done = (a[0], 0, b[0], True)
        else:
            done = (a[0], a[1], open_end + b[0], True) if a[3] else (open_end + b[0], 0, "", False)
        if not b[3]:
            return done
        if not done[3]:
            return done[0], b[1], b[2], True
        return done[0], done[1] + self.run(done[2]) + b[1], b[2], True

    def total(self, m: tuple) -> int:
        """Tokens when entered in the start state."""
        return (self.run(m[0]) if m[0] else 0) + (m[1] + self.run(m[2]) if m[3] else 0)


def counter_of(scores: dict[str, float], key: int) -> Counter:
    """One counter for each Python worker and vocabulary, kept between tasks."""
    home = sys.modules.setdefault("_llm_counters", types.ModuleType("_llm_counters")).__dict__
    if key not in home:
        home[key] = Counter(scores)
    return home[key]


def normal(text: str) -> str:
    """The model's alphabet: a leading space, spaces as marks; an empty text stays empty."""
    return (SPACE + text.replace(" ", SPACE)) if text else ""


_MAP = "uid long, doc_id long, n_bytes long, chunk long, chunks long, head string, count long, tail string, cut boolean"


_NAMES = [x.split()[0] for x in _MAP.split(", ")]
_KINDS = [pa.int64()] * 5 + [pa.string(), pa.int64(), pa.string(), pa.bool_()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=_NAMES)


def _maps(scores: dict[str, float], key: int, chunk: int):
    def run(batches):
        counter = counter_of(scores, key)
        for b in batches:
            rows = []
            for uid, doc, text in zip(*(b.column(c).to_pylist() for c in ("uid", "doc_id", "text"))):
                s = normal(text or "")
                n, chunks = len((text or "").encode()), -(-len(s) // chunk)
                if chunks < 2:
                    rows.append((uid, doc, n, 0, 1, None, counter.total(counter.state_map(s)), None, False))
                else:
                    rows += [(uid, doc, n, k, chunks, *counter.state_map(s[k * chunk:(k + 1) * chunk]))
                             for k in range(chunks)]
            yield _batch(rows)
    return run


def _scan(scores: dict[str, float], key: int):
    """Composes the maps of up to ROUND neighbouring chunks."""
    def run(batches):
        counter = counter_of(scores, key)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                whole = ("", 0, "", False)
                for m in r["maps"]:
                    whole = counter.compose(whole, (m["head"], m["count"], m["tail"], m["cut"]))
                chunks = -(-r["chunks"] // ROUND)
                if chunks == 1:
                    whole = (None, counter.total(whole), None, False)
                rows.append((r["uid"], r["doc_id"], r["n_bytes"], r["part"], chunks, *whole))
            yield _batch(rows)
    return run


def token_counts(docs: DataFrame, scores: dict[str, float], stage: Callable, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs (doc_id, text). scores:
    the vocabulary, about a megabyte, sent with the tasks."""
    key = hash(frozenset(scores.items()))
    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    maps = stage(src.mapInArrow(_maps(scores, key, chunk), _MAP), "maps")
    done, left = maps.where("chunks = 1"), maps.where("chunks > 1")
    widest = left.agg(F.max("chunks")).first()[0] or 1
    while widest > 1:
        grouped = left.groupBy("uid", "doc_id", "n_bytes", "chunks", F.floor(F.col("chunk") / ROUND).alias("part")).agg(
            F.array_sort(F.collect_list(F.struct("chunk", "head", "count", "tail", "cut"))).alias("maps"))
        left = grouped.mapInArrow(_scan(scores, key), _MAP)
        widest = -(-widest // ROUND)
    return done.unionAll(left).select("doc_id", "n_bytes", F.col("count").alias("n_tokens"))
