"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses, and each word becomes a symbol: insult, threat,
target, negation, reported speech, or other. Small transducers follow one
matter each: a negation reaches to the next match or contrast ("but"), a mention
of reported speech to the end of the clause, a target over the words after it;
one more reads the clause from its end, so that a target reaches the words
before it too. Their composition is one machine of product states from both
sides, which decide what an insult or threat counts as: plain, said with a
target before it, aimed at a target after it, negated or reported. A clause's
matches add up, weighted by the words' severities, and a document's matched
clauses make a dozen features for a logistic score. Which of the kinds count for
how much is learned: "you will kill" has its target before, "kill you" after.

The severities and further words are learned from labelled texts: words and
word beginnings found in many toxic texts and in next to no others. So are the
weights of the score. Both use at most ``FIT_ROWS`` labelled rows.

Null and empty texts have no matches and get the score of a text without any.
Repeated rows get equal scores; a null doc_id is scored and not held out. Texts
of any length are read whole, each in one task. Empty tables give no rows, and
without labels every score is 0.5. Further columns are left alone.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, labelled

# Word lists of the grammar (general vocabulary of four languages).
TARGETS = """you your yours you're u he she they him his her hers their them this these those people tu te toi vous votre ils elles
du dich dir ihr euch sie dein usted ustedes ellos ellas tú""".split()
CONTRASTS = "but mais sondern aber pero sino".split()
NEGATIONS = """not no never neither nor isn't aren't don't doesn't wasn't ne pas jamais aucun non nicht kein keine
nie niemals nunca jamás ningún ninguna tampoco""".split()
REPORTS = """said says say saying called calls wrote writes claimed quoted quote reportedly allegedly dit disait
écrit appelé selon sagte sagt schrieb nannte laut dijo dice escribió llamó según""".split()
INSULTS = """idiot idiots stupid moron morons loser losers scum trash clown pathetic worthless disgusting dumb fool fools
imbécile crétin débile dummkopf trottel blödmann idiota imbécil estúpido""".split()
THREATS = """kill murder hurt destroy beat stab shoot hang burn tuer frapper détruire töten umbringen schlagen
zerstören matar golpear destruir""".split()

OTHER, TARGET, NEGATION, REPORT, CONTRAST, INSULT, THREAT = range(7)
KINDS = ["plain", "led", "negated", "reported", "aimed"]
#: Words a target reaches, before and after it.
AIMED_FOR = 3
#: Learned entries: the texts that must hold one, as a share of the toxic ones,
#: and the share of its texts (smoothed) that must be toxic.
SUPPORT, LEAST, PURITY, ENTRIES = 0.005, 3, 0.9, 4096
BEGINNINGS = range(3, 7)
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:,\n]")


def tokens(text: str | None) -> list[str]:
    """Lower-cased words and clause marks; a typographic apostrophe is one."""
    return _TOKEN.findall((text or "").lower().replace("\u2019", "'"))


_STOPS = frozenset(".!?;:,\n")
_STOP = -1


def _product(transducers: list) -> tuple[list, list[list[int]], int]:
    """Transducers (states, symbol -> next state) run side by side as one:
    its states, the next state for each (state, symbol), and the start."""
    states = list(itertools.product(*(range(n) for n, _ in transducers)))
    number = {s: i for i, s in enumerate(states)}
    step = [[number[tuple(f(x, y) for (_, f), x in zip(transducers, s))] for y in range(THREAT + 1)] for s in states]
    return states, step, number[(0,) * len(transducers)]


class Grammar:
    """The composed machine: a product read from the left, one read from the
    right, and an output for each (left state, right state, symbol)."""

    def __init__(self):
        negation = (2, lambda s, x: 1 if x == NEGATION else 0 if x >= CONTRAST else s)
        target = (AIMED_FOR + 1, lambda s, x: AIMED_FOR if x == TARGET else max(0, s - 1))
        report = (2, lambda s, x: int(s or x == REPORT))
        left, self.step, self.start = _product([negation, target, report])
        right, self.back, self.end = _product([target])
        kind = lambda n, led, r, aimed: KINDS.index(
            "reported" if r else "negated" if n else "aimed" if aimed else "led" if led else "plain")
        none = [None] * INSULT
        self.out = [[none + [kind(*s, t), len(KINDS) + kind(*s, t)] for (t,) in right] for s in left]

    def clause(self, symbols, severities, totals: list) -> bool:
        """Adds one clause's matches to totals; whether it has any."""
        after, state = [], self.end
        for x in reversed(symbols):
            after.append(state)
            state = self.back[state][x]
        state, hit = self.start, False
        for x, w, r in zip(symbols, severities, reversed(after)):
            k = self.out[state][r][x]
            if k is not None:
                totals[k] += w
                hit = True
            state = self.step[state][x]
        return hit


class Lexicon(dict):
    """word -> (symbol, severity); remembers words of late; bounded."""

    def __init__(self, entries: dict[str, float]):
        super().__init__()
        self.entries = entries
        self.fixed = {w: (k, 1.0) for k, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS),
                                                (CONTRAST, CONTRASTS), (THREAT, THREATS), (INSULT, INSULTS)) for w in ws}
        self.fixed |= {w: (_STOP, 0.0) for w in _STOPS}

    def __missing__(self, w: str):
        if len(self) > 1_000_000:
            self.clear()
        symbol, severity = self.fixed.get(w, (OTHER, 0.0))
        if symbol in (OTHER, INSULT, THREAT):
            learned = max((self.entries.get(x, 0.0) for x in features_of(w)), default=0.0)
            if learned > 0:
                symbol, severity = (symbol or INSULT), max(severity, learned)
        got = self[w] = (symbol, severity)
        return got


def features_of(w: str) -> list[str]:
    """The word and its beginnings (marked by *)."""
    return [w, *(w[:n] + "*" for n in BEGINNINGS if len(w) >= n)]


N_FEATURES = 2 * len(KINDS) + 3


def document_features(text: str | None, grammar: Grammar, lexicon: Lexicon) -> list[float]:
    """Totals by kind, matched clauses, their share, matches per word."""
    found = [lexicon[t] for t in tokens(text)]
    totals = [0.0] * (2 * len(KINDS))
    if not any(s >= INSULT for s, _ in found):
        return totals + [0.0] * 3
    clauses, hits, at = 0, 0, 0
    for i in range(len(found) + 1):
        if i == len(found) or found[i][0] == _STOP:
            if i > at:
                clauses += 1
                part = found[at:i]
                if any(s >= INSULT for s, _ in part):
                    hits += grammar.clause([s for s, _ in part], [w for _, w in part], totals)
            at = i + 1
    words = sum(s != _STOP for s, _ in found)
    return [math.log1p(x) for x in totals] + [math.log1p(hits), hits / max(1, clauses), 100 * sum(totals) / max(1, words)]


def _near_copy_key(text: str) -> int:
    """Equal for most near copies: their words' least hashed triple."""
    words = text.split()
    return min((hash_of(" ".join(words[i:i + 3])) for i in range(max(1, len(words) - 2))), default=0)


def hash_of(s: str) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(s) >> 1


def _counted(only: frozenset | None):
    """Texts (label, texts) to (feature, texts that hold it), one per partition."""
    def run(batches):
        n = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                words = {w for w in tokens(t) if w not in _STOPS}
                found = {f for w in words for f in features_of(w)}
                n.update(found if only is None else found & only)
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["f", "n"])
    return run


def learn_lexicon(texts: DataFrame) -> dict[str, float]:
    """feature -> severity, from (label, text). At most ENTRIES features."""
    kinds = {r.label: r["count"] for r in texts.groupBy("label").count().collect()}
    toxic, clean = kinds.get(1, 0), kinds.get(0, 0)
    least = max(LEAST, SUPPORT * toxic)
    count = lambda label, only: (texts.where(F.col("label") == label).mapInArrow(_counted(only), "f string, n long")
                                 .groupBy("f").agg(F.sum("n").alias("n")))
    held = {r.f: r.n for r in count(1, None).where(F.col("n") >= least).collect()}
    other = {r.f: r.n for r in count(0, frozenset(held)).collect()}
    out = {}
    for f, p in held.items():
        rate, base = (p + 0.5) / (toxic + 1), (other.get(f, 0) + 0.5) / (clean + 1)
        if rate / (rate + base) >= PURITY and p / (p + other.get(f, 0)) >= 0.8:
            out[f] = math.log(rate / base) / 4
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:ENTRIES])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with intercept last, mean, scale) by Newton steps."""
    if not len(x):
        return np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES), np.ones(N_FEATURES)
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.05)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    pull = np.diag([ridge] * (z.shape[1] - 1) + [1e-3])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + pull @ w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + pull, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def fit(docs: DataFrame, labels: DataFrame) -> tuple:
    """(lexicon, logistic model) from labelled texts outside fold 0."""
    with common.scope(docs.sparkSession):
        texts = common.stage(labelled.fit_texts(docs, labelled.fit_rows(labels, "toxic")), "toxic-fit")
        # Near copies of one text support a word once.
        key = F.pandas_udf(lambda s: s.fillna("").map(_near_copy_key), "long")
        single = texts.withColumn("k", key("text")).dropDuplicates(["label", "k"])
        lexicon = learn_lexicon(common.stage(single.select("label", "text"), "toxic-single"))
        found = (texts.mapInArrow(_features(lexicon, ["doc_id", "label"]), "doc_id long, label int, f array<double>")
                 .orderBy("doc_id", "f").collect())  # at most FIT_ROWS rows
    x = np.array([r.f for r in found], float).reshape(len(found), N_FEATURES)
    return lexicon, fit_logistic(x, np.array([r.label for r in found], float))


def _features(entries: dict, keep: list[str]):
    def run(batches):
        grammar, lexicon = Grammar(), Lexicon(entries)
        for b in batches:
            f = [document_features(t, grammar, lexicon) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(f, pa.list_(pa.float64()))], names=[*keep, "f"])
    return run


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, held_out, score for every row of docs."""
    entries, (w, mean, scale) = model

    def run(batches):
        grammar, lexicon = Grammar(), Lexicon(entries)

        def of(b):
            x = np.array([document_features(t, grammar, lexicon) for t in b.column("text").to_pylist()], float)
            z = (x.reshape(b.num_rows, N_FEATURES) - mean) / scale
            return 1 / (1 + np.exp(-np.clip(z @ w[:-1] + w[-1], -30, 30)))
        yield from labelled.scored(batches, of)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), labelled.held_out(F.col("doc_id")).alias("held_out"), "text")
    return src.mapInArrow(run, labelled.SCORED)


CUT = 0.5


def keep_clean(docs: DataFrame, model: tuple) -> DataFrame:
    """docs without those scored toxic, with their own columns."""
    entries, (w, mean, scale) = model

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar, lexicon = Grammar(), Lexicon(entries)
        for s in parts:
            x = np.array([document_features(t, grammar, lexicon) for t in s], float).reshape(len(s), N_FEATURES)
            yield pd.Series(1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30))))
    return docs.where(of("text") < CUT)
