"""What clauses count as, one table a class."""

import numpy as np
import pytest

from llm import toxicity as T

CLAUSES = {
    "plain": ["what an idiot", "stupid weather today", "a pathetic show", "the clown came late", "murder on the train", "such trash",
              "idiots everywhere", "burn the toast"],
    "led": ["you idiot", "you are so stupid", "they will burn", "you will kill", "he is a moron", "tu es débile", "du dummkopf", "you're pathetic"],
    "aimed": ["kill you", "i will kill you", "idiot you are", "go hurt them", "shoot those people", "stupid you", "burn her house", "beat him up"],
    "negated": ["you are not an idiot", "she isn't stupid", "she isn’t stupid", "not by any stretch of the mind a fool", "never hurt them",
                "no trash here", "ich werde dich nicht töten", "nunca fue estúpido"],
    "reported": ["he said you are stupid", "they called him a moron", "the man allegedly wants to kill them", "she wrote that fools win",
                 "quote you idiot", "il a dit imbécil", "laut trottel", "reportedly pathetic"],
}


@pytest.mark.parametrize("kind", CLAUSES)
def test_kinds_of_clauses(kind):
    g, lex, n = T.Grammar(), T.Lexicon({}), len(T.KINDS)
    for clause in CLAUSES[kind]:
        f = np.array(T.document_features(clause, g, lex)[:2 * n])
        got = {T.KINDS[i % n] for i in np.flatnonzero(f)}
        assert got == {kind}, (clause, got)


def test_a_contrast_or_a_match_ends_a_negation():
    g, lex, n = T.Grammar(), T.Lexicon({}), len(T.KINDS)
    for clause in ("not nice but stupid", "not an idiot and a fool"):
        f = T.document_features(clause, g, lex)
        assert f[T.KINDS.index("plain")] > 0, clause


def test_both_sides_against_a_search_of_each_clause():
    """The composed machine against its rules read off the words directly."""
    g, r, n = T.Grammar(), np.random.default_rng(3), len(T.KINDS)
    for _ in range(2000):
        xs = r.integers(0, T.THREAT + 1, r.integers(1, 12)).tolist()
        want = [0.0] * (2 * n)
        for i, x in enumerate(xs):
            if x < T.INSULT:
                continue
            neg = [j for j in range(i) if xs[j] == T.NEGATION]
            kind = ("reported" if T.REPORT in xs[:i]
                    else "negated" if neg and all(y < T.CONTRAST for y in xs[neg[-1]:i])
                    else "aimed" if T.TARGET in xs[i + 1:i + 1 + T.AIMED_FOR]
                    else "led" if T.TARGET in xs[max(0, i - T.AIMED_FOR):i] else "plain")
            want[(x == T.THREAT) * n + T.KINDS.index(kind)] += i + 1
        got = [0.0] * (2 * n)
        g.clause(xs, [i + 1 for i in range(len(xs))], got)
        assert got == want, xs
