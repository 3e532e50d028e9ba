"""Candidates of the secret scan: time on long runs, values of every kind."""

import time

import pytest

from llm import secret_scan


@pytest.mark.parametrize("run", ["日本語の文章" * 166_667, "abcdef.(" * 125_000, "x1234567." * 111_111, "password=" * 111_111, "token=a;" * 125_000])
def test_long_runs_take_linear_time(run):
    start = time.process_time()
    found = secret_scan.candidates(run[:1_000_000])
    assert time.process_time() - start < 30
    assert sum(len(path) for _, _, path, *_ in found) < 400 * len(found) + 1


def test_cut_paths_keep_their_signs():
    *_, (_, _, path, *_) = secret_scan.candidates("https://me@host/" + "ab." * 1000 + "token=." + "x.y" * 200 + "!4c8f8006a3af39d8")
    assert all(m in path for m in ("/", "@", "token")) and len(path) < 400


@pytest.mark.parametrize("text, secret", [
    ("so password=correct-horse-battery end", "correct-horse-battery"), ("token=" + "abcdefghij" * 3, "abcdefghij" * 3),
    ("the pw: Tr!cky.Pa55 is", "Tr!cky.Pa55"), ('{"api_key": "a b#c", "x": 1}', "a b#c"), ("secret => 'q'", "q"),
    ("passwd := \u00e9t\u00e9$ok", "\u00e9t\u00e9$ok"), ("http://h/?auth=p$w&x=1", "p$w"), ("(pwd=hunter)", "hunter"),
    ("token=a!b;password=c!d", "a!b"), ("token=a!b;password=c!d", "c!d"),
    ("key " + "QwErTyUiOp" * 3 + " here", "QwErTyUiOp" * 3), ("password=abc12345!xyz", "abc12345!xyz")])
def test_planted_secrets_are_candidates(text, secret):
    assert (text.index(secret), secret) in [c[:2] for c in secret_scan.candidates(text)]


def test_words_of_prose_are_no_candidates():
    assert secret_scan.candidates("upward: shipwreck = nothing, at 10:30 he said: well") == []


def test_planted_secrets_are_found(spark):
    plain = ["colour", "size", "title", "city"]
    docs = [(i, f"{plain[i % 4]}: item{i}number{i * 7919} and so on") for i in range(400)]
    docs += [(1000 + i, f"here password={'abcdefgh'[i % 8]}!x{'yz'[i % 2]}.{'$%#'[i % 3]}q done") for i in range(400)]
    rows = secret_scan.secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.n_secrets == (r.doc_id >= 1000) for r in rows)
