"""State maps of long texts without spaces: of bounded size, equal to the library."""

import base64
import random

import pytest
import sentencepiece

import public_tokenizers
from llm import queries, token_counts


@pytest.fixture(scope="module")
def vocabulary():
    path = public_tokenizers.path(queries.TOKENIZER)
    return token_counts.Counter(token_counts.pieces(path)), sentencepiece.SentencePieceProcessor(model_file=path)


def texts():
    r = random.Random(9)
    yield "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(1_000_000))
    yield "".join(r.choice("ひらがなのぶんしょうとカタカナ、。") for _ in range(200_000))
    yield base64.b64encode(r.randbytes(150_000)).decode()
    yield "\n" * 1_000_000
    yield "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))


def test_maps_are_bounded_and_compose(vocabulary):
    counter, library = vocabulary
    for text in texts():
        s, chunk = token_counts.normal(text), token_counts.CHUNK
        whole = ("", 0, "", False)
        for at in range(0, len(s), chunk):
            m = counter.state_map(s[at:at + chunk])
            assert m[3] and len(m[0]) + len(m[2]) <= 512
            whole = counter.compose(whole, m)
            assert len(whole[0]) + len(whole[2]) <= 512
        assert counter.total(whole) == len(library.encode(text))


def test_any_grouping_of_small_chunks(vocabulary):
    """Composed from the left, from the right, and in pairs, borders anywhere."""
    counter, library = vocabulary
    r = random.Random(4)
    for _ in range(150):
        text = "".join(r.choice(["a", "aa", " ", "  ", "\n", "日", "本", "the", "ing", "Zq", "=", "1", "é", "\u2581", "😀"]) for _ in range(r.randrange(1, 60)))
        s, maps = token_counts.normal(text), []
        while s:
            n = r.randrange(1, 9)
            maps.append(counter.state_map(s[:n]))
            s = s[n:]
        left = maps[0]
        for m in maps[1:]:
            left = counter.compose(left, m)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = counter.compose(m, right)
        while len(maps) > 1:
            maps = [counter.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        want = len(library.encode(text))
        assert [counter.total(x) for x in (left, right, maps[0])] == [want] * 3, text
