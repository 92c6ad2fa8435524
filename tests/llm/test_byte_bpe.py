"""The transducer against the tiktoken library on random strings, and its parts against plain versions."""

import base64
import random

import pytest
import public_tokenizers
import tiktoken

from banstream.llm import byte_bpe
from banstream.llm.byte_bpe import Utf8Stream, encode_texts, load, merge

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def strings():
    draw = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyz eEaATsS  \n\t.,!0123456789'äöüßñ日本語кирилица　🙂👍́-–_<|endoftext|>"
    out = ["".join(draw.choice(alphabet) for _ in range(draw.choice([1, 3, 10, 40, 200]))) for _ in range(2000)]
    out += [draw.choice("aetä日-= ") * draw.choice([1, 5, 63, 255, 256, 257, 1000]) for _ in range(100)]
    return [*out, "ab" * 5000, "x" * 9000, "the" * 4000, " " * 9000, "".join(draw.choice("etaoinshr") for _ in range(20000))]


def test_random_strings_and_long_matches(own):
    odd = strings()
    assert [x.tolist() for x in encode_texts(odd, PATH, PATTERN)] == [own.encode_ordinary(t) for t in odd]


def test_states_are_made_again_after_they_are_given_up(own, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_TRANSITIONS", 50)
    monkeypatch.setattr(byte_bpe, "MAX_PAIRS", 50)
    machine = load(PATH, PATTERN).machine
    for word in ("unterhaltungs", "bxqzzt", "stationery" * 60):
        assert machine.encode(word.encode()) == own.encode_ordinary(word)
    assert machine.moves.n < 5000


def test_a_long_match_is_emitted_as_it_is_settled(own):
    word = "".join(random.Random(1).choice("etaoinshr") for _ in range(30000))
    data = word.encode()
    parts = list(load(PATH, PATTERN).machine.stream(data[i : i + 1000] for i in range(0, len(data), 1000)))
    assert [t for p in parts for t in p] == own.encode_ordinary(word)
    assert len(parts) == 31 and all(parts[:-1]) and len(parts[-1]) < 100


def test_pairs_are_what_the_merges_leave():
    machine, draw = load(PATH, PATTERN).machine, random.Random(3)
    for _ in range(5000):
        a, b = draw.choices(list(machine.token), k=2)
        assert machine.may_follow(a, b) == (merge(machine.token[a] + machine.token[b], machine.ranks) == [a, b])


def test_utf8_stream_is_the_decoder_whatever_the_chunks():
    draw = random.Random(4)
    odd = [0x41, 0xC3, 0xA4, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xF4, 0x90, 0xC0, 0xFF, 0xE0]
    for _ in range(4000):
        data = bytes(draw.choices(odd, k=draw.randrange(1, 9))) if draw.random() < 0.5 else "aä€🙂ab".encode()[: draw.randrange(1, 13)]
        stream, text, at = Utf8Stream(), "", 0
        while at < len(data):
            n = draw.randrange(1, 4)
            text, at = text + stream.feed(data[at : at + n]), at + n
        assert text + stream.close() == data.decode(errors="replace")
