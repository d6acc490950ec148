"""BPE against the tokenizers library and against a plain quadratic merge."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm.bpe import WordBpe, encode_documents, merge_word

PATH = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    "",
    "   ",
    " <|startoftext|>Hi<|endoftext|> x<|endoftext|>",
    "ΟΔΥΣΣΕΥΣ ΣΑΣ. İstanbul ǅ ﬁ",
    "a\x1cb\x1d c​d e f",
    "it's I'LL we've 'd 'dd ''s",
    "é é 가 ̈́ Å Ω",
    "😀👩‍👩‍👧 🇩🇪 ½ ² ٣ 日本語テスト한국어",
    "\x00\x01￾",
    "a\u0558b \U0001e6c0x 1\U00011de0 \U00010d50\ua7cb\u1c89 \U00016ea0",
    "x" * 3000,
    "the" * 2000 + " " + "ab" * 500,
]


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(PATH)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def random_texts():
    rng = random.Random(3)
    pick = lambda: rng.choice(
        [chr(rng.randrange(32, 0x500)), " ", "'", "s", "<|endoftext|>", "́", chr(rng.randrange(0x4E00, 0x9FA5)), "The", chr(rng.randrange(0x10000, 0x3FFFF))]
    )
    return ["".join(pick() for _ in range(60)) for _ in range(200)]


def test_equals_the_library(bpe, library):
    for text in TEXTS + random_texts():
        expected = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == expected, text
        assert bpe.decode(expected) == library.decode(expected, skip_special_tokens=False)


def plain_merge(symbols, ranks, merged):
    symbols = list(symbols)
    while True:
        best = min(((ranks.get(a << 32 | b, 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            return symbols
        symbols[best[1] : best[1] + 2] = [merged[best[0]]]


def test_segment_tree_takes_leftmost_lowest_rank():
    rng = random.Random(1)
    for _ in range(300):
        ranks, merged = {}, []
        for _ in range(rng.randint(0, 12)):
            pair = rng.randrange(8) << 32 | rng.randrange(8)
            if pair not in ranks:
                ranks[pair] = len(merged)
                merged.append(rng.randrange(8))
        word = [rng.randrange(4) for _ in range(rng.randint(0, 25))]
        assert merge_word(word, ranks, merged) == plain_merge(word, ranks, merged)


def test_memory_of_words_is_bounded():
    small = WordBpe(PATH, remembered=3)
    words = " ".join(f"word{i}" for i in "abcdefghij")
    assert small.encode(words) == WordBpe(PATH).encode(words) and len(small.known) <= 3


def test_documents(docs_of, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, None), (3, None)]
    out = encode_documents(docs_of(rows), PATH).collect()
    expected = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((doc, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, out), key=repr) == sorted(expected, key=repr)
    assert encode_documents(docs_of([]), PATH).collect() == []


def test_ids_and_text_come_along(docs_of, bpe):
    (row,) = encode_documents(docs_of([(1, "Hello there")]), PATH, with_ids=True).collect()
    assert row.ids == bpe.encode("Hello there") and row.decoded == "hello</w> there</w>"
