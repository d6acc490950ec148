"""BPE encoding and decoding with the vocabulary file of a public tokenizer.

Merging. A word's adjacent pairs are the leaves of a segment tree that holds their
merge ranks; every inner node holds the smaller of its two children, the left one on a
tie. The root therefore is the leftmost pair of the lowest rank. A merge changes at most
two neighbouring pairs and removes one, so a word of n characters costs O(n log n), also
where it has a million characters without a break.

Around it, as the file says: texts are cut at the special tokens' strings, normalised
(NFC, lower case), cut into words by the file's pattern (white space goes), mapped to
one character per byte, and the last character of each word carries the end-of-word
mark. A word's ids are remembered up to a bound, then forgotten.

Rows are independent, so the work is one Arrow-batched pass without a shuffle; the
vocabulary is read where the work is, from a path that every machine has.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from tallyloom.llm.tables import map_slices, text_or_empty

_NO_MERGE = 1 << 60
_PLACE = (1 << 32) - 1
# Fixed value: Unicode's White_Space, which is what the file's patterns mean by \s.
_SPACE = r"\t-\r \x85\xa0  -     　"
# Letters and numbers of the pattern library's Unicode version that the
# tokenizer's older one does not know (there they are neither), as code point ranges.
_NEWER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
# Capitals that Python's Unicode version has no lower case for: first, last, first lower case.
_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B),
    (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
_LOWER = {c: lower + c - first for first, last, lower in _CAPITALS for c in range(first, last + 1)}


def _newer_class() -> str:
    """The newer code points as the inside of a character class."""
    ends = [part.split("-") for part in _NEWER.split()]
    return "".join(f"\\U{int(e[0], 16):08x}-\\U{int(e[-1], 16):08x}" for e in ends)


def _byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def merge_word(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """BPE of one word by a segment tree over the ranks of its adjacent pairs.

    ``ranks`` has the rank of each mergeable pair under ``left << 32 | right``, ``merged``
    the symbol that each rank makes. A leaf is ``rank << 32 | place``, so that the least
    leaf is the leftmost pair of the lowest rank; a pair that cannot merge is ``_NO_MERGE``.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    get = ranks.get
    size = 1 << (n - 2).bit_length()
    tree = [_NO_MERGE] * (2 * size)
    left = symbols[0]
    for i in range(1, n):
        right = symbols[i]
        if (rank := get(left << 32 | right)) is not None:
            tree[size + i - 1] = rank << 32 | i - 1
        left = right
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) != _NO_MERGE:
        i = root & _PLACE
        j = after[i]
        symbols[i] = new = merged[root >> 32]
        symbols[j] = -1
        k = after[i] = after[j]
        changed = []
        if k < n:
            before[k] = i
            rank = get(new << 32 | symbols[k])
            changed.append((size + i, _NO_MERGE if rank is None else rank << 32 | i))
            changed.append((size + j, _NO_MERGE))
        else:
            changed.append((size + i, _NO_MERGE))
        if (h := before[i]) >= 0:
            rank = get(symbols[h] << 32 | new)
            changed.append((size + h, _NO_MERGE if rank is None else rank << 32 | h))
        for at, value in changed:
            if tree[at] == value:
                continue
            tree[at] = value
            # Up to the root, as long as the smaller child changes.
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value
    return [x for x in symbols if x >= 0]


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Words(dict):
    """Ids of words as packed unsigned 32-bit integers; forgets all when there are too many."""

    def __init__(self, encode, most: int) -> None:
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        packed = self.encode(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = packed
        return packed


class WordBpe:
    """Encoder and decoder of a vocabulary file of the word-end kind."""

    def __init__(self, path: str, remembered: int = 300_000) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.mark = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k: array("I", [v]).tobytes() for k, v in special.items()}
        self.tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in (vocab | special).items():
            self.tokens[i] = token
        self.ranks, self.merged = {}, []
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        characters = _byte_characters()
        self.inner = [vocab[c] for c in characters]
        self.last = [vocab[c + self.mark] for c in characters]
        (split,) = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        pattern = split["pattern"]["Regex"].replace(r"[^\s", f"[^{_SPACE}")
        self.words = regex.compile(pattern)
        # The same pattern with the newer code points as neither letters nor numbers.
        newer = _newer_class()
        older = pattern.replace(r"[\p{L}]", rf"[\p{{L}}--[{newer}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{newer}]]")
        self.older_words = regex.compile("(?V1)" + older.replace(rf"[^{_SPACE}\p{{L}}\p{{N}}]", rf"[[^{_SPACE}\p{{L}}\p{{N}}]||[{newer}]]"))
        self.newer = regex.compile(f"[{newer}]")
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) or r"(?!)")
        self.known = _Words(self._encode_word, remembered)

    def _encode_word(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return _little_endian(array("I", merge_word(symbols, self.ranks, self.merged)))

    def _plain(self, text: str) -> bytes:
        # Lower case goes character by character: a final sigma is no special case.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        words = self.words
        if not _is_latin(text):
            text = text.translate(_LOWER) if any(c in text for c in map(chr, _LOWER)) else text
            words = self.older_words if self.newer.search(text) else words
        return b"".join(map(self.known.__getitem__, words.findall(text)))

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if "<" not in text or not self.cut.search(text):
            return self._plain(text)
        parts, at = [], 0
        for found in self.cut.finditer(text):
            parts += [self._plain(text[at : found.start()]), self.special[found.group()]]
            at = found.end()
        return b"".join([*parts, self._plain(text[at:])])

    def encode(self, text: str) -> list[int]:
        return list(_unpacked(self.encode_packed(text)))

    def decode(self, ids) -> str:
        """The tokens, special ones included, with spaces between: the file names no decoder.

        Ids that the vocabulary has not are left out.
        """
        tokens, n = self.tokens, len(self.tokens)
        try:
            return " ".join([tokens[i] for i in ids])
        except IndexError:
            return " ".join([tokens[i] for i in ids if i < n])


def _little_endian(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def _unpacked(packed: bytes) -> array:
    ids = array("I", packed)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the ids' number and digest, the decoded text's digest.

    With ``with_ids`` also the ids themselves (array) and the decoded text. A NULL text is an
    empty one: no ids, an empty decoded text. ``path`` is the vocabulary file on each machine.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _tokenizer(path)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                packed = bpe.encode_packed(text)
                ids = _unpacked(packed)
                decoded = bpe.decode(ids)
                row = (
                    len(ids),
                    hashlib.sha256(packed).hexdigest(),
                    hashlib.sha256(decoded.encode("utf-8")).hexdigest(),
                )
                rows.append((*row, np.frombuffer(packed, "<u4").astype(np.int32), decoded) if with_ids else row)
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if with_ids else 3]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out
        # The worker lives on after the task; the words it has met need not.
        bpe.known.clear()

    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_slices(chosen, run, schema)
