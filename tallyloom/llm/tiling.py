"""Benchmark decontamination by greedy string tiling.

1. Every benchmark item is a list of words; its runs of ``seed`` words are seeds.
2. One pass over the documents looks each of their seeds up in a bit array of the
   benchmark's seeds (``BITS`` bits, whatever the benchmark's size: a full array lets
   more through, never less) and keeps the stretches of the text that hits cover. A tile
   of ``seed`` words or more cannot reach beyond them.
3. Hits are joined to the benchmark's seeds by value. A pair (document, item) goes on if
   its shared seeds could still cover enough of the item.
4. Running Karp-Rabin tiles each pair: hash all unmarked runs of the search length on
   both sides, extend the matches, mark the longest that overlap no tile, shorten the
   search length, again until it is ``seed``.
5. A document leaks an item if its tiles cover at least ``coverage`` of the item's words,
   in whatever order they stand.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tables import BITS, bit_array, map_slices, text_or_empty, without
from tallyloom.llm.words import WordHashes, hashed, rolling
from tallyloom.session import cut_lineage

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class TilingRule:
    """Tiles have ``seed`` words or more; a leak covers ``coverage`` of an item's words."""

    seed: int = 4
    coverage: float = 0.5


def _words(text: str, hashes: WordHashes) -> np.ndarray:
    words = [w.encode("utf-8") for w in _WORD.findall(text.lower())]
    # Zero separates stretches and is no word.
    return np.maximum(hashed(words, hashes), np.uint64(1))


def _bit(seeds: np.ndarray) -> np.ndarray:
    return (seeds % np.uint64(BITS)).astype(np.int64)


def _runs(tokens: list[int], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of each run of ``length`` free tokens."""
    base, modulus = 1_000_003, (1 << 61) - 1
    top = pow(base, length, modulus)
    value = count = 0
    for i, token in enumerate(tokens):
        if not free[i]:
            value = count = 0
            continue
        value = (value * base + token) % modulus
        count += 1
        if count > length:
            value = (value - tokens[i - length] * top) % modulus
        if count >= length:
            yield i - length + 1, value


def greedy_tiles(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length), longest first; zeros match nothing.

    A tile's tokens are equal on both sides and belong to no other tile. Ties go to the
    earlier place in the item, then in the text.
    """
    free_i, free_t = [t != 0 for t in item], [t != 0 for t in text]
    tiles = []
    length = max(least, min(len(item), len(text)))
    while True:
        at = defaultdict(list)
        for start, value in _runs(text, free_t, length):
            at[value].append(start)
        found = []
        if at:
            for p, value in _runs(item, free_i, length):
                for t in at.get(value, ()):
                    n = 0
                    while (
                        p + n < len(item)
                        and t + n < len(text)
                        and free_i[p + n]
                        and free_t[t + n]
                        and item[p + n] == text[t + n]
                    ):
                        n += 1
                    if n >= length:
                        found.append((-n, p, t))
        marked = False
        for n, p, t in sorted(found):
            n = -n
            # A longer tile may have taken the end of this one; what is left is seen again.
            if all(free_i[p : p + n]) and all(free_t[t : t + n]):
                free_i[p : p + n] = [False] * n
                free_t[t : t + n] = [False] * n
                tiles.append((p, t, n))
                marked = True
        if marked:
            continue
        if length == least:
            return tiles
        length = max(least, length // 2)


def _benchmark_seeds(rule: TilingRule):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item_id"], pdf["text"]):
                words = _words(text, hashes)
                seeds, times = np.unique(rolling(words, rule.seed), return_counts=True)
                rows.append((item, len(words), words.tobytes(), seeds.view(np.int64), times, np.unique(_bit(seeds))))
            yield pd.DataFrame(rows, columns=["item_id", "n_words", "words", "seeds", "times", "bits"])

    return run


def _hits(rule: TilingRule, bits: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                words = _words(text, hashes)
                seeds = rolling(words, rule.seed)
                if not len(seeds):
                    continue
                place = _bit(seeds)
                hit = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1
                if not hit.any():
                    continue
                at = np.flatnonzero(hit)
                covered = np.zeros(len(words) + 1, bool)
                for i in range(rule.seed):
                    covered[at + i] = True
                edges = np.flatnonzero(np.diff(np.concatenate(([False], covered)).astype(np.int8)))
                parts = []
                for a, b in zip(edges[::2], edges[1::2]):
                    parts += [words[a:b], np.zeros(1, np.uint64)]
                rows.append((doc, np.concatenate(parts).tobytes(), np.unique(seeds[at]).view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "stretches", "seeds"])

    return run


def _tile_pairs(rule: TilingRule):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, item, words, stretches in zip(pdf["doc_id"], pdf["item_id"], pdf["words"], pdf["stretches"]):
                pattern = np.frombuffer(words, np.uint64).tolist()
                tiles = greedy_tiles(pattern, np.frombuffer(stretches, np.uint64).tolist(), rule.seed)
                rows.append((doc, item, len(pattern), sum(n for _, _, n in tiles), len(tiles)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_words", "n_covered", "n_tiles"])

    return run


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, rule: TilingRule = TilingRule()) -> DataFrame:
    """One row per document and item it leaks: doc_id, item_id, n_words, n_covered, n_tiles, coverage.

    NULL and empty texts leak nothing, nor do items of fewer than ``seed`` words; rows
    without doc_id or item_id take no part. Of rows that repeat a doc_id or an item_id
    the pair with the highest coverage counts. Empty tables give an empty result.
    """
    items = cut_lineage(
        benchmark.filter(F.col("item_id").isNotNull())
        .select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
        .mapInPandas(
            _benchmark_seeds(rule),
            "item_id long, n_words int, words binary, seeds array<long>, times array<long>, bits array<long>",
        )
    )
    bits = bit_array(items.select(F.explode("bits").alias("bit")), "bit")
    named = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")
    )
    hits = cut_lineage(map_slices(named, _hits(rule, bits), "doc_id long, stretches binary, seeds array<long>"))
    of_items = items.select("item_id", "n_words", F.explode(F.arrays_zip("seeds", "times")).alias("of")).select(
        "item_id", "n_words", F.col("of.seeds").alias("seed"), F.col("of.times").alias("times")
    )
    of_docs = hits.select("doc_id", F.explode("seeds").alias("seed")).distinct()
    pairs = (
        of_docs.join(of_items, "seed")
        .groupBy("doc_id", "item_id", "n_words")
        .agg(F.sum("times").alias("shared"))
        # Each place of a shared seed covers no more than ``seed`` words.
        .filter(F.col("shared") * rule.seed >= F.col("n_words") * rule.coverage)
        .select("doc_id", "item_id", "n_words")
    )
    return (
        pairs.join(items.select("item_id", "n_words", "words").distinct(), ["item_id", "n_words"])
        .join(hits.select("doc_id", "stretches").distinct(), "doc_id")
        .select("doc_id", "item_id", "words", "stretches")
        .mapInPandas(_tile_pairs(rule), "doc_id long, item_id long, n_words int, n_covered int, n_tiles int")
        .withColumn("coverage", F.col("n_covered") / F.col("n_words"))
        .filter(F.col("coverage") >= rule.coverage)
        .groupBy("doc_id", "item_id")
        .agg(F.max_by(F.struct("n_words", "n_covered", "n_tiles", "coverage"), F.struct("coverage", "n_words", "n_tiles")).alias("best"))
        .select("doc_id", "item_id", "best.*")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, rule: TilingRule = TilingRule()) -> DataFrame:
    """``docs`` without the documents that leak an item; rows without doc_id stay."""
    return without(docs, cut_lineage(benchmark_leaks(docs, benchmark, rule).select("doc_id").distinct()))
