"""Benchmark leaks: reordered passages, thresholds, and tiles against a plain search."""

from __future__ import annotations

import random

import pytest

from tallyloom.llm.tiling import TilingRule, benchmark_leaks, greedy_tiles, without_leaks

WORDS = [f"w{i}" for i in range(400)]
ITEM = " ".join(WORDS[:40])


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, ITEM, 0), (2, " ".join(WORDS[100:112]), 0), (3, "one two three", 0), (4, None, 0), (None, ITEM, 0), (5, "", 0)]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id int")


def text_with(*parts):
    rng = random.Random(len(parts))
    filler = lambda: " ".join(f"f{rng.randrange(10**6)}" for _ in range(15))
    return " ".join([filler()] + [x for p in parts for x in (p, filler())])


def test_leaks(docs_of, benchmark):
    reordered = text_with(*[" ".join(WORDS[a : a + 8]) for a in (32, 0, 16, 8, 24)])
    docs = [
        (10, text_with(ITEM)),
        (11, text_with(ITEM.upper().replace(" ", ", "))),
        (12, reordered),
        (13, text_with(" ".join(WORDS[:21]))),  # 21 of 40 words
        (14, text_with(" ".join(WORDS[:19]))),  # 19 of 40
        (15, text_with(*[" ".join(WORDS[a : a + 3]) for a in range(0, 40, 3)])),  # pieces under the seed
        (16, text_with(*[" ".join(WORDS[0:8])] * 5)),  # the same piece again covers no more
        (17, None),
        (18, ""),
        (19, text_with("one two three")),
        (20, text_with(ITEM, " ".join(WORDS[100:112]))),
        (20, "a repeated id"),
        (None, ITEM),
    ]
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_covered) for r in benchmark_leaks(docs_of(docs), benchmark).collect()}
    assert got == {
        (10, 1): (40, 40), (11, 1): (40, 40), (12, 1): (40, 40), (13, 1): (40, 21), (20, 1): (40, 40), (20, 2): (12, 12),
    }
    kept = without_leaks(docs_of(docs), benchmark)
    assert kept.columns == ["doc_id", "text", "node", "component_id"]
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted([14, 15, 16, 17, 18, 19, None], key=repr)


def test_empty_tables(docs_of, benchmark):
    assert benchmark_leaks(docs_of([]), benchmark).collect() == []
    assert benchmark_leaks(docs_of([(1, ITEM)]), benchmark.limit(0)).collect() == []


def plain_tiles(item, text, least):
    """Longest common unmarked runs, one after the other."""
    free_i, free_t, total = [True] * len(item), [True] * len(text), 0
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] != 0 and free_i[p + n] and free_t[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < least:
            return total
        free_i[p : p + n] = [False] * n
        free_t[t : t + n] = [False] * n
        total += n


def test_tiles_are_valid_and_longest_first():
    rng = random.Random(3)
    for _ in range(120):
        item = [rng.randint(1, 4) for _ in range(rng.randint(1, 25))]
        text = [rng.randint(0, 4) for _ in range(rng.randint(0, 40))]
        least = rng.randint(1, 4)
        tiles = greedy_tiles(item, text, least)
        used_i, used_t = set(), set()
        for p, t, n in tiles:
            assert n >= least and item[p : p + n] == text[t : t + n] and 0 not in item[p : p + n]
            assert used_i.isdisjoint(range(p, p + n)) and used_t.isdisjoint(range(t, t + n))
            used_i.update(range(p, p + n))
            used_t.update(range(t, t + n))
        if tiles:
            longest = max(n for _, _, n in tiles)
            assert tiles[0][2] == longest
        if plain_tiles(item, text, least) == 0:
            assert not tiles


def test_rule_is_a_parameter(docs_of, benchmark):
    docs = docs_of([(14, text_with(" ".join(WORDS[:19])))])
    assert benchmark_leaks(docs, benchmark, TilingRule(coverage=0.4)).count() == 1


def test_an_item_of_few_different_runs(docs_of, spark):
    refrain = "row row row your boat " * 12
    items = spark.createDataFrame([(1, refrain), (2, "no " * 50)], "item_id long, text string")
    docs = docs_of([(10, f"{WORDS[0]} {refrain} {WORDS[1]}"), (11, "oh " + "no " * 50), (12, " ".join(WORDS))])
    got = {(r.doc_id, r.item_id): r.coverage for r in benchmark_leaks(docs, items).collect()}
    assert got == {(10, 1): 1.0, (11, 2): 1.0}
