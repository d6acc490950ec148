"""Components of the Jaccard join against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tallyloom.llm import ngram_join
from tallyloom.llm.components import connected_components
from tallyloom.llm.ngram_join import JaccardRule, linked_sets, one_per_component, overlaps, segment_keys
from tallyloom.llm.words import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, rule):
    sets = []
    for doc, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        n = rule.words
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and rows[i][0] is not None and rows[j][0] is not None and rule.den * both >= rule.num * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), None if doc is None else min(same)))
    return sorted(out, key=repr)


def near_copies(rng, copies, length=60, edits=3):
    words = [f"w{rng.randrange(4000)}" for _ in range(length)]
    out = []
    for _ in range(copies):
        copy = list(words)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(length)] = f"e{rng.randrange(4000)}"
        out.append(" ".join(copy))
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = near_copies(rng, 40) + near_copies(rng, 25, 400, 12) + near_copies(rng, 12, 9, 1)
    texts += [" ".join(f"q{rng.randrange(50)}" for _ in range(rng.randint(1, 30))) for _ in range(40)]
    texts += [None, "", " \t\n", "a", "A", "a b", "a  b", "a b c d", "É é", "é é", texts[0], texts[0].upper()]
    texts += ["de " * 500, "de " * 700, "x y " * 300]
    rows = list(zip(rng.sample(range(10_000), len(texts)), texts))
    return rows + [(None, texts[0]), (rows[3][0], rows[9][1]), rows[5]]


@pytest.mark.parametrize("rule", [JaccardRule(4, 85, 100), JaccardRule(5, 80, 100), JaccardRule(1, 75, 100)], ids=str)
def test_equals_all_pairs(docs_of, rule):
    rows = corpus(rule.words)
    got = sorted([tuple(r) for r in linked_sets(docs_of(rows, 3), rule).collect()], key=repr)
    assert got == plain(rows, rule)


def test_small_blocks_and_hot_keys_change_nothing(docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_IN_BATCH", 3)
    rows, rule = corpus(9), JaccardRule(4, 85, 100)
    got = sorted([tuple(r) for r in linked_sets(docs_of(rows, 3), rule, block=8).collect()], key=repr)
    assert got == plain(rows, rule)


def test_low_thresholds_are_refused():
    with pytest.raises(ValueError):
        JaccardRule(4, 50, 100)


def test_empty_tables(docs_of):
    assert linked_sets(docs_of([]), JaccardRule()).collect() == []
    assert [tuple(r) for r in linked_sets(docs_of([(4, None)]), JaccardRule()).collect()] == [(4, 0, 4)]


def test_one_per_component_keeps_rows_and_columns(docs_of):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (3, text + " more"), (9, "other words stand here alone"), (None, text), (8, None), (9, "other words stand here alone")]
    kept = one_per_component(docs_of(rows))
    assert kept.columns == ["doc_id", "text", "node", "component_id"]
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted([3, 9, 9, None, 8], key=repr)


def test_linked_sets_share_a_key():
    """The pigeonhole argument, on random pairs at the edge of the threshold."""
    rng = np.random.default_rng(2)
    rule = JaccardRule(4, 85, 100)
    for _ in range(400):
        n = int(rng.integers(1, 200))
        a = np.unique(mix(rng.integers(0, 1 << 60, n).astype(np.uint64)))
        b = a.copy()
        while True:
            c = np.unique(np.concatenate((np.delete(b, rng.integers(len(b))) if len(b) > 1 and rng.random() < 0.5 else b, mix(rng.integers(0, 1 << 60, 1).astype(np.uint64)) if rng.random() < 0.5 else b[:0])))
            both = len(np.intersect1d(a, c))
            if 100 * both < 85 * (len(a) + len(c) - both):
                break
            if len(c) == len(b) and np.array_equal(b, c):
                continue
            b = c
        if not np.array_equal(a, b):
            assert len(np.intersect1d(segment_keys(a, rule), segment_keys(b, rule)))


def test_overlaps_are_sums_over_fragments(monkeypatch):
    monkeypatch.setattr(ngram_join, "_COLUMNS", 7)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 25).astype(np.uint64)) for _ in range(9)]
    got = overlaps(sets[:4], sets[4:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40, 75)] + [(1, j) for j in range(100, 160)] + [(7, 7), (None, 3), (75, 40), (160, 100)]
    out = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert out == {**{i: 40 for i in range(40, 76)}, **{i: 1 for i in [1, *range(100, 160), 160]}, 7: 7}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
