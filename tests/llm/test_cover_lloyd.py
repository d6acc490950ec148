"""Cover trees and vector codes against plain comparisons of all points with all entries."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.cover_lloyd import CoverTree, build_cover_tree, compress, vector_codes, whole_numbers

SCHEMA = "vec_id long, vector array<float>, label int, code string, error long, which int"


def plain(rows, parts=8, entries=16, rounds=6):
    """The contract, one number at a time. Rows: (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    whole = [[math.floor(Fraction(float(np.float32(x))) * 4096) for x in r[1]] for r in kept]
    length = len(whole[0])
    sizes = [length // parts + (k < length % parts) for k in range(parts)]
    cuts = [(sum(sizes[:k]), sum(sizes[: k + 1])) for k in range(parts)]
    books = [[v[a:b] for v in whole[:entries]] for a, b in cuts]
    square = lambda p, e: sum((x - y) ** 2 for x, y in zip(p, e))

    def assign(a, b, book):
        return [min(range(len(book)), key=lambda e: (square(v[a:b], book[e]), e)) for v in whole]

    for _ in range(rounds):
        for k, (a, b) in enumerate(cuts):
            codes = assign(a, b, books[k])
            for e in set(codes):
                mine = [v[a:b] for v, c in zip(whole, codes) if c == e]
                books[k][e] = [sum(column) // len(mine) for column in zip(*mine)]
    final = [assign(a, b, book) for (a, b), book in zip(cuts, books)]
    errors = [sum(square(v[a:b], book[f[i]]) for (a, b), book, f in zip(cuts, books, final)) for i, v in enumerate(whole)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    per_label = {}
    for r, error in zip(kept, errors):
        per_label[r[2]] = per_label.get(r[2], 0) + error
    return sorted(
        (str(r[0]), "".join(f"{f[i]:02x}" for f in final), errors[i], per_label[r[2]], digest) for i, r in enumerate(kept)
    )


def found(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 1, (7, 16))
    return (middles[rng.integers(0, 7, 300)] + rng.normal(0, 0.2, (300, 16))).astype(np.float32)


@pytest.mark.parametrize("spread", [1, 3, 40, 10_000])
def test_tree_assigns_as_all_comparisons(spread):
    rng = np.random.default_rng(spread)
    for size in (1, 2, 9, 500):
        points, weights = np.unique(rng.integers(-spread, spread + 1, (size, 4)), axis=0, return_counts=True)
        tree, order = build_cover_tree(points, weights)
        assert (tree.points == points[order]).all() and (tree.weights == weights[order]).all()
        for entries in (points[:16], rng.integers(-spread, spread + 1, (16, 4)), np.zeros((3, 4), np.int64)):
            assigned = tree.assign(entries)
            all_squares = np.square(tree.points[:, None] - entries[None]).sum(axis=2)
            codes = tree.codes(assigned)
            assert (codes == all_squares.argmin(axis=1)).all()
            counts, sums = tree.sums(assigned, len(entries))
            for e in range(len(entries)):
                mine = codes == e
                assert counts[e] == tree.weights[mine].sum()
                assert (sums[e] == (tree.points[mine] * tree.weights[mine, None]).sum(axis=0)).all()


def test_tree_covers_and_separates(clouds):
    points = np.unique(whole_numbers(clouds[:, :4]), axis=0)
    tree, _ = build_cover_tree(points, np.ones(len(points), np.int64))
    for k in range(len(tree.low)):
        inside = tree.points[tree.low[k] : tree.high[k]] - tree.points[tree.centre[k]]
        assert np.square(inside).sum(axis=1).max() <= tree.radius[k] ** 2 * (1 + 1e-12)
        children = range(tree.first_child[k], tree.last_child[k])
        if children:
            middles = tree.points[tree.centre[list(children)]]
            apart = np.square(middles[:, None] - middles[None]).sum(axis=2)
            np.fill_diagonal(apart, np.iinfo(np.int64).max)
            assert 4 * apart.min() > tree.radius[k] ** 2 * (1 - 1e-12)
            assert [tree.low[c] for c in children] + [tree.high[k]] == [tree.low[k]] + [tree.high[c] for c in children]


def test_far_clusters_are_settled_as_subtrees():
    rng = np.random.default_rng(2)
    middles = rng.integers(-(10**5), 10**5, (16, 8))
    points = np.unique((middles[:, None] + rng.integers(-50, 50, (16, 200, 8))).reshape(-1, 8), axis=0)
    tree, _ = build_cover_tree(points, np.ones(len(points), np.int64))
    assigned = tree.assign(middles)
    assert len(assigned.points) == 0 and len(assigned.nodes) < 200


def test_equals_the_plain_version(spark, clouds):
    rows = [(1000 - i, v.tolist(), i % 3 or None) for i, v in enumerate(clouds[:150])]
    for parts in (1, 7):
        assert found(vector_codes(vectors(spark, rows, parts))) == plain(rows)


def test_nulls_repeats_ties_and_odd_lengths(spark):
    v = lambda *x: [float(i) for i in x]
    rows = [(i, v(*(((i * k) % 5) / 4096 for k in range(19))), 1) for i in range(40)]
    rows += [(7, rows[7][1], 1)] * 60  # one vector in over a third of the rows
    rows += [(None, rows[3][1], None), (90, None, 1), (91, v(), 1), (92, v(1, 2), 1)]
    rows += [(93, [1.0, None] + [0.0] * 17, 2), (94, [math.nan] + [0.0] * 18, 2), (95, [math.inf] + [0.0] * 18, 2)]
    assert found(vector_codes(vectors(spark, rows))) == plain(rows)


def test_fewer_vectors_than_entries_and_none(spark):
    rows = [(5, [float(k) for k in range(8)], 1), (2, [0.5] * 8, None)]
    assert found(vector_codes(vectors(spark, rows))) == plain(rows)
    assert found(vector_codes(vectors(spark, []))) == []
    assert found(vector_codes(vectors(spark, [(1, None, 3)]))) == []


def test_blocks_and_partitions_change_nothing(spark, clouds):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(clouds)]
    whole, books = compress(vectors(spark, rows, 1))
    small, same = compress(vectors(spark, rows, 6), block=17)
    assert all((a == b).all() for a, b in zip(books, same))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, small.collect()))
    few, _ = compress(vectors(spark, rows), parts=2, entries=5, rounds=1)
    assert few.agg(F.max("code"), F.max(F.length("code"))).first()[1] == 4


def test_vectors_too_large_for_a_long_are_refused():
    with pytest.raises(OverflowError):
        whole_numbers(np.full((1, 8), 1e9))
    assert whole_numbers(np.array([[-0.1, 0.1]])).tolist() == [[-410, 409]]


def test_tree_of_one_point():
    tree, _ = build_cover_tree(np.array([[3, 4]]), np.array([5]))
    assert isinstance(tree, CoverTree) and tree.sums(tree.assign(np.array([[0, 0], [3, 4]])), 2)[0].tolist() == [0, 5]
