"""Compression of vectors to codes: one codebook per part of a vector, trained by Lloyd rounds.

1. Vectors become whole numbers and are cut into parts. Each task takes its rows in blocks
   and builds a cover tree of the distinct values per part: a node's children lie within
   its radius and further apart than half of it, and cover its points within that half. A
   node's points stand side by side, so running sums over the points (weighted by how often
   a value occurs) give count and sum of any subtree.
2. A round assigns whole subtrees: if another entry is further from a node's centre than the
   nearest one by more than twice the radius, none of the node's points can be nearer to it
   (triangle inequality). Only nodes where that is not so descend; the points of ambiguous
   leaves are compared one by one. The trees are written once and read by every round; a
   round brings one sum per codebook number to the driver, whatever the number of rows.
3. All distances and means are whole numbers, so codes and codebooks do not depend on
   blocks or partitions.

Cases: a vector that is NULL, empty, or holds a NULL, NaN or infinite component is dropped,
and so is one whose length is not that of the kept vector with the smallest vec_id (NULL
vec_ids come last; rows with equal vec_ids in the order of their vectors). Repeated rows
count each, and each has its row of the result. With fewer kept vectors than entries, a
codebook is as long as there are vectors; an empty table has no rows. Where the length is
no multiple of the number of parts, the first parts are one longer. Vectors so large that a
squared distance of two exceeds a long raise an OverflowError. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.joins import spread_lookup
from tallyloom.session import cut_lineage

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Vectors of one block of trees, and distinct points that a node does not split.
BLOCK, LEAF = 4096, 8

_BLOCKS = "vec_ids array<long>, labels array<string>, trees binary"
_SLACK = 1e-9  # relative; far above the rounding of square roots


class Assigned(NamedTuple):
    """Subtrees whose points all have one nearest entry, and points that were compared one by one."""

    nodes: np.ndarray
    of_nodes: np.ndarray
    points: np.ndarray
    of_points: np.ndarray


class CoverTree:
    """Distinct points (rows of whole numbers) with their weights, in the order of the tree's leaves."""

    FIELDS = ("points", "weights", "centre", "radius", "low", "high", "first_child", "last_child")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)
        self.points = self.points.astype(np.int64)
        counted = self.weights.astype(np.int64)
        zero = np.zeros((1, self.points.shape[1]), np.int64)
        self.count_before = np.append(0, np.cumsum(counted))
        self.sum_before = np.concatenate((zero, np.cumsum(self.points * counted[:, None], axis=0)))

    def assign(self, entries: np.ndarray) -> Assigned:
        """Each point's nearest entry (ties to the lower): subtrees with one answer, and single points."""
        nodes, settled, single = np.zeros(1, np.int64), [], []
        while len(nodes):
            squares = _squares(self.points[self.centre[nodes]], entries)
            nearest = squares.argmin(axis=1)
            away = np.sqrt(squares.astype(np.float64))
            least = away[np.arange(len(nodes)), nearest][:, None]
            radius = self.radius[nodes][:, None]
            out_of_reach = away - least - 2 * radius > _SLACK * (away + least + radius + 1)
            out_of_reach[np.arange(len(nodes)), nearest] = True
            clear = out_of_reach.all(axis=1)
            settled.append((nodes[clear], nearest[clear]))
            open_ = nodes[~clear]
            leaf = self.first_child[open_] == self.last_child[open_]
            points = _ranges(self.low[open_[leaf]], self.high[open_[leaf]])
            if len(points):
                single.append((points, _squares(self.points[points], entries).argmin(axis=1)))
            nodes = _ranges(self.first_child[open_[~leaf]], self.last_child[open_[~leaf]])
        none = (np.zeros(0, np.int64),) * 2
        return Assigned(*map(np.concatenate, zip(*settled)), *map(np.concatenate, zip(*single or [none])))

    def codes(self, assigned: Assigned) -> np.ndarray:
        """The entry of each point."""
        out = np.empty(len(self.points), np.int64)
        low, high = self.low[assigned.nodes], self.high[assigned.nodes]
        out[_ranges(low, high)] = np.repeat(assigned.of_nodes, high - low)
        out[assigned.points] = assigned.of_points
        return out

    def sums(self, assigned: Assigned, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Count and sum of the points of each entry."""
        low = np.concatenate((self.low[assigned.nodes], assigned.points))
        high = np.concatenate((self.high[assigned.nodes], assigned.points + 1))
        entry = np.concatenate((assigned.of_nodes, assigned.of_points))
        counts, sums = np.zeros(entries, np.int64), np.zeros((entries, self.points.shape[1]), np.int64)
        np.add.at(counts, entry, self.count_before[high] - self.count_before[low])
        np.add.at(sums, entry, self.sum_before[high] - self.sum_before[low])
        return counts, sums


def build_cover_tree(points: np.ndarray, weights: np.ndarray, leaf: int = LEAF) -> tuple[CoverTree, np.ndarray]:
    """The tree of distinct ``points``, and the order in which it holds them."""
    order = np.arange(len(points))
    middle = points.mean(axis=0)
    root = int(np.square(points - middle).sum(axis=1).argmin())
    reach = int(_squares_to(points, points[root]).max())
    # centre, squared radius, its range in order; children are filled in when a node is split
    nodes = [[root, reach, 0, len(points), 0, 0]]
    at = 0
    while at < len(nodes):
        centre, reach, low, high = nodes[at][:4]
        if high - low > leaf and reach:
            members = order[low:high]
            groups, left, start = [], members, centre
            while len(left):
                squares = _squares_to(points[left], points[start])
                near = 4 * squares <= reach
                groups.append((start, int(squares[near].max()), left[near]))
                left = left[~near]
                start = left[0] if len(left) else -1
            order[low:high] = np.concatenate([g[2] for g in groups])
            nodes[at][4:] = len(nodes), len(nodes) + len(groups)
            for start, furthest, group in groups:
                nodes.append([start, furthest, low, low + len(group), 0, 0])
                low += len(group)
        at += 1
    table = np.array(nodes, np.int64)
    where = np.empty(len(points), np.int64)
    where[order] = np.arange(len(points))
    arrays = {
        "points": points[order],
        "weights": weights[order],
        "centre": where[table[:, 0]],
        "radius": np.sqrt(table[:, 1].astype(np.float64)),
        **{name: table[:, k] for k, name in enumerate(CoverTree.FIELDS[4:], start=2)},
    }
    return CoverTree(**arrays), order


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, one row per point and one column per entry."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * points.shape[1] < 2**53:  # doubles hold all the whole numbers on the way
        a, b = points.astype(np.float64), entries.astype(np.float64)
        crossed = np.square(a).sum(axis=1)[:, None] + np.square(b).sum(axis=1) - 2 * (a @ b.T)
        return crossed.astype(np.int64)
    return np.square(points[:, None, :] - entries[None, :, :]).sum(axis=2)


def _squares_to(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    away = points - centre
    return np.einsum("ij,ij->i", away, away)


def _ranges(lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    sizes = highs - lows
    return np.repeat(highs - np.cumsum(sizes), sizes) + np.arange(sizes.sum())


def _cuts(length: int, parts: int) -> list[tuple[int, int]]:
    sizes = [length // parts + (k < length % parts) for k in range(parts)]
    ends = np.cumsum(sizes).tolist()
    return [(end - size, end) for size, end in zip(sizes, ends)]


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(4096 * x) of finite numbers, as long as squared distances of such vectors fit a long."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    most = float(np.abs(scaled).max(initial=0))
    if 4 * most * most * vectors.shape[1] >= 2**63:
        raise OverflowError("vectors so far apart that no long holds their squared distance")
    return scaled.astype(np.int64)


def _smallest_type(numbers: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if abs(int(numbers.min(initial=0))) < np.iinfo(kind).max and int(numbers.max(initial=0)) < np.iinfo(kind).max:
            return numbers.astype(kind)
    return numbers


def _trees_of(numbers: np.ndarray, parts: int) -> bytes:
    """The trees of a block, and for each part which point each vector has."""
    arrays = {}
    for k, (low, high) in enumerate(_cuts(numbers.shape[1], parts)):
        distinct, which, counts = np.unique(numbers[:, low:high], axis=0, return_inverse=True, return_counts=True)
        tree, order = build_cover_tree(distinct, counts)
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        arrays[f"{k}.which"] = _smallest_type(where[which.ravel()])
        for name in CoverTree.FIELDS:
            field = getattr(tree, name)
            arrays[f"{k}.{name}"] = field if name == "radius" else _smallest_type(field)
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _read_trees(data: bytes, parts: int) -> list[tuple[CoverTree, np.ndarray]]:
    with np.load(io.BytesIO(data)) as arrays:
        return [
            (CoverTree(**{name: arrays[f"{k}.{name}"] for name in CoverTree.FIELDS}), arrays[f"{k}.which"].astype(np.int64))
            for k in range(parts)
        ]


def _is_finite(x: Column) -> Column:
    number = x.cast("double")
    return F.coalesce(~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))


def _blocks(kept: DataFrame, length: int, parts: int, block: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                rows = batch.slice(at, block)
                flat = rows.column("vector").flatten().to_numpy(zero_copy_only=False)
                numbers = whole_numbers(flat.reshape(rows.num_rows, length))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rows.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                        pa.array([rows.column("label").to_pylist()], pa.list_(pa.string())),
                        pa.array([_trees_of(numbers, parts)], pa.binary()),
                    ],
                    names=["vec_ids", "labels", "trees"],
                )

    return kept.mapInArrow(build, _BLOCKS)


def _round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [(np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)) for book in books]
        for batch in batches:
            for data in batch.column("trees"):
                for (tree, _), book, (counts, sums) in zip(_read_trees(data.as_py(), len(books)), books, totals):
                    more_counts, more_sums = tree.sums(tree.assign(book), len(book))
                    counts += more_counts
                    sums += more_sums
        rows = [
            (k, entry, place, int(counts[entry]), int(total))
            for k, (counts, sums) in enumerate(totals)
            for entry in np.flatnonzero(counts)
            for place, total in enumerate(sums[entry])
        ]
        if rows:
            names = ["part", "entry", "place", "n", "total"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    sums = (
        blocks.select("trees")
        .mapInArrow(add_up, "part long, entry long, place long, n long, total long")
        .groupBy("part", "entry", "place")
        .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    )
    after = [book.copy() for book in books]
    # One row per number of the codebooks.
    for row in sums.collect():
        after[row.part][row.entry, row.place] = int(row.total) // row.n
    return after


def train_codebooks(blocks: DataFrame, start: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    books = start
    for _ in range(rounds):
        books = _round(blocks, books)
    return books


def _codes(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) for every vector of the blocks."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            for at in range(batch.num_rows):
                ids, labels = batch.column("vec_ids")[at].values, batch.column("labels")[at].values
                error = np.zeros(len(ids), np.int64)
                text = np.full(len(ids), "", f"U{2 * len(books)}")
                for (tree, which), book in zip(_read_trees(batch.column("trees")[at].as_py(), len(books)), books):
                    nearest = tree.codes(tree.assign(book))
                    error += np.square(tree.points - book[nearest]).sum(axis=1)[which]
                    text = np.char.add(text, digits[nearest][which])
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array(text.tolist(), pa.string()), pa.array(error)],
                    names=["vec_id", "label", "code", "error"],
                )

    return blocks.mapInArrow(code, "vec_id long, label string, code string, error long")


def books_digest(books: list[np.ndarray]) -> str:
    numbers = ",".join(str(n) for book in books for n in book.ravel().tolist())
    return hashlib.sha256(numbers.encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of vectors (vec_id, vector, label), and the codebooks.

    At most 256 entries, so that an index has two hex digits. ``label`` comes as text.
    """
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    whole = F.coalesce((F.size("vector") > 0) & F.forall("vector", _is_finite), F.lit(False))
    kept = vectors.filter(whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label")
    )
    in_order = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector")
    smallest = in_order.limit(1).collect()
    length = len(smallest[0].vector) if smallest else parts
    kept = kept.filter(F.size("vector") == length)
    # As many rows as a codebook has entries.
    first = [row.vector for row in kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()]
    numbers = whole_numbers(np.array(first, np.float64).reshape(len(first), length))
    start = [numbers[:, low:high].copy() for low, high in _cuts(length, parts)]
    blocks = cut_lineage(_blocks(kept, length, parts, block))
    books = train_codebooks(blocks, start, rounds)
    return _codes(blocks, books), books


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for vectors (vec_id, vector, label)."""
    coded, books = compress(vectors)
    coded = cut_lineage(coded.withColumn("of_label", F.coalesce(F.concat(F.lit("="), "label"), F.lit("none"))))
    per_label = coded.groupBy("of_label").agg(F.sum("error").alias("label_error"))
    slot = F.pmod(F.xxhash64("vec_id", "code"), F.lit(64))
    return spread_lookup(coded, per_label, "of_label", slot).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )
