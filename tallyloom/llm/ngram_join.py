"""Jaccard self-join on word n-grams by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. It is cut into fragments
(hash ranges); a set's part in a fragment is its segment.

*First half.* Over the lower half of the order it is counted how many of a set's n-grams
any other set has. A linked partner lacks at most (1 - t) of the set, so a set of which
more is met nowhere else in that half has no partner. Most sets end here, however many
common passages they hold. An n-gram met twice within a batch is settled there and goes
on once, so a common one is a row per batch, not per document.

*Segments.* The others of similar size share a cut into F fragments. Two linked sets
differ in at most D n-grams, D following from their sizes, and each difference spoils one
segment at most; with F > D they agree on a whole segment, and only sets that share a
segment are compared. Size classes are so wide that a linked pair lies in one class or in
two neighbouring ones; a set is cut for its own class and for the one below.

*Empty segments* say nothing and are not used. F is D + 1 + slack, so a linked pair
agrees on at least 1 + slack segments; a set with at most ``slack`` empty ones therefore
meets its partner in one that is not. A set with more is cut again with the hashes mixed
anew, and so on until a cut is full enough; a partner that needs fewer cuts made those
too. Nothing is lost.

*Comparison.* Groups with a common segment that overlap form candidate components. A
component, or, where that costs less, each of its groups, is compared in blocks of
``BLOCK`` sets against blocks; a block pair counts partial overlaps fragment by fragment
(columns of an incidence matrix, cut by hash order), sums them per pair and returns a
spanning forest of the links, never the pairs. A large group of near copies thus costs
block pairs, spread over tasks.

Hashes travel as packed arrays, one row per task and bucket. Equal sets are one node.
Texts are never shuffled: later passes read them again and skip by a bit array those
that take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import connected_components
from tallyloom.llm.tables import map_slices, partitions, without
from tallyloom.llm.words import WordHashes, ascii_words, mix, shingle_set
from tallyloom.session import cut_lineage

BLOCK = 256
#: A key met by so many sets in one batch leaves it as rows, not as part of one bucket's array.
HOT_IN_BATCH = 64
_COLUMNS = 4096
_CUT_SEEDS = tuple(int(x) for x in mix(np.arange(1, 65, dtype=np.uint64)))


@dataclass(frozen=True)
class JaccardRule:
    """Sets of ``words``-word shingles link if ``den * intersection >= num * union``.

    num / den is 0.75 or more: below, segments would be too small to be full.
    """

    words: int = 5
    num: int = 80
    den: int = 100

    def __post_init__(self) -> None:
        if not 3 * self.den <= 4 * self.num <= 4 * self.den:
            raise ValueError("num / den must lie between 0.75 and 1")

    @property
    def slack(self) -> float:
        """Spare segments per needed one: somewhat more than are empty in the smallest set of a class."""
        t, share = self.num / self.den, 1 / 24
        while t < 1 and share < 1.1 * (1 + share) * math.exp(-t * t / (1 - t) / (1 + share)) + 0.01:
            share += 1 / 96
        return share

    def most_different(self, a: int, b: int) -> int:
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def largest_partner(self, a: int) -> int:
        return a * self.den // self.num


@lru_cache(maxsize=8)
def _lower_bounds(rule: JaccardRule, up_to: int) -> np.ndarray:
    """First sizes of the classes."""
    bounds = [1, 2]
    while bounds[-1] <= up_to:
        bounds.append(max(bounds[-1] + 1, rule.largest_partner(bounds[-1] - 1) + 1))
    return np.array(bounds)


@lru_cache(maxsize=4096)
def _cut(rule: JaccardRule, first: int, after: int) -> tuple[int, int]:
    """(F, slack) of the class of sizes first .. after - 1; F = 0 where only equal sets link."""
    most = rule.most_different(after - 1, rule.largest_partner(after - 1))
    if most == 0:
        return 0, 0
    slack = math.ceil((most + 1) * rule.slack) if most > 8 else 0
    return most + 1 + slack, slack


def segment_keys(grams: np.ndarray, rule: JaccardRule) -> np.ndarray:
    """The keys under which a set (sorted distinct hashes) meets its possible partners."""
    n = len(grams)
    if n == 0:
        return np.empty(0, np.uint64)
    bounds = _lower_bounds(rule, 1 << max(10, n.bit_length()))
    own = int(np.searchsorted(bounds, n, side="right")) - 1
    keys = []
    for cls in {own, max(own - 1, 0)}:
        f, slack = _cut(rule, int(bounds[cls]), int(bounds[cls + 1]))
        if f == 0:
            continue
        for attempt, seed in enumerate(_CUT_SEEDS):
            order = grams if attempt == 0 else np.sort(mix(grams ^ np.uint64(seed)))
            fragment = ((order >> np.uint64(32)) * np.uint64(f)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate(([True], fragment[1:] != fragment[:-1])))
            total = np.add.reduceat(mix(order), starts)
            tag = np.uint64((cls << 40) + (attempt << 32))
            keys.append(mix(total + mix(fragment[starts] + tag)))
            if f - len(starts) <= slack:
                break
        else:
            raise ValueError("no cut of this set is full enough")
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def node_of(grams: np.ndarray) -> np.uint64:
    """One number per set; equal sets have equal ones. Zero stands for no set."""
    if len(grams) == 0:
        return np.uint64(0)
    value = mix(np.add.reduce(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)))[None] + np.uint64(len(grams)))[0]
    return value or np.uint64(1)


def _dealt(to: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of the buckets that get something; positions ascend."""
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


def _sets(pdf: pd.DataFrame, rule: JaccardRule, hashes: WordHashes) -> Iterator[np.ndarray]:
    for text in pdf["text"]:
        yield shingle_set(ascii_words(text), rule.words, hashes)


_HALF = np.uint64(1 << 63)
_COUNTED = "bucket int, high binary, low binary, nodes binary, times binary, documents binary"
_DOCUMENT = np.dtype(
    [("node", "<u8"), ("doc_id", "<i8"), ("no_id", "<i8"), ("n", "<i8"), ("half", "<i8"), ("met", "<i8")]
)
_MET = "node long, doc_id long, n long, half long, met long"


def _count_pack(rule: JaccardRule, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            if pdf.empty:
                continue
            ids = pdf["doc_id"]
            documents = np.zeros(len(pdf), _DOCUMENT)
            documents["no_id"] = ids.isna().to_numpy()
            documents["doc_id"] = ids.fillna(0).to_numpy().astype(np.int64)
            parts, seen = [], {}
            for i, grams in enumerate(_sets(pdf, rule, hashes)):
                node = node_of(grams)
                half = grams[: np.searchsorted(grams, _HALF)]
                documents[["node", "n", "half"]][i] = (node, len(grams), len(half))
                # Equal sets of a batch are one.
                if int(node) not in seen:
                    seen[int(node)] = len(parts)
                    parts.append(half)
            nodes = np.array(list(seen), np.uint64)
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            key = np.concatenate(parts) >> np.uint64(23)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
            counts = np.diff(np.append(starts, len(key)))
            shared = np.repeat(counts > 1, counts)
            met = np.bincount(owner[shared], minlength=len(parts))
            documents["met"] = met[[seen[int(v)] for v in documents["node"]]]
            # What only one set of the batch has asks for an answer; of the rest one row says that it is there.
            single = starts[counts == 1]
            several = starts[counts > 1]
            k = np.concatenate((key[single], key[several]))
            o = np.concatenate((owner[single], np.full(len(several), -1)))
            by_owner = np.argsort(o, kind="stable")
            k, o = k[by_owner], o[by_owner]
            rows = {}
            for b, at in _dealt((mix(k) % np.uint64(buckets)).astype(np.int64), buckets):
                own, times = np.unique(o[at], return_counts=True)
                names = np.where(own < 0, np.uint64(0), nodes[np.maximum(own, 0)]) if len(nodes) else own
                rows[b] = [
                    (k[at] >> np.uint64(32)).astype(np.uint8).tobytes(),
                    k[at].astype(np.uint32).tobytes(),
                    names.astype(np.uint64).tobytes(),
                    times.astype(np.uint32).tobytes(),
                    b"",
                ]
            # Not by node: one set may be that of very many documents.
            spread = mix(documents["doc_id"].view(np.uint64) + np.uint64(1))
            for b, at in _dealt((spread % np.uint64(buckets)).astype(np.int64), buckets):
                rows.setdefault(b, [b""] * 5)[4] = documents[at].tobytes()
            yield pd.DataFrame([(b, *row) for b, row in rows.items()], columns=[c.split()[0] for c in _COUNTED.split(", ")])

    return run


_ANSWERED = "part int, nodes binary, met binary, documents binary"


def _count(buckets: int):
    """Per node how many of its n-grams in the bucket others have too, dealt by node; documents go through."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        high = np.frombuffer(b"".join(pdf["high"]), np.uint8).astype(np.uint64)
        key = (high << np.uint64(32)) | np.frombuffer(b"".join(pdf["low"]), np.uint32)
        node = np.repeat(
            np.frombuffer(b"".join(pdf["nodes"]), np.uint64), np.frombuffer(b"".join(pdf["times"]), np.uint32)
        )
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        rows = [(int(pdf["bucket"].iloc[0]), b"", b"", b"".join(pdf["documents"]))]
        if len(key):
            # The mark that a batch has several sets with an n-gram stands for two.
            weight = np.where(node == 0, 2, 1)
            weight[1:][(key[1:] == key[:-1]) & (node[1:] == node[:-1])] = 0
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            total = np.repeat(np.add.reduceat(weight, starts), np.diff(np.append(starts, len(key))))
            names, met = np.unique(node[(total > 1) & (weight == 1)], return_counts=True)
            for part, at in _dealt((names % np.uint64(buckets)).astype(np.int64), buckets):
                rows.append((part, names[at].tobytes(), met[at].astype(np.uint32).tobytes(), b""))
        return pd.DataFrame(rows, columns=["part", "nodes", "met", "documents"])

    return run


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per node with its n-grams met elsewhere (n = -1), and one per document."""
    nodes = np.frombuffer(b"".join(pdf["nodes"]), np.uint64)
    names, inverse = np.unique(nodes, return_inverse=True)
    met = np.bincount(inverse, np.frombuffer(b"".join(pdf["met"]), np.uint32), len(names)).astype(np.int64)
    documents = np.frombuffer(b"".join(pdf["documents"]), _DOCUMENT)
    n = len(names)

    def column(first: np.ndarray | list, second) -> pd.Series:
        return pd.concat([pd.Series(first, dtype="Int64"), pd.Series(second, dtype="Int64")], ignore_index=True)

    doc_id = pd.array(documents["doc_id"].copy(), "Int64")
    doc_id[documents["no_id"] == 1] = pd.NA
    return pd.DataFrame(
        {
            "node": np.concatenate([_signed(names), _signed(np.ascontiguousarray(documents["node"]))]),
            "doc_id": column([pd.NA] * n, doc_id),
            "n": column(np.full(n, -1), documents["n"].copy()),
            "half": column([pd.NA] * n, documents["half"].copy()),
            "met": column(met, documents["met"].copy()),
        }
    )


_PACKED = "bucket int, keys binary, nodes binary, times binary"
_GROUPED = "gid long, node long"


def _pack(rule: JaccardRule, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            if pdf.empty:
                continue
            keys, nodes = {}, []
            for grams in _sets(pdf, rule, hashes):
                node = int(node_of(grams))
                if node and node not in keys:
                    keys[node] = np.unique(segment_keys(grams, rule))
            if not keys:
                continue
            nodes = np.array(list(keys), np.uint64)
            k = np.concatenate(list(keys.values()))
            v = np.repeat(nodes, [len(x) for x in keys.values()])
            order = np.argsort(k, kind="stable")
            k, v = k[order], v[order]
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
            counts = np.diff(np.append(starts, len(k)))
            hot = np.repeat(counts >= HOT_IN_BATCH, counts)
            # A marker (node 0) tells the bucket that this key's group has members elsewhere.
            marked = np.unique(k[hot])
            to = np.concatenate(
                (
                    np.where(hot, buckets + (mix(k ^ mix(v)) % np.uint64(buckets)).astype(np.int64), (mix(k) % np.uint64(buckets)).astype(np.int64)),
                    (mix(marked) % np.uint64(buckets)).astype(np.int64),
                )
            )
            k, v = np.concatenate((k, marked)), np.concatenate((v, np.zeros(len(marked), np.uint64)))
            by_node = np.argsort(v, kind="stable")
            k, v, to = k[by_node], v[by_node], to[by_node]
            rows = []
            for b, at in _dealt(to, 2 * buckets):
                own, times = np.unique(v[at], return_counts=True)
                # Members of hot keys are dealt by key and node, to buckets below zero.
                rows.append(
                    (b if b < buckets else buckets - 1 - b, k[at].tobytes(), own.tobytes(), times.astype(np.uint32).tobytes())
                )
            yield pd.DataFrame(rows, columns=["bucket", "keys", "nodes", "times"])

    return run


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _unpack(pdf: pd.DataFrame) -> pd.DataFrame:
    """Groups of nodes under a common key, each once per bucket."""
    k = np.frombuffer(b"".join(pdf["keys"]), np.uint64)
    v = np.repeat(np.frombuffer(b"".join(pdf["nodes"]), np.uint64), np.frombuffer(b"".join(pdf["times"]), np.uint32))
    order = np.lexsort((v, k))
    k, v = k[order], v[order]
    if len(k):
        fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])))
        k, v = k[fresh], v[fresh]
    if int(pdf["bucket"].iloc[0]) < 0:
        return pd.DataFrame({"gid": _signed(k), "node": _signed(v)})
    starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    counts = np.diff(np.append(starts, len(k)))
    wide = counts > 1
    starts, counts = starts[wide], counts[wide]
    if not len(starts):
        return pd.DataFrame({"gid": np.empty(0, np.int64), "node": np.empty(0, np.int64)})
    first = np.cumsum(counts) - counts
    own = v[np.repeat(starts - first, counts) + np.arange(counts.sum())]
    hot = own[first] == 0  # sorted: the marker comes first
    gid = np.where(hot, k[starts], mix(np.add.reduceat(mix(own), first) + counts.astype(np.uint64)))
    _, once = np.unique(gid, return_index=True)
    keep = np.zeros(len(gid), bool)
    keep[once] = True
    wanted = np.repeat(keep, counts) & (own != 0)
    return pd.DataFrame({"gid": _signed(np.repeat(gid, counts)[wanted]), "node": _signed(own[wanted])})


def _grams_of(rule: JaccardRule):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            sets = list(_sets(pdf, rule, hashes))
            yield pd.DataFrame(
                {
                    "node": np.array([node_of(s) for s in sets], np.uint64).view(np.int64),
                    "grams": [s.tobytes() for s in sets],
                }
            )

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, summed over fragments of the global order."""
    sets = left + right
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams = np.concatenate(sets)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.concatenate(([True], grams[1:] != grams[:-1]))
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(grams)))
    shared = np.repeat(counts > 1, counts)
    owner = owner[shared]
    column = np.cumsum(new[shared]) - 1
    out = np.zeros((len(left), len(right)), np.int64)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + _COLUMNS, _COLUMNS))
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        part = np.zeros((len(sets), _COLUMNS), np.float32)
        part[owner[a:b], column[a:b] % _COLUMNS] = 1
        out += (part[: len(left)] @ part[len(left) :].T).astype(np.int64)
    return out


def _forest(rule: JaccardRule):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf["node"].to_numpy()
        sets = [np.frombuffer(g, np.uint64) for g in pdf["grams"]]
        blocks, low, high = pdf["block"].to_numpy(), int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        left = np.flatnonzero(blocks == low)
        right = np.flatnonzero(blocks == high)
        parent = np.arange(len(nodes))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        links = []
        if len(left) and len(right):
            sizes = np.array([len(s) for s in sets])
            both = overlaps([sets[i] for i in left], [sets[i] for i in right])
            union = sizes[left][:, None] + sizes[right][None, :] - both
            for i, j in zip(*np.nonzero(rule.den * both >= rule.num * union)):
                a, b = left[i], right[j]
                if a != b and (ra := root(a)) != (rb := root(b)):
                    parent[ra] = rb
                    links.append((nodes[a], nodes[b]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def _units(members: DataFrame, block: int) -> DataFrame:
    """(unit, node, blocks): what to compare with what. A unit is a candidate component or a group."""
    groups = members.groupBy("gid").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size"))
    candidate = connected_components(
        members.join(groups, "gid").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    )
    candidate = cut_lineage(candidate)
    sizes = candidate.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    cost = (F.col("size") * F.ceil(F.col("size") / block)).cast("long")
    by_group = (
        groups.join(candidate, F.col("hub") == F.col("node"))
        .groupBy("component")
        .agg(F.sum(cost).alias("group_cost"))
    )
    choice = sizes.join(by_group, "component").withColumn("whole", cost <= F.col("group_cost"))
    blocks = F.ceil(F.col("size") / block).cast("int").alias("blocks")
    whole = choice.filter("whole").join(candidate, "component").select(F.col("component").alias("unit"), "node", blocks)
    split = choice.filter("not whole").select("component").join(candidate, "component").select("node")
    parts = members.join(split, "node").join(groups, "gid").select(F.col("gid").alias("unit"), "node", blocks)
    return whole.unionByName(parts)


def linked_sets(docs: DataFrame, rule: JaccardRule, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n (size of its set), component_id.

    ``component_id`` is the smallest doc_id that can be reached by links, the document's own
    included. A text without words has an empty set, n = 0, and links with nothing; a row
    without doc_id links with nothing and has no component. Rows that repeat a doc_id are
    rows of their own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = max(partitions(spark), 1)
    counted = map_slices(docs, _count_pack(rule, buckets), _COUNTED, rows=2048)
    answered = counted.groupBy("bucket").applyInPandas(_count(buckets), _ANSWERED)
    met = cut_lineage(answered.groupBy("part").applyInPandas(_add_up, _MET))
    info = met.filter(F.col("n") >= 0).select("doc_id", "node", "n")
    known = info.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = known.groupBy("node").agg(F.min("doc_id").alias("least_id"))
    missing = F.floor(F.col("n") * (rule.den - rule.num) / rule.den)
    elsewhere = met.filter(F.col("n") < 0).select("node", F.col("met").alias("elsewhere"))
    wanted = cut_lineage(
        met.filter(F.col("n") > 0)
        .groupBy("node", "n", "half")
        .agg(F.max("met").alias("met"))
        .join(elsewhere, "node", "left")
        .filter(F.col("met") + F.coalesce("elsewhere", F.lit(0)) + missing >= F.col("half"))
        # Nodes only of rows without doc_id take no part.
        .join(classes, "node")
        .select("node", F.col("least_id").alias("doc_id"))
    )
    packed = map_slices(docs, _pack(rule, buckets), _PACKED, rows=2048, members=wanted.select("doc_id"))
    members = cut_lineage(
        packed.groupBy("bucket")
        .applyInPandas(_unpack, _GROUPED)
        .distinct()
        .join(wanted.select("node"), "node", "left_semi")
    )
    of_members = members.select("node").distinct().join(wanted, "node").select("doc_id")
    grams = (
        map_slices(docs, _grams_of(rule), "node long, grams binary", members=of_members)
        .groupBy("node")
        .agg(F.first("grams").alias("grams"))
    )
    placed = (
        _units(members, block)
        .withColumn("block", F.pmod(F.xxhash64("node", "unit"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("unit", "node", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    links = (
        placed.join(grams, "node")
        .groupBy("unit", "low", "high")
        .applyInPandas(_forest(rule), "a long, b long")
    )
    component = connected_components(cut_lineage(links))
    named = classes.join(component, "node")
    labels = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_node = (
        classes.join(component, "node", "left")
        .join(labels, "component", "left")
        .select("node", F.coalesce("component_id", "least_id").alias("component_id"))
    )
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return info.join(of_node, "node", "left").select(
        "doc_id", "n", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_per_component(docs: DataFrame, rule: JaccardRule = JaccardRule()) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each component.

    Rows without doc_id are kept; of rows that repeat the doc_id that stays, all stay.
    """
    sets = cut_lineage(linked_sets(docs, rule).select("doc_id", "component_id"))
    stays = sets.filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
    goes = sets.filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return without(docs, cut_lineage(goes.join(stays, "doc_id", "left_anti").distinct()))
