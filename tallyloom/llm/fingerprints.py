"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its pairs of neighbouring words with their counts (a single
word stands for itself). For each of ``SAMPLES`` positions every term draws r and c from
Gamma(2, 1) and b from [0, 1), all from the term's hash. A term of weight w gets
``t = floor(ln w / r + b)`` and ``ln a = ln c - r (t - b) - r``; the sample is the term
with the least a, together with its t. Two texts agree at a position with probability
equal to their generalised Jaccard similarity (sum of minima over sum of maxima).

The draws come from a table of ``_ROWS`` rows that a term's hash selects from; what is
kept of a sample is 16 bits of a hash of the whole term, its t and the position, so terms
that share a row are still told apart.

Neighbours. ``fingerprint_with_edits`` gives each document the text that follows in
descending order of doc_id. Rows are cut into slices of neighbouring ids at quantiles
(some numbers on the driver, two per partition), sorted inside a slice and streamed with
one text in memory; the last document of a slice is also sent to the next one. One
shuffle of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tables import map_slices, partitions, text_or_empty
from tallyloom.llm.words import WordHashes, ascii_words, hashed, mix, rolling

SAMPLES = 64
_ROWS = 1 << 16
_TERMS_AT_ONCE = 8192


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ln a of weight 1, r, b) per row and position."""
    cells = np.arange(_ROWS * SAMPLES, dtype=np.uint64)

    def uniform(stream: int) -> np.ndarray:
        bits = mix(cells + mix(np.array([stream + 1], np.uint64))[0])
        return (((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)).astype(np.float32)

    r = -np.log(uniform(0)) - np.log(uniform(1))
    c = -np.log(uniform(2)) - np.log(uniform(3))
    b = uniform(4)
    shape = (_ROWS, SAMPLES)
    return (np.log(c) + r * b - r).reshape(shape), r.reshape(shape), b.reshape(shape)


def terms(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the weighted terms, ascending, and their weights."""
    h = hashed(ascii_words(text), hashes)
    if len(h) > 1:
        h = rolling(h, 2)
    return np.unique(h, return_counts=True)


def sample(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``SAMPLES`` numbers of 16 bits; all zero (and only then) for an empty set."""
    if not len(hashes):
        return np.zeros(SAMPLES, np.uint16)
    first, r, b = _draws()
    lanes = np.arange(SAMPLES)
    best = np.full(SAMPLES, np.inf, np.float32)
    term, times = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.int64)
    for at in range(0, len(hashes), _TERMS_AT_ONCE):
        h, w = hashes[at : at + _TERMS_AT_ONCE], weights[at : at + _TERMS_AT_ONCE]
        rows = (h & np.uint64(_ROWS - 1)).astype(np.int64)
        a = first[rows]
        t = np.zeros(0)
        several = np.flatnonzero(w > 1)
        if len(several):
            own = r[rows[several]]
            t = np.floor(np.log(w[several]).astype(np.float32)[:, None] / own + b[rows[several]])
            a[several] -= own * t
        least = a.argmin(axis=0)
        value = a[least, lanes]
        better = value < best
        best = np.where(better, value, best)
        term = np.where(better, h[least], term)
        now = np.zeros(SAMPLES, np.int64)
        if len(several):
            place = np.searchsorted(several, least)
            found = (place < len(several)) & (several[np.minimum(place, len(several) - 1)] == least)
            now[found] = t[place[found], lanes[found]].astype(np.int64)
        times = np.where(better, now, times)
    bits = mix(term + mix(times.astype(np.uint64) * np.uint64(SAMPLES) + lanes.astype(np.uint64)))
    return np.maximum(bits >> np.uint64(48), np.uint64(1)).astype(np.uint16)


def fingerprint(text: str | None, hashes: WordHashes) -> np.ndarray:
    return sample(*terms(text, hashes))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of positions that agree."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (lowercase hex) per row of ``docs``; a NULL text is an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "fingerprint": [fingerprint(t, hashes).astype("<u2").tobytes().hex() for t in pdf["text"]],
                }
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_slices(chosen, run, "doc_id long, fingerprint string")


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by slice, lead-in first, then ascending doc_id: what came before follows in descending order."""
    hashes = WordHashes()
    nothing = ("", np.zeros(SAMPLES, np.uint16))
    at = before = now = current = None
    for pdf in batches:
        rows = []
        for part, lead_in, doc, text in zip(pdf["slice"], pdf["lead_in"], pdf["doc_id"], pdf["text"]):
            if part != at:
                at, before, now, current = part, nothing, None, None
            if lead_in:
                # The first row of an id stands for it.
                now = now or (text, fingerprint(text, hashes))
                continue
            known = fingerprint(text, hashes)
            no_id = pd.isna(doc)
            if not no_id and current != doc:
                before, now, current = now or nothing, (text, known), doc
            following = nothing if no_id else before
            edited = _edited(text, following[0])
            changed = fingerprint(edited, hashes)
            rows.append(
                (
                    doc,
                    len(text),
                    hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                    known.astype("<u2").tobytes().hex(),
                    changed.astype("<u2").tobytes().hex(),
                    likeness(known, changed),
                    likeness(known, following[1]),
                )
            )
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _RESULT.split(", ")])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last floor(n / 2) code points replaced by the first as many of
    the next document in descending order of doc_id; the last one is followed by the first,
    a single one by itself. NULL texts are empty. Of rows that repeat a doc_id each gets a
    result, the smallest text stands for the id as a neighbour. Rows without doc_id have no
    neighbour: nothing replaces their end, and the next text counts as empty.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n = partitions(spark)
    wanted = [i / (2 * n) for i in range(1, 2 * n)]
    cuts = chosen.agg(F.percentile_approx("doc_id", wanted, 10_000).alias("cuts")).first().cuts
    points = F.array(*(F.lit(c).cast("long") for c in sorted(set(cuts or [0]))))
    part = F.size(F.filter(points, lambda c: c < F.col("doc_id")))
    ids = chosen.filter(F.col("doc_id").isNotNull()).select("doc_id", part.alias("slice"))
    # One row per slice, as many as cut points.
    ends = sorted(ids.groupBy("slice").agg(F.max("doc_id").alias("last")).collect())
    to = {row.last: ends[(i + 1) % len(ends)].slice for i, row in enumerate(ends)}
    sent = F.lit(None).cast("int")
    if to:
        pairs = F.create_map(*(x for k, v in to.items() for x in (F.lit(k).cast("long"), F.lit(v).cast("int"))))
        sent = F.try_element_at(pairs, F.col("doc_id"))
    own = F.struct(F.coalesce(part, F.lit(-1)).cast("int").alias("slice"), F.lit(False).alias("lead_in"))
    no_id = F.struct((-1 - F.pmod(F.xxhash64("text"), F.lit(n))).cast("int").alias("slice"), F.lit(False).alias("lead_in"))
    also = F.struct(sent.alias("slice"), F.lit(True).alias("lead_in"))
    sliced = (
        chosen.withColumn(
            "to",
            F.explode(
                F.when(F.col("doc_id").isNull(), F.array(no_id)).when(sent.isNull(), F.array(own)).otherwise(F.array(own, also))
            ),
        )
        .select("to.slice", "to.lead_in", "doc_id", "text")
        .repartition(n, "slice")
        .sortWithinPartitions("slice", F.desc("lead_in"), "doc_id", "text")
    )
    return map_slices(sliced, _stream, _RESULT)
