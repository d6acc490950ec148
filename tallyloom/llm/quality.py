"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into overlapping chunks that cover all of it. Learned
filters of ``WIDTH`` bytes slide over each chunk; per filter the largest response in the
chunk counts (max-pooling). A document's features are the mean and the maximum of its
chunks' responses; a logistic unit makes one probability of them.

Fitting uses a bounded sample (``FitSample``): the labelled rows with the smallest hashes
of doc_id, per label, and of each text at most ``chunks`` evenly spaced chunks. The
sample reaches the driver as packed bytes, some tens of megabytes at most; the fitted
weights are some hundred kilobytes and go out with the tasks. Scoring reads every byte
of every text in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tables import text_or_empty

CHUNK, OVERLAP, WIDTH, FILTERS = 512, 64, 6, 16
_PAD = 256
_SYMBOLS = 257
_LONG = CHUNK + WIDTH - 1


@dataclass(frozen=True)
class FitSample:
    """Bounds of what the classifier is fitted on, and its steps of 32 texts each."""

    rows_per_label: int = 1500
    chunks: int = 12
    steps: int = 750
    seed: int = 7


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 257 x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # mean features, then maxima
    offset: float

    def pair_tables(self) -> list[np.ndarray]:
        """For each pair of neighbouring bytes, what it adds to every filter."""
        return [
            (self.filters[k][:, None, :] + self.filters[k + 1][None, :, :]).reshape(-1, FILTERS).astype(np.float32)
            for k in range(0, WIDTH, 2)
        ]


def chunks_of(raw: bytes) -> np.ndarray:
    """All chunks of a text, one per row, the last one padded; an empty text is one row of padding."""
    step = CHUNK - OVERLAP
    count = 1 + max(0, -(-(len(raw) - CHUNK) // step))
    padded = np.full((count - 1) * step + _LONG, _PAD, np.uint16)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(padded, _LONG)[::step]
    return rows[:count]


def pooled(rows: np.ndarray, tables: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Largest response of each filter per chunk."""
    out = np.empty((len(rows), FILTERS), np.float32)
    for at in range(0, len(rows), 32):
        x = rows[at : at + 32].astype(np.int32)
        pairs = x[:, :-1] * _SYMBOLS + x[:, 1:]
        total = np.take(tables[0], pairs[:, :CHUNK], axis=0)
        for i, table in enumerate(tables[1:], start=1):
            total += np.take(table, pairs[:, 2 * i : 2 * i + CHUNK], axis=0)
        out[at : at + 32] = total.max(axis=1)
    return np.maximum(out + bias.astype(np.float32), 0)


def scores(net: Network, texts: list[str], group: int = 256) -> np.ndarray:
    """Probabilities of label 1."""
    tables, result = net.pair_tables(), []
    rows, counts = [], []

    def flush() -> None:
        if not counts:
            return
        p = pooled(np.concatenate(rows), tables, net.bias)
        starts = np.cumsum([0, *counts[:-1]])
        mean = np.add.reduceat(p, starts, axis=0) / np.array(counts)[:, None]
        high = np.maximum.reduceat(p, starts, axis=0)
        logit = np.concatenate([mean, high], axis=1) @ net.weights + net.offset
        result.append(1 / (1 + np.exp(-logit)))
        rows.clear()
        counts.clear()

    for text in texts:
        part = chunks_of(text.encode("utf-8", "surrogatepass"))
        rows.append(part)
        counts.append(len(part))
        if sum(counts) >= group:
            flush()
    flush()
    return np.concatenate(result) if result else np.empty(0)


def fit(samples: list[tuple[np.ndarray, int]], how: FitSample) -> Network:
    """Adam on the logistic loss, both labels weighing the same. ``samples``: (chunks, label)."""
    rng = np.random.default_rng(how.seed)
    params = {
        "filters": rng.normal(0, 0.25, (WIDTH, _SYMBOLS, FILTERS)),
        "bias": np.zeros(FILTERS),
        "weights": rng.normal(0, 0.1, 2 * FILTERS),
        "offset": np.zeros(1),
    }
    params["filters"][:, _PAD] = 0
    labels = np.array([label for _, label in samples])
    share = {v: (labels == v).mean() for v in (0, 1)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    order: list[int] = []
    for step in range(1, how.steps + 1):
        if not order:
            order = rng.permutation(len(samples)).tolist()
        chosen, order = order[:32], order[32:]
        rate = 0.02 * (1 - step / how.steps) + 0.001
        rows = np.concatenate([samples[i][0] for i in chosen])
        counts = np.array([len(samples[i][0]) for i in chosen])
        starts = np.cumsum(counts) - counts
        grads = _gradients(params, rows, counts, starts, labels[chosen], share)
        for k, g in grads.items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            params[k] = params[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(params["filters"], params["bias"], params["weights"], float(params["offset"][0]))


def _gradients(params, rows, counts, starts, y, share) -> dict[str, np.ndarray]:
    tables = Network(params["filters"], params["bias"], params["weights"], 0.0).pair_tables()
    x = rows.astype(np.int32)
    pairs = x[:, :-1] * _SYMBOLS + x[:, 1:]
    best = np.empty((len(rows), FILTERS), np.int64)
    top = np.empty((len(rows), FILTERS))
    for a in range(0, len(rows), 32):
        part = slice(a, a + 32)
        total = np.take(tables[0], pairs[part, :CHUNK], axis=0)
        for i, table in enumerate(tables[1:], start=1):
            total += np.take(table, pairs[part, 2 * i : 2 * i + CHUNK], axis=0)
        best[part] = total.argmax(axis=1)
        top[part] = np.take_along_axis(total, best[part][:, None, :], axis=1)[:, 0]
    pre = top + params["bias"]
    p = np.maximum(pre, 0)
    mean = np.add.reduceat(p, starts, axis=0) / counts[:, None]
    high = np.maximum.reduceat(p, starts, axis=0)
    features = np.concatenate([mean, high], axis=1)
    prob = 1 / (1 + np.exp(-np.clip(features @ params["weights"] + params["offset"], -30, 30)))
    weight = np.where(y == 1, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9))
    d = weight * (prob - y) / len(y)
    back = d[:, None] * params["weights"][None, :]
    of = np.repeat(np.arange(len(counts)), counts)
    g = back[of, :FILTERS] / counts[of][:, None]
    # Chunks that share a maximum share its gradient.
    top_chunks = (p == high[of]).astype(float)
    g = g + back[of, FILTERS:] * top_chunks / np.add.reduceat(top_chunks, starts, axis=0)[of]
    g = g * (pre > 0)
    filters = np.zeros_like(params["filters"])
    lanes = np.broadcast_to(np.arange(FILTERS), best.shape)
    for k in range(WIDTH):
        np.add.at(filters[k], (np.take_along_axis(x, best + k, axis=1), lanes), g)
    filters[:, _PAD] = 0
    return {
        "filters": filters + 1e-5 * params["filters"],
        "bias": g.sum(axis=0),
        "weights": features.T @ d + 1e-4 * params["weights"],
        "offset": np.array([d.sum()]),
    }


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _fit_rows(docs: DataFrame, labels: DataFrame, how: FitSample) -> list[tuple[np.ndarray, int]]:
    """The bounded sample as (chunks, label), in a fixed order."""
    marked = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~_held_out())
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [marked.filter(F.col("quality") == v).orderBy(*order).limit(how.rows_per_label) for v in (0, 1)]
    few = chosen[0].unionByName(chosen[1])

    def spaced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                rows = chunks_of(text.encode("utf-8", "surrogatepass"))
                at = np.unique(np.linspace(0, len(rows) - 1, how.chunks).astype(int))
                out.append(rows[at].astype("<u2").tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "chunks": out})

    texts = docs.select("doc_id", text_or_empty().alias("text"))
    # At most 2 x rows_per_label ids: a bound, whatever the tables' size.
    got = (
        texts.join(F.broadcast(few), "doc_id")
        .mapInPandas(spaced, "doc_id long, quality int, chunks binary")
        .collect()
    )
    got.sort(key=lambda r: (r.doc_id, r.chunks))
    return [(np.frombuffer(r.chunks, "<u2").reshape(-1, _LONG), r.quality) for r in got]


def fit_quality(docs: DataFrame, labels: DataFrame, how: FitSample = FitSample()) -> Network | None:
    """The network fitted on labelled rows that are not held out; None unless both labels occur."""
    samples = _fit_rows(docs, labels, how)
    return fit(samples, how) if {label for _, label in samples} == {0, 1} else None


def score_documents(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with a column ``score``, 0 to 1. NULL texts score as empty ones.

    Without a network (labels of one kind only, or none) every score is 0.5.
    """
    if net is None:
        return docs.withColumn("score", F.lit(0.5))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(scores(net, texts.tolist()))

    return docs.withColumn("score", score(text_or_empty()))


def quality_scores(docs: DataFrame, labels: DataFrame, how: FitSample = FitSample(), least: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 if score >= least)."""
    net = fit_quality(docs, labels, how)
    scored = score_documents(docs.select("doc_id", "text"), net)
    return scored.select(
        "doc_id",
        _held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= least, 1).otherwise(0).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, how: FitSample = FitSample(), least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``."""
    return score_documents(docs, fit_quality(docs, labels, how)).filter(F.col("score") >= least).drop("score")
