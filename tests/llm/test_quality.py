"""The convolutional network: gradients, pooling over whole texts, held-out accuracy."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pytest

from tallyloom.llm import quality as q

FOLDER = "/root/testdata/sf0.01"
HOW = q.FitSample(rows_per_label=60, chunks=4, steps=60)


def junk(i):
    return " ".join(["spam!!"] * (5 + i % 40))


def prose(i):
    return ". ".join(f"Word{i} and then some other things, {k} of them" for k in range(2 + i % 20))


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(i, junk(i) if i % 4 == 0 else prose(i)) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, prose(3)), (1, rows[1][1])], "doc_id long, text string")
    labels = [(i, int(i % 4 != 0), 0) for i in range(400)] + [(5, 1, 0), (7, None, 0), (None, 1, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chunks_cover_the_whole_text():
    for n in (0, 1, q.CHUNK, q.CHUNK + 1, 5000):
        raw = bytes(i % 251 for i in range(n))
        rows = q.chunks_of(raw)
        step, seen = q.CHUNK - q.OVERLAP, bytearray()
        for k, row in enumerate(rows):
            part = row[: q.CHUNK]
            part = bytes(part[part != 256].astype(np.uint8))
            assert part == raw[k * step : k * step + q.CHUNK]
            seen[k * step : k * step + len(part)] = part
        assert bytes(seen) == raw


def test_pooling_equals_a_plain_convolution():
    rng = np.random.default_rng(1)
    net = q.Network(rng.normal(size=(q.WIDTH, 257, q.FILTERS)), rng.normal(size=q.FILTERS), rng.normal(size=2 * q.FILTERS), 0.1)
    raw = bytes(rng.integers(0, 256, 700).astype(np.uint8))
    rows = q.chunks_of(raw)
    plain = []
    for row in rows:
        response = [sum(net.filters[k, row[i + k]] for k in range(q.WIDTH)) for i in range(q.CHUNK)]
        plain.append(np.maximum(np.max(response, axis=0) + net.bias, 0))
    assert np.allclose(q.pooled(rows, net.pair_tables(), net.bias), plain, atol=1e-4)
    ascii_text = "".join(chr(32 + b % 90) for b in raw)
    rows = q.pooled(q.chunks_of(ascii_text.encode()), net.pair_tables(), net.bias)
    features = np.concatenate([rows.mean(axis=0), rows.max(axis=0)])
    expected = 1 / (1 + np.exp(-(features @ net.weights + net.offset)))
    assert np.allclose(q.scores(net, ["", ascii_text, "x"])[1], expected)


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    params = {
        "filters": rng.normal(0, 0.3, (q.WIDTH, 257, q.FILTERS)), "bias": rng.normal(0, 0.1, q.FILTERS),
        "weights": rng.normal(0, 0.5, 2 * q.FILTERS), "offset": np.array([0.2]),
    }
    params["filters"][:, 256] = 0
    texts = [prose(1).encode(), junk(9).encode(), (prose(30) * 3).encode()]
    parts = [q.chunks_of(t) for t in texts]
    rows, counts = np.concatenate(parts), np.array([len(p) for p in parts])
    starts, y, share = np.cumsum(counts) - counts, np.array([1, 0, 1]), {0: 1 / 3, 1: 2 / 3}

    def loss(p):
        net = q.Network(p["filters"], p["bias"], p["weights"], float(p["offset"][0]))
        prob = np.clip(q.scores(net, [t.decode() for t in texts]), 1e-9, 1 - 1e-9)
        weight = np.where(y == 1, 0.5 / share[1], 0.5 / share[0])
        decay = 0.5e-5 * (p["filters"] ** 2).sum() + 0.5e-4 * (p["weights"] ** 2).sum()
        return -(weight * (y * np.log(prob) + (1 - y) * np.log(1 - prob))).mean() + decay

    grads = q._gradients(params, rows, counts, starts, y, share)
    for name, at in (("offset", (0,)), ("bias", (3,)), ("weights", (2,)), ("weights", (q.FILTERS + 5,)), ("filters", (0, ord("s"), 4)), ("filters", (2, ord(" "), 7))):
        up, down = ({k: v.copy() for k, v in params.items()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        assert np.isclose(grads[name][at], (loss(up) - loss(down)) / 2e-3, rtol=0.1, atol=2e-3), name


def test_scores_and_columns(toy):
    docs, labels = toy
    out = q.quality_scores(docs, labels, HOW)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in held]) > 0.95


def test_held_out_labels_are_not_learned(spark, toy):
    docs, _ = toy
    flipped = spark.createDataFrame(
        [(i, int((i % 4 == 0) if zlib.crc32(str(i).encode()) % 5 == 0 else (i % 4 != 0))) for i in range(400)],
        "doc_id long, quality int",
    )
    same = {r.doc_id: r.score for r in q.quality_scores(docs, flipped, HOW).filter("doc_id < 400").collect()}
    clean = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)], "doc_id long, quality int")
    assert same == {r.doc_id: r.score for r in q.quality_scores(docs, clean, HOW).filter("doc_id < 400").collect()}


def test_without_two_kinds_of_labels_every_score_is_a_half(toy):
    docs, labels = toy
    assert {r.score for r in q.quality_scores(docs, labels.filter("quality = 1"), HOW).collect()} == {0.5}
    assert q.quality_scores(docs.limit(0), labels, HOW).collect() == []


def test_filter_keeps_columns(toy):
    docs, labels = toy
    kept = q.keep_good(docs, labels, HOW)
    assert kept.columns == docs.columns and 250 < kept.count() < 330


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    out = q.quality_scores(docs, labels).filter("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r.score for r in out if r.quality == v] for v in (1, 0))
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in bad] for a in good])
    assert auc > 0.95 and np.mean([s >= 0.3 for s in good]) > 0.93
