"""Effects of sale requests on a stock, and scans over them, against one request after the other."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tallyloom.functions.scan import exclusive_scan
from tallyloom.functions.stock import Effect, act_packed, compose, compose_packed, effect_of, sold


def in_turn(quantities, stock):
    accepted = []
    for q in quantities:
        accepted.append(q <= stock)
        stock -= q if accepted[-1] else 0
    return accepted, stock


def samples(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        lowest = rng.choice([1, 1, 0, -3, -20])
        highest = rng.choice([3, 10, 60])
        quantities = np.array([rng.randint(lowest, highest) for _ in range(rng.randrange(1, 60))])
        yield rng, quantities, rng.choice([rng.randrange(50), rng.randrange(1000), -5])


def limit_of(quantities):
    return max(int(quantities.max()), 0) - int(np.minimum(quantities, 0).sum()) + 1


def test_sold_in_stretches_is_sold_in_turn():
    for _, quantities, stock in samples(1, 2000):
        accepted, left = sold(quantities, stock)
        assert (accepted.tolist(), left) == in_turn(quantities.tolist(), stock)
    assert sold(np.zeros(0, np.int64), 5)[1] == 5


def test_composed_effects_are_those_of_all_requests():
    for rng, quantities, stock in samples(2, 1500):
        limit = limit_of(quantities)
        cuts = sorted(rng.sample(range(len(quantities) + 1), min(len(quantities), 3)))
        effects, track = [], stock
        for low, high in zip([0, *cuts], [*cuts, len(quantities)]):
            effects.append(effect_of(quantities[low:high], track, limit))
            track -= int(quantities[low:high].sum())
        whole = Effect.unpack(compose(effects).pack())
        nested = compose([compose(effects[:2]), *effects[2:]])
        for found in {stock, *range(min(0, stock), limit)}:
            passed = [found]
            for q in quantities.tolist():
                passed.append(passed[-1] - (q if q <= passed[-1] else 0))
            if found == stock or max(passed) < limit:  # else no refusal leaves it
                assert whole.act(found) == nested.act(found) == passed[-1]


def test_an_effect_has_no_more_steps_than_stocks_below_the_limit():
    quantities = np.random.default_rng(3).integers(1, 51, 4096)
    effect = effect_of(quantities, 10**9, 51)
    assert len(effect.lows) <= 51 and effect.after == 10**9 - quantities.sum()
    assert len(compose([effect] * 3).lows) <= 51


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_scan_of_sequences_of_very_different_lengths(spark, fan):
    rng = np.random.default_rng(fan)
    nodes, starts, want = [], [], {}
    for key, length in ((1, 200), (2, 1), (3, 37), (4, fan), (5, fan + 1)):
        quantities = [rng.integers(1, 9, rng.integers(1, 5)) for _ in range(length)]
        stock = track = found = 300
        starts.append((key, stock))
        for place, slice_ in enumerate(quantities):
            want[key, place] = found
            nodes.append((key, place, effect_of(slice_, track, 10).pack()))
            track -= int(slice_.sum())
            found = in_turn(slice_.tolist(), found)[1]
    frame = spark.createDataFrame(nodes, "key long, place long, effect binary").repartition(4)
    scanned = exclusive_scan(frame, spark.createDataFrame(starts, "key long, state long"), compose_packed, act_packed, fan)
    assert {(r.key, r.place): r.state for r in scanned.collect()} == want


def test_scan_of_nothing(spark):
    frame = spark.createDataFrame([], "key long, place long, effect binary")
    starts = spark.createDataFrame([], "key long, state long")
    assert exclusive_scan(frame, starts, compose_packed, act_packed).count() == 0
