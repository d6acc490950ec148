"""What a run of sale requests does to a stock, as an effect that can be composed.

A request of ``q`` is accepted if ``q`` is at most the stock left, and then takes it; a
negative one adds. Before the first refusal the stock is a plain running sum, so a run of
requests needs to know its effect for one such stock only, the one on ``track``. A refusal
leaves less than the refused quantity, and what is added later is bounded too; so after it
the stock stays below a ``limit`` (largest quantity plus all that is added). There the
effect is a step function: bounds of the stock found, and what is taken from each bound on.
It has at most as many steps as there are stocks below the limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

_BOTTOM = np.iinfo(np.int64).min // 4


class Effect(NamedTuple):
    """``track`` becomes ``after``; a stock below ``limit``, from ``lows[i]`` on, loses ``taken[i]``."""

    track: int
    after: int
    limit: int
    lows: np.ndarray
    taken: np.ndarray

    def pack(self) -> bytes:
        return np.concatenate(([self.track, self.after, self.limit], self.lows, self.taken)).astype("<i8").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Effect:
        numbers = np.frombuffer(data, "<i8")
        lows, taken = numbers[3:].reshape(2, -1)
        return cls(*numbers[:3].tolist(), lows, taken)

    def act(self, stock: int) -> int:
        """The stock left of a stock that is on the track or below the limit."""
        if stock == self.track:
            return self.after
        return stock - int(self.taken[np.searchsorted(self.lows, stock, side="right") - 1])


def sold(quantities: np.ndarray, stock: int) -> tuple[np.ndarray, int]:
    """Which requests are accepted in turn, and the stock left.

    Whole stretches without a refusal are settled by their running sum.
    """
    accepted = np.zeros(len(quantities), bool)
    at = 0
    while at < len(quantities):
        rest = quantities[at:]
        before = np.cumsum(rest) - rest
        refused = np.flatnonzero(rest > stock - before)
        if not len(refused):
            accepted[at:] = True
            return accepted, stock - int(rest.sum())
        first = int(refused[0])
        accepted[at : at + first] = True
        stock -= int(before[first])
        # Until something is added, only what fits the stock left can be next.
        at += first + 1
        fits = np.flatnonzero((quantities[at:] <= stock) | (quantities[at:] < 0))
        at = at + int(fits[0]) if len(fits) else len(quantities)
    return accepted, stock


def effect_of(quantities: np.ndarray, track: int, limit: int) -> Effect:
    """The effect of requests in turn on the stock ``track`` and on all stocks below ``limit``."""
    after = sold(quantities, track)[1]
    lows, taken = np.array([_BOTTOM]), np.zeros(1, np.int64)
    # Nothing below the limit holds more than the limit plus what has been added.
    for q in quantities[quantities < limit].tolist():
        edge = taken + q  # the least stock found that still holds the request
        highs = np.append(lows[1:], limit)
        fits = lows >= edge
        split = ~fits & (highs > edge)
        if split.any():
            lows = np.concatenate((lows, edge[split]))
            fits = np.concatenate((fits, np.ones(int(split.sum()), bool)))
            taken = np.concatenate((taken, taken[split]))
            order = np.argsort(lows, kind="stable")
            lows, taken, fits = lows[order], taken[order], fits[order]
        elif not fits.any():
            continue
        lows, taken = _merged(lows, taken + q * fits)
    return Effect(track, after, limit, lows, taken)


def _merged(lows: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same steps, equal neighbours as one."""
    kept = np.append(True, taken[1:] != taken[:-1])
    return lows[kept], taken[kept]


def compose(effects: Sequence[Effect]) -> Effect:
    """One effect of several, in order; all of one limit."""
    first, *rest = effects
    after, lows, taken = first.after, first.lows, first.taken
    for effect in rest:
        after = effect.act(after)
        # Where a step of the next effect begins, seen from the stock found first.
        highs = np.append(lows[1:], first.limit)
        start = np.searchsorted(effect.lows, lows - taken, side="right")
        stop = np.searchsorted(effect.lows, highs - taken, side="left")
        inside = np.maximum(stop - start, 0)
        step = np.repeat(np.arange(len(lows)), inside)
        cut = np.arange(inside.sum()) - np.repeat(np.cumsum(inside) - inside, inside) + start[step]
        all_lows = np.concatenate((lows, effect.lows[cut] + taken[step]))
        all_taken = np.concatenate((taken + effect.taken[start - 1], taken[step] + effect.taken[cut]))
        order = np.argsort(all_lows, kind="stable")
        lows, taken = _merged(all_lows[order], all_taken[order])
    return Effect(first.track, after, first.limit, lows, taken)


def compose_packed(effects: Sequence[bytes]) -> bytes:
    return compose([Effect.unpack(e) for e in effects]).pack()


def act_packed(effect: bytes, stock: int) -> int:
    return Effect.unpack(effect).act(stock)
