"""Simple-8b: whole numbers in 64-bit words, as many to a word as its selector says.

A word's four highest bits are its selector, the other sixty hold a fixed count of numbers
of a fixed width, or a run of zeros. A number that sixty bits cannot hold is an escape: the
word holds its place in a table of plain 64-bit numbers. Numbers are coded in blocks that
start at a word of their own, and the words before each block are listed, so any range of
blocks can be decoded by itself, all words of a kind at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Fixed values of the code: numbers to a word and bits to a number, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 240, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 0])
ZEROS, ESCAPE = 14, 15

BLOCK = 1024
_LONGEST = int(COUNTS.max())
_SELECTOR = np.uint64(60)
_PAYLOAD = np.uint64((1 << 60) - 1)


@dataclass(frozen=True)
class Packed:
    """Words of some blocks, the words before each block and after the last, and the escaped numbers."""

    words: np.ndarray
    offsets: np.ndarray
    escapes: np.ndarray


def pack(values: np.ndarray, block: int = BLOCK, first_escape: int = 0) -> Packed:
    """Codes ``values`` (any array of unsigned 64-bit numbers) block by block.

    ``first_escape`` is the number of escapes coded before, in the same table.
    """
    values = np.ascontiguousarray(values, np.uint64)
    if not len(values):
        return Packed(np.zeros(0, np.uint64), np.zeros(1, np.uint64), np.zeros(0, np.uint64))
    blocks = -(-len(values) // block)
    grid = np.zeros((blocks, block + _LONGEST), np.uint64)
    flat = np.zeros(blocks * block, np.uint64)
    flat[: len(values)] = values
    grid[:, :block] = flat.reshape(blocks, block)
    size = np.full(blocks, block)
    size[-1] = len(values) - (blocks - 1) * block

    selectors = _selectors(grid, block)
    steps, at = [], np.zeros(blocks, np.int64)
    rows = np.arange(blocks)
    while len(rows):
        now = selectors[rows, at[rows]]
        steps.append((rows, at[rows], now))
        at[rows] += COUNTS[now]
        rows = rows[at[rows] < size[rows]]
    row, column, selector = (np.concatenate(part) for part in zip(*steps))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=blocks))))
    # The k-th step took the k-th word of each block that was not done.
    place = offsets[row] + np.repeat(np.arange(len(steps)), [len(rows) for rows, _, _ in steps])

    start = row * grid.shape[1] + column
    cells = grid.ravel()
    words = np.empty(len(place), np.uint64)
    escapes = np.zeros(0, np.uint64)
    for kind in np.unique(selector):
        of_kind = np.flatnonzero(selector == kind)
        held = np.full(len(of_kind), int(kind) << 60, np.uint64)
        if kind == ESCAPE:
            of_kind = of_kind[np.argsort(place[of_kind])]
            escapes = cells[start[of_kind]]
            held |= np.arange(first_escape, first_escape + len(of_kind), dtype=np.uint64)
        elif kind != ZEROS:
            for next_ in range(COUNTS[kind]):
                held |= cells[start[of_kind] + next_] << np.uint64(next_ * WIDTHS[kind])
        words[place[of_kind]] = held
    return Packed(words, offsets.astype(np.uint64), escapes)


def _selectors(grid: np.ndarray, block: int) -> np.ndarray:
    """For each place, the selector that takes most numbers from there on; beyond a block's end are zeros."""
    bits = _bit_lengths(grid)
    out = np.full((len(grid), block), ESCAPE, np.int8)
    for kind in sorted(range(ESCAPE), key=COUNTS.__getitem__):
        fits = _all_of_next(bits <= WIDTHS[kind], int(COUNTS[kind]))
        np.copyto(out, np.int8(kind), where=fits[:, :block])
    return out


def _all_of_next(holds: np.ndarray, count: int) -> np.ndarray:
    """Where ``holds`` is true ``count`` times in a row, from each place on; windows are doubled."""
    have = 1
    while have < count:
        step = min(have, count - have)
        holds = holds[:, :-step] & holds[:, step:]
        have += step
    return holds


_OF_16_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bit_lengths(numbers: np.ndarray) -> np.ndarray:
    if not (numbers >> np.uint64(16)).any():
        return _OF_16_BITS[numbers]
    exact = np.frexp(numbers.astype(np.float64))[1].astype(np.uint8)
    large = numbers >> np.uint64(53) != 0  # a double may round these up
    exact[large] = np.frexp((numbers[large] >> np.uint64(11)).astype(np.float64))[1] + 11
    return exact


def unpack(packed: Packed, length: int, block: int = BLOCK) -> np.ndarray:
    """The first ``length`` numbers of consecutive blocks; ``escapes`` is the whole table."""
    offsets = packed.offsets.astype(np.int64) - int(packed.offsets[0])
    blocks = len(offsets) - 1
    selector = (packed.words >> _SELECTOR).astype(np.int64)
    counts = COUNTS[selector]
    row = np.repeat(np.arange(blocks), np.diff(offsets))
    before = np.cumsum(counts) - counts
    width = block + _LONGEST
    start = before - before[offsets[:-1]][row] + row * width if blocks else before
    cells = np.zeros(blocks * width, np.uint64)
    for kind in np.unique(selector):
        of_kind = np.flatnonzero(selector == kind)
        held = packed.words[of_kind] & _PAYLOAD
        if kind == ESCAPE:
            cells[start[of_kind]] = packed.escapes[held.astype(np.int64)]
        elif kind != ZEROS:
            mask = np.uint64((1 << int(WIDTHS[kind])) - 1)
            for place in range(COUNTS[kind]):
                cells[start[of_kind] + place] = (held >> np.uint64(place * WIDTHS[kind])) & mask
    return cells.reshape(blocks, width)[:, :block].reshape(-1)[:length]
