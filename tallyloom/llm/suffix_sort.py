"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

import numpy as np

SHALLOW_WORDS = 2  # eight bytes each
_SMALL = 8


def padded(strings: list[bytes], width: int) -> np.ndarray:
    """One string per row, filled up with zeros."""
    return np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), np.uint8).reshape(len(strings), width)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes], members: list[int]) -> list[int]:
    """``members`` in the order of their strings; equal strings keep their order.

    Inner nodes hold the depth at which their strings part and a child per byte there
    (-1 where a string ends). A string goes down by those bytes alone, is compared once
    with the leaf it meets, and splits the path where it differs.
    """
    root = None  # an inner node is (depth, children), a leaf the list of equal strings
    for i in members:
        s = strings[i]
        if root is None:
            root = [i]
            continue
        node, path = root, []
        while isinstance(node, tuple):
            depth, children = node
            path.append(node)
            byte = s[depth] if depth < len(s) else -1
            node = children.get(byte)
            if node is None:
                node = next(iter(children.values()))
                while isinstance(node, tuple):
                    node = next(iter(node[1].values()))
        t = strings[node[0]]
        same = _common(s, t)
        if same == len(s) == len(t):
            node.append(i)
            continue
        above = None
        for step in path:
            if step[0] > same:
                break
            above = step
        own = s[same] if same < len(s) else -1
        if above is not None and above[0] == same:
            above[1][own] = [i]
            continue
        # The subtree that hangs at this place goes one level down.
        if above is None:
            below = root
        else:
            key = s[above[0]] if above[0] < len(s) else -1
            below = above[1][key]
        other = t[same] if same < len(t) else -1
        fresh = (same, {other: below, own: [i]})
        if above is None:
            root = fresh
        else:
            above[1][key] = fresh
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
        else:
            out += node
    return out


def deep_shallow_order(strings: list[bytes], matrix: np.ndarray) -> np.ndarray:
    """Positions of the strings in ascending order. ``matrix``: the strings, padded."""
    n = len(strings)
    if n < 2:
        return np.arange(n)
    width = 8 * SHALLOW_WORDS
    head = np.zeros((n, width), np.uint8)
    head[:, : min(width, matrix.shape[1])] = matrix[:, :width]
    words = head.view(">u8").astype(np.uint64)
    order = np.empty(n, np.int64)
    stack = [(np.arange(n), 0, 0)]
    while stack:
        part, at, depth = stack.pop()
        if len(part) == 1:
            order[at] = part[0]
        elif len(part) <= _SMALL or depth == SHALLOW_WORDS:
            order[at : at + len(part)] = blind_trie_order(strings, part.tolist())
        else:
            word = words[part, depth]
            pivot = np.sort(word[:: max(1, len(word) // 9)])
            pivot = pivot[len(pivot) // 2]
            less, more = word < pivot, word > pivot
            low, high = part[less], part[more]
            equal = part[~(less | more)]
            if len(low):
                stack.append((low, at, depth))
            stack.append((equal, at + len(low), depth + 1))
            if len(high):
                stack.append((high, at + len(low) + len(equal), depth))
    return order


def neighbours_common(matrix: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each string in order with the one before; zero for the first."""
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 65536):
        a, b = order[at - 1 : at + 65535][: len(order[at : at + 65536])], order[at : at + 65536]
        differ = matrix[a] != matrix[b]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
        out[at : at + 65536] = np.minimum(first, np.minimum(lengths[a], lengths[b]))
    return out
