"""Words, hashes and shingles of a text, as numpy arrays; used inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
     0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9],
    dtype=np.uint64,
)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _S30)) * _ODD[7]
    x = (x ^ (x >> _S27)) * _ODD[6]
    return x ^ (x >> _S31)


class WordHashes(dict):
    """64-bit hashes of words, as eight bytes; forgets them all when there are too many."""

    def __init__(self, most: int = 200_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_digest(word)[::-1]
        return value


def ascii_words(text: str | None) -> list[bytes]:
    """A-Z in lower case; words are what stands between space and the characters 09 to 0D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashed(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.frombuffer(b"".join(map(hashes.__getitem__, words)), "<u8").astype(np.uint64, copy=False)


# The algorithm's constants (XXH3, seed 0): its secret's words, folded as inputs of 1-3, 4-8 and 9-16 bytes use them.
_SECRET = np.frombuffer(
    bytes.fromhex(
        "b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671f"
        "cb79e64eccc0e578825ad07dccff7221b8084674f743248ee03590e6813a264c"
    ),
    "<u8",
).astype(np.uint64)
_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _xxh3(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``xxh3_64`` of the words of ``raw`` from ``start`` to ``end``; eight bytes must follow the last."""
    u = np.uint64
    size = end - start
    out = np.empty(len(start), u)
    flat = np.frombuffer(raw, np.uint8)
    eights = np.lib.stride_tricks.sliding_window_view(flat, 8)

    def eight(at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(eights[at]).view("<u8").ravel().astype(u, copy=False)

    at = np.flatnonzero(size <= 3)
    if len(at):
        a, n = start[at], size[at]
        first, middle, last = (flat[i].astype(u) for i in (a, a + (n >> 1), end[at] - 1))
        h = (first << u(16)) | (middle << u(24)) | last | (n.astype(u) << u(8))
        h ^= (_SECRET[0] & u(0xFFFFFFFF)) ^ (_SECRET[0] >> u(32))
        h = (h ^ (h >> u(33))) * u(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> u(29))) * u(0x165667B19E3779F9)
        out[at] = h ^ (h >> u(32))
    at = np.flatnonzero((size > 3) & (size <= 8))
    if len(at):
        low = u(0xFFFFFFFF)
        h = (eight(end[at] - 4) & low) + (eight(start[at]) << u(32))
        h ^= _SECRET[1] ^ _SECRET[2]
        h ^= ((h << u(49)) | (h >> u(15))) ^ ((h << u(24)) | (h >> u(40)))
        h *= u(0x9FB21C651E98DF25)
        h ^= (h >> u(35)) + size[at].astype(u)
        h *= u(0x9FB21C651E98DF25)
        out[at] = h ^ (h >> u(28))
    at = np.flatnonzero((size > 8) & (size <= 16))
    if len(at):
        a = eight(start[at]) ^ (_SECRET[3] ^ _SECRET[4])
        b = eight(end[at] - 8) ^ (_SECRET[5] ^ _SECRET[6])
        low = u(0xFFFFFFFF)
        a_low, a_high, b_low, b_high = a & low, a >> u(32), b & low, b >> u(32)
        side = a_high * b_low
        cross = ((a_low * b_low) >> u(32)) + (side & low) + a_low * b_high
        folded = (a * b) ^ ((side >> u(32)) + (cross >> u(32)) + a_high * b_high)
        h = size[at].astype(u) + a.byteswap() + b + folded
        h = (h ^ (h >> u(37))) * u(0x165667919E3779F9)
        out[at] = h ^ (h >> u(32))
    for i in np.flatnonzero(size > 16).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return out


def hashed_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that ``hashed`` gives of the ``ascii_words`` of all texts, and how many each text has."""
    raws = [text.encode("utf-8", "surrogatepass").lower() for text in texts]
    # Eight spaces at the end, so that eight bytes can be read from any word's start.
    raw = b" ".join([*raws, b"        "])
    space = np.concatenate(([True], _SPACES[np.frombuffer(raw, np.uint8)]))
    at = np.flatnonzero(space[1:] != space[:-1])
    start, end = at[::2], at[1::2]
    begins = np.cumsum([0, *(len(x) + 1 for x in raws)])
    return _xxh3(raw, start, end), np.diff(np.searchsorted(start, begins))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive values; empty if there are fewer."""
    count = len(h) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = mix(out + h[i : i + count] * _ODD[i & 7])
    return out


def shingle_set(words: list[bytes], n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; fewer words are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(rolling(hashed(words, hashes), n))
