"""Words of whole texts as arrays: byte spans and hashes, many documents at a time.

A word is a run of bytes other than space and 0x09-0x0D. All work is on arrays over a slice of a
batch, so no Python loop runs per word, and a slice holds half a MB of text (its arrays: some 30 MB), or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Lane:
    """One 64-bit hash function of byte and word sequences: polynomials over the odd numbers mod 2**64."""

    def __init__(self, seed: int, fold_case: bool = False):
        base = _U((seed * 0x9E3779B97F4A7C15) % 2**64)
        self.table = mix(np.arange(256, dtype=_U) + base)
        if fold_case:
            self.table[65:91] = self.table[97:123]
        self.odd = [int(v) | 5 for v in mix(np.array([seed * 4 + 1, seed * 4 + 2], dtype=_U))]
        self.powers = [(np.ones(1, _U), np.ones(1, _U)) for _ in self.odd]

    def _powers(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.powers[which]
        if len(up) < n:
            p = self.odd[which]
            q = pow(p, -1, 2**64)
            n = max(n, 2 * len(up))
            up, down = np.full(n, p, dtype=_U), np.full(n, q, dtype=_U)
            up[0] = down[0] = 1
            up, down = np.cumprod(up), np.cumprod(down)
            if n <= SLICE_BYTES * 2:
                self.powers[which] = (up, down)
        return up, down

    def _prefix(self, values: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self._powers(which, len(values) + 1)
        sums = np.empty(len(values) + 1, dtype=_U)
        sums[0] = 0
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return sums, down

    def of_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums, down = self._prefix(self.table[data], 0)
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))

    def runs(self, words: np.ndarray) -> "Runs":
        return Runs(*self._prefix(words, 1))


class Runs:
    """Hashes of any runs of words, from prefix sums."""

    def __init__(self, sums: np.ndarray, down: np.ndarray):
        self.sums, self.down = sums, down

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(_U))


class Slice:
    """Consecutive documents of a batch: bytes, word spans, and where each document's words begin."""

    def __init__(self, texts: pa.Array, first: int):
        self.first, self.n = first, len(texts)
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + self.n + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        full = ~_SPACE[self.data]
        size = len(self.data)
        inner = self.offsets[1:-1]
        before = np.empty(size, dtype=bool)
        after = np.empty(size, dtype=bool)
        if size:
            before[0] = after[-1] = False
            before[1:], after[:-1] = full[:-1], full[1:]
            before[inner[inner < size]] = False
            after[inner[inner > 0] - 1] = False
        self.starts = np.flatnonzero(full & ~before)
        self.ends = np.flatnonzero(full & ~after) + 1
        #: words of document d: from self.at[d] to self.at[d + 1]
        self.at = np.searchsorted(self.starts, self.offsets)

    def words_left(self) -> np.ndarray:
        """For each word, the number of words from it to the end of its document, itself included."""
        counts = np.diff(self.at)
        return np.repeat(self.at[1:], counts) - np.arange(len(self.starts))

    def words_of(self, d: int, keep: np.ndarray | None = None) -> list[bytes]:
        lo, hi = self.at[d], self.at[d + 1]
        raw = self.data[self.offsets[d] : self.offsets[d + 1]].tobytes().split()
        return raw if keep is None else [w for w, k in zip(raw, keep[lo:hi]) if k]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a column of texts into slices of about `most` bytes; a longer text is a slice of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield Slice(texts.slice(first, i - first), first)
            first, held = i, 0
        held += size + 1
    if first < len(texts):
        yield Slice(texts.slice(first), first)
