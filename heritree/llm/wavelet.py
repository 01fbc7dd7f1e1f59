"""A wavelet matrix over token ids: the file format of a shard.

A shard's ids are renumbered by their rank among the ids that occur in it, so that the number of bit-planes follows the
shard's own alphabet. Plane k holds, for the symbols in the order that the planes above have left, their k-th highest
bit; after a plane, the symbols with a 0 go before those with a 1, in unchanged order. Ranks are kept for every 512
bits. One file answers access(i), rank(id, i), count(id) and select(id, k) without unpacking the rest.

Layout, little-endian: magic, n (u64), alphabet (u32), planes (u32), documents (u64); alphabet ids (u32 each); ends of the
documents (u64 each); document ids (i64 each) and their presence (u8 each); for each plane the number of zeros (u64), ranks (u32 for each 512 bits)
and the bits, padded to whole bytes. Limit: 2**32 - 1 tokens in a shard.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, BLOCK = b"WMX1", 512
_HEAD = struct.Struct("<4sQIIQ")


def build(tokens: np.ndarray, ends: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """The file of one shard. tokens: all ids; ends: where each document's tokens end."""
    n = len(tokens)
    ids = np.flatnonzero(np.bincount(tokens)) if n else np.empty(0, np.int64)
    table = np.zeros(int(ids[-1]) + 1 if len(ids) else 1, np.uint32)
    table[ids] = np.arange(len(ids))
    width = np.uint16 if len(ids) <= 1 << 16 else np.uint32
    symbols = table.astype(width)[tokens]
    planes = max(1, (len(ids) - 1).bit_length())
    out = [_HEAD.pack(MAGIC, n, len(ids), planes, len(ends)), ids.astype("<u4").tobytes(), np.asarray(ends, "<u8").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes()]
    for k in range(planes - 1, -1, -1):
        ones = (symbols >> width(k)) & width(1) != 0
        bits = np.packbits(ones, bitorder="little")
        low, high = _places(ones)
        ranks = np.zeros(n // BLOCK + 1, np.int64)
        if n >= BLOCK:
            np.cumsum(np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), BLOCK // 8), dtype=np.int64)[: n // BLOCK], out=ranks[1:])
        out += [struct.pack("<Q", len(low)), ranks.astype("<u4").tobytes(), bits.tobytes()]
        symbols = np.concatenate([symbols.take(low), symbols.take(high)])
    return b"".join(out)


def _places(ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the zeros and the ones are: taking by places is several times faster than by masks, whose bits are like random ones."""
    return np.flatnonzero(~ones), np.flatnonzero(ones)


class WaveletMatrix:
    """Reads one file."""

    def __init__(self, data: bytes) -> None:
        magic, self.n, n_ids, n_planes, n_docs = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.ids, self.ends, ids, there = take("<u4", n_ids), take("<u8", n_docs).astype(np.int64), take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [int(d) if t else None for d, t in zip(ids, there)]
        self.planes = [(int(take("<u8", 1)[0]), take("<u4", self.n // BLOCK + 1), take("u1", (self.n + 7) // 8)) for _ in range(n_planes)]

    def _ones(self, plane: tuple, i: int) -> int:
        """Ones among the first i bits."""
        _, ranks, bits = plane
        b = i // BLOCK
        part = bits[b * BLOCK // 8 : (i + 7) // 8].copy()
        if i % 8:
            part[-1] &= (1 << i % 8) - 1
        return int(ranks[b]) + int(np.bitwise_count(part).sum(dtype=np.int64))

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        symbol = 0
        for p in self.planes:
            bit = int(p[2][i // 8]) >> i % 8 & 1
            ones = self._ones(p, i)
            i = p[0] + ones if bit else i - ones
            symbol = symbol << 1 | bit
        return int(self.ids[symbol])

    def _symbol(self, token: int) -> int | None:
        k = int(np.searchsorted(self.ids, token))
        return k if k < len(self.ids) and self.ids[k] == token else None

    def _interval(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the symbol's run starts after the last plane, and where its occurrences among the first i end."""
        low = 0
        for k, p in enumerate(self.planes):
            bit = symbol >> (len(self.planes) - 1 - k) & 1
            a, b = self._ones(p, low), self._ones(p, i)
            low, i = (p[0] + a, p[0] + b) if bit else (low - a, i - b)
        return low, i

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token among the first i."""
        symbol = self._symbol(token)
        if symbol is None:
            return 0
        low, high = self._interval(symbol, min(i, self.n))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the token's k-th occurrence, from 0."""
        symbol = self._symbol(token)
        if symbol is None or not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._interval(symbol, 0)[0] + k
        for j, p in enumerate(reversed(self.planes)):
            bit = symbol >> j & 1
            at = self._nth(p, at - p[0] if bit else at, bit)
        return at

    def _nth(self, plane: tuple, k: int, bit: int) -> int:
        """The place of the k-th bit of that value."""
        _, ranks, bits = plane
        starts = ranks.astype(np.int64)
        if not bit:
            starts = np.arange(len(starts)) * BLOCK - starts
        b = int(np.searchsorted(starts, k, "right")) - 1
        part = np.unpackbits(bits[b * BLOCK // 8 : (b + 1) * BLOCK // 8], bitorder="little")[: self.n - b * BLOCK]
        return b * BLOCK + int(np.flatnonzero(part == bit)[k - int(starts[b])])

    def tokens(self) -> np.ndarray:
        """All ids in order, by putting the planes' orders back from the last to the first."""
        width = np.uint16 if len(self.planes) <= 16 else np.uint32
        symbols = np.zeros(self.n, width)
        for k, (zeros, _, bits) in enumerate(reversed(self.planes)):
            ones = np.unpackbits(bits, count=self.n, bitorder="little").view(bool)
            before = np.empty_like(symbols)
            low, high = _places(ones)
            before[low] = symbols[:zeros]
            before[high] = symbols[zeros:] | width(1 << k)
            symbols = before
        return self.ids[symbols]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return np.array([self.access(i) for i in range(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))], np.uint32)
