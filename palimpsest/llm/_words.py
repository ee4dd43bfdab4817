"""Words and their hashes over whole batches of texts, in numpy."""

from __future__ import annotations

import numpy as np

_PIECE = 1 << 19  # bytes hashed at a time, so that the arrays stay in cache
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for n places."""
    if len(_powers.get("up", ())) < n:
        size = max(n, _PIECE + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base & 0xFFFFFFFFFFFFFFFF))
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def split_words(text: str | None, table: bytes | None = None) -> list[bytes]:
    """The maximal runs of bytes other than x20 and x09 to x0D; null and empty texts have none.

    ``table`` maps each byte before the split, to fold case or to part words at punctuation.
    """
    return text.encode("utf-8", "surrogatepass").translate(table).split() if text else []


#: Byte tables: A-Z to a-z; and with it, ASCII punctuation to spaces.
LOWER = bytes(range(256)).lower()
PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)


class Batch:
    """The words of many texts: their bounds in one buffer, and the text each belongs to."""

    def __init__(self, texts: list[str | None], table: bytes | None = None):
        docs = [b" ".join(split_words(t, table)) for t in texts]
        self.blob = b" ".join(d for d in docs if d) + b" "
        self.buf = np.frombuffer(self.blob, np.uint8)
        self.ends = np.flatnonzero(self.buf == 32) if len(self.blob) > 1 else np.zeros(0, np.int64)
        self.starts = np.concatenate(([0], self.ends[:-1] + 1)) if len(self.ends) else self.ends
        counts = np.fromiter((d.count(b" ") + 1 if d else 0 for d in docs), np.int64, len(docs))
        self.offsets = np.concatenate(([0], np.cumsum(counts)))  # of each text's words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def words(self, i: int) -> list[bytes]:
        lo, hi = self.offsets[i], self.offsets[i + 1]
        return self.blob[self.starts[lo] : self.ends[hi - 1]].split(b" ") if hi > lo else []

    def hashes(self, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
        """64-bit hashes of the words and, for each given length, of their first bytes."""
        n = len(self.ends)
        out = [np.empty(n, np.uint64) for _ in range(1 + len(prefixes))]
        at = 0
        while at < n:
            lo = self.starts[at]
            upto = max(at + 1, int(np.searchsorted(self.ends, lo + _PIECE, "right")))
            s, e = self.starts[at:upto] - lo, self.ends[at:upto] - lo
            up, down = _power_table(int(e[-1]) + 1)
            sums = np.zeros(int(e[-1]) + 1, np.uint64)
            np.cumsum(_BYTE[self.buf[lo : lo + e[-1]]] * up[: e[-1]], out=sums[1:])
            for o, k in zip(out, (None, *prefixes), strict=True):
                stop = e if k is None else np.minimum(e, s + k)
                o[at:upto] = mix64((sums[stop] - sums[s]) * down[s])
            at = upto
        return out

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of each run of k words within one text, in order."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        acc = hashes[:n].copy()
        for j in range(1, k):
            acc = acc * np.uint64(_BASE) + hashes[j : j + n]
        left = np.repeat(self.offsets[1:], self.counts)[:n] - np.arange(n)  # words left in the text
        start = np.flatnonzero(left >= k)
        return start, mix64(acc[start] + np.uint64(k))

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text that each word position belongs to."""
        return np.searchsorted(self.offsets, at, "right") - 1


def pack_sorted(keys: np.ndarray, level: int = 1) -> bytes:
    """Ascending 64-bit integers as compressed byte planes of their differences."""
    import zstandard

    steps = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=level).compress(planes.tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def pack_planes(values: np.ndarray) -> bytes:
    """64-bit integers in any order as compressed byte planes."""
    import zstandard

    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_planes(blob: bytes, dtype: type = np.int64) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins in an ordered array."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
