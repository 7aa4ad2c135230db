"""Vectorised work on the UTF-8 bytes of many texts at once: words, hashes of words and of n-grams.

Word classes that treat all non-ASCII characters alike can be told byte by byte, as every byte of such a character
is 0x80 or above. Hashes are polynomials modulo 2**64 from prefix sums, followed by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Text bytes worked on at once (a longer text is worked on alone): bounds the temporary arrays.
CHUNK = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Runs of ASCII letters and digits and of all characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Everything but ASCII white space.
SOLID = np.ones(256, bool)
SOLID[9:14] = SOLID[32] = False

_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64 for i below n."""
    if n > len(_powers.get("up", ())):
        size = max(n, CHUNK + 1)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, U)
            out[0] = 1
            _powers[key] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(29)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(32)
    return x


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, U)
    up, _ = powers(len(buf))
    np.cumsum((buf.astype(U) + U(1)) * up, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of the buffer: equal bytes, equal hash, wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(_STEP))


class Words:
    """The words of texts that stand in one buffer: start and end byte, number of the text, hash; count for each text."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, inside: np.ndarray, lower: bool = True):
        n = len(buf)
        mask = inside[buf]
        prev, nxt = np.zeros(n, bool), np.zeros(n, bool)
        prev[1:], nxt[:-1] = mask[:-1], mask[1:]
        full = off[1:] > off[:-1]
        prev[off[:-1][full]] = False
        nxt[off[1:][full] - 1] = False
        self.start, self.end = np.flatnonzero(mask & ~prev), np.flatnonzero(mask & ~nxt) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(off) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.hash = span_hash(prefix_sums(LOWER[buf] if lower else buf), self.start, self.end)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of k words in one text."""
        if len(self.hash) < k:
            return np.zeros(0, np.int64), np.zeros(0, U)
        n = len(self.hash) - k + 1
        acc = np.zeros(n, U)
        for j in range(k):
            acc *= U(_STEP)
            acc += self.hash[j : j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, mix(acc[at] + U(k))

    def run_hash(self, first: np.ndarray, last: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hash of the words first..last-1 of each run, whatever stands between them. Another salt, another hash."""
        up, down = powers(len(self.hash) + 1)
        sums = np.zeros(len(self.hash) + 1, U)
        own = mix(self.hash ^ U(salt)) if salt else self.hash
        np.cumsum(own * up[: len(own)], out=sums[1:])
        return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(U))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    out = batch.column(batch.schema.get_field_index(name))
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of groups of whole texts of about limit bytes. Null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    off = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
