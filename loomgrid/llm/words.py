"""Word and shingle hashes of whole Arrow columns, without a loop over rows or words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, U)
        out[:1] = 1
        return np.multiply.accumulate(out)


class WordHasher:
    """Splits texts into words and hashes them to 64 bits; A-Z count as a-z.

    ``letters``: words are runs of 0-9, a-z and all that isn't ASCII; else runs of anything but
    ASCII blanks.  Both are classes of bytes in UTF-8, so bytes are all that is looked at.
    """

    def __init__(self, letters: bool) -> None:
        byte = np.arange(256)
        lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        if letters:
            self.inside = (byte >= 128) | ((lower >= 97) & (lower <= 122)) | ((byte >= 48) & (byte <= 57))
        else:
            self.inside = ~((byte == 32) | ((byte >= 9) & (byte <= 13)))
        self.value = mix(lower.astype(U) + U(0x1234567))
        self.value[~self.inside] = 0
        self.up = self.down = np.zeros(0, U)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.column(pa.array(texts, pa.large_binary()))

    def column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all words, the row of each, and the number of words of each row; nulls have none."""
        n = len(col)
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
        wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
        offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        data = col.buffers()[2] if n else None
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if not len(raw):
            return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(n, np.int64)
        if len(self.up) <= len(raw):
            self.up, self.down = _powers(_PRIME, len(raw) + 1), _powers(_INVERSE, len(raw) + 1)
        inside = self.inside[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[offsets] = True
        before = np.empty(len(raw), bool)
        before[0], before[1:] = False, inside[:-1]
        starts = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.empty(len(raw), bool)
        after[-1], after[:-1] = False, inside[1:]
        ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        with np.errstate(over="ignore"):
            total = np.empty(len(raw) + 1, U)
            total[0] = 0
            np.cumsum(self.value[raw] * self.up[: len(raw)], out=total[1:])
            h = (total[ends] - total[starts]) * self.down[starts]
            h = mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))
        of = np.searchsorted(offsets, starts, "right") - 1
        return h, of, np.bincount(of, minlength=n)


def shingles(h: np.ndarray, of: np.ndarray, n: int, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a row, the row of each, and its first word's place.

    ``short``: a row with fewer words, but one at least, gives its whole sequence as one run.
    """
    counts = np.bincount(of, minlength=n) if len(of) else np.zeros(n, np.int64)
    begins = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        m = len(h) - k + 1
        if m > 0:
            at = np.flatnonzero(of[:m] == of[k - 1 :])
            g = np.zeros(m, U)
            for j in range(k):
                g = g * U(_PRIME) + h[j : j + m]
            g, row = mix(g[at]), of[at]
        else:
            at = np.zeros(0, np.int64)
            g, row = np.zeros(0, U), np.zeros(0, np.int64)
        pos = at - begins[row] if len(at) else at
        if short:
            few = np.flatnonzero((counts > 0) & (counts < k))
            if len(few):
                extra = []
                for r in few:
                    x = U(int(counts[r]))
                    for w in h[begins[r] : begins[r] + counts[r]]:
                        x = x * U(_PRIME) + w
                    extra.append(x)
                g = np.concatenate([g, mix(np.array(extra, U) ^ U(0xA5A5A5A5A5A5A5A5))])
                row = np.concatenate([row, few])
                pos = np.concatenate([pos, np.zeros(len(few), np.int64)])
    return g, row, pos
