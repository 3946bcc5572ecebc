"""Words of many documents as numpy arrays: boundaries, 64-bit word hashes and rolling window hashes.

One grid holds a bounded number of bytes (documents are packed until ``CHUNK`` bytes; a longer document is a grid of
its own), so memory in a task follows CHUNK or the longest single text, not the partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
#: Two primes below 2**31 and a base for each hash words (a product of two residues fits 62 bits); a hash modulo a power
#: of two would give certain pairs of words one value, whatever its base.
PRIMES = ((2_147_483_629, 1_103_515_249), (2_147_483_587, 1_736_731_266))
#: Fixed odd multiplier of the rolling hash over word hashes; both sides of every comparison use the same one.
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
M64 = (1 << 64) - 1

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
#: Words of [^\x20\x09-\x0D]+ and of letters, digits and everything beyond ASCII.
NOT_SPACE = ~WHITE
ALNUM = np.zeros(256, bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_a : _b + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[tuple[int, int], np.ndarray] = {}


def room(n: int) -> int:
    """Entries of a table of powers where n are asked for: an eighth more, so that growing texts seldom make it anew and a
    process that sees only short ones (the driver, a benchmark) holds little."""
    return n + n // 8


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i below n."""
    have = _powers.get((base, 0))
    if have is None or len(have) < n:
        grown = np.full(room(n), base, np.uint64)
        grown[0] = 1
        _powers[base, 0] = have = np.cumprod(grown, dtype=np.uint64)
    return have[:n]


def residues(base: int, n: int, prime: int) -> np.ndarray:
    """base ** i modulo prime for i below n."""
    have = _powers.get((base, prime))
    if have is None or len(have) < n:
        grown, known = np.ones(room(n), np.int64), 1
        while known < len(grown):
            more = grown[known : 2 * known]
            np.multiply(grown[: len(more)], pow(base, known, prime), out=more)
            more %= prime
            known += len(more)
        _powers[base, prime] = have = grown
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value over all bits (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[start:end] (uint64), equal for equal ranges wherever they lie."""
    up = powers(base, len(values) + 1)
    down = powers(pow(base, -1, 1 << 64), len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words buf[start:end], equal for equal words wherever they lie: two polynomials of the bytes
    and the length, mixed."""
    out = (ends - starts).astype(np.uint64)
    total = np.zeros(len(buf) + 1, np.int64)
    for prime, base in PRIMES:
        term = (buf.astype(np.int64) + 1) * residues(base, len(buf), prime)  # below 2**39: sums of 2**24 fit
        if len(buf) < 1 << 24:
            np.cumsum(term, out=total[1:])
        else:
            carry = 0
            for at in range(0, len(buf), 1 << 24):
                part = np.cumsum(term[at : at + (1 << 24)]) + carry
                carry = int(part[-1] % prime)
                total[at + 1 : at + 1 + len(part)] = part
                total[at + len(part)] = carry
        down = residues(pow(base, -1, prime), len(buf) + 1, prime)
        value = (total[ends] - total[starts]) % prime * down[starts] % prime
        out = mix(out * np.uint64(WORD_BASE) + value.astype(np.uint64))
    return out


class Grid:
    """``buf`` bytes of the texts, each closed by a line feed; word i is buf[starts[i]:ends[i]]; document d owns words
    first[d] to first[d + 1] and begins at byte ``at[d]``."""

    def __init__(self, texts: list[bytes], word: np.ndarray, fold: np.ndarray | None) -> None:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.buf = raw if fold is None else fold[raw]
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[1:] = word[raw]
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.at[1:])
        self.first = np.searchsorted(self.starts, self.at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.left = self.first[1:][self.doc] - np.arange(len(self.starts))  # words from here to the document's end
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = word_hashes(self.buf, self.starts, self.ends)
        return self._hashes

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every n-word window that stays within its document."""
        at = np.flatnonzero(self.left >= n)
        return at, range_hashes(self.hashes, at, at + n, WORD_BASE)

    def words(self, start: int, end: int) -> bytes:
        """Words start to end, joined by one space."""
        return b" ".join(self.buf[a:b].tobytes() for a, b in zip(self.starts[start:end], self.ends[start:end], strict=True))


def grids(rows: Iterable[tuple[list, list[bytes | None]]], word: np.ndarray, fold: np.ndarray | None = None) -> Iterator[tuple[list, Grid]]:
    """Pack (keys, texts) batches into grids of about CHUNK bytes; a null text counts as empty."""
    for keys, texts in rows:
        begin, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t or b"")
            if held >= CHUNK or i + 1 == len(texts):
                yield keys[begin : i + 1], Grid([t or b"" for t in texts[begin : i + 1]], word, fold)
                begin, held = i + 1, 0


def sliced(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about size bytes in a text or binary column (or one longer row), so that what a map makes of a batch
    stays small."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            before = int(ends[begin - 1]) if begin else 0
            end = min(max(int(np.searchsorted(ends, before + size)), begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end
