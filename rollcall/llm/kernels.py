"""Vectorised text kernels used inside Arrow batches.

All work on the UTF-8 bytes of a whole group of texts at once, so that no Python
object is made for a word. Word hashes are polynomials modulo 2**64 over a random
byte table: equal words have equal hashes; two different words of a corpus meet
with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = U64(pow(int(_BASE), -1, 2**64))
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters and digits; every byte of a letter outside ASCII counts as one.
LETTER = np.zeros(256, bool)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
#: Bytes of text treated at once; one longer text is treated alone.
GROUP_BYTES = 1 << 19
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def groups(column: pa.Array, limit: int = GROUP_BYTES):
    """Yield (first row, bytes, offsets) of runs of texts of about ``limit`` bytes.
    Null texts count as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    raw = column.buffers()
    ends = np.frombuffer(raw[1], np.int64, n + 1 + column.offset)[column.offset:]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(ends, ends[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), n)
        yield row, data[ends[row]: ends[stop]], (ends[row: stop + 1] - ends[row]).astype(np.int64)
        row = stop


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte run [start, end)."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def word_bounds(data: np.ndarray, offsets: np.ndarray, part: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that ``part`` marks), and the number
    of words before each text (and after the last)."""
    inside = part[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words before each text."""
    if lower:
        data = _LOWER[data]
    starts, ends, counts = word_bounds(data, offsets)
    return run_hashes(data, starts, ends), counts


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on (the last n - 1 positions are
    left out)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    out = np.zeros(m, U64)
    for i in range(n):
        out *= _BASE
        out += words[i: i + m]
        out ^= out >> U64(32)
    return mix(out)


def sets_of_grams(words: np.ndarray, counts: np.ndarray, n: int):
    """Yield for each text its sorted distinct gram hashes. With fewer than ``n``
    words the whole sequence is the only gram; without words there is none."""
    grams = gram_hashes(words, n)
    for a, b in zip(counts[:-1], counts[1:]):
        if b - a >= n:
            yield np.unique(grams[a: b - n + 1])
        elif b > a:
            yield gram_hashes(words[a:b], int(b - a))
        else:
            yield np.empty(0, U64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours."""
    out = x[: len(x) - w + 1].copy()
    for i in range(1, w):
        np.minimum(out, x[i: i + len(out)], out=out)
    return out


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    out = x[: len(x) - w + 1].copy()
    for i in range(1, w):
        np.maximum(out, x[i: i + len(out)], out=out)
    return out
