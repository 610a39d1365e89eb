"""Vectorised words and hashes over the UTF-8 buffers of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK, 1 << (n - 1).bit_length()) if n else CHUNK
    if size not in _tables:
        if len(_tables) > 1:
            _tables.clear()
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _tables[size] = (out[0], out[1])
    return _tables[size]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and bytes of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within them) of runs of rows of at most `most` bytes, a row at least."""
    offsets, data = buffers(column)
    at, rows = 0, len(column)
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, rows)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words and the row of each; words are parted by ASCII white space and ends of rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    space = SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z taken as a-z: a polynomial over random values of the bytes, then mixed."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def row_hashes(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each row's words in their order, and where its words begin and how many they are."""
    count = np.bincount(row, minlength=rows)
    first = np.append(0, np.cumsum(count))[:-1]
    place = (np.arange(len(h)) - first[row]).astype(np.uint64)
    total = np.append(np.uint64(0), np.cumsum(mix(h + place * np.uint64(_BASE))))
    return mix(total[first + count] - total[first] + count.astype(np.uint64)), first, count


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n items of h, by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    done, part, power = 1, h.astype(np.uint64), _BASE
    out, used = None, 0
    while True:
        if n & done:
            if out is None:
                out, used = part, done
            else:
                size = len(h) - used - done + 1
                out = out[:size] * np.uint64(power) + part[used : used + size]
                used += done
        if used == n:
            return mix(out[: len(h) - n + 1])
        size = len(part) - done
        part = part[:size] * np.uint64(power) + part[done:]
        power, done = power * power & (1 << 64) - 1, done * 2


def sliding(a: np.ndarray, n: int, f=np.minimum) -> np.ndarray:
    """f over each run of n items, by doubling."""
    if len(a) < n:
        return a[:0]
    done, out = 1, a
    while done < n:
        step = min(done, n - done)
        out = f(out[: len(out) - step], out[step:])
        done += step
    return out


def codepoints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the offsets counted in them."""
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), before[offsets]
