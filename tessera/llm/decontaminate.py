"""Benchmark decontamination: q-gram counts in diagonal bands, then banded alignment."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow_text import chunks, codepoints, gram_hashes
from tessera.llm.scratch import map_batches, saved, table

Q = 10
#: Edits that a passage may have, as a share of the item's normalised characters.
EDITS = 0.06
#: Normalised characters beyond which an item is matched in parts of equal length.
PART_CHARS = 1000
#: Pairs of hits and offsets that are counted at once.
BLOCK = 1 << 22
#: Normalised characters of the benchmark that one index may hold; a larger benchmark is indexed in several.
INDEX_CHARS = 4_000_000
SPACE, BETWEEN = 32, 0x110000
_BITS = 20
_fold: list[np.ndarray] = []
OUT = "doc_id long, item_id long, start long, end long, edits long"


def _table() -> np.ndarray:
    """Lower case of letters and digits among the first 65,536 code points, 0 for others."""
    if not _fold:
        out = np.zeros(1 << 16, np.uint32)
        for c in range(1 << 16):
            if unicodedata.category(chr(c))[0] in "LNM":
                low = chr(c).lower()
                out[c] = ord(low) if len(low) == 1 else c
        _fold.append(out)
    return _fold[0]


def normalise(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and digits with one space for each run of others, a mark before every row; and
    where each is among the code points."""
    low = np.where(cp < 1 << 16, _table()[np.minimum(cp, 0xFFFF)], cp)
    row = np.zeros(len(cp), bool)
    row[offsets[:-1][offsets[:-1] < len(cp)]] = True
    solid = low > 0
    before = np.ones(len(cp), bool)
    before[1:] = solid[:-1]
    keep = solid | before | row
    where = np.flatnonzero(keep)
    out = np.where(solid[where], low[where], SPACE).astype(np.uint32)
    marks = np.flatnonzero(row[where])
    return np.insert(out, marks, BETWEEN), np.insert(where, marks, where[marks])


@dataclass
class Index:
    """Items of a benchmark and where their q-grams are."""

    ids: list[int]
    items: list[np.ndarray]
    edits: np.ndarray
    least: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    seen: np.ndarray


def build(rows: list[tuple[int, str]], q: int = Q, share: float = EDITS) -> Index:
    """Items of fewer than q normalised characters take no part; one of over PART_CHARS is matched in parts. An item of m characters that occurs with k edits keeps
    at least m + 1 - q (k + 1) of its q-grams; k is share x m, less where that bound would be below 1."""
    ids, items, edits, least, hs, owner, place, cut = [], [], [], [], [], [], [], []
    for item_id, text in rows:
        a = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
        a = normalise(a, np.array([0, len(a)]))[0] if len(a) else a
        a = a[1:]
        a = a[(a != SPACE).argmax() :] if (a != SPACE).any() else a[:0]
        a = a[: len(a) - int(a[-1] == SPACE)] if len(a) else a
        parts = {p.tobytes(): p for p in np.array_split(a, max(1, -(-len(a) // PART_CHARS)))} if len(a) >= q else {}
        cut += [(item_id, p) for p in parts.values()]
    for item_id, a in cut:
        k = min(int(share * len(a)), len(a) // q - 1)
        h = gram_hashes(a, q)
        ids.append(item_id)
        items.append(a)
        edits.append(k)
        least.append(len(a) + 1 - q * (k + 1))
        hs.append(h)
        owner.append(np.full(len(h), len(ids) - 1))
        place.append(np.arange(len(h)))
    joined = (lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind))
    h, owner_, place_ = joined(hs, np.uint64), joined(owner, np.int64), joined(place, np.int64)
    order = np.argsort(h, kind="stable")
    unique, first = np.unique(h[order], return_index=True)
    seen = np.zeros(1 << _BITS, bool)
    seen[unique >> np.uint64(64 - _BITS)] = True
    return Index(ids, items, np.array(edits, np.int64), np.array(least, np.int64), unique, np.append(first, len(h)), owner_[order], place_[order], seen)


def bands(text: np.ndarray, index: Index, q: int = Q) -> list[tuple[int, int]]:
    """(item, first diagonal of a band) of the bands that hold as many q-gram hits as the item's edits leave.

    A hit lies on the diagonal of its position less its offset in the item. The hits of an occurrence with k edits are within k + 1
    diagonals; bands are twice as wide and overlap by half, so that one of them holds all."""
    h = gram_hashes(text, q)
    hit = np.flatnonzero(index.seen[h >> np.uint64(64 - _BITS)])
    if not len(hit) or not len(index.grams):
        return []
    at = np.minimum(np.searchsorted(index.grams, h[hit]), len(index.grams) - 1)
    same = index.grams[at] == h[hit]
    hit, at = hit[same], at[same]
    if not len(hit):
        return []
    n = index.first[at + 1] - index.first[at]
    total = np.append(0, np.cumsum(n))
    shift = int(max((len(x) for x in index.items), default=0)) + 1
    keys, counts, lo = [], [], 0
    while lo < len(hit):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + BLOCK, "right")) - 1)
        m = n[lo:hi]
        slot = np.repeat(index.first[at[lo:hi]] - (total[lo:hi] - total[lo]), m) + np.arange(m.sum())
        item, diagonal = index.item[slot], np.repeat(hit[lo:hi], m) - index.offset[slot]
        width = index.edits[item] + 1
        for half in (0, 1):
            band = (diagonal + shift + half * width) // (2 * width)
            key, count = np.unique((item << 1 | half) << 43 | band, return_counts=True)
            keys.append(key)
            counts.append(count)
        lo = hi
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(which, np.concatenate(counts))
    out = set()
    for x in key[count >= index.least[key >> 44]].tolist():
        i, half, b = x >> 44, x >> 43 & 1, x & ((1 << 43) - 1)
        w = int(index.edits[i]) + 1
        out.add((i, b * 2 * w - half * w - shift))
    return sorted(out)


def align(item: np.ndarray, region: np.ndarray, width: int) -> tuple[int, int]:
    """Least edits between the item and a part of the region that begins in its first `width` places, and that part's end.
    Cells are those with (place in region - place in item) in [0, width)."""
    step = np.arange(width)
    row = np.zeros(width, np.int64)
    pad = np.concatenate([region, np.full(max(0, len(item) + width - len(region)), BETWEEN + 1, np.uint32)])
    for i, c in enumerate(item):
        new = row + (pad[i : i + width] != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
    best = int(row.argmin())
    return int(row[best]), min(best + len(item), len(region))


def leaks(text: np.ndarray, index: Index, q: int = Q) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of the verified occurrences, positions in the normalised text; of overlapping
    ones of an item, the one of fewest edits. A band may hold the hits of several rows, but each row is aligned by itself."""
    found: dict[int, list] = {}
    marks = np.flatnonzero(text == BETWEEN)
    for i, diagonal in bands(text, index, q):
        item, k = index.items[i], int(index.edits[i])
        low, high = max(0, diagonal - k), min(len(text), max(0, diagonal + 2 * (k + 1) + k + len(item)))
        begins = diagonal + 2 * (k + 1) + k  # the last place at which an occurrence may begin
        inside = marks[np.searchsorted(marks, low) : np.searchsorted(marks, high)]
        for a, b in zip([low, *(inside + 1).tolist()], [*inside.tolist(), high], strict=True):
            width = begins - a + 1
            if width < 1 or b - a < len(item) - k:
                continue
            # k places that match nothing come first, so that an occurrence may begin where the row does and lack characters
            region = np.concatenate([np.full(k, BETWEEN, np.uint32), text[a:b]])
            edits, end = align(item, region, width + k)
            end -= k
            if edits > k or end < 1:
                continue
            part = np.concatenate([np.full(k, BETWEEN, np.uint32), text[a : a + end][::-1][: len(item) + k]])
            back, size = align(item[::-1], part, 2 * k + 1)
            start = max(0, end - (size - k)) if back <= edits else max(0, end - len(item))
            found.setdefault(i, []).append((edits, a + start, a + end))
    out = []
    for i, all_ in found.items():
        kept: list = []
        for edits, a, b in sorted(all_):
            if not any(a < y and x < b for _, x, y in kept):
                kept.append((edits, a, b))
        out += [(i, a, b, e) for e, a, b in kept]
    return sorted(out, key=lambda x: (x[1], x[0]))


def scan(column: pa.Array, index: Index, q: int = Q) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) of a column of texts, positions in code points of the row."""
    for lo, _, data, offsets in chunks(column):
        cp, off = codepoints(data, offsets)
        if not len(cp):
            continue
        text, where = normalise(cp, off)
        for i, a, b, edits in leaks(text, index, q):
            row = int(np.searchsorted(off, where[min(a, len(where) - 1)], "right")) - 1
            yield lo + row, i, int(where[a] - off[row]), int(where[b - 1] + 1 - off[row]), edits


def indexes(benchmark: DataFrame, q: int = Q, share: float = EDITS, most: int = INDEX_CHARS) -> tuple[int, Iterator[Index]]:
    """How many indexes of about `most` characters hold the benchmark, and these, of which one is in the driver at a time. Rows
    that repeat an item's id and text are one item."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    parts = max(1, -(-int(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // most))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return parts, (build([tuple(r) for r in rows.where(part == k).orderBy("item_id", "text").collect()], q, share) for k in range(parts))


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDITS, most: int = INDEX_CHARS) -> DataFrame:
    """doc_id, item_id, start, end, edits: where benchmark items occur in documents with at most share x length edits.

    Both are normalised to lower-case letters and digits with single spaces between; start and end are code points of the
    text as it is. An item of fewer than q normalised characters takes no part; one of over PART_CHARS occurs where
    one of its parts does. Null and empty texts match nothing.
    An occurrence lies within one document, whatever documents are read with it. Rows of repeated documents each give their rows, rows that repeat an item are one; a doc_id may be null; other columns are not read; no
    rows: no rows. Documents are not shuffled; an index of the benchmark has a bounded size and is broadcast,
    and a benchmark beyond it takes a pass over the documents for each index, written before the next is built.
    """
    text, out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), None
    parts, found = indexes(benchmark, q, share, most)
    for index in found:
        sent = docs.sparkSession.sparkContext.broadcast(index)
        del index

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = list(scan(b.column(1), sent.value, q))
                if got:
                    row, item, *rest = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array([sent.value.ids[i] for i in item], pa.int64()), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "item_id", "start", "end", "edits"])

        part = text.mapInArrow(run, OUT)
        if parts > 1:
            part, _ = saved(part, "leaks")
            sent.destroy()
        out = part if out is None else out.union(part)
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDITS, most: int = INDEX_CHARS) -> DataFrame:
    """Rows of docs, all their columns, in which no item occurs; decided where the row is. Null and empty texts, and rows without
    doc_id, stay as others do; repeated rows stay or go alike. A benchmark beyond one index takes a pass for each, written before the next."""
    at, (parts, found) = docs.columns.index("text"), indexes(benchmark, q, share, most)
    for index in found:
        sent = docs.sparkSession.sparkContext.broadcast(index)
        del index

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(len(b), bool)
                for row, *_ in scan(b.column(at), sent.value, q):
                    clean[row] = False
                yield b.filter(pa.array(clean))

        docs = map_batches(docs, run)
        if parts > 1:
            docs, _ = saved(docs, "clean")
            sent.destroy()
    return docs


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Where items of the benchmark occur in documents; see find_leaks()."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
