"""Substring dedup: MinHash banding of 50-word paragraphs, exact Jaccard checks, removals clustered by components.

Passages begin anywhere in a line, so a paragraph here is any run of 50 words, with its set of 46 five-word shingles. A band
is the MinHash of 13 consecutive shingles of a paragraph, and its key the 12 words that begin at the least one. Neighbouring
paragraphs share nearly all their bands, so a text has about one key for each seven words (winnowing, Schleimer et al.
2003). Paragraphs of Jaccard 0.8 differ in one place of at most a few words, which leaves 24 equal words in a row on one side: a band
lies within these, so the two share a key with certainty. Equal paragraphs have all their keys in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.arrow_text import chunks, gram_hashes, mix, row_hashes, sliding, word_hashes, words
from tessera.llm.components import connected_components
from tessera.llm.scratch import columns_of, drop_path, map_batches, marked, release, saved, table, unused_name

#: Words of a paragraph and of a shingle; shingles of a band; words of a key. 24 = 13 + 12 - 1 equal words share a key.
LEAST, GRAM, BAND, UNIT = 50, 5, 13, 12
SIMILARITY = 0.8
#: Longer runs around a key that paragraphs of this similarity must share: of 24 equal words that hold a key, one of the runs of 21 that
#: begin so many words before it is a part.
RUN, SHIFTS = 21, (0, 3, 6, 9)
#: Words that an inserted or deleted word may shift shingles by.
SLIP = 5
#: Words that are worked on at once.
BLOCK = 1 << 20
#: Documents of a longer run up to which all pairs are compared.
ALL = 8
#: Words that similar paragraphs have in common in two runs; the lengths of the one that holds a key (the other has GRAM words or more).
SHARED, HALF, LONGEST = 49, 25, 44
#: Lengths of that run that one key stands for, step by step: all of them, fewer, and one.
LENGTHS = LONGEST - HALF + 1
WIDTHS = (LENGTHS, 5, 1)
LEFT, RIGHT = LEAST - UNIT + 1, LEAST + 1


def places(w: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words at which keys begin. w: word hashes; row: the row of each."""
    g = gram_hashes(w, GRAM)
    low = sliding(g, BAND)
    if not len(low):
        return np.zeros(0, np.int64)
    low = np.where(row[: len(low)] == row[GRAM + BAND - 2 :], low, 0)
    edge = np.zeros(BAND - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([edge, low, edge]), BAND, np.maximum) == g)
    at = at[at + UNIT <= len(w)]
    return at[row[at] == row[at + UNIT - 1]]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values, kind))


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of an array of 4-byte values, a binary for each."""
    offsets = np.append(0, np.cumsum(counts)) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows of text: each one's hash, words, words' hashes and the row of each word."""
    starts, ends, row = words(data, offsets)
    h = word_hashes(data, starts, ends)
    whole, _, count = row_hashes(h, row, len(offsets) - 1)
    return whole, count, np.maximum(h >> np.uint64(32), np.uint64(1)).astype(np.uint32), row


def text_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows of text: each one's hash, words, and words' hashes; and (row, key) of its distinct keys."""
    whole, count, w, row = text_words(data, offsets)
    at = places(w.astype(np.uint64), row)
    keys, owner = gram_hashes(w.astype(np.uint64), UNIT)[at], row[at]
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return whole, count, w, owner[new], keys[new]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def banded(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, keys of the rows of LEAST words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in chunks(b.column(1)):
                whole, count, _, owner, keys = text_keys(data, offsets)
                long = count >= LEAST
                if not long.any():
                    continue
                held = np.bincount(owner, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).filter(pa.array(long)), pa.array(whole.view(np.int64)[long]), pa.array(count[long], pa.int32()), _lists(keys.view(np.int64)[long[owner]], held[long], pa.int64())], ["doc_id", "text_hash", "n_words", "keys"])

    return _texts(docs).mapInArrow(run, "doc_id long, text_hash long, n_words int, keys array<long>")


def worded(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text_hash, words (4 bytes each) of the rows of LEAST words or more whose doc_id is one of ids (doc_id), and of a few others; the texts are
    read again, as their words take as much disk as they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in chunks(b.column(1)):
                whole, count, w = text_words(data, offsets)[:3]
                long = count >= LEAST
                if long.any():
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).filter(pa.array(long)), pa.array(whole.view(np.int64)[long]), _binary(w[np.repeat(long, count)], count[long])], ["doc_id", "text_hash", "words"])

    asked = marked(_texts(docs), F.col("doc_id"), ids, "doc_id", "asked").where("asked").drop("asked")
    return asked.mapInArrow(run, "doc_id long, text_hash long, words binary")


def _pooled(b: pa.RecordBatch, column: str, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, words, row of each word, first word of each row) of runs of rows of some `most` words."""
    parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in b.column(column)]
    lo = 0
    while lo < len(parts):
        hi, size = lo, 0
        while hi < len(parts) and (hi == lo or size + len(parts[hi]) <= most):
            size, hi = size + len(parts[hi]), hi + 1
        count = np.array([len(p) for p in parts[lo:hi]])
        yield lo, hi, np.concatenate(parts[lo:hi]).astype(np.uint64), np.repeat(np.arange(hi - lo), count), np.append(0, np.cumsum(count))
        lo = hi


def opened(texts: DataFrame, least: int) -> DataFrame:
    """texts: doc_id, text_hash, words, keys (those that other texts have too). Of each: the runs of `least` words all of whose
    keys are shared (starts and hashes), and its places with a shared key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared = np.unique(np.asarray(b.column("keys").flatten()))
            for lo, hi, w, row, first in _pooled(b, "words"):
                at = places(w, row)
                keys = gram_hashes(w, UNIT)[at].view(np.int64)
                known = np.isin(keys, shared)
                held, other = (np.append(0, np.cumsum(np.bincount(x, minlength=len(w) + 1))) for x in (at[known], at[~known]))
                s = np.arange(max(0, len(w) - least + 1))
                s = s[row[s] == row[s + least - 1]]
                # between these two places a band of the run chooses every key, so all must be shared
                sure = other[s + least - GRAM - BAND + 2] == other[s + BAND - 1]
                s = s[sure & (held[s + least - UNIT + 1] > held[s])]
                windows = gram_hashes(w, least)[s].view(np.int64)
                at, keys = at[known], keys[known]
                n = hi - lo
                starts = _lists((s - first[row[s]]).astype(np.int32), np.bincount(row[s], minlength=n), pa.int32())
                found = _lists(windows, np.bincount(row[s], minlength=n), pa.int64())
                at_ = _lists((at - first[row[at]]).astype(np.int32), np.bincount(row[at], minlength=n), pa.int32())
                keys_ = _lists(keys, np.bincount(row[at], minlength=n), pa.int64())
                own = [b.column(k).slice(lo, n) for k in ("doc_id", "text_hash", "words")]
                yield pa.RecordBatch.from_arrays([*own, starts, found, at_, keys_], ["doc_id", "text_hash", "words", "starts", "windows", "places", "keys"])

    return texts.select("doc_id", "text_hash", "words", "keys").mapInArrow(run, "doc_id long, text_hash long, words binary, starts array<int>, windows array<long>, places array<int>, keys array<long>")


def exact_islands(open_: DataFrame, least: int) -> tuple[DataFrame, list[str]]:
    """doc_id, word_start, word_end, kept_doc_id: maximal runs of equal `least`-word runs that have the same first document, its own
    included; and paths to drop. Equal runs meet in minima that are aggregated before the shuffle, whatever their number."""
    runs = open_.select("doc_id", F.explode(F.arrays_zip("starts", "windows")).alias("r")).select("doc_id", F.col("r.starts").alias("start"), F.col("r.windows").alias("window"))
    first = runs.groupBy("window").agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("last")).where("kept_doc_id < last").drop("last")
    # written, as AQE splits a hot window's rows only where both sides of the join are dealt out for it
    first, first_path = saved(first, "first")
    line = Window.partitionBy("doc_id").orderBy("start", "kept_doc_id")
    new = F.coalesce((F.col("start") - F.lag("start").over(line) > 1) | (F.col("kept_doc_id") != F.lag("kept_doc_id").over(line)), F.lit(True)).cast("int")
    hits = runs.join(first, "window").select("doc_id", "start", "kept_doc_id").withColumn("new", new).withColumn("nth", F.sum("new").over(line))
    out = hits.groupBy("doc_id", "nth").agg(F.min("start").alias("word_start"), (F.max("start") + least).alias("word_end"), F.min("kept_doc_id").alias("kept_doc_id")).drop("nth")
    out, path = saved(out, "islands")
    return out, [first_path, path]


def _asked(open_: DataFrame, wanted: DataFrame, f, schema: str) -> DataFrame:
    """f(words, first word of each row, row and place in the words of each wanted place) gives the columns after doc_id and place."""
    asked = wanted.groupBy("doc_id").agg(F.collect_set("place").alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w, _, first in _pooled(b, "words"):
                asked = b.column("asked").slice(lo, hi - lo)
                own = np.repeat(np.arange(hi - lo), np.asarray(asked.value_lengths()))
                place = np.asarray(asked.flatten())
                column = f(w, first, own, place + first[own])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(lo + own)), pa.array(place, pa.int32()), column], ["doc_id", "place", schema.split()[0]])

    return open_.select("doc_id", "words").join(asked, "doc_id").mapInArrow(run, f"doc_id long, place int, {schema}")


def longer_runs(open_: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, place, runs: hashes of the longer runs around wanted places (doc_id, place)."""

    def runs(w: np.ndarray, first: np.ndarray, own: np.ndarray, at: np.ndarray) -> pa.Array:
        hashes = gram_hashes(w, RUN).view(np.int64)
        begins = at[:, None] - np.array(SHIFTS)
        fits = (begins >= first[own][:, None]) & (begins + RUN <= first[own + 1][:, None])
        found = hashes[np.clip(begins, 0, max(0, len(hashes) - 1))] + np.arange(len(SHIFTS)) if len(hashes) else np.zeros(begins.shape, np.int64)
        return _lists(found[fits], fits.sum(axis=1), pa.int64())

    return _asked(open_, wanted, runs, "runs array<long>")


def surroundings(open_: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, place, around: LEFT words before wanted places and RIGHT from each on, 4 bytes each; 0 is beyond the text."""

    def around(w: np.ndarray, first: np.ndarray, own: np.ndarray, at: np.ndarray) -> pa.Array:
        near = at[:, None] + np.arange(-LEFT, RIGHT)
        inside = (near >= first[own][:, None]) & (near < first[own + 1][:, None])
        found = np.where(inside, w[np.clip(near, 0, len(w) - 1)], 0).astype(np.uint32)
        return _binary(found.reshape(-1), np.full(len(at), LEFT + RIGHT))

    return _asked(open_, wanted, around, "around binary")


def similar_spans(x: np.ndarray, y: np.ndarray, least: int = LEAST, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """x, y: surroundings of two places, a row for each pair. First and end word (of x) of the union of the paragraphs around the
    place whose shingles reach this Jaccard similarity with those of the paragraph at the same place in y; both 0 if there are none. The union begins and ends
    with a shared shingle. Shingles are compared in order, at most SLIP words apart, so one that repeats counts as often."""
    n, size = x.shape[1] - GRAM + 1, least - GRAM + 1

    def grams(a: np.ndarray, never: int) -> np.ndarray:
        out, hole = np.zeros((len(a), n), np.uint64), np.zeros((len(a), n), bool)
        for k in range(GRAM):
            out = out * np.uint64(0x9E3779B97F4A7C15) + a[:, k : k + n]
            hole |= a[:, k : k + n] == 0
        return np.where(hole, np.uint64(never), mix(out))

    a, b = grams(x, 1), grams(y, 2)
    left = np.ones(a.shape, bool)
    starts = n - size + 1
    total = np.zeros((len(a), starts), np.int32)
    for slip in sorted(range(-SLIP, SLIP + 1), key=abs):
        lo, hi = max(0, -slip), min(n, n - slip)
        same = np.zeros(a.shape, bool)
        same[:, lo:hi] = a[:, lo:hi] == b[:, lo + slip : hi + slip]
        same &= left
        left &= ~same
        sums = np.concatenate([np.zeros((len(a), 1), np.int32), np.cumsum(same, axis=1, dtype=np.int32)], axis=1)
        t = np.arange(starts)
        total += sums[:, np.minimum(t + size, t + size - slip)] - sums[:, np.maximum(t, t - slip)]
    good = total >= np.ceil(2 * size * similarity / (1 + similarity) - 1e-9)
    any_ = good.any(axis=1)
    begin, end = good.argmax(axis=1), starts - 1 - good[:, ::-1].argmax(axis=1) + size
    shared, at = ~left, np.arange(n)
    shared &= (at >= begin[:, None]) & (at < end[:, None])
    begin, end = shared.argmax(axis=1), n - shared[:, ::-1].argmax(axis=1) + GRAM - 1
    any_ &= end - begin >= least
    return np.where(any_, begin, 0), np.where(any_, end, 0)


def verified(pairs: DataFrame, around: DataFrame, least: int) -> DataFrame:
    """pairs: doc_id, place, kept_doc_id, kept_place. doc_id, place, word_start, word_end, kept_doc_id of those around which paragraphs are similar."""
    own = around.select("doc_id", "place", F.col("around").alias("x"))
    kept = around.select(F.col("doc_id").alias("kept_doc_id"), F.col("place").alias("kept_place"), F.col("around").alias("y"))
    both = pairs.join(own, ["doc_id", "place"]).join(kept, ["kept_doc_id", "kept_place"]).select("doc_id", "place", "kept_doc_id", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(len(b), -1) for k in ("x", "y"))
            begin, end = similar_spans(x, y, least)
            place = np.asarray(b.column("place")) - LEFT
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("place"), pa.array((place + begin).astype(np.int32)), pa.array((place + end).astype(np.int32)), b.column("kept_doc_id")], ["doc_id", "place", "word_start", "word_end", "kept_doc_id"])
            yield out.filter(pa.array(end > begin))

    return both.mapInArrow(run, "doc_id long, place int, word_start int, word_end int, kept_doc_id long")


def _spread(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """first[k] folded with the columns of at[k] one after the other: a hash for each number of columns, none included."""
    out = np.empty((len(at), at.shape[1] + 1), np.uint64)
    out[:, 0] = first
    for k in range(at.shape[1]):
        out[:, k + 1] = mix(out[:, k] * np.uint64(0x9E3779B97F4A7C15) + at[:, k])
    return out


def forks(around: DataFrame) -> DataFrame:
    """doc_id, place, depth, node, word: what follows the key of a place word by word, and what goes before it. A node is the words read so far, and the word is the
    next one. Depths are words from the place on (UNIT and more) or, negative, before it (-1 for none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            w = np.frombuffer(b"".join(b.column("around").to_pylist()), np.uint32).reshape(len(b), -1).astype(np.uint64)
            key = _spread(np.zeros(len(b), np.uint64), w[:, LEFT : LEFT + UNIT])[:, -1]
            most = LONGEST - UNIT
            after, before = w[:, LEFT + UNIT : LEFT + LONGEST + 1], w[:, LEFT - 1 - most : LEFT][:, ::-1]
            nodes = np.concatenate([_spread(key, after[:, :most]), _spread(mix(key + np.uint64(1)), before[:, :most])], axis=1)
            word = np.concatenate([after, before], axis=1)
            depth = np.append(np.arange(UNIT, LONGEST + 1), -1 - np.arange(most + 1)).astype(np.int8)
            own = np.repeat(np.arange(len(b)), len(depth))
            there = word.reshape(-1) != 0
            own = pa.array(own[there])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(own), b.column("place").take(own), pa.array(np.tile(depth, len(b))[there]), pa.array(nodes.reshape(-1).view(np.int64)[there]), pa.array(word.reshape(-1)[there].astype(np.int64))], ["doc_id", "place", "depth", "node", "word"])

    return around.select("doc_id", "place", "around").mapInArrow(run, "doc_id long, place int, depth byte, node long, word long")


def _powers(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of words (0 is none): powers of a number; sums of words by powers, and counts of holes, before each column. The hash of a run is the
    difference of sums, moved to one place by a power so that it tells words alone."""
    power = np.cumprod(np.full(w.shape[1] + 1, 0x9E3779B97F4A7C15, np.uint64))
    edge = np.zeros((len(w), 1), np.uint64)
    sums = np.concatenate([edge, np.cumsum(mix(w) * power[:-1], axis=1, dtype=np.uint64)], axis=1)
    holes = np.concatenate([edge.astype(np.int32), np.cumsum(w == 0, axis=1, dtype=np.int32)], axis=1)
    return power, sums, holes


def _way(depth: Column, gap: int) -> Column:
    """A depth of forks(), words between two runs, and the least length of the one that holds the key, in a number; see gapped_keys()."""
    return (64 * (2 * depth.cast("int") + gap) + HALF).cast("short")


def gapped_keys(around: DataFrame, wider: int, width: int) -> DataFrame:
    """around: doc_id, place, around, ways (of _way()). doc_id, place, way, key: hashes of two runs of words, one that holds the place's
    key up to a depth where others go on with another word, and one beyond it, after one word of this text or none. Of the `wider` lengths from a way's least on that the first run may have,
    each `width` are a way again, and its key the words that all of these have in common; with a width of 1 the two runs are SHARED words together, and similar
    paragraphs have such a key in common (see similar_passages()). Texts of a key have those of all larger widths in common too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            w = np.frombuffer(b"".join(b.column("around").to_pylist()), np.uint32).reshape(len(b), -1).astype(np.uint64)
            power, sums, holes = _powers(w)
            ways = b.column("ways")
            row = np.repeat(np.arange(len(b)), np.asarray(ways.value_lengths()))
            way = np.asarray(ways.flatten()).astype(np.int64)
            side, low = way // 64, way % 64
            depth, gap = side // 2, side % 2
            right = depth > 0
            at = np.where(right, depth, depth + 1) + LEFT
            # words from the place's key to the depth
            least = np.where(right, depth, UNIT - depth - 1)
            owners, found, keys = [], [], []
            for more in range(0, wider, width):
                first, last = low + more, low + more + width - 1
                long, short = np.maximum(first, least), SHARED - last
                a = np.where(right, at - long, at)
                c = np.where(right, at + gap, at - gap - short)
                fits = (long <= last) & (a >= 0) & (a + long <= w.shape[1]) & (c >= 0) & (c + short <= w.shape[1])
                r, a, c, long, short, first = row[fits], a[fits], c[fits], long[fits], short[fits], first[fits]
                whole = (holes[r, a + long] == holes[r, a]) & (holes[r, c + short] == holes[r, c])
                r, a, c, long, short, first, side_ = r[whole], a[whole], c[whole], long[whole], short[whole], first[whole], side[fits][whole]
                one = (sums[r, a + long] - sums[r, a]) * power[w.shape[1] - a]
                two = (sums[r, c + short] - sums[r, c]) * power[w.shape[1] - c]
                keys.append(mix(mix(one) * np.uint64(0x9E3779B97F4A7C15) + mix(two + first.astype(np.uint64)) + (side_ // 2).astype(np.uint64)))
                owners.append(r)
                found.append((64 * side_ + first).astype(np.int16))
            own, found, key = np.concatenate(owners), np.concatenate(found), np.concatenate(keys)
            for lo in range(0, len(own), BLOCK):
                part = pa.array(own[lo : lo + BLOCK])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(part), b.column("place").take(part), pa.array(found[lo : lo + BLOCK]), pa.array(key[lo : lo + BLOCK].view(np.int64))], ["doc_id", "place", "way", "key"])

    return around.select("doc_id", "place", "around", "ways").mapInArrow(run, "doc_id long, place int, way short, key long")


def gapped_pairs(around: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc_id, place, kept_doc_id, kept_place: each place of around (doc_id, place, around) with the first of those that have a key of gapped_keys() in common with it, by
    doc_id; and paths to drop. Rows grow with the places, whatever the number that share a key. Keys of many lengths of the runs tell first which lengths no other text can
    have in common, so that few keys of one length are made that it has not."""
    spark = around.sparkSession
    steps, steps_path = saved(forks(around), "forks")
    nodes, nodes_path = saved(steps.groupBy("node").agg(F.min("word").alias("low"), F.max("word").alias("high")).where("low < high").select("node"), "nodes")
    ways = steps.join(nodes, "node", "left_semi").groupBy("doc_id", "place").agg(F.flatten(F.collect_set(F.array(_way(F.col("depth"), 0), _way(F.col("depth"), 1)))).alias("ways"))
    used = [steps_path, nodes_path]
    for wider, width in zip((LENGTHS, *WIDTHS[:-1]), WIDTHS, strict=True):
        rows, rows_path = saved(gapped_keys(around.join(ways, ["doc_id", "place"]), wider, width), "gapped")
        for path in used:
            drop_path(spark, path)
        release(spark)
        if width > 1:
            known, known_path = saved(rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key"), "known")
            ways = rows.join(known, "key", "left_semi").groupBy("doc_id", "place").agg(F.collect_set("way").alias("ways"))
            used = [rows_path, known_path]
    first = rows.groupBy("key").agg(F.min(F.struct("doc_id", "place")).alias("kept"), F.max("doc_id").alias("last")).where("kept.doc_id < last").drop("last")
    first, first_path = saved(first, "gapped-first")
    # rows of keys that no other has aren't dealt out
    rows = marked(rows, F.col("key"), first, "key", "shared").where("shared").drop("shared")
    pairs = rows.join(first, "key").where("doc_id > kept.doc_id").select("doc_id", "place", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.place").alias("kept_place"))
    return pairs.distinct(), [rows_path, first_path]


def similar_passages(open_: DataFrame, loose: DataFrame, least: int) -> tuple[DataFrame, list[str]]:
    """Passages (doc_id, place, word_start, word_end, kept_doc_id) around loose places (doc_id, place, key) that are similar, not equal, to an
    earlier document's; and paths to drop.

    Places that share a key and a longer run meet, the first of each document. All pairs of a run of up to ALL documents are compared. In a run of more, places meet by keys that
    only similar ones share, and each is compared to the first of a key: of paragraphs of 50 words and Jaccard 0.8, 41 of 46 shingles are in common, so all words
    but one are, in order, in two runs of SHARED words together that one word parts in either text or both. A key is the hash of two such runs, taken where
    texts of the longer run really part. The first of a key is similar in the same words as any other that has it, so no similar paragraph is missed, but for two narrow cases: two or more words put in that
    repeat those before them; and one word left out, where the first of a key shares SHARED words, one short of a passage, and only others share more."""
    several = loose.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
    # written, as AQE splits a hot key's rows only where both sides of the join are dealt out for it
    several, several_path = saved(several, "several")
    wanted, wanted_path = saved(loose.join(several, "key", "left_semi").select("doc_id", "place").distinct(), "wanted")
    runs, runs_path = saved(longer_runs(open_, wanted), "runs")
    spark = loose.sparkSession
    release(spark)
    rows = runs.select("doc_id", "place", F.explode("runs").alias("run")).groupBy("run", "doc_id").agg(F.min("place").alias("place"))
    rows, rows_path = saved(rows, "places")
    groups, groups_path = saved(rows.groupBy("run").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    few = rows.join(groups.where(F.col("n") <= ALL).select("run"), "run")
    many = rows.join(groups.where(F.col("n") > ALL).select("run"), "run").select("doc_id", "place").distinct()
    many, many_path = saved(surroundings(open_, many), "many")
    release(spark)
    other = few.select("run", F.col("doc_id").alias("kept_doc_id"), F.col("place").alias("kept_place"))
    met = few.join(other, "run").where("doc_id > kept_doc_id").select("doc_id", "place", "kept_doc_id", "kept_place")
    gapped, gapped_paths = gapped_pairs(many)
    pairs, pairs_path = saved(met.unionByName(gapped).distinct(), "pairs")
    for path in (several_path, wanted_path, runs_path, rows_path, groups_path, many_path, *gapped_paths):
        drop_path(spark, path)
    release(spark)
    asked = pairs.select("doc_id", "place").union(pairs.select("kept_doc_id", "kept_place")).distinct()
    around, around_path = saved(surroundings(open_, asked), "around")
    near, near_path = saved(verified(pairs, around, least), "similar")
    for path in (pairs_path, around_path):
        drop_path(spark, path)
    release(spark)
    return near, [near_path]


def repeated_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text_hash, word_start, word_end, kept_doc_id, class_id: the passages that repeat one of a document of smaller doc_id, and
    so may go; words are counted from 0 and end at ASCII white space, and A-Z counts as a-z.

    Every run of `least` words (50 at least, below which the bands guarantee nothing) that an earlier document has is
    covered, whatever the number of documents that have it: equal runs meet by a hash of the whole run. Beyond these, paragraphs
    of 50 words whose 5-word shingles have a Jaccard similarity of 0.8 or more with an earlier document's are found by the
    keys of their bands and verified (see similar_passages() for those of runs that many documents share); such a passage begins and ends with a shared shingle and has
    `least` words or more. Words are compared by 32-bit hashes and runs by 64-bit ones. class_id names a cluster: passages that share a key, directly or by others, are of one.

    A text that equals an earlier document's is one passage, whole, of a class of its own; only the first of equal texts is
    searched. Repeats within a document aren't passages. Rows that repeat a doc_id and its text are one document; of different texts of
    a doc_id, the one of the least text_hash is searched, and text_hash tells which row a passage belongs to. Rows without doc_id, and
    null, empty or short texts, take no part. docs is read twice, other columns are not; no rows: no rows.
    """
    if least < LEAST:
        raise ValueError(f"least must be {LEAST} or more")
    spark = docs.sparkSession
    texts, texts_path = saved(banded(docs.where("doc_id is not null")), "texts")
    reps, reps_path = saved(texts.groupBy("text_hash").agg(F.min("doc_id").alias("rep")), "reps")
    copies = texts.select("doc_id", "text_hash", "n_words").join(reps, "text_hash").where("doc_id <> rep").distinct()
    copies = copies.select("doc_id", "text_hash", F.lit(0).alias("word_start"), F.col("n_words").alias("word_end"), F.col("rep").alias("kept_doc_id"), F.col("text_hash").alias("class_id"))
    copies, _ = saved(copies.where(F.col("n_words") >= least), "copies")
    rows = texts.select("doc_id", "text_hash", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).where("low < high").select("key")
    shared, shared_path = saved(shared, "shared")
    release(spark)
    chosen = reps.groupBy(F.col("rep").alias("doc_id")).agg(F.min("text_hash").alias("text_hash"))
    asked = rows.join(shared, "key").groupBy("doc_id", "text_hash").agg(F.collect_set("key").alias("keys"))
    asked, asked_path = saved(asked.join(chosen, ["doc_id", "text_hash"], "left_semi"), "asked")
    release(spark)
    for path in (texts_path, reps_path, shared_path):
        drop_path(spark, path)
    open_, open_path = saved(opened(worded(docs.where("doc_id is not null"), asked).join(asked, ["doc_id", "text_hash"]), least), "open")
    drop_path(spark, asked_path)
    release(spark)
    islands, used = exact_islands(open_, least)
    release(spark)
    equal = islands.where("kept_doc_id <> doc_id").withColumn("span", F.xxhash64("doc_id", "word_start", "word_end"))
    held = open_.select("doc_id", F.explode(F.arrays_zip("places", "keys")).alias("p")).select("doc_id", F.col("p.places").alias("place"), F.col("p.keys").alias("key"))
    inside = (F.col("place") >= F.col("word_start")) & (F.col("place") + UNIT <= F.col("word_end"))
    spans = equal.select(F.col("doc_id").alias("span_doc"), "word_start", "word_end", "span")
    held, held_path = saved(held.join(spans, (F.col("doc_id") == F.col("span_doc")) & inside, "left").select("doc_id", "place", "key", "span"), "held")
    release(spark)
    similar, paths = similar_passages(open_, held.where("span is null").select("doc_id", "place", "key"), least)
    used += [open_path, held_path, *paths]
    heads = held.where("span is not null").groupBy("doc_id", "span").agg(F.min("key").alias("head"))
    links = held.where("span is not null").join(heads, ["doc_id", "span"]).select(F.col("head").alias("a"), F.col("key").alias("b")).distinct()
    found = equal.join(heads, ["doc_id", "span"]).select("doc_id", "word_start", "word_end", "kept_doc_id", "head")
    near = similar.join(held.select("doc_id", "place", "key"), ["doc_id", "place"]).groupBy("doc_id", "word_start", "word_end", "kept_doc_id").agg(F.min("key").alias("head"))
    found = found.union(near)
    classes = connected_components(links)
    named = found.join(classes, F.col("head") == F.col("node"), "left").withColumn("class_id", F.coalesce("component", "head"))
    named = named.join(open_.select("doc_id", "text_hash").distinct(), "doc_id")
    out, _ = saved(named.select("doc_id", "text_hash", "word_start", "word_end", "kept_doc_id", "class_id"), "passages")
    for path in used:
        drop_path(spark, path)
    release(spark)
    return out.union(copies)


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without these words; the white space after a cut goes too."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, _, _ = words(data, np.array([0, len(data)]))
    bounds, out, at = np.append(starts, len(data)), [], 0
    for a, b in sorted(spans):
        a, b = int(bounds[min(a, len(starts))]), int(bounds[min(b, len(starts))])
        if a > at:
            out.append(data[at:a].tobytes())
        at = max(at, b)
    return b"".join([*out, data[at:].tobytes()]).decode()


def without_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs without these passages, n_chars counted anew where the column is there; a document of which no word is left goes. Documents without
    passages stay as they are, null and empty texts too, and so do rows without doc_id; of rows that repeat a doc_id, only those of
    a passage's text_hash are cut. Columns of docs: doc_id, text and any more, which are kept."""
    cuts, owner, met = (unused_name(docs, x) for x in ("cuts", "owner", "met"))
    asked = spans.groupBy(F.col("doc_id").cast("long").alias(owner)).agg(F.collect_set(F.struct("text_hash", "word_start", "word_end")).alias(cuts))
    # documents without passages stay, so their texts need no join
    every = marked(docs, F.col("doc_id").cast("long"), asked, owner, met)
    rows = every.where(F.col(met)).join(asked, F.col("doc_id") == F.col(owner), "left")
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(b.num_columns - 1)
            if asked.null_count == len(asked):
                yield b.select(range(len(names)))
                continue
            texts = b.column(at).to_pylist()
            sizes = b.column(count).to_pylist() if count is not None else None
            keep = np.ones(len(b), bool)
            for k in np.flatnonzero(np.asarray(asked.is_valid())):
                if not texts[k]:
                    continue
                data = np.frombuffer(texts[k].encode(), np.uint8)
                own = int(text_keys(data, np.array([0, len(data)]))[0].view(np.int64)[0])
                spans = [(s["word_start"], s["word_end"]) for s in asked[k].as_py() if s["text_hash"] == own]
                if spans:
                    texts[k] = _cut(texts[k], spans)
                    keep[k] = bool(texts[k].strip(" \t\n\v\f\r"))
                    if sizes:
                        sizes[k] = len(texts[k])
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, b.schema.field(at).type)
            if sizes:
                columns[count] = pa.array(sizes, b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1]).filter(pa.array(keep))

    return map_batches(rows.select(*columns_of(docs), cuts), run, (cuts,)).union(every.where(~F.col(met)).select(*columns_of(docs)))


def op3_passages(spark, sf_dir: str) -> DataFrame:
    """The repeated passages of all documents; see repeated_passages()."""
    return repeated_passages(table(spark, sf_dir, "documents"))
