"""Language identification of spans: scripts narrow the candidates, Viterbi labels the words."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow_text import chunks, codepoints
from tessera.llm.scratch import map_batches, table

#: Documents of each language that are learned from, on average over hashes; languages at most.
TRAIN_DOCS, MOST_LANGUAGES = 1500, 256
BUCKETS = 1 << 15
SMOOTH = 0.05
#: Nats that a change of language must gain.
SWITCH = 8.0
#: A language may be written in scripts that make at least this share of its letters.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"
#: Scores (words x languages) whose paths are found together, and scores of letters that are added up at once; a text is never parted.
POOL, LETTERS = 1 << 23, 1 << 22

# First and last code points of scripts, as Unicode's blocks have them.
SCRIPTS = (
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Latin", 0x2C60, 0x2C7F), ("Latin", 0xA720, 0xA7FF), ("Latin", 0xFF21, 0xFF5A),
    ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x0400, 0x052F), ("Cyrillic", 0x1C80, 0x1C8F), ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF), ("Arabic", 0x0750, 0x077F), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF),
    ("Tamil", 0x0B80, 0x0BFF), ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Ethiopic", 0x1200, 0x137F),
    ("Kana", 0x3040, 0x30FF), ("Hangul", 0xAC00, 0xD7AF), ("Han", 0x3400, 0x9FFF), ("Han", 0xF900, 0xFAFF),
)
NAMES = ("", "Other", *dict.fromkeys(n for n, _, _ in SCRIPTS))
MARK = 255


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Script (0: no letter, 1: of another script, 255: a mark) and lower case of the first 65,536 code points."""
    script, lower = np.zeros(1 << 16, np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            script[c] = 1
            low = chr(c).lower()
            lower[c] = ord(low) if len(low) == 1 else c
        elif kind == "M":
            script[c] = MARK
    for name, a, b in SCRIPTS:
        part = script[a : b + 1]
        part[part == 1] = NAMES.index(name)
    return script, lower


_held: list = []


def letters(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of letters (marks that follow them included), their scripts, and which of them begin a word.
    A word ends where letters end, where the script changes and where a row ends."""
    if not _held:
        _held[:] = _tables()
    script, _ = _held
    kind = script[np.minimum(cp, 0xFFFF)]
    for c in np.unique(cp[cp > 0xFFFF]):
        kind[cp == c] = (NAMES.index("Han") if 0x20000 <= c <= 0x3FFFF else 1) if unicodedata.category(chr(c))[0] == "L" else 0
    at = np.arange(len(cp))
    at[kind == MARK] = -1
    first = offsets[:-1][offsets[:-1] < len(cp)]
    lone = first[kind[first] == MARK]
    kind[lone], at[lone] = 0, lone
    at = np.maximum.accumulate(at) if len(at) else at
    kind = kind[at] if len(at) else kind
    change = np.ones(len(cp), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[first] = True
    where = np.flatnonzero(kind)
    return where, kind[where], change[where]


def buckets(cp: np.ndarray, where: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A bucket for each letter: of it and its neighbours in the word, 0 beyond the word."""
    _, lower = _held
    low = np.where(cp[where] < 1 << 16, lower[np.minimum(cp[where], 0xFFFF)], cp[where]).astype(np.uint64)
    left, right = np.zeros_like(low), np.zeros_like(low)
    left[1:], right[:-1] = low[:-1], low[1:]
    left[begins] = 0
    right[:-1][begins[1:]] = 0
    h = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (low * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (right * np.uint64(0x165667B19E3779F9))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(49)).astype(np.int64)


class Model:
    """Smoothed logarithms of bucket probabilities (buckets x languages), and the scripts of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        self.languages = languages
        self.logp = np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * BUCKETS)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        self.allowed = share >= SCRIPT_SHARE


def counts_of(docs: DataFrame) -> DataFrame:
    """docs: text, lang. (lang, kind, item, n): letters in each bucket (kind 0) and script (kind 1) of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            for lo, hi, data, offsets in chunks(b.column(0)):
                cp, off = codepoints(data, offsets)
                where, script, begins = letters(cp, off)
                names, which = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                own = which[np.searchsorted(off, where, "right") - 1]
                for kind, items, size in ((0, buckets(cp, where, begins), BUCKETS), (1, script.astype(np.int64), 256)):
                    keys, n = np.unique(own * size + items, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": names[keys // size].tolist(), "kind": pa.array([kind] * len(keys), pa.int32()), "item": pa.array(keys % size, pa.int32()), "n": pa.array(n, pa.int64())})

    return docs.select("text", "lang").mapInArrow(run, "lang string, kind int, item int, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """Learns from some train_docs documents of each lang, whole: those whose hash of doc_id is in the share that gives
    so many, so that no text is shuffled. The counts that come to the driver are bounded by buckets x languages; over 256 languages are an error."""
    rows = docs.where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages; no more can be learned")
    share = F.lit(0.0)
    for lang, n in sizes:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, train_docs / n))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    got = counts_of(rows.where(place < share)).toPandas()
    names = sorted(got["lang"].unique())
    if not names:
        return None
    tables = [np.zeros((BUCKETS, len(names))), np.zeros((256, len(names)))]
    for kind in (0, 1):
        part = got[got["kind"] == kind]
        tables[kind][part["item"], np.searchsorted(names, part["lang"])] = part["n"]
    return Model(names, *tables)


def best_paths(scores: np.ndarray, first: np.ndarray, count: np.ndarray, switch: float) -> np.ndarray:
    """Viterbi paths through rows of `scores` (words x languages), of each document's run of words; a change costs `switch`.
    Documents advance together, the longest first."""
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    out = np.zeros(len(scores), np.int16)
    if not len(scores):
        return out
    stay = np.ones(scores.shape, bool)
    jump = np.zeros(len(scores), np.int16)
    alive = np.searchsorted(-count, -np.arange(1, count[0] + 1), "right")  # documents of at least t words
    v = scores[first[: alive[0]]].copy()
    last = np.zeros((len(count), scores.shape[1]), scores.dtype)
    for t in range(1, len(alive)):
        n = alive[t]
        last[n : len(v)] = v[n:]
        v, at = v[:n], first[:n] + t
        to = v.argmax(axis=1)
        over = (v[np.arange(n), to] - switch)[:, None]
        keep = v >= over
        stay[at], jump[at] = keep, to
        v = np.where(keep, v, over) + scores[at]
    last[: len(v)] = v
    state = last.argmax(axis=1)
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        at = first[:n] + t
        out[at] = state[:n]
        if t:
            state[:n] = np.where(stay[at, state[:n]], state[:n], jump[at])
    return out


def word_scores(bucket: np.ndarray, at: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Sums of the letters' scores of each word (words x languages), in blocks of words. at: first letters."""
    out = np.empty((len(at), logp.shape[1]), np.float32)
    step, lo = max(1, LETTERS // logp.shape[1]), 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + step)))
        end = at[hi] if hi < len(at) else len(bucket)
        out[lo:hi] = np.add.reduceat(logp[bucket[at[lo] : end]], at[lo:hi] - at[lo], axis=0)
        lo = hi
    return out


def label(column: pa.Array, model: Model, switch: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: (rows, row of each word, start, end, letters, scores, whether a language was learned in the word's script, whether the
    word is labelled), positions in code points of the row. All languages compete for the words of a row that has none in a known script."""
    for lo, hi, data, offsets in chunks(column):
        cp, off = codepoints(data, offsets)
        where, script, begins = letters(cp, off)
        at = np.flatnonzero(begins)
        ends = np.append(at[1:], len(where))[: len(at)]
        row = np.searchsorted(off, where[at], "right") - 1
        s = word_scores(buckets(cp, where, begins), at, model.logp)
        able = model.allowed[script[at]]
        known = able.any(axis=1)
        used = known | (np.bincount(row, known, hi - lo) == 0)[row]
        s[known] = np.where(able[known], s[known], np.float32(-1e9))
        yield hi - lo, row, where[at] - off[row], where[ends - 1] + 1 - off[row], ends - at, s, known, used


def identify_batches(batches: Iterator[pa.RecordBatch], text: int, model: Model, switch: float = SWITCH) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch with (language, score, spans) of its rows; paths are found for pools of batches."""
    held: list[tuple[pa.RecordBatch, list]] = []
    words = 0

    def solve() -> Iterator[tuple[pa.RecordBatch, list]]:
        parts = [p for _, ps in held for p in ps]
        known, used = (np.concatenate([p[k] for p in parts]) for k in (6, 7))
        scores = np.concatenate([p[5] for p in parts])[used]
        shift = np.cumsum([0, *(p[0] for p in parts)])
        rows = np.concatenate([p[1] + k for p, k in zip(parts, shift[:-1], strict=True)])
        first = np.searchsorted(rows[used], np.arange(shift[-1]))
        count = np.diff(np.append(first, used.sum()))
        path = np.full(len(rows), -1, np.int16)
        path[used] = best_paths(scores, first, count, switch)
        start, end, size = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
        n = len(model.languages)
        total = np.bincount(rows, size, shift[-1])
        by = np.bincount(rows[used] * n + path[used], size[used], shift[-1] * n).reshape(-1, n)
        top = by.argmax(axis=1)
        most = np.where(np.bincount(rows, known, shift[-1]) > 0, by[np.arange(len(top)), top], 0)
        path[~known] = -1
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (path[1:] != path[:-1])
        k = np.flatnonzero(new)
        stop = np.append(k[1:], len(rows))[: len(k)] - 1
        spans: list[list] = [[] for _ in range(shift[-1])]
        for r, a, b, x in zip(rows[k].tolist(), start[k].tolist(), end[stop].tolist(), path[k].tolist(), strict=True):
            spans[r].append({"start": a, "end": b, "lang": model.languages[x] if x >= 0 else UNKNOWN})
        found = [(model.languages[x], float(m / t), s) if t else (UNKNOWN, 0.0, s) for x, m, t, s in zip(top.tolist(), most.tolist(), total.tolist(), spans, strict=True)]
        at = 0
        for b, _ in held:
            yield b, found[at : at + len(b)]
            at += len(b)

    for b in batches:
        if not len(b):
            continue
        parts = list(label(b.column(text), model, switch))
        held.append((b, parts))
        words += sum(p[5].size for p in parts)
        if words >= POOL:
            yield from solve()
            held, words = [], 0
    if held:
        yield from solve()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


OUT = "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def predict(docs: DataFrame, model: Model | None, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score, spans of every row, from its whole text alone.

    Words are runs of letters of one script. A word's candidates are the languages that were learned in its script; each
    gets the sum of logarithms of its letter trigrams' probabilities, and Viterbi finds the labels of a text's words
    with a penalty for every change. spans are runs of one label (code points); a word in a script that was never
    learned is `und`. lang_pred is the language of most letters, the first by name in a tie; score is its share of all letters.
    A text that is null or has no letter is `und` with score 0. For a text with letters of none but scripts that were never learned, all languages compete: lang_pred is the best of
    them, with score 0. Repeated rows each give a row; other columns are not read; no rows: no rows. Without a model all are `und`.
    """
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if model is None:
        return text.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast("array<struct<start:int,end:int,lang:string>>").alias("spans"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in identify_batches(batches, 1, sent.value, switch):
            lang, score, spans = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score, pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return text.mapInArrow(run, OUT)


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """Rows of docs, all their columns, whose language is known with at least this score; decided where the row is. Null and empty texts, and those without a letter
    of a learned script, go; rows without doc_id, and repeated rows, are judged as others are. Without a model (no labelled text) no language is
    known, so nothing is judged and all rows stay. No rows: no rows."""
    if model is None:
        return docs
    at, sent = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in identify_batches(batches, at, sent.value):
            yield b.filter(pa.array([lang != UNKNOWN and score >= least for lang, score, _ in found]))

    return map_batches(docs, run)


def op10_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of those that aren't held out; see predict(). A null doc_id is not held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
