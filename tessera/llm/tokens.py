"""Token counts of sections: whole documents are encoded once, token spans are joined to section spans."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import table

#: A token that crosses a boundary counts for: the section of its first byte, of its last, or that of most of its bytes
#: (the first of those in a tie).
RULES = ("start", "end", "majority")
#: Bytes of a vocabulary file that may be sent to executors.
MOST_VOCABULARY = 64 << 20
OUT = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long"
_encoders: dict[int, tuple] = {}


def encoder(vocabulary: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding, and the bytes of each token."""
    key = hash((vocabulary, pattern))
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            size[k] = len(token)
        _encoders[key] = (tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size)
    return _encoders[key]


def lines(data: np.ndarray) -> np.ndarray:
    """First bytes of a text's lines, each with its line feed; 0 alone for an empty text."""
    starts = np.flatnonzero(data[:-1] == 10) + 1 if len(data) else np.zeros(0, np.int64)
    return np.append(0, starts)


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section. ends: the last byte + 1 of each token, which tile the text as the
    sections do; bounds: first bytes of the sections, then the text's size. The join is one pass over two sorted lists."""
    n = len(bounds) - 1
    starts = np.append(0, ends[:-1])[: len(ends)]
    first = np.searchsorted(bounds[:-1], starts, "right") - 1
    last = np.searchsorted(bounds[:-1], ends - 1, "right") - 1
    crossing = last > first
    own = last.copy() if rule == "end" else first.copy()
    if rule == "majority" and crossing.any():
        k = np.flatnonzero(crossing)
        best = bounds[first[k] + 1] - starts[k]
        for step in range(1, int((last[k] - first[k]).max()) + 1):
            sec = np.minimum(first[k] + step, last[k])
            part = np.minimum(ends[k], bounds[sec + 1]) - bounds[sec]
            more = (first[k] + step <= last[k]) & (part > best)
            own[k[more]], best[more] = sec[more], part[more]
    return np.bincount(own, minlength=n), np.bincount(own[crossing], minlength=n)


def token_counts(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, rule: str = "majority") -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_crossing: a row for each section (line, its line feed included) of each text.

    A whole text is encoded at once, so the sum over its sections is the text's token count. Tokens of a byte-level
    vocabulary tile the text's bytes; their spans are joined to the sections', and a token that crosses a boundary
    counts once, by `rule`. start and end are code points. A null or empty text has one section without tokens.
    Repeated rows each give their rows; other columns are not read; no rows: no rows. Neither the text
    nor a hot source is shuffled. `vocabulary` is the path of a file of ranks on the driver, sent to the executors.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = file.read(MOST_VOCABULARY + 1)
    if len(ranks) > MOST_VOCABULARY:
        raise ValueError("the vocabulary is too large to send to executors")
    sent = docs.sparkSession.sparkContext.broadcast((ranks, pattern or public_tokenizers.PATTERN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size = encoder(*sent.value)
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            ids = []
            for k, text in enumerate(b.column(1)):
                text = text.as_py() or ""
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                bounds = np.append(lines(data), len(data))
                chars = bounds if len(raw) == len(text) else np.append(0, np.cumsum((data & 0xC0) != 0x80))[bounds]
                got = encoding.encode_to_numpy(text, disallowed_special=())
                tokens, crossing = attribute(np.cumsum(size[got]), bounds, rule) if len(got) else (np.zeros(len(bounds) - 1, np.int64),) * 2
                ids.append(np.full(len(tokens), k))
                for col, x in zip(cols, (np.arange(len(tokens)), chars[:-1], chars[1:], tokens, crossing), strict=True):
                    col.append(x)
            if ids:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(ids))), *(pa.array(np.concatenate(c), pa.int64()) for c in cols)], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUT)


def op6_tokens(spark, sf_dir: str) -> DataFrame:
    """Token counts of the lines of all documents; see token_counts()."""
    return token_counts(table(spark, sf_dir, "documents"))
