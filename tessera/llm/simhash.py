"""SimHash near-duplicates: fingerprints, links at a few differing bits, groups.

Links are found by segment popcounts. A 64-bit fingerprint is embedded as sixteen counts, the ones of each
4-bit segment. Fingerprints that differ in at most d bits have counts that differ by at most d in Manhattan
distance, and the differing bits touch at most d of eight bytes; so the pair agrees on all counts of some
8 - d bytes. Each choice of 8 - d bytes is a grid, its cells are the counts there, and pairs within a cell
are kept if their Manhattan distance is at most d, and then if their Hamming distance is.

Cells of more than `cell` fingerprints, as large groups of near copies make, aren't paired. Their
fingerprints are linked exactly through fingerprints between them instead: two that differ in at most 2 bits
have a common neighbour at 1 bit at most, so each gives its 65 neighbours, and each neighbour links all
who gave it to the smallest. No more than 65 can meet in one, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.scratch import dealt, drop_path, saved, table

SEED = 42
SEGMENTS, BYTES = 16, 8
#: Shingles of one text that are hashed at once.
BLOCK = 1 << 16


def shingle_hashes(text: bytes, n: int) -> Iterator[np.ndarray]:
    """XXH64 of the n-word shingles of a text, in blocks; A-Z is lower-cased, words end at ASCII white space.
    A text of fewer words is one shingle; a text without words has none."""
    tokens = text.lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = min(n, len(tokens))
    ends = ends[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(ends), BLOCK):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=False)]
        yield np.array(part, np.uint64)


def simhash(blocks: Iterator[np.ndarray]) -> int:
    """64 bits, each 1 if it is set in over half of the hashes; 0 if there are none. Signed, as Spark's long."""
    total, ones = 0, np.zeros(64, np.int64)
    for h in blocks:
        total += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fingerprint long) of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [simhash(shingle_hashes((t.as_py() or "").encode(), shingle)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint long")


def _shifted(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n)


def popcounts(x: Column) -> Column:
    """Sixteen counts of ones, 4 bits each, in a long."""
    pairs = x - _shifted(x, 1).bitwiseAND(F.lit(0x5555555555555555))
    return pairs.bitwiseAND(F.lit(0x3333333333333333)) + _shifted(pairs, 2).bitwiseAND(F.lit(0x3333333333333333))


def manhattan(a: Column, b: Column) -> Column:
    """Between two embeddings."""
    gap = [F.abs(_shifted(a, 4 * k).bitwiseAND(F.lit(15)) - _shifted(b, 4 * k).bitwiseAND(F.lit(15))) for k in range(SEGMENTS)]
    return sum(gap[1:], gap[0])


def _wrapped(df: DataFrame, name: str, x: str) -> DataFrame:
    """popcounts() of column x; the halves are apart so that no sum leaves the range of a long."""
    low, high = F.col(x).bitwiseAND(F.lit(0xFFFFFFFF)), _shifted(F.col(x), 32)
    return df.withColumn(name, popcounts(low).bitwiseOR(F.shiftleft(popcounts(high), 32)))


def hamming_links(points: DataFrame, bits: int, cell: int = 64) -> DataFrame:
    """points: distinct longs `fingerprint`. Pairs (a, b), a < b, that hold every group together: all pairs
    within `bits` from cells of at most `cell`, and links that join the rest exactly as such pairs would.
    bits is 2 at most, the reach of the exact way for hot cells."""
    if not 0 <= bits <= 2:
        raise ValueError("bits must be 0, 1 or 2")
    grids = [sum(0xFF << (8 * k) for k in range(BYTES) if k not in drop) for drop in combinations(range(BYTES), bits)]
    signed = [g - (1 << 64) if g >> 63 else g for g in grids]
    point = _wrapped(points.select("fingerprint"), "counts", "fingerprint")
    cells = F.array(*[F.struct(F.lit(k).cast("byte").alias("grid"), F.col("counts").bitwiseAND(F.lit(g)).alias("cell")) for k, g in enumerate(signed)])
    keyed = point.select("fingerprint", "counts", F.explode(cells).alias("key")).select("fingerprint", "counts", "key.grid", "key.cell")
    full = keyed.groupBy("grid", "cell").agg(F.count("*").alias("size")).where("size > 1")
    met, met_path = saved(keyed.join(dealt(full), ["grid", "cell"]), "cells")
    cold = met.where(F.col("size") <= cell)
    pairs = (
        cold.alias("x").join(dealt(cold.alias("y")), ["grid", "cell"]).where("x.fingerprint < y.fingerprint")
        .where(manhattan(F.col("x.counts"), F.col("y.counts")) <= bits)
        .where(F.bit_count(F.col("x.fingerprint").bitwiseXOR(F.col("y.fingerprint"))) <= bits)
        .select(F.col("x.fingerprint").alias("a"), F.col("y.fingerprint").alias("b"))
    )
    hot = met.where(F.col("size") > cell).select("fingerprint").distinct()
    flips = F.array(F.lit(0), *[F.lit((1 << k) - (1 << 64 if k == 63 else 0)) for k in range(64)])
    if bits < 2:  # one at 1 bit: the smaller of the two ends is the neighbour that they share
        flips = F.array(F.lit(0)) if not bits else flips
    near = hot.select("fingerprint", F.explode(F.transform(flips, lambda m: F.col("fingerprint").bitwiseXOR(m))).alias("via"))
    if bits == 1:
        near = near.join(dealt(hot.select(F.col("fingerprint").alias("via"))), "via", "left_semi")
    star = near.groupBy("via").agg(F.min("fingerprint").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = near.join(dealt(star), "via").where("a < fingerprint").select("a", F.col("fingerprint").alias("b"))
    out, _ = saved(pairs.union(links).distinct(), "links")
    drop_path(out.sparkSession, met_path)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2, cell: int = 64) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id.

    component_id is the smallest doc_id that links reach, the row's own included; a link is two fingerprints
    that differ in at most `bits` bits. A null or empty text, or one of white space, has fingerprint zero and
    is linked like any other. Rows that repeat a doc_id each give a row; if their texts differ, the doc_id
    holds both texts' groups together. A row without doc_id links others, and names its group as they do
    (null if no row of the group has one). Columns other than doc_id and text are not read. No rows: no rows.
    """
    rows, path = saved(fingerprints(docs, shingle), "fingerprints")
    points, _ = saved(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "points")
    links = hamming_links(points, bits, cell)
    # nodes are fingerprints, so one that only rows without doc_id have still links others; repeated doc_ids join theirs
    again = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b")).where("a < b").select("doc_id", "a")
    more = rows.join(dealt(again), "doc_id").where("a <> fingerprint").select("a", F.col("fingerprint").alias("b"))
    found = connected_components(links.union(more))
    named = points.join(dealt(found), F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("group"))
    named, _ = saved(named, "named")
    ids, _ = saved(named.groupBy("group").agg(F.min("first").alias("component_id")), "ids")
    out = rows.join(dealt(named.join(dealt(ids), "group").select("fingerprint", "component_id")), "fingerprint")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and groups of all documents; see near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, bits=2)
