"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, survivors recomputed exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import saved, table

#: Rows at most of a block of queries and of candidates; queries and candidates of one product tile.
QUERY_ROWS, ROWS, QUERY_TILE, TILE = 16384, 65536, 1024, 2048
SLACK = 1e-6
CODED = "vec_id long, d int, codes binary, scale double, rest double"
OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, only finite components, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 forms of vectors: v / |v| = scale x codes + a rest whose length is known."""
    unit = v / np.abs(v).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1, initial=0) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def coded(rows: DataFrame) -> DataFrame:
    """vec_id, d (length), codes, scale, rest of rows vec_id, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b.column(1).value_lengths())
            for d in np.unique(size):
                part = b.filter(pa.array(size == d))
                codes, scale, rest = encode(np.asarray(part.column(1).flatten()).reshape(-1, d))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(part), d, np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(rest)], ["vec_id", "d", "codes", "scale", "rest"])

    return rows.mapInArrow(run, CODED)


class Block:
    """Coded vectors of one length."""

    def __init__(self, t: pa.Table) -> None:
        self.ids, self.scale, self.rest = (np.asarray(t.column(k)) for k in ("vec_id", "scale", "rest"))
        self.codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int8).reshape(len(t), -1)


def survivors(q: Block, c: Block, k: int) -> pa.Table:
    """Pairs that may be among the k nearest of c to each of q by cosine, own ids left out, with bounds of the cosine.

    A tile's int8 products give each cosine within |rest_q| + (1 + |rest_q|) |rest_c|. A pair survives if its upper bound
    reaches the k-th best lower bound of the block."""
    kind = np.float32 if q.codes.shape[1] <= 1024 else np.float64  # products of codes are whole numbers, exact in these
    out = [OUT.empty_table()]
    for first in range(0, len(q.ids), QUERY_TILE):
        r = slice(first, first + QUERY_TILE)
        left, floor, held = q.codes[r].astype(kind), np.full((len(q.ids[r]), k), -np.inf), []
        for at in range(0, len(c.ids), TILE):
            s = slice(at, at + TILE)
            near = (left @ c.codes[s].astype(kind).T).astype(np.float64) * (q.scale[r][:, None] * c.scale[s])
            bound = q.rest[r][:, None] + (1 + q.rest[r][:, None]) * c.rest[s] + SLACK
            own = q.ids[r][:, None] == c.ids[s]
            low = np.where(own, -np.inf, near - bound)
            floor = np.partition(np.concatenate([floor, low], axis=1), -k, axis=1)[:, -k:]
            i, j = np.nonzero((near + bound >= floor[:, :1]) & ~own)
            held.append((i, at + j, low[i, j], near[i, j] + bound[i, j]))
        i, j, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
        keep = high >= floor[i, 0]
        out.append(pa.table(dict(zip(OUT.names, (q.ids[r][i[keep]], c.ids[j[keep]], low[keep], high[keep]), strict=True)), OUT))
    return pa.concat_tables(out)


def nearest(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of the largest cosine to each row that `queries` selects.

    vectors: vec_id, embedding. Vectors that are null or zero, or hold null or non-finite components, take no part,
    nor do rows without vec_id; vectors of different lengths aren't compared. Of rows that repeat a vec_id, one takes
    part: that with the smallest embedding. The score is the cosine in double precision of the vectors as given.
    Ties go to the smaller vec_id. Fewer candidates than k give fewer rows; no rows: no rows. Other columns are not read.

    Queries and candidates are dealt into blocks of bounded size by a hash of vec_id, and each pair of blocks is
    one task's work on int8 codes, which are all that is sent for it. Pairs that survive the bounds of their block, and then those of all blocks, get
    their vectors back and are computed exactly. Of equal vectors only the k + 1 smallest vec_ids are candidates, as no
    more can be among the nearest; so a vector that very many rows have makes no more pairs.
    """
    clean = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    rows, _ = saved(clean.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    twins = Window.partitionBy(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")).orderBy("vec_id")
    kept = rows.withColumn("twin", F.row_number().over(twins)).where(F.col("twin") <= k + 1).select("vec_id", "v")
    found, _ = saved(coded(kept), "candidates")
    asked, _ = saved(coded(rows.where(queries)), "queries")
    n, m, cores = found.count(), asked.count(), vectors.sparkSession.sparkContext.defaultParallelism
    down = max(1, -(-m // QUERY_ROWS))
    across = max(1, -(-n // ROWS), min(-(-n // TILE), 2 * cores // down))
    place = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = asked.select("*", place(down).alias("i"), all_of(across).alias("j"))
    right = found.select("*", place(across).alias("j"), all_of(down).alias("i"))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        return survivors(Block(a), Block(b), k) if len(a) and len(b) else OUT.empty_table()

    keys = ("d", "i", "j")
    # a given number of partitions, as AQE would join those of few bytes though their work is long
    dealt = (df.repartition(min(down * across, 100_000), *keys).groupBy(*keys) for df in (left, right))
    pairs, _ = saved(next(dealt).cogroup(next(dealt)).applyInArrow(tile, "query_id long, vec_id long, low double, high double"), "survivors")
    by_low = Window.partitionBy("query_id").orderBy(F.desc("low"))
    floor = pairs.withColumn("n", F.row_number().over(by_low)).where(F.col("n") <= k).groupBy("query_id").agg(F.min(F.when(F.col("n") == k, F.col("low"))).alias("floor"))
    left_ = pairs.join(floor, "query_id").where(F.coalesce(F.col("high") >= F.col("floor"), F.lit(True))).select("query_id", "vec_id")
    both = left_.join(rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").join(rows, "vec_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    score = dot("q", "v") / (F.sqrt(dot("q", "q")) * F.sqrt(dot("v", "v")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return both.select("query_id", "vec_id", score.alias("score")).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark, sf_dir: str) -> DataFrame:
    """The five nearest of all embeddings to each whose id is divisible by 50; see nearest()."""
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, min(v) AS v FROM v GROUP BY vec_id),
n AS (SELECT vec_id, v, list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b) AS n2 FROM u),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) / (sqrt(q.n2) * sqrt(c.n2)) AS score
      FROM n q, n c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
