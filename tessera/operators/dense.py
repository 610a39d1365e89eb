"""Exact dense search by blocks of queries and candidates, a saved index, and the hook for an encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.stored import load_artifact, save_artifact

QUERY_ROWS, ROWS, TILE = 1024, 16384, 2048
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(t: pa.Table) -> np.ndarray:
    return np.asarray(t.column("v").combine_chunks().flatten()).reshape(len(t), -1)


def best_of_block(q: pa.Table, c: pa.Table, k: int) -> pa.Table:
    """The k largest dot products of each query with the candidates, own ids left out; ties to 6 digits by id."""
    if not len(q) or not len(c):
        return FOUND.empty_table()
    queries, ids, qids = _matrix(q), np.asarray(c.column("vec_id")), np.asarray(q.column("vec_id"))
    vectors, out = _matrix(c), []
    for at in range(0, len(ids), TILE):
        dots = queries @ vectors[at : at + TILE].T
        own = np.where(qids[:, None] == ids[at : at + TILE], -np.inf, np.round(dots, 6))
        top = np.sort(np.partition(own, -min(k, own.shape[1]), axis=1)[:, -min(k, own.shape[1]) :], axis=1)[:, :1]
        i, j = np.nonzero((own >= top) & (own > -np.inf))
        part = pd.DataFrame({"query_id": qids[i], "vec_id": ids[at + j], "score": dots[i, j], "shown": own[i, j]})
        out.append(part.sort_values(["query_id", "shown", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k).drop(columns="shown"))
    return pa.Table.from_pandas(pd.concat(out), FOUND, preserve_index=False)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """vectors, queries: vec_id, v (array<double> of one length). query_id, vec_id, score (dot product to 6 digits), rank; own ids are left out and ties
    go to the smaller id. k of 0 or less finds nothing.

    Queries and candidates are dealt into blocks of bounded size by a hash of vec_id; a pair of blocks is one task's matrix product, from
    which k rows a query come out."""
    spark = vectors.sparkSession
    if k <= 0:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    cores = spark.sparkContext.defaultParallelism
    down = max(1, -(-queries.count() // QUERY_ROWS))
    across = max(1, -(-(n := vectors.count()) // ROWS), min(-(-n // TILE), 2 * cores // down))
    place = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = queries.select("vec_id", "v", place(down).alias("i"), every(across).alias("j"))
    # new columns, as both sides may come from one table
    right = vectors.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v"), place(across).alias("j"), every(down).alias("i"))
    dealt = [df.repartition(down * across, "i", "j").groupBy("i", "j") for df in (left, right)]
    found = dealt[0].cogroup(dealt[1]).applyInArrow(lambda q, c: best_of_block(q, c, k), "query_id long, vec_id long, score double").withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def encoded(rows: DataFrame, encode: Callable[[list[str]], np.ndarray], key: str, text: str = "text", batch: int = 64) -> DataFrame:
    """key, v: unit vectors of texts by `encode`, a function of a list of texts to a matrix, called for `batch` of them at a time where the rows are. Null and blank texts have no row; a
    zero vector stays zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.slice(at, batch)
                m = np.asarray(encode(part.column(1).to_pylist()), np.float32)
                size = np.linalg.norm(m, axis=1, keepdims=True)
                unit = (m / np.where(size == 0, 1, size)).astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * unit.shape[1]), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, "v"])

    kept = rows.where(F.btrim(F.col(text)) != "").select(F.col(key).cast("long"), text)
    return kept.mapInArrow(run, f"{key} long, v array<double>")


def save_vectors(vectors: DataFrame, path: str, encoder: str) -> None:
    """Writes vec_id, v with the name of the encoder that made them."""
    save_artifact(path, {"vectors": vectors.select("vec_id", "v")}, encoder=encoder)


def load_vectors(spark: SparkSession, path: str, encoder: str) -> DataFrame:
    """Vectors of another encoder, or not all of them, are an error."""
    return load_artifact(spark, path, encoder=encoder)["vectors"]
