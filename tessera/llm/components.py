"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import dealt, drop_path, saved

MAX_ROUNDS = 60


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: longs a, b. Returns (node, component) for every node that is not the smallest of its component.

    Self loops, repeated edges and edges with a null end are ignored; an empty table gives no rows. Each
    round aggregates before it shuffles (a minimum for each node) and joins that minimum back, so a node
    with very many neighbours is no single task's group. The minima are written and read again before the join: AQE
    splits its hot side only where both sides are dealt out for the join. Tables go to the shared folder; only two
    numbers for each round come to the driver.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, path = saved(e, "components")
    spark, mark = e.sparkSession, None
    now = _mark(e)
    for _ in range(MAX_ROUNDS):
        if now == mark or not now[0]:
            break
        mark = now
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v"), F.col("u")))
        least, least_path = saved(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
        large, large_path = saved(both.where("y > x").join(dealt(least), "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "large")
        root, root_path = saved(large.groupBy("u").agg(F.min("v").alias("m")), "root")
        rest = large.join(dealt(root), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, new_path = saved(rest.union(root.select("u", F.col("m").alias("v"))).distinct(), "components")
        for used in (least_path, large_path, root_path):
            drop_path(spark, used)
        drop_path(spark, path)
        e, path, now = new, new_path, _mark(new)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
