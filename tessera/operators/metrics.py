"""Session metrics, fold summaries, retrieval and classifier metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISS_TURN = 11


def session_metrics() -> list[Column]:
    """Aggregates over outcomes (hit_turn and best_rank are null for a miss); half-even rounding to 6 digits."""
    return [
        F.count("*").alias("sample_count"),
        F.bround(F.coalesce(F.avg(F.when(F.col("hit_turn").isNotNull(), 1.0).otherwise(0.0)), F.lit(0.0)), 6).alias("hit_rate_at_10"),
        F.bround(F.coalesce(F.avg(F.coalesce(1.0 / F.col("best_rank"), F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"),
        F.bround(F.avg(F.coalesce("hit_turn", F.lit(MISS_TURN)).cast("double")), 6).alias("mttc"),
    ]


def score_of(hit: Column, mrr: Column, mttc: Column) -> Column:
    """The technical score of three metrics, to 6 digits."""
    return F.bround(0.50 * hit + 0.30 * mrr + 0.20 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (11.0 - mttc) / 10.0)), 6)


def with_score(summary: DataFrame) -> DataFrame:
    """Adds efficiency and technical_score, from the rounded metrics."""
    efficiency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (11.0 - F.col("mttc")) / 10.0))
    score = 0.50 * F.col("hit_rate_at_10") + 0.30 * F.col("mrr") + 0.20 * efficiency
    return summary.withColumn("efficiency", F.bround(efficiency, 6)).withColumn("technical_score", F.bround(score, 6))


#: Steps of a score that are one range of the area's sums.
STEPS = 4096


def brier_logloss_auc(rows: DataFrame) -> DataFrame:
    """rows: p, y. One row: accuracy, log_loss, brier, roc_auc (ties count half; null for one class), positive_rate. Distinct scores are counted and dealt into
    STEPS ranges; the sums over ranges are one small sorted table, and those within a range are its own window, so no single
    task sorts the rows."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1 - 1e-15))
    y = F.col("y").cast("double")
    base = rows.agg(
        F.round(F.avg(F.when((F.col("p") >= 0.5) == (F.col("y") == 1), 1.0).otherwise(0.0)), 6).alias("accuracy"),
        F.round(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))), 6).alias("log_loss"),
        F.round(F.avg((F.col("p") - y) * (F.col("p") - y)), 9).alias("brier"), F.round(F.avg(y), 6).alias("positive_rate"),
    )
    by = rows.groupBy("p").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")).withColumn("step", F.least(F.floor(F.col("p") * STEPS), F.lit(STEPS - 1)))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = by.groupBy("step").agg(F.sum("neg").alias("whole"))
    ranges = ranges.select("step", F.coalesce(F.sum("whole").over(earlier.orderBy("step")), F.lit(0.0)).alias("before"))
    own = F.coalesce(F.sum("neg").over(earlier.partitionBy("step").orderBy("p")), F.lit(0.0))
    auc = by.withColumn("own", own).join(ranges, "step").agg(F.try_divide(F.sum(F.col("pos") * (F.col("before") + F.col("own") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))
    return base.join(F.broadcast(auc.select(F.round("auc", 6).alias("roc_auc"))))
