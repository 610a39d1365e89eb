"""Trained models: the router of conversations and the calibrator of retrieval confidence."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import hash_fraction
from tessera.operators.tfidf import grams

WIDTH = 1 << 15
FEATURES = ("top1", "gap2", "gap10", "mean10", "turn", "terms")


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """Adds weight: rows / (labels x rows of the label). Labels are counted, and joined as the small table that counts are."""
    by = rows.groupBy(label).agg(F.count("*").alias("own"))
    n, kinds = by.agg(F.sum("own"), F.count("*")).first()
    return rows.join(by, label).withColumn("weight", F.lit(float(n or 0)) / (F.lit(float(kinds or 1)) * F.col("own"))).drop("own")


def split_by_group(rows: DataFrame, group: str, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(train, validation): all rows of a group fall on one side."""
    held = hash_fraction(F.col(group).cast("string")) < share
    return rows.where(~held), rows.where(held)


def fit_router(rows: DataFrame, text: str = "prefix", label: str = "label"):
    """Multinomial logistic regression on hashed words and pairs, labels balanced. The model adds prediction, probability."""
    terms = rows.withColumn("grams", grams(F.col(text)))
    stages = [StringIndexer(inputCol=label, outputCol="target", stringOrderType="alphabetAsc"), HashingTF(inputCol="grams", outputCol="counts", numFeatures=WIDTH), IDF(inputCol="counts", outputCol="features", minDocFreq=2), LogisticRegression(labelCol="target", weightCol="weight", maxIter=30, regParam=1e-3)]
    return Pipeline(stages=stages).fit(balanced(terms, label))


def route(model, rows: DataFrame, text: str = "prefix") -> DataFrame:
    """rows with model_mode and model_p."""
    from pyspark.ml.functions import vector_to_array

    names = F.array(*[F.lit(n) for n in model.stages[0].labels])
    out = model.transform(rows.withColumn("grams", grams(F.col(text))))
    p = vector_to_array("probability")
    return out.select(*rows.columns, F.element_at(names, F.col("prediction").cast("int") + 1).alias("model_mode"), F.round(F.array_max(p), 6).alias("model_p"))


def fit_calibrator(rows: DataFrame, least: int = 100):
    """rows: FEATURES, hit (0 or 1). Logistic regression, balanced, C = 0.5. Fewer than `least` rows, or one class, is an error."""
    n, kinds = rows.agg(F.count("*"), F.countDistinct("hit")).first()
    if n < least or kinds < 2:
        raise ValueError(f"{n} rows of {kinds} classes can't calibrate")
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    return Pipeline(stages=[assemble, LogisticRegression(labelCol="hit", weightCol="weight", standardization=False, regParam=2.0 / n)]).fit(balanced(rows, "hit"))


def prefixes_of(turns: DataFrame) -> DataFrame:
    """Text so far of each turn of (session, turn, text)."""
    line = Window.partitionBy("session").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("prefix", F.array_join(F.collect_list("text").over(line), " "))
