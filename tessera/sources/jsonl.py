"""JSON lines: products in, results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Price is text, as it may be a label; details keep the order of their keys.
PRODUCT = "parent_asin string, title string, features array<string>, description string, price string, categories array<string>, details string, average_rating double, rating_number long, store string"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A row for each line that isn't blank; a malformed line is an error if strict, else a row of nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Products with details as an array of key and value, in the order of the file (null if it isn't an object)."""
    keys = F.json_object_keys("details")
    pairs = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.from_json("details", "map<string,string>"), k).alias("value")))
    return read_jsonl(spark, path, PRODUCT).withColumn("details", pairs)


def last_of_each(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last row of each key by ordinal."""
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), ordinal).alias("last")).select(key, "last.*")


def unique_or_fail(rows: DataFrame, key: str) -> DataFrame:
    """rows; reading them fails if a key repeats."""
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).select(F.assert_true(F.max("n") <= 1, F.lit(f"{key} repeats")).alias("ok"))
    # the check is a filter, as an unused column would never be computed; its side is one row
    return rows.join(F.broadcast(twice)).where(F.col("ok").isNull()).drop("ok")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
