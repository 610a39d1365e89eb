"""Tables kept between steps in the shared folder, and artifacts that are checked when they are loaded."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir; a temporary one under a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet and read again: it is computed once, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_artifact(path: str, tables: dict[str, DataFrame], version: int = VERSION, **facts: str) -> None:
    """Writes the tables below path, then one row that tells the version, the rows of each table and other facts. The row
    comes last, so an artifact that was not finished can't be loaded."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, spark.read.parquet(f"{path}/{name}").count()))
    meta = spark.createDataFrame([(version, dict(rows), {k: str(v) for k, v in facts.items()})], "version int, counts map<string,long>, facts map<string,string>")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_artifact(spark: SparkSession, path: str, version: int = VERSION, **facts: str) -> dict[str, DataFrame]:
    """The tables of an artifact. Another version, a table whose rows aren't as many as were written, or a fact that differs is an error."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta.version != version:
        raise ValueError(f"{path} has version {meta.version}, not {version}")
    for name, value in facts.items():
        if meta.facts.get(name) != str(value):
            raise ValueError(f"{path} was made with {name} = {meta.facts.get(name)}, not {value}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in meta.counts}
    for name, df in tables.items():
        n = df.agg(F.count("*")).first()[0]
        if n != meta.counts[name]:
            raise ValueError(f"{path}/{name} has {n} rows, not {meta.counts[name]}")
    return tables
