"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of an Arrow batch; texts are long, and a batch is held whole by the JVM and by Python.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20
#: Bits of marked(), 2 MB for each executor whatever the ids.
MARKS = 1 << 24


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may fall back on a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def saved(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written as Parquet and read again: the lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dealt(df: DataFrame) -> DataFrame:
    """df, to be joined by dealing out both sides, never as a broadcast: Spark takes a saved table to be as large as its files, which
    may hold far more than a driver's memory once they are rows."""
    return df.hint("merge")


def marked(df: DataFrame, key: Column, ids: DataFrame, id_: str, name: str) -> DataFrame:
    """df with a boolean column of this name: true where key may be one of ids, and surely where it is. What is false needs no join with ids, so
    long texts aren't dealt out for the sake of a few. With more ids than bits it is true more often, and costs what the join costs."""

    def bit(of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(MARKS)) + 1

    at, bits = unused_name(df, "bucket"), unused_name(df, "bits")
    held = ids.groupBy(F.bitmap_bucket_number(bit(F.col(id_))).alias(at)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit(F.col(id_)))).alias(bits))
    place = F.bitmap_bit_position(bit(key))
    byte = F.conv(F.hex(F.substring(F.col(bits), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    own = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    rows = df.withColumn(at, F.bitmap_bucket_number(bit(key))).join(F.broadcast(held), at, "left")
    return rows.withColumn(name, own).drop(at, bits)


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the rows and bytes of an Arrow batch for this session, unless the session already has a smaller bound. A text longer than the
    bound is a batch of its own."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    held = spark.conf.get(size).rstrip("b")
    if not held.isdigit() or not 0 < int(held) <= ARROW_BYTES:
        spark.conf.set(size, str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def unused_name(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def map_batches(df: DataFrame, run, extra: tuple[str, ...] = ()) -> DataFrame:
    """df.mapInArrow(run) with the columns of df but the extra ones, which come last and which run takes away. Columns go by their places, as
    names may clash or hold points."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    kept = df.columns[: len(df.columns) - len(extra)]
    return plain.mapInArrow(run, StructType(plain.schema.fields[: len(kept)])).toDF(*kept)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that are no longer held, which else stay until the
    driver happens to collect garbage. Twice, as what the first round frees may hold more, and the cleaner has its own thread."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
