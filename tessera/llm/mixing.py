"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import columns_of, saved, table

SEED = 17
TEMPERATURE = 0.5
OWN = ("copy", "repetition_rate", "shuffle_key")
#: A larger rate is drawn as the sum of so many equal ones, each of this rate at most, so that no table of probabilities is long.
MOST_RATE = 200


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, total: float | None = None) -> DataFrame:
    """(mix_source, rate, parts, cdf) of each source: its mean repetition rate, and the cumulative Poisson probabilities of rate / parts.

    A source's rate is weight x total / size, sizes in characters. Without weights, they are in proportion to
    size ** temperature. total is the characters to come out, as many as went in if None. A source
    without a character has rate 1; one that given weights don't name has rate 0.
    """
    sizes, _ = saved(docs.groupBy(F.col("source").alias("mix_source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size")), "sources")
    size = F.col("size")
    if weights is None:
        weight = F.pow(size, F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    whole, share = sizes.agg(F.sum("size"), F.sum(F.when(size > 0, weight))).first()
    target = F.lit(float(total if total is not None else whole or 0.0))
    rate = F.when(size > 0, weight / F.lit(float(share or 1.0)) * target / size).otherwise(F.lit(1.0))
    parts = F.greatest(F.ceil(F.col("rate") / MOST_RATE), F.lit(1)).cast("int")
    own = F.col("rate") / F.col("parts")
    # logarithms of the probabilities, so that none is too small
    top = F.ceil(own + 12 * F.sqrt(own) + 20).cast("int")
    start = F.struct((-own).alias("log"), F.exp(-own).alias("below"), F.array(F.exp(-own)).alias("all"))

    def step(acc, k):
        log = acc["log"] + F.log(own / k)
        below = acc["below"] + F.exp(log)
        return F.struct(log.alias("log"), below.alias("below"), F.concat(acc["all"], F.array(below)).alias("all"))

    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(1), top), start, step)["all"]).otherwise(F.array(F.lit(1.0)))
    return sizes.select("mix_source", rate.alias("rate")).select("mix_source", "rate", parts.alias("parts")).select("mix_source", "rate", "parts", cdf.alias("cdf"))


def uniform(text: Column) -> Column:
    """A number in [0, 1) by the hash of a text."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, total: float | None = None, seed: int = SEED) -> DataFrame:
    """docs, each row as often as its Poisson count says, shuffled globally; with copy (from 1), repetition_rate
    and shuffle_key.

    The count inverts the Poisson distribution of the source's rate at a uniform number hashed from seed and
    doc_id, so a rerun or a retried task draws the same; a rate over MOST_RATE is the sum of several such draws. Rows that repeat a doc_id are drawn alike; a null
    doc_id is hashed as the word null; a null source is a source of its own. Null and empty texts are drawn as
    others are. Columns of docs named as the three new ones are replaced, all others are kept whatever their names. No rows: no rows.

    The rates are a table of one row a source, which Spark broadcasts if it is below its threshold; a source with
    most of the rows meets no single task, as rows are dealt by a hash of (doc_id, copy). Each task's
    rows come sorted by shuffle_key, a second hash of the same.
    """
    rates, _ = saved(source_rates(docs, weights, temperature, total), "rates")
    kept = [c for c in docs.columns if c not in OWN]
    # the input is one column, so that none of its names can clash
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), F.col("source").alias("source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("name"))
    rows = rows.join(rates, F.col("source").eqNullSafe(F.col("mix_source")))
    name = F.concat(F.lit(f"{seed}:"), F.col("name"))
    # cumulative probabilities ascend, so those at or below the uniform number come first
    below = lambda u: F.size(F.filter("cdf", lambda c: u >= c))
    more = F.aggregate(F.sequence(F.lit(2), F.col("parts")), F.lit(0), lambda n, k: n + below(uniform(F.concat(name, F.lit(":part"), k.cast("string")))))
    count = below(uniform(name)) + F.when(F.col("parts") > 1, more).otherwise(0)
    drawn = rows.withColumn("mix_count", count).where("mix_count > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix_count"))))
    key = F.md5(F.concat(name, F.lit(":"), F.col("copy").cast("string")))
    out = drawn.select("row", "copy", F.round("rate", 9).alias("repetition_rate"), key.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select(*[F.col("row").getField(c).alias(c) for c in kept], *OWN)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed by the square roots of their sources' sizes; see mix()."""
    return mix(table(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH sizes AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source),
whole AS (SELECT sum(size) AS total, sum(CASE WHEN size > 0 THEN pow(size, CAST(0.5 AS DOUBLE)) END) AS share FROM sizes),
all_rates AS (SELECT source, CASE WHEN size > 0 THEN pow(size, CAST(0.5 AS DOUBLE)) / share * total / size ELSE 1.0 END AS rate FROM sizes, whole),
rates AS (SELECT source, rate, greatest(CAST(ceil(rate / {MOST_RATE}) AS INTEGER), 1) AS parts, rate / greatest(ceil(rate / {MOST_RATE}), 1) AS own FROM all_rates),
terms AS (SELECT source, rate, parts, k, sum(exp(-own + k * ln(own) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below
          FROM rates, range(0, 400) r(k) WHERE k <= ceil(own + 12 * sqrt(own) + 20)),
tables AS (SELECT source, rate, parts, list(below ORDER BY k) AS cdf FROM terms GROUP BY source, rate, parts),
drawn AS (SELECT d.*, t.rate, CAST(list_sum(list_transform(range(1, t.parts + 1), lambda p: len(list_filter(t.cdf, lambda c: CAST(('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || CASE WHEN p > 1 THEN ':part' || CAST(p AS VARCHAR) ELSE '' END), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) >= c)))) AS BIGINT) AS n
          FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, text, lang, source, n_chars, CAST(c AS INTEGER) AS copy, round(rate, 9) AS repetition_rate,
       md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(c AS VARCHAR)) AS shuffle_key
FROM drawn, LATERAL (SELECT unnest(range(1, n + 1)) AS c)
"""
