"""Fusion, gating, min-max, preference reranking, question utilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.text import phrase_match

RRF = 60.0


def fuse(ranks: DataFrame, weight: float | Column) -> DataFrame:
    """query, id, bm25_rank, cos_rank (either may be null) with score and rank: reciprocal ranks, the second weighing
    `weight`; ties by BM25 rank, then id. An id of the second list alone stays, with score 0 at weight 0."""
    part = lambda w, r: F.coalesce((w if isinstance(w, Column) else F.lit(w)) / (F.lit(RRF) + F.col(r)), F.lit(0.0))
    score = part(F.lit(1.0) - weight, "bm25_rank") + part(weight, "cos_rank")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("bm25_rank").asc_nulls_last(), "id")
    return ranks.withColumn("score", F.round(score, 8)).withColumn("rank", F.row_number().over(order))


def joined_ranks(bm25: DataFrame, cosine: DataFrame) -> DataFrame:
    """Full outer join of (query, id, rank) lists."""
    return bm25.withColumnRenamed("rank", "bm25_rank").join(cosine.withColumnRenamed("rank", "cos_rank"), ["query", "id"], "full_outer")


def gated_weight(confidence: Column, low: float = 0.0, medium: float = 0.0, high: float = 0.05) -> Column:
    return F.when(confidence >= 0.80, high).when(confidence >= 0.45, medium).otherwise(low)


def minmax(score: Column, window) -> Column:
    """-score between 0 and 1 over the window; 1 if all are equal."""
    low, high = F.min(-score).over(window), F.max(-score).over(window)
    return F.when(high == low, 1.0).otherwise((-score - low) / (high - low))


def rerank(candidates: DataFrame) -> DataFrame:
    """The ten best of each query by score (lower is better), reordered by 0.8 x min-max + bonuses of matched preferences,
    three times for hard requirements. Without any preference the order stays."""
    first = Window.partitionBy("query").orderBy("score", "id")
    top = candidates.withColumn("place", F.row_number().over(first)).where("place <= 10")
    hard = lambda f: F.array_contains("hard", f)
    bonus = F.lit(0.0)
    for field, weight in V.SOFT_WEIGHTS.items():
        text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(x), F.lit("")) for x in V.RERANK_FIELDS[field]]))
        hit = F.regexp_like(text, F.concat(F.lit(r"\b(?:size\s*)?\Q"), F.col("size"), F.lit(r"\E\b"))) if field == "size" else phrase_match(text, F.col(field))
        bonus = bonus + F.when(F.col(field).isNotNull() & hit, F.when(hard(field), 3 * weight).otherwise(weight)).otherwise(0.0)
    side = F.when(hard("budget"), 0.09).otherwise(0.03)
    bonus = bonus + F.when(F.col("price").isNull() | F.col("budget").isNull(), 0.0).when(F.col("price") <= F.col("budget"), side).otherwise(-side)
    wanted = [F.col(f).isNotNull() & (F.col(f) != "") for f in V.SOFT_WEIGHTS] + [F.col("budget").isNotNull()]
    any_ = wanted[0]
    for w in wanted[1:]:
        any_ = any_ | w
    whole = Window.partitionBy("query")
    scored = top.withColumn("rank_score", F.when(any_, F.round(0.80 * minmax(F.col("score"), whole) + bonus, 8)))
    order = Window.partitionBy("query").orderBy(F.desc("rank_score"), "place")
    return scored.withColumn("rank", F.row_number().over(order)).select("query", "id", "rank", "rank_score")


def utilities(pool: DataFrame, least: float = 0.08) -> tuple[DataFrame, DataFrame]:
    """pool: query, rank (from 0), attribute, value, known, tags; a row for each distinct value of a candidate, or one with nulls.
    (query, attribute, utility) of the open attributes that cover enough, and (query, attribute, nth, value): the three
    heaviest values of each."""
    weight = 1.0 / F.log2(F.col("rank") + 2.0)
    total = pool.select("query", "rank").distinct().groupBy("query").agg(F.sum(weight).alias("total"))
    held = pool.where("attribute is not null and not known")
    each = Window.partitionBy("query", "rank", "attribute")
    shares = held.withColumn("share", weight / F.count("*").over(each))
    values = shares.groupBy("query", "attribute", "value").agg(F.sum("share").alias("w"), F.first("tags").alias("tags"))
    by = values.groupBy("query", "attribute").agg(F.sum("w").alias("covered"), F.count("*").alias("n"), F.sum(F.col("w") * F.log2("w")).alias("wlogw"), F.first("tags").alias("tags"))
    entropy = F.log2("covered") - F.col("wlogw") / F.col("covered")
    diversity = F.when(F.col("n") > 1, entropy / F.log2(F.col("n").cast("double"))).otherwise(0.0)
    prior, boost = F.lit(None).cast("double"), F.lit(0.0)
    for name, p in V.PRIORS.items():
        prior = F.when(F.col("attribute") == name, p).otherwise(prior)
        overlap = F.arrays_overlap(F.transform("tags", F.lower), F.array(*[F.lit(t) for t in V.PROFILE_TAGS[name]]))
        boost = F.when((F.col("attribute") == name) & overlap, 0.08).otherwise(boost)
    full = by.join(total, "query").withColumn("coverage", F.col("covered") / F.col("total")).where(F.col("coverage") >= least)
    utility = full.select("query", "attribute", F.round(prior * (0.58 * F.col("coverage") + 0.42 * diversity) + boost, 8).alias("utility"))
    nth = F.row_number().over(Window.partitionBy("query", "attribute").orderBy(F.desc(F.round("w", 9)), "value"))
    options = values.join(full.select("query", "attribute"), ["query", "attribute"], "left_semi").withColumn("nth", nth).where("nth <= 3").select("query", "attribute", "nth", "value")
    return utility, options


def next_question(utility: DataFrame) -> DataFrame:
    """(query, attribute): of the highest utility, ties in the fixed order."""
    order = F.array_position(F.array(*[F.lit(a) for a in V.QUESTION_ORDER]), F.col("attribute"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("utility"), order))
    return utility.withColumn("nth", rank).where("nth = 1").select("query", "attribute")


def question_text(attribute: Column, options: Column) -> Column:
    """The question with the first two options of 2 to 28 characters, or the plain one if there are fewer."""
    clean = F.filter(options, lambda o: F.length(o).between(2, 28))
    a, b = F.get(clean, F.lit(0)), F.get(clean, F.lit(1))
    plain = F.lit(None).cast("string")
    for name, prompt in V.PROMPTS.items():
        plain = F.when(attribute == name, prompt).otherwise(plain)
    said = F.when(attribute.isin("material", "color", "brand", "style"), F.concat(F.lit("Do you prefer "), a, F.lit(", "), b, F.lit(", or another "), attribute, F.lit("?")))
    said = said.when(attribute == "feature", F.concat(F.lit("Would "), a, F.lit(", "), b, F.lit(", or another feature matter most?")))
    said = said.when(attribute == "use_case", F.concat(F.lit("Will you mainly use it for "), a, F.lit(", "), b, F.lit(", or something else?")))
    said = said.when(attribute == "budget", F.concat(F.lit("Should I focus on options "), a, F.lit(", "), b, F.lit(", or another budget?")))
    return F.coalesce(F.when(F.size(clean) >= 2, said), plain)
