"""A conversation's turns answered all at once: query, page, two searches, fusion, the next question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vocabulary as V
from tessera.operators import bm25, ranking, tfidf
from tessera.sources.stored import stored

POOL, TOP = 160, 10


def evidence(turns: DataFrame) -> DataFrame:
    """turns: session, turn, text (what the customer said). query_id, session, turn, nth, terms, query, page: the terms of all that was said so far, and how many turns in a row
    have had the same ones before. A session is short, and is one task's window."""
    line = Window.partitionBy("session").orderBy("turn")
    whole = line.rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select("session", "turn", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("session", "turn", F.row_number().over(line).alias("nth"), F.array_join(F.collect_list("text").over(whole), " ").alias("query"))
    rows = rows.withColumn("terms", T.first_terms(F.col("query")))
    new = F.coalesce(F.col("terms") != F.lag("terms").over(line), F.lit(True)).cast("int")
    rows = rows.withColumn("island", F.sum(new).over(line))
    page = F.row_number().over(Window.partitionBy("session", "island").orderBy("turn")) - 1
    return rows.select(F.xxhash64("session", "turn").alias("query_id"), "session", "turn", "nth", "terms", "query", page.alias("page"))


def respond(turns: DataFrame, catalog: DataFrame, top: int = TOP, pool: int = POOL) -> DataFrame:
    """turns: session, turn, text; catalog: id, text. session, turn, page, weight, ask, rank, id, score: a row for each recommendation, one with nulls
    for a turn that finds nothing.

    A turn searches by BM25 and by TF-IDF with all that was said; `pool` of each list, or as many as its page needs, are fused by
    reciprocal ranks, where TF-IDF weighs as much as its best score is sure (gated_weight). The page's `top` are recommended. The
    question is that of the turn's number in the fixed order of slots, `other` when they are through."""
    asked = stored(evidence(turns), "evidence")
    last = asked.agg(F.max("page")).first()[0] or 0
    depth = max(pool, (last + 1) * top)
    terms = asked.select("query_id", F.explode("terms").alias("term"))
    words = bm25.search(catalog, terms, {"text": 1.0}, depth, "id").select(F.col("query_id").alias("query"), "id", "rank")
    fit = tfidf.fitted(catalog.select("id", "text"), "id")
    cosine = stored(tfidf.search_fit(fit, asked.select("query_id", F.col("query").alias("text")), depth, "id", "query_id"), "cosine")
    sure = cosine.where("rank = 1").select(F.col("query_id").alias("query"), F.col("score").alias("sure"))
    lists = ranking.joined_ranks(words, cosine.select(F.col("query_id").alias("query"), "id", "rank"))
    held = asked.select(F.col("query_id").alias("query"), "session", "turn", "nth", "page").join(sure, "query", "left")
    held = held.withColumn("weight", ranking.gated_weight(F.coalesce("sure", F.lit(0.0))))
    fused = ranking.fuse(lists.join(held.select("query", "page", "weight"), "query"), F.col("weight"))
    page = fused.where((F.col("rank") > F.col("page") * top) & (F.col("rank") <= (F.col("page") + 1) * top)).select("query", "rank", "id", "score")
    order = F.array(*[F.lit(a) for a in [*V.SLOT_ORDER, "other"]])
    ask = F.get(order, F.least("nth", F.lit(len(V.SLOT_ORDER) + 1)) - 1)
    return held.join(page, "query", "left").select("session", "turn", "page", "weight", ask.alias("ask"), "rank", "id", "score")
