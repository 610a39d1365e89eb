"""Queries of retrieval, ranking and metrics, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vocabulary as V
from tessera.operators import agent, bm25, dense, metrics, ranking, synthesis, tfidf
from tessera.plans.fixtures import CANDIDATES, OUTCOMES, POOL, PREDICTIONS, PRODUCTS, RANKED
from tessera.plans.text_queries import product_sql, q, squeeze_sql, terms_sql, words
from tessera.sources import jsonl
from tessera.sources.stored import shared_dir

QUERIES: dict = {}
SQL: dict = {}
FIELDS = {"text": 6.0, "source": 3.0, "lang": 1.0}
c = F.col


def add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def asked(spark, d):
    return read(spark, d, "benchmark").select(c("item_id").alias("query_id"), F.explode(T.first_terms(c("text"))).alias("term"))


TOKENS = lambda x: f"regexp_extract_all(lower(strip_accents(coalesce({x}, ''))), '[\\p{{L}}\\p{{N}}]+')"
POST = "(" + " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, CAST({w} AS DOUBLE) AS weight, unnest({TOKENS(f)}) AS term FROM documents" for f, w in FIELDS.items()) + ")"
SIZES = "(SELECT doc_id, " + " + ".join(f"len({TOKENS(f)})" for f in FIELDS) + " AS size FROM documents)"
ASKED = f"(SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, term, row_number() OVER (PARTITION BY item_id ORDER BY min(pos)) AS n FROM (SELECT item_id, unnest({terms_sql('text')}) AS term, unnest(range(len({terms_sql('text')}))) AS pos FROM benchmark) GROUP BY item_id, term) WHERE n <= {V.MAX_TERMS})"
BM25 = f"""WITH post AS {POST}, sizes AS {SIZES}, asked AS {ASKED}, st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(size AS DOUBLE)) AS mean FROM sizes),
f AS (SELECT doc_id, term, sum(weight) AS f FROM post WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term), h AS (SELECT term, CAST(count(*) AS DOUBLE) AS h FROM f GROUP BY term),
s AS (SELECT query_id, doc_id, round(-sum(CASE WHEN ln((n - h + CAST(0.5 AS DOUBLE)) / (h + CAST(0.5 AS DOUBLE))) > 0 THEN ln((n - h + CAST(0.5 AS DOUBLE)) / (h + CAST(0.5 AS DOUBLE))) ELSE CAST(1e-6 AS DOUBLE) END
  * f * CAST(2.2 AS DOUBLE) / (f + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * size / mean))), 6) AS score
  FROM f JOIN h USING (term) JOIN asked USING (term) JOIN sizes USING (doc_id), st GROUP BY query_id, doc_id)
"""
add("bm25_topk", lambda s, d: bm25.search(read(s, d, "documents"), asked(s, d), FIELDS), BM25 + "SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score, doc_id) QUALIFY rank <= 10")
add("inverted_index", lambda s, d: bm25.inverted_index(read(s, d, "documents"), FIELDS), f"SELECT doc_id, field, term, count(*) AS tf FROM {POST} GROUP BY ALL")
add("corpus_stats", lambda s, d: bm25.corpus_stats(read(s, d, "documents"), FIELDS).select("docs", F.round("mean_size", 6).alias("mean_size")), f"SELECT count(*) AS docs, round(avg(CAST(size AS DOUBLE)), 6) AS mean_size FROM {SIZES}")
add("fts_match", lambda s, d: bm25.postings(read(s, d, "documents"), FIELDS).join(asked(s, d), "term").select("query_id", "doc_id").distinct(), f"SELECT DISTINCT query_id, doc_id FROM {POST} JOIN {ASKED} USING (term)")
GRAMS = lambda t, k: f"(WITH g AS (SELECT {k}, regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM {t}) SELECT {k}, term, count(*) AS tf FROM (SELECT {k}, unnest(w) AS term FROM g UNION ALL SELECT {k}, w[i] || ' ' || w[i + 1] FROM g, LATERAL (SELECT unnest(range(1, len(w))) AS i)) GROUP BY ALL)"
VOC = lambda t, n: f"(SELECT term, ln((1 + CAST((SELECT count(*) FROM {n}) AS DOUBLE)) / (1 + count(*))) + 1 AS idf FROM {t} GROUP BY term HAVING count(*) >= 2 AND count(*) <= CAST(0.995 AS DOUBLE) * (SELECT count(*) FROM {n}) ORDER BY sum(tf) DESC, term LIMIT 60000)"
WEIGHTS = lambda t, v, k: f"(SELECT {k}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {k})) AS w FROM (SELECT {k}, term, (1 + ln(tf)) * idf AS raw FROM {t} JOIN {v} USING (term)))"


def tfidf_weights(s, d):
    rows = read(s, d, "benchmark")
    tf = tfidf.counts(rows, "item_id")
    return tfidf.weights(tf, tfidf.vocabulary(tf, rows.count()), "item_id").select("item_id", "term", F.round("w", 6).alias("w"))


add("tfidf_weights", tfidf_weights, f"WITH tf AS {GRAMS('benchmark', 'item_id')}, v AS {VOC('tf', 'benchmark')} SELECT item_id, term, round(w, 6) AS w FROM {WEIGHTS('tf', 'v', 'item_id')}")
add("tfidf_cosine", lambda s, d: tfidf.cosine_search(read(s, d, "documents").select("doc_id", "text"), read(s, d, "benchmark")),
    f"WITH tf AS {GRAMS('documents', 'doc_id')}, v AS {VOC('tf', 'documents')}, a AS {WEIGHTS('tf', 'v', 'doc_id')}, tq AS {GRAMS('benchmark', 'item_id')}, b AS {WEIGHTS('tq', 'v', 'item_id')}, s AS (SELECT item_id, doc_id, round(sum(a.w * b.w), 6) AS score FROM a JOIN b USING (term) GROUP BY ALL) SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM s WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 10")
#: The query set of dense search: every row whose id this divides.
EACH = 100


def dense_topk(s, d):
    """The ten best dot products of each vector whose id is divisible by 100 with all others."""
    rows = read(s, d, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("v"))
    return dense.search(rows, rows.where(c("vec_id") % EACH == 0))


add("dense_topk", dense_topk, f"WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_reduce(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]), lambda x, y: x + y), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EACH} = 0) SELECT query_id, vec_id, score, CAST(row_number() OVER w AS INTEGER) AS rank FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10")


def recall_at_k(s, d):
    """Recall at 1, 5 and 10 and MRR of the labels of nearest vectors against the query's own."""
    rows = read(s, d, "embeddings")
    top = dense_topk(s, d).join(rows.select("vec_id", "label"), "vec_id").join(rows.select(c("vec_id").alias("query_id"), c("label").alias("own")), "query_id")
    first = top.groupBy("query_id").agg(F.min(F.when(c("label") == c("own"), c("rank"))).alias("first"))
    at = lambda k: F.round(F.avg(F.when(c("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    return first.agg(at(1), at(5), at(10), F.round(F.avg(F.coalesce(1.0 / c("first"), F.lit(0.0))), 6).alias("mrr"))


add("recall_at_k", recall_at_k, f"WITH t AS ({SQL['dense_topk']}), f AS (SELECT query_id, min(CASE WHEN e.label = o.label THEN rank END) AS first FROM t JOIN embeddings e USING (vec_id) JOIN embeddings o ON o.vec_id = query_id GROUP BY query_id) SELECT " + ", ".join(f"round(avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}" for k in (1, 5, 10)) + ", round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM f")
R = RANKED.sql()
RRF = lambda w: f"coalesce(CAST({1 - w} AS DOUBLE) / (60 + bm25_rank), 0) + coalesce(CAST({w} AS DOUBLE) / (60 + cos_rank), 0)"


def rrf(s, d):
    r = RANKED.spark(s)
    left, right = (r.where(f"{x} is not null").select("query", "id", c(x).alias("rank")) for x in ("bm25_rank", "cos_rank"))
    return ranking.fuse(ranking.joined_ranks(left, right), 0.05)


add("rrf_fusion", rrf, f"SELECT query, id, bm25_rank, cos_rank, round({RRF(0.05)}, 8) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY round({RRF(0.05)}, 8) DESC, bm25_rank NULLS LAST, id) AS INTEGER) AS rank FROM {R}")
add("candidate_union", lambda s, d: (r := RANKED.spark(s)).where("bm25_rank is not null").select("query", "id").union(r.where("cos_rank is not null").select("query", "id")).distinct(), f"SELECT query, id FROM {R} WHERE bm25_rank IS NOT NULL UNION SELECT query, id FROM {R} WHERE cos_rank IS NOT NULL")
add("gated_weight", lambda s, d: PREDICTIONS.spark(s).select("id", ranking.gated_weight(c("p")).alias("weight")), f"SELECT id, CAST(CASE WHEN p >= 0.8 THEN 0.05 ELSE 0.0 END AS DOUBLE) AS weight FROM {PREDICTIONS.sql()}")
C = CANDIDATES.sql()
add("minmax_norm", lambda s, d: CANDIDATES.spark(s).select("query", "id", F.round(ranking.minmax(c("score"), Window.partitionBy("query")), 8).alias("norm")), f"SELECT query, id, round(CASE WHEN max(-score) OVER w = min(-score) OVER w THEN 1.0 ELSE (-score - min(-score) OVER w) / (max(-score) OVER w - min(-score) OVER w) END, 8) AS norm FROM {C} WINDOW w AS (PARTITION BY query)")
hay = lambda fs: "lower(" + " || ' ' || ".join(f"coalesce({f}, '')" for f in fs) + ")"
bare = lambda f: f"trim(regexp_replace(trim(lower({f})), '^for that,\\s*what matters is:\\s*', ''), ' .')"
hit = lambda f: f"regexp_matches({hay(V.RERANK_FIELDS[f])}, '\\b(?:size\\s*)?' || regexp_escape(size) || '\\b')" if f == "size" else f"len(list_filter(list_transform(string_split({bare(f)}, ';'), lambda p: trim(p, ' .')), lambda p: p <> '' AND regexp_matches({hay(V.RERANK_FIELDS[f])}, '\\b' || regexp_escape(p) || '\\b'))) > 0"
BONUS = " + ".join(f"CASE WHEN {f} IS NOT NULL AND {hit(f)} THEN CASE WHEN list_contains(hard, '{f}') THEN CAST({3 * w} AS DOUBLE) ELSE CAST({w} AS DOUBLE) END ELSE 0 END" for f, w in V.SOFT_WEIGHTS.items())
SIDE = "CASE WHEN list_contains(hard, 'budget') THEN CAST(0.09 AS DOUBLE) ELSE CAST(0.03 AS DOUBLE) END"
WANTED = " OR ".join([*(f"({f} IS NOT NULL AND {f} <> '')" for f in V.SOFT_WEIGHTS), "budget IS NOT NULL"])
add("preference_rerank", lambda s, d: ranking.rerank(CANDIDATES.spark(s)), f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, id) AS place FROM {C}), n AS (SELECT *, CASE WHEN max(-score) OVER w = min(-score) OVER w THEN 1.0 ELSE (-score - min(-score) OVER w) / (max(-score) OVER w - min(-score) OVER w) END AS norm FROM t WHERE place <= 10 WINDOW w AS (PARTITION BY query)), r AS (SELECT query, id, place, CASE WHEN {WANTED} THEN round(CAST(0.8 AS DOUBLE) * norm + {BONUS} + CASE WHEN price IS NULL OR budget IS NULL THEN 0 WHEN price <= budget THEN {SIDE} ELSE -({SIDE}) END, 8) END AS rank_score FROM n) SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY rank_score DESC NULLS LAST, place) AS INTEGER) AS rank, rank_score FROM r")
U = POOL.sql()
PRIOR = "CASE attribute " + " ".join(f"WHEN '{n}' THEN CAST({p} AS DOUBLE)" for n, p in V.PRIORS.items()) + " END"
BOOST = "CASE " + " ".join(f"WHEN attribute = '{n}' AND list_has_any(list_transform(tags, lambda t: lower(t)), {words(t)}) THEN CAST(0.08 AS DOUBLE)" for n, t in V.PROFILE_TAGS.items()) + " ELSE 0 END"
UTIL = f"WITH p AS (SELECT *, 1 / log2(rank + 2) AS weight FROM {U}), t AS (SELECT query, sum(weight) AS total FROM (SELECT DISTINCT query, rank, weight FROM p) GROUP BY query), sh AS (SELECT *, weight / count(*) OVER (PARTITION BY query, rank, attribute) AS share FROM p WHERE attribute IS NOT NULL AND NOT known), v AS (SELECT query, attribute, value, sum(share) AS w, first(tags) AS tags FROM sh GROUP BY query, attribute, value), b AS (SELECT query, attribute, sum(w) AS cov, count(*) AS n, sum(w * log2(w)) AS wl, first(tags) AS tags FROM v GROUP BY query, attribute), u AS (SELECT *, cov / total AS coverage FROM b JOIN t USING (query) WHERE cov / total >= 0.08) "
USEL = f"SELECT query, attribute, round({PRIOR} * (CAST(0.58 AS DOUBLE) * coverage + CAST(0.42 AS DOUBLE) * CASE WHEN n > 1 THEN (log2(cov) - wl / cov) / log2(n) ELSE 0 END) + {BOOST}, 8) AS utility FROM u"
OSEL = "SELECT query, attribute, CAST(row_number() OVER (PARTITION BY query, attribute ORDER BY round(w, 9) DESC, value) AS INTEGER) AS nth, value FROM v SEMI JOIN u USING (query, attribute) QUALIFY nth <= 3"
add("attribute_utility", lambda s, d: ranking.utilities(POOL.spark(s))[0], UTIL + USEL)
add("attribute_options", lambda s, d: ranking.utilities(POOL.spark(s))[1], UTIL + OSEL)
ORDER = f"list_position({words(V.QUESTION_ORDER)}, attribute)"
add("next_question", lambda s, d: ranking.next_question(ranking.utilities(POOL.spark(s))[0]), UTIL + f"SELECT query, attribute FROM ({USEL}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY utility DESC, {ORDER}) = 1")


def question_text(s, d):
    options = ranking.utilities(POOL.spark(s))[1]
    by = options.groupBy("query", "attribute").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "value"))), lambda x: x["value"]).alias("options"))
    return by.select("query", "attribute", ranking.question_text(c("attribute"), c("options")).alias("question"))


PLAIN = "CASE attribute " + " ".join(f"WHEN '{n}' THEN {q(p)}" for n, p in V.PROMPTS.items()) + " END"
add("question_text", question_text, UTIL + f"SELECT query, attribute, CASE WHEN len(o) < 2 THEN {PLAIN} WHEN attribute IN ('material', 'color', 'brand', 'style') THEN 'Do you prefer ' || o[1] || ', ' || o[2] || ', or another ' || attribute || '?' WHEN attribute = 'feature' THEN 'Would ' || o[1] || ', ' || o[2] || ', or another feature matter most?' ELSE {PLAIN} END AS question FROM (SELECT query, attribute, list_filter(list(value ORDER BY nth), lambda x: length(x) BETWEEN 2 AND 28) AS o FROM ({OSEL}) GROUP BY query, attribute)")
O = OUTCOMES.sql()
MET = "count(*) AS sample_count, round_even(coalesce(avg(CASE WHEN hit_turn IS NOT NULL THEN 1.0 ELSE 0.0 END), 0), 6) AS hit_rate_at_10, round_even(coalesce(avg(coalesce(CAST(1 AS DOUBLE) / best_rank, 0)), 0), 6) AS mrr, round_even(avg(CAST(coalesce(hit_turn, 11) AS DOUBLE)), 6) AS mttc"
EFF = "greatest(0, least(1, (11 - mttc) / 10))"
SCORE = f"round_even({EFF}, 6) AS efficiency, round_even(CAST(0.5 AS DOUBLE) * hit_rate_at_10 + CAST(0.3 AS DOUBLE) * mrr + CAST(0.2 AS DOUBLE) * {EFF}, 6) AS technical_score"
add("ir_metrics", lambda s, d: OUTCOMES.spark(s).agg(*metrics.session_metrics()), f"SELECT {MET} FROM {O}")
add("technical_score", lambda s, d: metrics.with_score(OUTCOMES.spark(s).agg(*metrics.session_metrics())), f"SELECT *, {SCORE} FROM (SELECT {MET} FROM {O})")
add("scenario_metrics", lambda s, d: OUTCOMES.spark(s).groupBy("scenario").agg(*metrics.session_metrics()), f"SELECT scenario, {MET} FROM {O} GROUP BY scenario")
usage = lambda f: F.coalesce(F.sum(F.when(c(f) >= 0, c(f))), F.lit(0)).alias(f)
add("usage_totals", lambda s, d: OUTCOMES.spark(s).agg(usage("prompt_tokens"), usage("completion_tokens")).withColumn("total_tokens", c("prompt_tokens") + c("completion_tokens")), f"SELECT CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(k) AS BIGINT) AS completion_tokens, CAST(sum(p) + sum(k) AS BIGINT) AS total_tokens FROM (SELECT greatest(coalesce(prompt_tokens, 0), 0) AS p, greatest(coalesce(completion_tokens, 0), 0) AS k FROM {O})")


def cv_summary(s, d):
    by = metrics.with_score(OUTCOMES.spark(s).groupBy("fold").agg(*metrics.session_metrics()))
    return by.agg(F.round(F.avg("technical_score"), 6).alias("fold_score_mean"), F.round(F.stddev_pop("technical_score"), 6).alias("fold_score_stdev"), F.round(F.min("technical_score"), 6).alias("worst_fold"))


add("cv_summary", cv_summary, f"SELECT round(avg(technical_score), 6) AS fold_score_mean, round(stddev_pop(technical_score), 6) AS fold_score_stdev, round(min(technical_score), 6) AS worst_fold FROM (SELECT *, {SCORE} FROM (SELECT fold, {MET} FROM {O} GROUP BY fold))")
add("fold_train_valid", lambda s, d: (o := OUTCOMES.spark(s)).join(o.where("fold = 0").select("sample"), "sample", "left_anti").select("sample", F.lit("train").alias("part")).union(o.join(o.where("fold = 0").select("sample"), "sample", "left_semi").select("sample", F.lit("valid"))), f"SELECT sample, CASE WHEN fold = 0 THEN 'valid' ELSE 'train' END AS part FROM {O}")
add("brier_logloss_auc", lambda s, d: metrics.brier_logloss_auc(PREDICTIONS.spark(s)), f"WITH p AS {PREDICTIONS.sql()} SELECT round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) * (p - y)), 9) AS brier, round((SELECT avg(CASE WHEN a.p > b.p THEN CAST(1 AS DOUBLE) WHEN a.p = b.p THEN 0.5 ELSE 0 END) FROM p a JOIN p b ON a.y = 1 AND b.y = 0), 6) AS roc_auc, round(avg(CAST(y AS DOUBLE)), 6) AS positive_rate FROM p")


def confidence_features(s, d):
    """Features of the TF-IDF scores of each benchmark item: top1, gaps, mean of ten, turn, terms."""
    top = tfidf.cosine_search(read(s, d, "documents").select("doc_id", "text"), read(s, d, "benchmark"))
    by = top.groupBy("item_id").agg(F.max(F.when(c("rank") == 1, c("score"))).alias("top1"), F.coalesce(F.max(F.when(c("rank") == 2, c("score"))), F.lit(0.0)).alias("top2"), F.avg("score").alias("mean10"))
    n = F.least(F.size(T.query_terms(c("text"))), F.lit(100)) / F.lit(100.0)
    return by.join(read(s, d, "benchmark"), "item_id").select("item_id", "top1", F.round(c("top1") - c("top2"), 6).alias("gap2"), F.round(c("top1") - c("mean10"), 6).alias("gap10"), F.round("mean10", 6).alias("mean10"), F.lit(0.1).alias("turn"), n.alias("terms"))


add("confidence_features", confidence_features, f"WITH t AS ({SQL['tfidf_cosine']}), g AS (SELECT item_id, max(CASE WHEN rank = 1 THEN score END) AS top1, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS top2, avg(score) AS mean10 FROM t GROUP BY item_id) SELECT item_id, top1, round(top1 - top2, 6) AS gap2, round(top1 - mean10, 6) AS gap10, round(mean10, 6) AS mean10, CAST(0.1 AS DOUBLE) AS turn, least(len({terms_sql('text')}), 100) / CAST(100 AS DOUBLE) AS terms FROM g JOIN benchmark USING (item_id)")
add("catalog_scan", lambda s, d: jsonl.last_of_each(read(s, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id").select("user_id", "event_type", "value"), "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def match_join_price(s, d):
    """Parts whose name has a word of the search, with the price of the side table, whose key may not repeat."""
    match = s.createDataFrame([("red",), ("ring",)], "term string")
    hits = bm25.postings(read(s, d, "part").select("p_partkey", "p_name"), {"p_name": 1.0}, "p_partkey").join(match, "term", "left_semi").groupBy("p_partkey").agg(F.count("*").alias("hits"))
    side = jsonl.unique_or_fail(read(s, d, "part").select("p_partkey", T.numeric_price(c("p_retailprice").cast("string")).alias("price")), "p_partkey")
    return hits.join(side, "p_partkey")


add("match_join_price", match_join_price, "SELECT p_partkey, hits, m.p_retailprice AS price FROM (SELECT p_partkey, count(*) AS hits FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS term FROM part) WHERE term IN ('red', 'ring') GROUP BY p_partkey) JOIN part m USING (p_partkey)")
add("candidate_attributes", lambda s, d: read(s, d, "lineitem").select("l_partkey").distinct().join(read(s, d, "part").where("p_size <= 25"), c("l_partkey") == c("p_partkey"), "left").select("l_partkey", F.coalesce("p_brand", F.lit("")).alias("brand"), "p_size"), "SELECT l_partkey, coalesce(p_brand, '') AS brand, p_size FROM (SELECT DISTINCT l_partkey FROM lineitem) LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON l_partkey = p_partkey")
add("sample_target", lambda s, d: synthesis.joined_or_fail(read(s, d, "labels"), read(s, d, "documents").select("doc_id", "lang", "source"), "doc_id"), "SELECT l.*, d.lang, d.source FROM labels l JOIN documents d USING (doc_id)")
add("target_in_catalog", lambda s, d: read(s, d, "documents").join(read(s, d, "labels"), "doc_id", "left_semi").select("doc_id"), "SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
add("category_members", lambda s, d: synthesis.places(read(s, d, "part").select("p_type", "p_partkey"), F.md5(c("p_partkey").cast("string")), "p_type").select("p_type", "nth", "n", "p_partkey"), "SELECT p_type, row_number() OVER (PARTITION BY p_type ORDER BY md5(CAST(p_partkey AS VARCHAR))) AS nth, count(*) OVER (PARTITION BY p_type) AS n, p_partkey FROM part")
NEGATIVES = 7
RING = """p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY h) AS pos, count(*) OVER (PARTITION BY category) AS n, row_number() OVER (ORDER BY h) AS gpos, count(*) OVER () AS gn FROM (SELECT id, category, md5('2026:' || id) AS h FROM {0})),
same AS (SELECT a.id, CAST(k AS INTEGER) AS k, b.id AS negative FROM p a, range(1, 8) r(k) JOIN p b ON b.category = a.category AND b.pos = (a.pos - 1 + k) % a.n + 1 WHERE k < a.n),
fill AS (SELECT a.id, CAST(a.n - 1 + row_number() OVER (PARTITION BY a.id ORDER BY step) AS INTEGER) AS k, b.id AS negative FROM p a, range(1, 15) r(step) JOIN p b ON b.gpos = (a.gpos - 1 + step) % a.gn + 1 WHERE a.n <= 7 AND step < a.gn AND b.category IS DISTINCT FROM a.category),
neg AS (SELECT * FROM same UNION ALL SELECT * FROM fill WHERE k <= 7)"""
PARTS = "(SELECT p_partkey AS id, p_type AS category FROM part)"
add("hard_negatives", lambda s, d: synthesis.negatives(read(s, d, "part").select(c("p_partkey").alias("id"), c("p_type").alias("category")), NEGATIVES).withColumnRenamed("id", "p_partkey"), "WITH " + RING.format(PARTS) + " SELECT id AS p_partkey, k, negative FROM neg")
RARE = "(SELECT p_partkey AS id, p_brand || p_type || p_size AS category FROM part)"
add("filled_negatives", lambda s, d: synthesis.negatives(read(s, d, "part").select(c("p_partkey").alias("id"), F.concat("p_brand", "p_type", c("p_size").cast("string")).alias("category")), NEGATIVES), "WITH " + RING.format(RARE) + " SELECT id, k, negative FROM neg")
PAGES = BM25 + "SELECT query_id, CAST(query_id % 3 AS INTEGER) AS page, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score, doc_id) QUALIFY rank > (query_id % 3) * 10 AND rank <= (query_id % 3 + 1) * 10"


def paged_search(s, d):
    """Page 0, 1 or 2 of each benchmark item's search, by its id."""
    pages = read(s, d, "benchmark").select(c("item_id").alias("query_id"), (c("item_id") % 3).cast("int").alias("page"))
    return bm25.search(read(s, d, "documents"), asked(s, d), FIELDS, pages=pages)


add("paged_search", paged_search, PAGES)


def saved_index_search(s, d):
    """bm25_topk through an index that is saved, checked and loaded."""
    path = f"{shared_dir(s)}/tessera/index-{uuid.uuid4().hex}"
    bm25.save_index(read(s, d, "documents"), path, FIELDS)
    return bm25.search_index(bm25.load_index(s, path, FIELDS), asked(s, d))


add("saved_index_search", saved_index_search, SQL["bm25_topk"])
USERS = "(SELECT conv_id AS session, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user')"
FIRST_TERMS = lambda x: f"list_slice(list_filter(list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN list_position({x}, {x}[i]) = i THEN {x}[i] END), lambda v: v IS NOT NULL), 1, {V.MAX_TERMS})"
EVIDENCE = f"""e0 AS (SELECT session, turn, string_agg(text, ' ') OVER (PARTITION BY session ORDER BY turn) AS query, row_number() OVER (PARTITION BY session ORDER BY turn) AS nth FROM {USERS}),
e1 AS (SELECT *, {terms_sql('query')} AS found FROM e0), e2 AS (SELECT *, {FIRST_TERMS('found')} AS terms FROM e1),
e3 AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY turn) AS island FROM (SELECT *, CASE WHEN terms = lag(terms) OVER (PARTITION BY session ORDER BY turn) THEN 0 ELSE 1 END AS new FROM e2)),
e AS (SELECT session * 1000 + turn AS qid, session, turn, nth, query, terms, CAST(row_number() OVER (PARTITION BY session, island ORDER BY turn) - 1 AS INTEGER) AS page FROM e3)"""
users = lambda s, d: read(s, d, "conversations").where("role = 'user'").select(c("conv_id").alias("session"), "turn", "text")
add("turn_evidence", lambda s, d: agent.evidence(users(s, d)).select("session", "turn", F.array_join("terms", " ").alias("terms"), "page"), f"WITH {EVIDENCE} SELECT session, turn, array_to_string(terms, ' ') AS terms, page FROM e")
ITEM = TOKENS("text")
AGENT = f"""WITH {EVIDENCE}, depth AS (SELECT greatest({agent.POOL}, (max(page) + 1) * {agent.TOP}) AS d FROM e),
post AS (SELECT item_id AS id, unnest({ITEM}) AS term, len({ITEM}) AS size FROM benchmark), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(len({ITEM}) AS DOUBLE)) AS mean FROM benchmark),
asked AS (SELECT qid, unnest(terms) AS term FROM e), f AS (SELECT id, term, size, CAST(count(*) AS DOUBLE) AS f FROM post GROUP BY ALL), h AS (SELECT term, CAST(count(*) AS DOUBLE) AS h FROM f GROUP BY term),
b AS (SELECT qid, id, round(-sum(CASE WHEN ln((n - h + CAST(0.5 AS DOUBLE)) / (h + CAST(0.5 AS DOUBLE))) > 0 THEN ln((n - h + CAST(0.5 AS DOUBLE)) / (h + CAST(0.5 AS DOUBLE))) ELSE CAST(1e-6 AS DOUBLE) END * f * CAST(2.2 AS DOUBLE) / (f + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * size / mean))), 6) AS score FROM f JOIN h USING (term) JOIN asked USING (term), st GROUP BY qid, id),
br AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS bm25_rank FROM b QUALIFY bm25_rank <= (SELECT d FROM depth)),
said AS (SELECT qid, query AS text FROM e), tf AS {GRAMS('benchmark', 'item_id')}, v AS {VOC('tf', 'benchmark')}, wa AS {WEIGHTS('tf', 'v', 'item_id')}, tq AS {GRAMS('said', 'qid')}, wb AS {WEIGHTS('tq', 'v', 'qid')},
t AS (SELECT qid, item_id AS id, round(sum(wa.w * wb.w), 6) AS score FROM wa JOIN wb USING (term) GROUP BY ALL),
tr AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS cos_rank FROM t QUALIFY cos_rank <= (SELECT d FROM depth)),
held AS (SELECT e.*, CAST(CASE WHEN coalesce(sure, 0) >= 0.8 THEN 0.05 ELSE 0.0 END AS DOUBLE) AS weight FROM e LEFT JOIN (SELECT qid, max(score) AS sure FROM tr GROUP BY qid) USING (qid)),
j AS (SELECT qid, id, bm25_rank, cos_rank FROM br FULL JOIN (SELECT qid, id, cos_rank FROM tr) USING (qid, id)),
r AS (SELECT j.qid, j.id, round(coalesce((1 - weight) / (60 + bm25_rank), 0) + coalesce(weight / (60 + cos_rank), 0), 8) AS score, row_number() OVER (PARTITION BY j.qid ORDER BY coalesce((1 - weight) / (60 + bm25_rank), 0) + coalesce(weight / (60 + cos_rank), 0) DESC, bm25_rank NULLS LAST, id) AS rank FROM j JOIN held USING (qid))
SELECT session, turn, page, weight, list_extract({words([*V.SLOT_ORDER, 'other'])}, least(nth, {len(V.SLOT_ORDER) + 1})) AS ask, CAST(rank AS INTEGER) AS rank, r.id, score FROM held LEFT JOIN r ON r.qid = held.qid AND rank > page * {agent.TOP} AND rank <= (page + 1) * {agent.TOP}"""
add("agent_turn", lambda s, d: agent.respond(users(s, d), read(s, d, "benchmark").select(c("item_id").alias("id"), "text")), AGENT)
add("hash_sample", lambda s, d: synthesis.hash_sample(read(s, d, "part").select("p_partkey", "p_name"), "p_partkey", 100), "SELECT p_partkey, p_name FROM part ORDER BY md5('2026:' || p_partkey), p_partkey LIMIT 100")
add("profile_query", lambda s, d: read(s, d, "documents").select("doc_id", synthesis.profile_query(F.concat(F.lit("I need "), "lang"), F.when(c("doc_id") % 3 == 0, c("text")), F.when(c("doc_id") % 3 == 1, F.array("source", "lang"))).alias("query")), "SELECT doc_id, 'I need ' || lang || CASE doc_id % 3 WHEN 0 THEN coalesce(' Shopper profile: ' || nullif(" + squeeze_sql("text", 220) + ", ''), '') WHEN 1 THEN ' Shopper profile: Past preferences: ' || source || ', ' || lang || '.' ELSE '' END AS query FROM documents")
add("worst_case", lambda s, d: OUTCOMES.spark(s).groupBy("scenario").agg(*metrics.session_metrics()).select("scenario", F.least(metrics.score_of(c("hit_rate_at_10"), c("mrr"), c("mttc")), metrics.score_of(c("hit_rate_at_10") * 0.9, c("mrr"), c("mttc"))).alias("worst_score")), f"SELECT scenario, least(round_even(CAST(0.5 AS DOUBLE) * hit_rate_at_10 + CAST(0.3 AS DOUBLE) * mrr + CAST(0.2 AS DOUBLE) * {EFF}, 6), round_even(CAST(0.5 AS DOUBLE) * (hit_rate_at_10 * CAST(0.9 AS DOUBLE)) + CAST(0.3 AS DOUBLE) * mrr + CAST(0.2 AS DOUBLE) * {EFF}, 6)) AS worst_score FROM (SELECT scenario, {{MET}} FROM {{O}} GROUP BY scenario)".replace("{MET}", MET).replace("{O}", O))
PT = product_sql(700, 450, 600)
some = lambda rx: f"list_sort(list_distinct(list_transform(regexp_extract_all(lower({PT}), {q(rx)}), lambda x: replace(x, 'grey', 'gray'))))"
match = lambda ts: f"list_filter({words(ts)}, lambda t: regexp_matches(lower({PT}), '\\b' || t || '\\b'))"


def product_attributes(s, d):
    low = F.lower(T.product_text())
    found = lambda rx: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(low, F.lit(f"({rx})"), 1), lambda x: F.replace(x, F.lit("grey"), F.lit("gray")))))
    sized = F.filter(F.coalesce("details", F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.lower(e["key"]).rlike("size|width|fit"))
    sizes = F.slice(F.filter(F.transform(F.split(F.array_join(F.transform(sized, lambda e: F.coalesce(e["value"], F.lit("None"))), " "), "[,;/]"), lambda v: F.lower(F.btrim(v))), lambda v: v != ""), 1, 4)
    one = lambda v: F.when(F.coalesce(v, F.lit("")) != "", F.array(v)).otherwise(F.array().cast("array<string>"))
    all_ = {"material": found(V.MATERIAL_RX), "color": found(V.COLOR_RX), "style": T.matched_terms(T.product_text(), V.STYLE_TERMS), "use_case": T.matched_terms(T.product_text(), V.USE_CASE_TERMS), "feature": T.matched_terms(T.product_text(), V.FEATURE_TERMS), "size": sizes, "brand": one(F.lower(T.squeeze(c("store"), 80))), "budget": one(T.budget_bucket(c("price")))}
    each = F.array(*[F.struct(F.lit(k).alias("attribute"), v.alias("values")) for k, v in all_.items()])
    return PRODUCTS.spark(s).select("id", F.explode(each).alias("a")).select("id", "a.attribute", F.explode("a.values").alias("value"))


SIZED = "list_slice(list_filter(list_transform(regexp_split_to_array(array_to_string(list_transform(list_filter(coalesce(details, []), lambda e: regexp_matches(lower(e.key), 'size|width|fit')), lambda e: coalesce(e.value, 'None')), ' '), '[,;/]'), lambda v: lower(trim(v))), lambda v: v <> ''), 1, 4)"
STORE = "lower(rtrim(left(trim(regexp_replace(coalesce(store, ''), '\\s+', ' ', 'g'), ' -;,.'), 80), ' '))"
BUCKET = "CASE WHEN TRY_CAST(price AS DOUBLE) < 25 THEN 'under $25' WHEN TRY_CAST(price AS DOUBLE) < 50 THEN '$25–$50' WHEN TRY_CAST(price AS DOUBLE) < 100 THEN '$50–$100' WHEN TRY_CAST(price AS DOUBLE) IS NOT NULL THEN '$100 or more' END"
ATTRS = {"material": some(V.MATERIAL_RX), "color": some(V.COLOR_RX), "style": match(V.STYLE_TERMS), "use_case": match(V.USE_CASE_TERMS), "feature": match(V.FEATURE_TERMS), "size": SIZED, "brand": f"list_filter([{STORE}], lambda x: x <> '')", "budget": f"list_filter([{BUCKET}], lambda x: x IS NOT NULL)"}
add("product_attributes", product_attributes, " UNION ALL ".join(f"SELECT id, '{k}' AS attribute, unnest({v}) AS value FROM {PRODUCTS.sql()}" for k, v in ATTRS.items()))
