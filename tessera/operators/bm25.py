"""Field-weighted BM25 over token postings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tessera.functions.text import index_tokens
from tessera.operators.topk import best, bounded, few, listed, with_lists
from tessera.sources.stored import load_artifact, save_artifact, stored

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Rows that a page's search reads at least, as pages of one search are cut from one list.
POOL = 160
#: Postings of a part of a saved index.
PART_ROWS = 4_000_000


def tokenised(docs: DataFrame, fields: dict[str, float], key: str) -> DataFrame:
    """key, size (tokens of all fields), terms (an array for each field, in order)."""
    terms = F.array(*[index_tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields])
    return docs.select(key, terms.alias("terms")).select(key, F.aggregate("terms", F.lit(0), lambda n, t: n + F.size(t)).alias("size"), "terms")


def postings(docs: DataFrame, fields: dict[str, float], key: str = "doc_id") -> DataFrame:
    """(key, field, weight, term, size): a row for each token; size counts the tokens of the document's fields."""
    named = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(w)).alias("weight")) for f, w in fields.items()])
    rows = tokenised(docs, fields, key).select(key, "size", F.explode(F.zip_with(named, "terms", lambda n, t: F.struct(n["field"].alias("field"), n["weight"].alias("weight"), t.alias("terms")))).alias("f"))
    return rows.select(key, "size", "f.field", "f.weight", F.explode("f.terms").alias("term"))


def inverted_index(docs: DataFrame, fields: dict[str, float], key: str = "doc_id") -> DataFrame:
    return postings(docs, fields, key).groupBy(key, "field", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, fields: dict[str, float], key: str = "doc_id") -> DataFrame:
    """One row: documents and mean tokens of a document."""
    return tokenised(docs, fields, key).agg(F.count("*").alias("docs"), F.avg(F.col("size").cast("double")).alias("mean_size"))


def idf(docs: Column, having: Column) -> Column:
    raw = F.log((docs - having + 0.5) / (having + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def bags(docs: DataFrame, fields: dict[str, float], key: str, wanted: list[str] | None = None) -> DataFrame:
    """(key, size, terms, w): a row for each document. size counts the tokens of its fields, terms are its distinct ones (of the wanted ones if they are named), and w has the
    sum of the weights of the fields that a term occurs in, for each occurrence. Counted within the document, so nothing is shuffled."""
    bounded(docs.sparkSession)
    terms = F.array(*[index_tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields])
    schema = StructType([StructField(key, docs.schema[key].dataType), StructField("size", IntegerType()), StructField("terms", ArrayType(StringType())), StructField("w", ArrayType(DoubleType()))])
    weights = np.array(list(fields.values()), dtype=float)

    def run(batches):
        known = None if wanted is None else pa.array(wanted, pa.string())
        for batch in batches:
            rows, lists = batch.num_rows, batch.column(1).flatten()
            n, words = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
            field = np.repeat(np.arange(rows * len(weights)), n)
            if known is None:
                found = words.dictionary_encode()
                names, code = found.dictionary, found.indices.to_numpy(zero_copy_only=False)
            else:
                names, code = known, pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)
            field, code = field[code >= 0], code[code >= 0].astype(np.int64)
            cell, place = np.unique(field // len(weights) * max(1, len(names)) + code, return_inverse=True)
            w = np.bincount(place, weights[field % len(weights)], minlength=len(cell))
            doc, code = np.divmod(cell, max(1, len(names)))
            size = pa.array(n.reshape(rows, -1).sum(axis=1), pa.int32())
            yield with_lists([batch.column(0), size], names.take(pa.array(code)), w, doc, rows, [key, "size"])

    return docs.select(key, terms.alias("terms")).mapInArrow(run, schema)


def postings_of(held: DataFrame, key: str) -> DataFrame:
    """(key, term, size, f) of bags."""
    return held.select(key, "size", F.explode(F.arrays_zip("terms", "w")).alias("e")).select(key, F.col("e.terms").alias("term"), "size", F.col("e.w").alias("f"))


def frequencies(held: DataFrame) -> DataFrame:
    """(term, having) of bags."""
    return held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("having"))


def save_index(docs: DataFrame, path: str, fields: dict[str, float], key: str = "doc_id") -> None:
    """Writes the postings of documents, sorted by term so that a search reads the row groups of its terms, with document frequencies and statistics. Ranges of term and key are
    dealt out, so that a common term is not one task's, in parts of about PART_ROWS postings."""
    held = stored(bags(docs, fields, key), "bags")
    rows = held.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    parts = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))
    stats = held.agg(F.count("*").alias("docs"), F.avg(F.col("size").cast("double")).alias("mean_size"))
    tables = {"postings": postings_of(held, key).repartitionByRange(parts, "term", key).sortWithinPartitions("term", key), "terms": frequencies(held), "stats": stats}
    save_artifact(path, tables, fields=sorted(fields.items()), key=key)


def load_index(spark: SparkSession, path: str, fields: dict[str, float], key: str = "doc_id") -> dict[str, DataFrame]:
    """An index's tables; other fields, weights or keys than it was made with are an error, and so is one that isn't whole."""
    return load_artifact(spark, path, fields=sorted(fields.items()), key=key)


def ranked(held: DataFrame, having: DataFrame, queries: DataFrame, n: int, mean: float | None, k: int, key: str, pages: DataFrame | None) -> DataFrame:
    """held: key, size, terms, w. The k best of each query, or those of its page (pages: query_id, page from 0); rank counts from 1 on the first page."""
    share = lambda f: f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.lit(float(mean or 1.0))))
    docs = held.select(key, "terms", F.transform("w", share).alias("w"))
    need = queries.select("query_id", F.lit(k).alias("need")).distinct()
    if pages is not None:
        need = pages.groupBy("query_id").agg(((F.max("page") + 1) * k).cast("int").alias("need"))
    asked = listed(queries.join(having, "term").select("query_id", "term", idf(F.lit(float(n)), F.col("having")).alias("w")), "query_id")
    found = best(docs, stored(asked.join(need, "query_id"), "asked"), key, "query_id").withColumn("score", F.lit(0.0) - F.col("score"))
    rows = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", key))).where(F.col("rank") <= F.col("need"))
    if pages is None:
        return rows.select("query_id", "rank", key, "score")
    rows = rows.join(pages, "query_id").where((F.col("rank") > F.col("page") * k) & (F.col("rank") <= (F.col("page") + 1) * k))
    return rows.select("query_id", "page", "rank", key, "score")


def search(docs: DataFrame, queries: DataFrame, fields: dict[str, float], k: int = 10, key: str = "doc_id", pages: DataFrame | None = None) -> DataFrame:
    """queries: (query_id, term) distinct. query_id, rank, key (unique in docs), score (lower is better, to 6 digits), ties by key; with pages
    (query_id, page), each query's page of k, and its number.

    A document's query terms are counted within it and written once; its scores are made in one task, which keeps only the best of each query.
    """
    held = stored(bags(docs, fields, key, few(queries.select("term"))), "bags")
    n, mean = held.agg(F.count("*"), F.avg(F.col("size").cast("double"))).first()
    return ranked(held, frequencies(held), queries, n, mean, k, key, pages)


def search_index(index: dict[str, DataFrame], queries: DataFrame, k: int = 10, key: str = "doc_id", pages: DataFrame | None = None) -> DataFrame:
    """search() over an index that was saved: only postings of query terms are dealt out, by document."""
    n, mean = index["stats"].first()
    terms = queries.select("term").distinct()
    found = index["postings"].join(F.broadcast(terms) if few(terms) is not None else terms, "term", "left_semi")
    held = stored(listed(found.withColumnRenamed("f", "w"), key, "size"), "found")
    return ranked(held, index["terms"], queries, n, mean, k, key, pages)
