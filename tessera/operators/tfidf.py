"""TF-IDF of words and word pairs, and cosine search with it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from tessera.functions.text import folded
from tessera.operators.topk import best, bounded, few, listed, with_lists
from tessera.sources.stored import load_artifact, save_artifact, stored

LEAST_DF, MOST_DF, MOST_TERMS = 2, 0.995, 60_000
#: Words that are counted at once; words of the corpus for each part of its grams; postings of a part of a saved fit.
MOST_WORDS, PART_WORDS, PART_ROWS = 1 << 21, 10_000_000, 4_000_000


def long_words(x: Column) -> Column:
    return F.regexp_extract_all(folded(x), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def grams(x: Column) -> Column:
    """Words of two characters or more, and pairs of neighbours among them."""
    words = long_words(x)
    near = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.filter(near, lambda g: g.isNotNull()))


def counts(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    return rows.select(key, F.explode(grams(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(tf: DataFrame, docs: int, most: int = MOST_TERMS) -> DataFrame:
    """(term, idf): the most frequent terms that are in two documents or more, and in 99.5 % of them at most; ties by term."""
    return most_frequent(tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")), docs, most)


def most_frequent(df: DataFrame, docs: int, most: int = MOST_TERMS) -> DataFrame:
    """vocabulary() of (term, df, total)."""
    kept = df.where((F.col("df") >= LEAST_DF) & (F.col("df") <= MOST_DF * docs)).orderBy(F.desc("total"), "term").limit(most)
    return kept.select("term", (F.log((F.lit(1.0) + docs) / (1 + F.col("df"))) + 1.0).alias("idf"))


def raw_weights(tf: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, term, raw): (1 + ln tf) idf."""
    return tf.join(vocabulary, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))


def norms(raw: DataFrame, key: str) -> DataFrame:
    """(key, norm): added up before the shuffle."""
    return raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))


def weights(tf: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, term, w): (1 + ln tf) idf, rows of length 1."""
    raw = raw_weights(tf, vocabulary, key)
    return raw.join(norms(raw, key), key).select(key, "term", (F.col("raw") / F.col("norm")).alias("w"))


def gram_counts(n: np.ndarray, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all documents in a row, n for each: the distinct grams; then document (ascending), gram and count of each pair of these."""
    found = words.dictionary_encode()
    code, size = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(found.dictionary)
    doc = np.repeat(np.arange(len(n)), n)
    near = doc[1:] == doc[:-1]
    pair, place = np.unique((code[:-1] * size + code[1:])[near], return_inverse=True)
    first, second = (found.dictionary.take(pa.array(x)) for x in np.divmod(pair, max(1, size)))
    names = pa.concat_arrays([found.dictionary, pc.binary_join_element_wise(first, second, " ")])
    cell, tf = np.unique(np.concatenate([doc, doc[1:][near]]) * max(1, len(names)) + np.concatenate([code, place + size]), return_counts=True)
    return names, *np.divmod(cell, max(1, len(names))), tf


def frequencies(words: DataFrame) -> DataFrame:
    """words: key, words. (term, df, total): documents that have a gram, and how often it occurs. Counted for many documents before the shuffle."""

    def counted(held):
        lists = pa.chunked_array(held).combine_chunks()
        names, _, gram, tf = gram_counts(pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten())
        df, total = np.bincount(gram, minlength=len(names)), np.bincount(gram, tf, minlength=len(names)).astype(np.int64)
        for at in range(0, len(names), 10_000):
            part = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays([names[part], pa.array(df[part], pa.int64()), pa.array(total[part], pa.int64())], names=["term", "df", "total"])

    def run(batches):
        held, many = [], 0
        for batch in batches:
            held.append(batch.column(0))
            many += len(held[-1].flatten())
            if many >= MOST_WORDS:
                yield from counted(held)
                held, many = [], 0
        if held:
            yield from counted(held)

    many = words.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-many // PART_WORDS))
    # dealt out before they are added up: most grams are rare, so that adding up in the tasks that read would hold them all and save little
    dealt = words.select("words").mapInArrow(run, "term string, df long, total long").repartition(parts, "term")
    return dealt.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def bags(words: DataFrame, vocabulary: DataFrame, key: str, wanted: list[str] | None = None) -> DataFrame:
    """words: key (unique), words. (key, terms, w): the grams of a document that the vocabulary has and, if they are named, are wanted; w is (1 + ln tf) idf, and the
    whole document's weights have length 1. Nothing is shuffled, as a vocabulary is bounded and sent to all tasks."""
    bounded(words.sparkSession)
    rows = vocabulary.collect()
    known, idf = [r.term for r in rows], np.array([r.idf for r in rows], dtype=float)
    asked = None if wanted is None else np.isin(np.array(known, dtype=object), np.array(wanted, dtype=object))
    schema = StructType([StructField(key, words.schema[key].dataType), StructField("terms", ArrayType(StringType())), StructField("w", ArrayType(DoubleType()))])

    def run(batches):
        values = pa.array(known, pa.string())
        for batch in batches:
            names, doc, gram, tf = gram_counts(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False), batch.column(1).flatten())
            at = pc.fill_null(pc.index_in(names, value_set=values), -1).to_numpy(zero_copy_only=False)[gram]
            doc, tf, at = doc[at >= 0], tf[at >= 0], at[at >= 0]
            raw = (1 + np.log(tf)) * idf[at]
            w = raw / np.sqrt(np.bincount(doc, raw * raw, minlength=batch.num_rows))[doc]
            if asked is not None:
                doc, w, at = doc[asked[at]], w[asked[at]], at[asked[at]]
            yield with_lists([batch.column(0)], values.take(pa.array(at)), w, doc, batch.num_rows, [key])

    return words.select(key, "words").mapInArrow(run, schema)


def worded(rows: DataFrame, key: str) -> DataFrame:
    """key, words of two characters or more."""
    bounded(rows.sparkSession)
    return rows.select(key, F.coalesce(long_words(F.col("text")), F.array().cast("array<string>")).alias("words"))


def fitted(docs: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """vocabulary, and words (key, words) of documents; each is written once and read by what follows."""
    words = stored(worded(docs, key), "words")
    return {"vocabulary": stored(most_frequent(frequencies(words), words.count()), "vocabulary"), "words": words}


def save_fit(docs: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes the vocabulary and the postings (key, term, w), sorted by term; ranges of term and key are dealt out, so that a common term is not one task's."""
    fit = fitted(docs, key)
    held = stored(bags(fit["words"], fit["vocabulary"], key), "bags")
    rows = held.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    parts = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))
    postings = held.select(key, F.explode(F.arrays_zip("terms", "w")).alias("e")).select(key, F.col("e.terms").alias("term"), F.col("e.w").alias("w"))
    tables = {"vocabulary": fit["vocabulary"], "postings": postings.repartitionByRange(parts, "term", key).sortWithinPartitions("term", key)}
    save_artifact(path, tables, key=key, text=docs.agg(F.count("*")).first()[0])


def load_fit(spark: SparkSession, path: str, docs: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """A saved fit; that of another number of documents, or one that isn't whole, is an error."""
    return load_artifact(spark, path, key=key, text=docs.agg(F.count("*")).first()[0])


def search_fit(fit: dict[str, DataFrame], queries: DataFrame, k: int = 10, key: str = "doc_id", query: str = "item_id") -> DataFrame:
    """fit: fitted or loaded. query, rank, key, score to 6 digits, ties by key. A document's weights of query terms are made within it (of a saved fit, only postings of
    query terms are dealt out), and its scores in one task, which keeps only the best of each query."""
    asked = stored(bags(worded(queries.select(query, "text"), query), fit["vocabulary"], query).withColumn("need", F.lit(k)), "asked")
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    if "words" in fit:
        docs = bags(fit["words"], fit["vocabulary"], key, few(terms))
    else:
        docs = listed(fit["postings"].join(F.broadcast(terms), "term", "left_semi"), key)
    found = best(stored(docs, "found"), asked, key, query)
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(query, "rank", key, "score")


def cosine_search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """docs: doc_id, text; queries: item_id, text. item_id, rank, doc_id, score to 6 digits, ties by doc_id."""
    return search_fit(fitted(docs), queries, k)
