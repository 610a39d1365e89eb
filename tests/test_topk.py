"""Searches at the edges of blocks and batches, and by the size of what they deal out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bm25, tfidf, topk


def dealt_out(spark, df) -> int:
    """Rows that a plan writes into shuffles, once it has run without adaptive changes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        todo, rows = [df._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            if "Exchange" in node.getClass().getSimpleName() and node.metrics().contains("shuffleRecordsWritten"):
                rows += node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(k) for k in range(node.children().size())]
        return rows
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.fixture
def many(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), " ".join(f"w{x}" for x in rng.integers(0, 40, 12))) for k in rng.permutation(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(q, f"w{t}") for q in range(700) for t in {q % 40, q // 40 % 40, q % 7}], "query_id int, term string")


def by_hand(docs, asked, need):
    """BM25 of whole lists, without blocks."""
    bags = {r.doc_id: r.text.split() for r in docs.collect()}
    mean, having = np.mean([len(b) for b in bags.values()]), {}
    for b in bags.values():
        for t in set(b):
            having[t] = having.get(t, 0) + 1
    idf = {t: max(np.log((len(bags) - h + 0.5) / (h + 0.5)), 0) or 1e-6 for t, h in having.items()}
    part = {}
    for i, b in bags.items():
        for t in set(b):
            f = b.count(t)
            part.setdefault(t, []).append((i, idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(b) / mean))))
    terms, out = {}, {}
    for r in asked.collect():
        terms.setdefault(r.query_id, set()).add(r.term)
    for q, ts in terms.items():
        total = {}
        for t in ts:
            for i, w in part.get(t, []):
                total[i] = total.get(i, 0) + w
        out[q] = sorted((round(-s, 5), i) for i, s in total.items())[: need(q)]
    return out


def test_search_deals_out_only_the_best(spark, many, asked):
    found = bm25.search(many, asked, {"text": 1.0}, 3)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(r.score, 5), r.doc_id))
    want = by_hand(many, asked, lambda q: 3)
    assert got.keys() == want.keys() and all([s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], abs=2e-5) for q in want)
    # 700 queries meet about 1,500 documents each, and no task gives on more than three of each query
    assert dealt_out(spark, bm25.search(many, asked, {"text": 1.0}, 3)) < 700 * 3 * 20


def test_pages_deal_out_only_their_depth(spark, many, asked):
    pages = asked.select("query_id", (F.col("query_id") % 3).alias("page")).distinct()
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in bm25.search(many, asked, {"text": 1.0}, 4, pages=pages).collect()}
    whole = {(r.query_id, r.rank): (r.doc_id, r.score) for r in bm25.search(many, asked, {"text": 1.0}, 12).collect()}
    assert got == {k: v for k, v in whole.items() if k[0] % 3 * 4 < k[1] <= k[0] % 3 * 4 + 4} and len(got) == 2800
    assert dealt_out(spark, bm25.search(many, asked, {"text": 1.0}, 4, pages=pages)) < 700 * 12 * 20


def test_blocks_and_slices_change_nothing(spark, many, asked, monkeypatch):
    key = lambda r: (r.query_id, r.rank)
    want = sorted(bm25.search(many, asked, {"text": 1.0}, 5).collect(), key=key)
    for name, value in (("ROWS", 7), ("PART_TERMS", 300), ("FEW_TERMS", 3)):
        monkeypatch.setattr(topk, name, value)
    assert sorted(bm25.search(many, asked, {"text": 1.0}, 5).collect(), key=key) == want


def test_equal_documents_are_ranked_by_key(spark):
    docs = spark.createDataFrame([(k, "red hat") for k in range(2000, 0, -1)] + [(0, None), (-1, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "red"), (1, "hat"), (1, "red"), (2, "none")], "query_id int, term string")
    got = [(r.query_id, r.rank, r.doc_id) for r in bm25.search(docs, queries, {"text": 1.0}, 3).orderBy("query_id", "rank").collect()]
    assert got == [(q, k, k) for q in (0, 1) for k in (1, 2, 3)]


def test_a_block_picks_as_a_plain_sort():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    held = topk.Block(pa.array([10, 20, 30]), np.array([2, 5, 1]), np.array([2, 1, 1]), pa.array(["a", "b", "b", "c"]), np.array([1.0, 2.0, 1.0, 1.0]))
    rows = [(k, {t: float(rng.integers(1, 4)) for t in "abd" if rng.random() < 0.6}) for k in rng.permutation(900).tolist()]
    for at in range(0, 900, 100):
        part = rows[at : at + 100]
        held.add(pa.array([k for k, _ in part]), np.array([len(d) for _, d in part]), pa.array([t for _, d in part for t in d]), np.array([w for _, d in part for w in d.values()]))
    got = [(r["q"], r["s"], r["k"]) for b in held.rows(["q", "need", "k", "s"]) for r in b.to_pylist()]
    want = []
    for q, need, ts in ((10, 2, {"a": 1, "b": 2}), (20, 5, {"b": 1}), (30, 1, {"c": 1})):
        scored = [(-sum(d[t] * w for t, w in ts.items() if t in d), k) for k, d in rows if set(d) & set(ts)]
        want += [(q, -s, k) for s, k in sorted(scored)[:need]]
    assert got == want


def test_cosines_deal_out_only_the_best(spark, many, asked):
    items = asked.groupBy(F.col("query_id").alias("item_id")).agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("text"))
    fit = tfidf.fitted(many)
    rows = tfidf.search_fit(fit, items, 3)
    assert rows.count() == 2100
    # 700 queries meet about 2,000 documents each
    assert dealt_out(spark, tfidf.search_fit(fit, items, 3)) < 700 * 3 * 20


@pytest.mark.parametrize("at_once", [1, 9, 1 << 21])
def test_grams_are_counted_as_by_hand(spark, monkeypatch, at_once):
    from collections import Counter

    texts = ["red red hat", "Red hat red", "a b c", None, "", "hat", "one two one two one", "red"]
    monkeypatch.setattr(tfidf, "MOST_WORDS", at_once)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    df, total = Counter(), Counter()
    for t in texts:
        w = [x for x in (t or "").lower().split() if len(x) > 1]
        g = w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        df.update(set(g))
        total.update(g)
    words = tfidf.worded(docs, "doc_id")
    assert {(r.term, r.df, r.total) for r in tfidf.frequencies(words).collect()} == {(t, df[t], total[t]) for t in df}
    kept = tfidf.most_frequent(tfidf.frequencies(words), len(texts))
    lists = {r.doc_id: dict(zip(r.terms, r.w, strict=True)) for r in tfidf.bags(words, kept, "doc_id").collect()}
    assert set(lists) == set(range(8)) and set(lists[0]) == {"red", "hat", "red hat"} and set(lists[1]) == {"red", "hat", "red hat"}
    assert all(sum(w * w for w in v.values()) == pytest.approx(1) for v in lists.values() if v) and not lists[6] and lists[5] == {"hat": 1.0}


def test_confidence_is_of_the_same_search(spark, sf_dir):
    from tessera.plans import registry

    found = registry.QUERIES["confidence_features"](spark, sf_dir)
    top = {r.item_id: r.score for r in registry.QUERIES["tfidf_cosine"](spark, sf_dir).where("rank = 1").collect()}
    assert {r.item_id: r.top1 for r in found.collect()} == top
    # 40 items of ten documents; before, each met most of the documents in a shuffle
    assert dealt_out(spark, registry.QUERIES["confidence_features"](spark, sf_dir)) < 40 * 10 * 10


def test_saved_index_deals_a_common_term_to_several_tasks(spark, many, asked, tmp_path):
    docs = many.select("doc_id", F.concat(F.lit("common "), "text").alias("text"))
    path = f"file://{tmp_path}/index"
    bm25.save_index(docs, path, {"text": 1.0})
    index = bm25.load_index(spark, path, {"text": 1.0})
    parts = index["postings"].groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.sum((F.col("term") == "common").cast("int")).alias("common")).collect()
    # 3,000 documents have the term, beside about 31,000 other postings in 8 parts
    assert sum(r.common for r in parts) == 3000 and max(r.n for r in parts) < 7000
    queries = asked.union(spark.createDataFrame([(0, "common")], asked.schema))
    key = lambda r: (r.query_id, r.rank)
    assert sorted(bm25.search_index(index, queries, 3).collect(), key=key) == sorted(bm25.search(docs, queries, {"text": 1.0}, 3).collect(), key=key)
    assert dealt_out(spark, bm25.search_index(index, queries, 3)) < 700 * 3 * 20
