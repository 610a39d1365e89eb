"""Artifacts, guards, folds, negatives, encoders, sources and the entry point."""

import hashlib
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import bm25, dense, metrics, synthesis, tfidf
from tessera.sources import jsonl

DOCS = [(1, "red boot boot"), (2, "blue boot"), (3, "green hat"), (4, "wool hat red"), (5, None)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_saved_index_is_checked(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    bm25.save_index(docs, path, {"text": 2.0})
    queries = spark.createDataFrame([(0, t) for t in ("red", "hat")], "query_id int, term string")
    index = bm25.load_index(spark, path, {"text": 2.0})
    assert bm25.search_index(index, queries).collect() == bm25.search(docs, queries, {"text": 2.0}).collect()
    with pytest.raises(ValueError, match="fields"):
        bm25.load_index(spark, path, {"text": 1.0})
    index["postings"].limit(2).write.mode("overwrite").parquet(f"{path}-cut")
    spark.read.parquet(f"{path}-cut").write.mode("overwrite").parquet(f"{path}/postings")
    with pytest.raises(ValueError, match="rows"):
        bm25.load_index(spark, path, {"text": 2.0})


def test_saved_fit_is_checked(spark, docs, tmp_path):
    path = f"file://{tmp_path}/fit"
    tfidf.save_fit(docs, path)
    asked = spark.createDataFrame([(7, "red hat boot")], "item_id long, text string")
    assert tfidf.search_fit(tfidf.load_fit(spark, path, docs), asked).collect() == tfidf.cosine_search(docs, asked).collect()
    with pytest.raises(ValueError, match="text"):
        tfidf.load_fit(spark, path, docs.limit(2))


def test_pages_follow_each_other(spark, docs):
    queries = spark.createDataFrame([(q, t) for q in (0, 1, 2) for t in ("red", "hat", "boot")], "query_id int, term string")
    pages = spark.createDataFrame([(0, 0), (1, 1), (2, 5)], "query_id int, page int")
    got = {(r.query_id, r.rank): r.doc_id for r in bm25.search(docs, queries, {"text": 1.0}, 2, pages=pages).collect()}
    whole = [r.doc_id for r in bm25.search(docs, queries.where("query_id = 0"), {"text": 1.0}, 9).orderBy("rank").collect()]
    assert got == {(0, 1): whole[0], (0, 2): whole[1], (1, 3): whole[2], (1, 4): whole[3]}


def test_encoder_and_dense_index(spark, docs, tmp_path):
    encode = lambda texts: np.array([[t.count("o"), t.count("e"), len(t)] for t in texts])
    vectors = dense.encoded(docs.union(spark.createDataFrame([(6, " ")], docs.schema)), encode, "doc_id").withColumnRenamed("doc_id", "vec_id")
    assert {r.vec_id: round(float(np.linalg.norm(r.v)), 6) for r in vectors.collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    path = f"file://{tmp_path}/vectors"
    dense.save_vectors(vectors, path, "counts")
    assert dense.load_vectors(spark, path, "counts").count() == 4
    with pytest.raises(ValueError, match="encoder"):
        dense.load_vectors(spark, path, "other")
    assert dense.search(vectors, vectors, 0).collect() == [] and dense.search(vectors, vectors, 9).count() == 12


def test_folds_of_groups_by_a_plain_greedy_choice(spark):
    rng = np.random.default_rng(8)
    rows = [(k, f"t{rng.integers(0, 25)}", ["buying", "browsing"][k % 2], str(rng.integers(0, 2))) for k in range(80)]
    got = {r.sample: r.fold for r in synthesis.grouped_folds(spark.createDataFrame(rows, "sample long, target string, scenario string, difficulty string"), 5, 7).collect()}
    groups = {}
    for r in sorted(rows):
        groups.setdefault(r[1], []).append(r)
    key = lambda t: (groups[t][0][2], groups[t][0][3], hashlib.blake2b(f"7\0{t}".encode(), digest_size=8).digest())
    sizes, want = [0] * 5, {}
    for t in sorted(groups, key=key):
        fold = sizes.index(min(sizes))
        sizes[fold] += len(groups[t])
        want |= {r[0]: fold for r in groups[t]}
    assert got == want


def test_selection_of_the_best_of_other_folds(spark):
    scores = spark.createDataFrame([("a", 0, 10, 0.9), ("a", 1, 10, 0.2), ("b", 0, 10, 0.5), ("b", 1, 10, 0.5), ("c", 0, 10, 0.5), ("c", 1, 10, 0.5)], "config string, fold int, n int, score double")
    assert {r.fold: (r.config, r.train_score, r.valid_score) for r in synthesis.selected(scores, 2).collect()} == {0: ("b", 0.5, 0.5), 1: ("a", 0.9, 0.2)}


def test_negatives_are_complete(spark):
    rows = [(k, "big" if k < 50 else f"small{k % 20}") for k in range(80)] + [(100, None)]
    got = {}
    for r in synthesis.negatives(spark.createDataFrame(rows, "id long, category string")).collect():
        got.setdefault(r.id, {})[r.k] = r.negative
    kind = dict(rows)
    assert set(got) == set(kind) and all(sorted(v) == [1, 2, 3, 4, 5, 6, 7] and len(set(v.values())) == 7 and i not in v.values() for i, v in got.items())
    assert all(kind[n] == "big" for i in range(50) for n in got[i].values())
    assert all(kind[got[i][1]] == kind[i] for i in range(50, 60)) and synthesis.negatives(spark.createDataFrame([(1, "x"), (2, "x")], "id long, category string")).count() == 2


def test_missing_or_repeated_keys_fail(spark):
    samples, catalog = (spark.createDataFrame([(k,) for k in ks], "id long") for ks in ((1, 2), (1, 3)))
    with pytest.raises(Exception, match="no id 2"):
        synthesis.joined_or_fail(samples, catalog, "id").collect()
    assert synthesis.joined_or_fail(samples.where("id = 1"), catalog, "id").count() == 1
    with pytest.raises(Exception, match="id repeats"):
        jsonl.unique_or_fail(samples.union(samples), "id").collect()


def test_lines_that_are_no_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\nnot json\n\n{"id": 2, "more": 3}\n')
    assert sorted(str(r.id) for r in jsonl.read_jsonl(spark, str(tmp_path), "id long").collect()) == ["1", "2", "None"]
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_jsonl(spark, str(tmp_path), "id long", strict=True).collect()
    jsonl.write_jsonl(spark.createDataFrame([(1, None)], "id long, x string"), f"{tmp_path}/out")
    assert [r.id for r in jsonl.read_jsonl(spark, f"{tmp_path}/out", "id long").collect()] == [1]


def test_accents_and_marks_are_folded(spark):
    row = spark.createDataFrame([("Tőke Čapek ŞİŠ café café Ἀθήνα Ёж",)], "t string").select(T.index_tokens(F.col("t")).alias("w")).first()
    assert row.w[:2] == ["toke", "capek"] and row.w[3] == row.w[4] == "cafe" and row.w[5:] == ["αθηνα", "еж"]


def test_area_of_many_scores_by_pairs(spark):
    rng = np.random.default_rng(2)
    p, y = np.round(rng.random(300), 3), rng.integers(0, 2, 300)
    got = metrics.brier_logloss_auc(spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int")).first().roc_auc
    pairs = [(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]
    assert got == round(float(np.mean(pairs)), 6)


def test_entry_without_a_library_of_the_training_queries():
    code = "import sys; sys.modules['tiktoken'] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; names = e.queries(); print(len(names), 'op6_tokens' in names)"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[-2]) > 70 and out[-1] == "False"
