"""Properties, independent implementations and streams."""

import math
import sqlite3

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import bm25, metrics, ranking, sessions
from tessera.plans.fixtures import MESSAGES, OUTCOMES, PREDICTIONS
from tessera.sources import jsonl
from tessera.streaming.memory import stream_memory


def test_bm25_is_sqlites(spark):
    rows = [(1, "red boot boot", "acme"), (2, "blue boot", "red"), (3, "green hat", "acme acme"), (4, "wool hat red", ""), (5, "scarf", "x")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, title, store, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    want = {int(i): s for i, s in con.execute("SELECT id, bm25(t, 0.0, 6.0, 3.0) FROM t WHERE t MATCH 'red OR hat OR boot'")}
    docs = spark.createDataFrame(rows, "doc_id long, title string, store string")
    queries = spark.createDataFrame([(0, t) for t in ("red", "hat", "boot")], "query_id int, term string")
    got = {r.doc_id: r.score for r in bm25.search(docs, queries, {"title": 6.0, "store": 3.0}).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)


def test_stream_equals_batch(spark, tmp_path):
    rows = MESSAGES.spark(spark)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = stream_memory(stream).writeStream.format("memory").queryName("memory").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    run.awaitTermination()
    seen = spark.table("memory").collect()
    last = {r.session: max(x.turn for x in seen if x.session == r.session) for r in seen}
    got = {(r.session, r.slot, r.value, r.required) for r in seen if r.turn == last[r.session]}
    assert got == {tuple(r) for r in sessions.session_memory(rows).collect()}


@settings(max_examples=4, deadline=None)
@given(st.permutations([("q", "a", 1, 2), ("q", "b", 2, None), ("q", "c", None, 1), ("q", "d", 3, 3)]))
def test_fusion_ignores_row_order(spark, rows):
    out = ranking.fuse(spark.createDataFrame(rows, "query string, id string, bm25_rank int, cos_rank int"), 0.05)
    assert [r.id for r in out.orderBy("rank").collect()] == ["a", "d", "b", "c"]


def test_metrics_of_no_sessions(spark):
    row = OUTCOMES.spark(spark).limit(0).agg(*metrics.session_metrics()).first()
    assert (row.sample_count, row.hit_rate_at_10, row.mrr, row.mttc) == (0, 0.0, 0.0, None)


def test_auc_of_one_class_is_null(spark):
    assert metrics.brier_logloss_auc(PREDICTIONS.spark(spark).where("y = 1")).first().roc_auc is None


def test_catalog_keeps_the_order_of_details(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"parent_asin": "a", "price": "x", "details": {"z": "1", "a": "2", "m": null}}\n\n{"parent_asin": "b", "features": ["f"]}\n')
    rows = {r.parent_asin: r for r in jsonl.read_catalog(spark, str(tmp_path)).collect()}
    assert [tuple(e) for e in rows["a"].details] == [("z", "1"), ("a", "2"), ("m", None)]
    assert rows["b"].details is None and rows["b"].features == ["f"]


def test_traps_of_slots(spark):
    df = spark.createDataFrame([("a tailored earring",), ("not suede",), ("size 9.5 under $40",)], "t string")
    got = [r.asDict() for r in df.select(*[v.alias(k) for k, v in T.slots(F.col("t")).items()]).collect()]
    assert got[0]["color"] == "red" and got[0]["category"] == "ring"
    assert got[1]["material"] == "suede" and got[1]["material_negated"]
    assert got[2]["size"] == "9.5" and got[2]["budget"] == "40"
