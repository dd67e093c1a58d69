"""The pipeline's stages against what their operators say, and the registered queries on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from stratamesh.llm import queries
from stratamesh.llm._io import table, written


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    seen = []
    for name, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), "test-stage")
        assert docs.columns == columns, name
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    all_ids = {r["doc_id"] for r in table(spark, sf, "documents").collect()}
    good = {r["doc_id"] for r in queries.op10_rule_ensemble(spark, sf).where("predicted = 1").collect()}
    kept = {r["doc_id"] for r in queries.op6_line_crf(spark, sf).where("kept").collect()}
    assert seen[0] == good and seen[1] == good & kept and seen[0] < all_ids
    assert seen[2] < seen[1] and seen[3] == seen[2]
    assert docs.where("n_chars <> length(text)").count() == 0
    out = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in out} == seen[3]
    fill = {}
    for r in out:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) + 1


def test_secrets_go(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id < 3").withColumn("text", F.concat("text", F.lit("\nAPI_KEY = 'a1b2c3d4e5f6' ok")))
    got = cp.secret_scan(spark, docs, sf)
    assert got.where(F.col("text").endswith("\n[SECRET]' ok")).count() == 3 and got.where("n_chars <> length(text)").count() == 0


def test_empty_table(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = written(stage(spark, docs, sf), "test-empty")
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("pages", "documents", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_odd_rows_go_through_every_stage(spark, sf):
    """Null ids and texts, repeated rows and further columns with names the stages use themselves."""
    sure = queries.op10_rule_ensemble(spark, sf).where("score > 0.9").join(queries.op6_line_crf(spark, sf).where("content_share > 0.9 AND kept"), "doc_id")
    good = [r["text"] for r in table(spark, sf, "documents").join(sure, "doc_id", "left_semi").where("n_chars BETWEEN 1500 AND 4000").orderBy("doc_id").limit(4).collect()]
    rows = [(1, good[0]), (1, good[0]), (2, good[0]), (None, good[1]), (None, good[1]), (3, None), (4, ""), (5, good[2].replace(" ", " password: abcdef123456 ", 1)), (6, good[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "mine", 7, 8, 9, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _note string, _score int, c0 int, size int, gone string")
    columns, kept = docs.columns, []
    for name, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), "test-odd")
        assert docs.columns == columns, name
        assert all((r["_note"], r["_score"], r["c0"], r["size"], r["gone"]) == ("mine", 7, 8, 9, None) for r in docs.collect()), name
        kept.append(sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect()))
    assert kept[0] == kept[1] == sorted([(False, 1), (False, 1), (False, 2), (True, 0), (True, 0), (False, 5), (False, 6)])
    assert kept[2] == kept[3] == sorted([(False, 1), (False, 1), (True, 0), (True, 0), (False, 5), (False, 6)])
    assert "abcdef123456" not in " ".join(r["text"] for r in docs.collect())
    out = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert len(out) >= 6 and {r["doc_id"] for r in out} == {1, None, 5, 6}


def test_queries_return_every_row(spark, sf):
    n = table(spark, sf, "documents").count()
    for name in ("op1_order_minhash", "op2_licence_scan", "op4_suffix_array_pieces", "op5_rendezvous", "op7_markov_secrets", "op8_bbit_minhash"):
        assert queries.QUERIES[name](spark, sf).count() == n
