"""End-to-end plans on the sf0.001 tables: invariants (R checks), KNN vs
brute force, NB vs a direct numpy computation, streaming, stage store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from inferna.operators import knn, nb
from inferna.sources import store
from inferna.sources import tables as src


def test_ids_unique_across_rounds(spark):
    # D1 guard: output rows = input rows and ids are unique
    raw = src.nli_raw(spark, SF001)
    n = raw.count()
    assert raw.select("id").distinct().count() == n
    assert src.round_union(raw).count() == n


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    for r in rows:
        assert 0.0 <= r.accuracy <= 1.0


def test_every_query_has_columns(spark):
    import __spark_entry__ as entry
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    xt = rng.normal(size=(60, 4)).round(2)
    xq = rng.normal(size=(15, 4)).round(2)
    yt = rng.integers(0, 3, size=60)
    train = spark.createDataFrame([("m", f"t{i:03d}", int(yt[i]), xt[i].tolist()) for i in range(60)],
                                  "model string, train_id string, label int, vec array<double>")
    test = spark.createDataFrame([("m", f"q{i:03d}", "d", 0, xq[i].tolist()) for i in range(15)],
                                 "model string, doc_id string, dataset string, y int, vec array<double>")
    got = {r.doc_id: r.pred for r in knn.knn_predict(train, test, "vec", 5, "euclidean", block_rows=16).collect()}
    for i in range(15):
        d = np.round(np.sqrt(((xt - xq[i]) ** 2).sum(1)), 9)
        order = sorted(range(60), key=lambda j: (d[j], f"t{j:03d}"))[:5]
        votes = np.bincount(yt[order], minlength=3)
        assert got[f"q{i:03d}"] == int(np.argmax(votes))


def test_nb_matches_direct_computation(spark):
    x = np.array([[2, 0, 1], [0, 3, 0], [1, 1, 0], [0, 0, 4]], dtype=float)
    y = np.array([0, 1, 0, 2])
    feats = spark.createDataFrame([("m", f"d{i}", int(y[i]), j, float(x[i, j]))
                                   for i in range(4) for j in range(3) if x[i, j]],
                                  "model string, doc_id string, label int, f int, x double")
    docs = spark.createDataFrame([("m", f"d{i}", int(y[i])) for i in range(4)], "model string, doc_id string, label int")
    nf = spark.createDataFrame([("m", 3)], "model string, n_features long")
    classes, fm = nb.fit(feats, docs, nf, ["model"], 1.0)
    q = np.array([[1, 1, 1], [0, 0, 0]], dtype=float)
    qf = spark.createDataFrame([("m", f"q{i}", j, float(q[i, j])) for i in range(2) for j in range(3) if q[i, j]],
                               "model string, doc_id string, f int, x double")
    qd = spark.createDataFrame([("m", f"q{i}") for i in range(2)], "model string, doc_id string")
    got = {r.doc_id: r.pred for r in nb.predict(qf, qd, classes, fm, ["model"], ["doc_id"]).collect()}
    prior = np.log(np.bincount(y) / len(y))
    cnt = np.stack([x[y == c].sum(0) for c in range(3)])
    logp = np.log((cnt + 1) / (cnt.sum(1, keepdims=True) + 3))
    want = (q @ logp.T + prior).argmax(1)
    assert [got["q0"], got["q1"]] == want.tolist()


def test_streaming_text_stats(spark, tmp_path):
    from inferna.streaming import pairs as SP
    landing = str(tmp_path / "docs")
    src.table(spark, SF001, "documents").repartition(3).write.parquet(landing)   # 3 files = 3 micro-batches
    docs = SP.document_stream(spark, landing)
    labels = src.table(spark, SF001, "labels")
    q = SP.start(SP.pair_stats_stream(spark, docs, labels), "memory", "pair_stats_test")
    q.processAllAvailable()
    q.stop()
    n_stream = spark.sql("SELECT count(*) AS n FROM pair_stats_test").first().n
    assert n_stream == src.nli_raw(spark, SF001).count()


def test_stage_store_roundtrip(spark, tmp_path):
    base = str(tmp_path)
    raw = src.nli_raw(spark, SF001).select("id", "dataset", "split", "label")
    assert not store.exists(spark, base, "raw")
    got = store.stage(spark, base, "raw", lambda: raw)
    assert got.count() == raw.count()
    one = store.load(spark, base, "raw", dataset="en", split="test")
    assert one.count() == raw.where((F.col("dataset") == "en") & (F.col("split") == "test")).count()
    empty = store.load(spark, base, "missing", schema=raw.schema)
    assert empty.count() == 0
