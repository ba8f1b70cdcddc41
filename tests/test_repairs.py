"""Cases that once gave wrong results: float labels, far neighbours, short samples, stage reuse, bad sentences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inferna.operators import annotate, clean, knn, sample
from inferna.sources import store


def test_labels_of_every_numeric_type(spark):
    t = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (1.5,), (None,), (float("nan"),), (7.0,), (-1.0,), (float("inf"),)], "label double")
    assert sorted(r.y for r in clean.clean_labels(t).collect()) == [0, 1, 2]
    t = spark.createDataFrame([("1.0",), ("2",), (" Neutral ",), ("x",), ("7",), ("0.5",)], "label string")
    assert sorted(r.y for r in clean.clean_labels(t).collect()) == [1, 1, 2]


@pytest.mark.parametrize("models", [1, 16])
def test_neighbours_far_away_and_many_models(spark, models):
    train = [(f"m{m}", f"t{i}", 0 if i < 6 else 1, [1.0 + i / 10 if i < 6 else 3e5 + i, 0.0]) for m in range(models) for i in range(40)]
    test = [(f"m{m}", f"q{i}", "d", 0, [float(i), 0.0]) for m in range(models) for i in range(3)]
    got = knn.knn_predict(spark.createDataFrame(train, "model string, train_id string, label int, vec array<double>"),
                          spark.createDataFrame(test, "model string, doc_id string, dataset string, y int, vec array<double>"),
                          "vec", 5, "euclidean", block_rows=10, query_rows=2).collect()
    assert len(got) == 3 * models and {g.pred for g in got} == {0}


def test_ties_go_to_the_smaller_rank():
    d = np.array([[2.0, 1.0, 1.0, 1.0, 0.5]])
    assert knn.nearest_rows(d, np.array([0, 4, 2, 3, 1]), 3).tolist() == [[4, 2, 3]]


def test_sample_whose_first_threshold_is_short(spark):
    rows = spark.range(1000).select(F.lit("g").alias("g"), (F.col("id") % 3).alias("key")) \
        .withColumn("ok", sample.order_key(F.col("key")))
    quota = spark.createDataFrame([("g", 10)], "g string, n long")
    got = sample.take_first_n(rows, ["g"], quota, "ok").collect()
    assert len(got) == 10 and len({r.key for r in got}) == 1
    smallest = min((r.ok, r.key) for r in rows.distinct().collect())
    assert got[0].key == smallest[1]


def test_stage_reuse_is_per_partition(spark, tmp_path):
    base, calls = f"file://{tmp_path}", []

    def build(ds):
        def f():
            calls.append(ds)
            return spark.createDataFrame([(ds, "train", n) for n in range(2)], "dataset string, split string, n int")
        return f
    for ds in ("en", "fr", "en", "f/r,*"):
        got = store.stage(spark, base, "t", build(ds), dataset=ds, split="train").collect()
        assert [r.dataset for r in got] == [ds, ds]
    assert calls == ["en", "fr", "f/r,*"]
    (tmp_path / "empty").mkdir()
    assert not store.exists(spark, base, "empty") and not store.built(spark, base, "empty")
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").upper() == "STATIC"


def test_one_bad_sentence_keeps_its_batch(spark):
    def make():
        def f(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no parse")
            return [f"({t})" for t in texts], [[] for _ in texts]
        return f
    t = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", None)], "id string, text string").coalesce(1)
    got = {r.sentence_id: r for r in annotate.annotate_with(t, make).collect()}
    assert got["1"].constituency == "(good)" and got["1"].error is None and got["3"].constituency == "()"
    assert got["2"].constituency == "" and "no parse" in got["2"].error


def test_negative_features_fail(spark):
    from inferna.operators import nb
    feats = spark.createDataFrame([("m", "d", 0, 1, -1.0)], "model string, doc_id string, label int, f int, x double")
    docs = spark.createDataFrame([("m", "d", 0)], "model string, doc_id string, label int")
    n = spark.createDataFrame([("m", 1)], "model string, n_features int")
    with pytest.raises(Exception, match="at least 0"):
        nb.fit(feats, docs, n, ["model"])[1].collect()


def test_encoder_loads_once_per_task(spark):
    from inferna.functions import embed

    def make():
        calls = []

        def f(texts):
            calls.append(len(texts))
            return np.array([[len(t), len(calls)] for t in texts], dtype=float)
        return f
    t = spark.createDataFrame([(i, "x" * i) for i in range(5)] + [(9, None)], "id long, text string").coalesce(1)
    got = {r.sentence_id: r.embedding for r in embed.encode_with(t, make, batch=2).collect()}
    assert [got[i][0] for i in (0, 4, 9)] == [0, 4, 0] and max(e[1] for e in got.values()) == 3


def test_max_depth(spark):
    from inferna.functions import parse
    t = spark.createDataFrame([("(a (b c) (d (e f)))",), ("",), (None,)], "t string")
    assert [r[0] for r in t.select(parse.max_depth(F.col("t"))).collect()] == [3, 0, 0]
