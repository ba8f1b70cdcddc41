"""Every key trained, saved, loaded and evaluated; failed saves leave nothing; scaling against plain Python."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from inferna.operators import trees
from inferna.plans import model_store as MS

ROW = "doc_id string, label int, premise_text string, hypothesis_text string, syn map<string,double>"
WORDS = ["apple bread", "river stone", "cloud storm"]
SMALL = {"baseline-1": trees.Spec(depth=2, bins=4), "experiment-1": trees.Spec(depth=2, bins=4),
         "experiment-5": trees.Spec(depth=3, bins=4, trees=5, forest=True), "experiment-6": trees.Spec(depth=2, bins=4, stages=1)}


def rows(spark, seed, n, models):
    r, out = random.Random(seed), []
    for m in models:
        for i in range(n):
            y = i % 3
            syn = {"premise_const_a": float(y), "diff_dep_b": r.random() + y, "x_dep_odd": 1.0} if i % 5 else {"premise_const_a": float(y)}
            out.append((m, f"{m}{i}", y, f"{WORDS[y]} noise{r.randrange(4)} word", f"{WORDS[y].split()[0]} thing{r.randrange(4)}", syn))
    return spark.createDataFrame(out, f"model string, {ROW}")


@pytest.fixture(scope="module")
def frames(spark):
    train = rows(spark, 1, 30, ["en", "fr"])
    test = rows(spark, 2, 9, ["en", "fr"]).select(F.concat(F.lit("t"), "doc_id").alias("doc_id"), F.col("model").alias("dataset"), F.col("label").alias("y"),
                                                 "premise_text", "hypothesis_text", "syn")
    return train, test


def small(key):
    m = MS.MODELS[key]
    return replace(m, spec=SMALL.get(key), steps=20, k=3)


def test_registry_has_every_key():
    assert sorted(MS.MODELS) == [f"baseline-{i}" for i in (1, 2, 3)] + [f"experiment-{i}" for i in range(1, 7)]
    assert sorted(MS.STUDIES) == ["experiment-7", "experiment-8"]


@pytest.mark.parametrize("key", sorted(MS.MODELS))
def test_round_trip(spark, frames, tmp_path, key):
    train, test = frames
    path = MS.train(spark, key, train, str(tmp_path), small(key))
    saved = MS.load(spark, key, str(tmp_path), small(key))
    assert saved.path.endswith(path)
    meta = {r.model: (r.key, r.n_train) for r in saved.tables["metadata"].collect()}
    assert meta == {"en": (key, 30), "fr": (key, 30)}
    pred = saved.predict(test).collect()
    assert len(pred) == 2 * 18 and {r.pred for r in pred} <= {0, 1, 2}
    assert sum(r.y == r.pred for r in pred) >= 0.8 * len(pred)
    if key in ("baseline-3", "experiment-3"):
        cells = saved.evaluate(test).select("experiment", "predict_dataset", "trained_dataset").collect()
        assert sorted(map(tuple, cells)) == [(key, p, t) for p in ("en", "fr") for t in ("en", "fr")]


def test_failed_save_leaves_the_version_before(spark, tmp_path):
    base = str(tmp_path)
    good = spark.createDataFrame([("k", "en", "nb", 1, 1)], "key string, model string, learner string, n_train long, n_features long")
    first = MS.save(spark, {"metadata": good}, base, "baseline-3")
    bad = good.select("model", F.raise_error(F.lit("disk lost")).cast("string").alias("x"))
    with pytest.raises(Exception, match="disk lost"):
        MS.save(spark, {"weights": bad, "metadata": good}, base, "baseline-3")
    assert [v.split("/")[-1] for v in MS.versions(spark, base, "baseline-3")] == [first.split("/")[-1]]
    assert len(list((tmp_path / "baseline-3").iterdir())) == 1
    second = MS.save(spark, {"metadata": good}, base, "baseline-3")
    assert MS.load(spark, "baseline-3", base).path.endswith(second)
    with pytest.raises(FileNotFoundError):
        MS.load(spark, "experiment-1", base)


def test_scaling_counts_missing_features_as_zero(spark):
    values = [{"a": 2.0, "b": 5.0}, {"a": 4.0}, {"a": 4.0, "c": -1.0}, {}]
    df = spark.createDataFrame([("m", f"d{i}", 0, "", "", v) for i, v in enumerate(values)], f"model string, {ROW}")
    for kind in ("raw", "standard", "nomean", "minmax"):
        scaling = MS.fit_scaling(df, kind)
        got = {r.doc_id: r.vec for r in MS.scaled_vectors(df.select("model", "doc_id", "syn"), scaling).collect()}
        for j, name in enumerate("abc"):
            x = [v.get(name, 0.0) for v in values]
            mean, lo, hi = sum(x) / 4, min(x), max(x)
            sd = math.sqrt(sum((v - mean) ** 2 for v in x) / 4)
            want = {"raw": x, "standard": [(v - mean) / sd for v in x], "nomean": [v / sd for v in x], "minmax": [(v - lo) / (hi - lo) for v in x]}[kind]
            assert [got[f"d{i}"][j] for i in range(4)] == pytest.approx(want)
    same = df.withColumn("syn", F.expr("map('k', 3.0D)"))
    assert {tuple(r.vec) for r in MS.scaled_vectors(same.select("model", "doc_id", "syn"), MS.fit_scaling(same, "minmax")).collect()} == {(0.0,)}


def test_one_class_and_empty(spark, frames, tmp_path):
    train, test = frames
    for key in ("baseline-2", "baseline-3"):
        MS.train(spark, key, train.where("label = 1"), str(tmp_path / "one"), small(key))
        pred = MS.load(spark, key, str(tmp_path / "one"), small(key)).predict(test).collect()
        assert len(pred) == 36 and {r.pred for r in pred} == {1}
    MS.train(spark, "baseline-3", train.limit(0), str(tmp_path / "none"), small("baseline-3"))
    assert MS.load(spark, "baseline-3", str(tmp_path / "none"), small("baseline-3")).predict(test).count() == 0
