"""one preparation for all saved models; vectors scaled by batches."""

from pyspark.sql import functions as F

from inferna.plans import model_store as MS


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def write_documents(spark, folder):
    docs = [(i, ". ".join(f"word{i} number{j} sat here" for j in range(4)), "en" if i // 10 % 2 else "fr") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_models_share_one_preparation(spark, tmp_path, monkeypatch):
    write_documents(spark, tmp_path)
    calls, real = [], MS.TM.train_test
    monkeypatch.setattr(MS.TM, "train_test", lambda *a: (calls.append(a[2]), real(*a))[1])
    keys = ("baseline-3", "experiment-4")
    out = {(r.experiment, r.predict_dataset, r.trained_dataset): r.n for r in MS.train_save_evaluate(spark, str(tmp_path), keys, str(tmp_path / "models")).collect()}
    assert calls == [True] and out == {(k, p, t): 9 for k in keys for p in ("en", "fr") for t in ("en", "fr")}


def test_scaled_vectors_of_unknown_models(spark):
    docs = spark.createDataFrame([("m", "1", {"b": 5.0}), ("x", "2", {"b": 5.0}), (None, "3", {}), ("m", "4", None)], "model string, doc_id string, syn map<string,double>")
    scaling = spark.createDataFrame([("m", "a", 0, 1.0, 2.0), ("m", "b", 1, 1.0, 4.0)], "model string, feature string, pos int, shift double, scale double")
    out = MS.scaled_vectors(docs, scaling)
    assert "lambda" not in plan(out) and "Join" not in plan(out)
    assert {r.doc_id: r.vec for r in out.collect()} == {"1": [-0.5, 1.0], "2": [], "3": [], "4": [-0.5, -0.25]}
