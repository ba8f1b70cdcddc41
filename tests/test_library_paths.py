"""Library paths not reached by the registered queries."""

import sys

from pyspark import cloudpickle

from inferna.operators import annotate
from inferna.sources import tables as src


# user-supplied annotator factories must reach the Python workers: ship this
# module by value (a deployed annotator would be installed or --py-files'd)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _toy_annotator():
    def run(texts):
        const = ["(ROOT (S (NN " + t + ")))" if t else "" for t in texts]
        deps = [[{"id": 1, "text": t, "lemma": t.lower(), "pos": "NOUN", "head": 0, "deprel": "root"}]
                if t else [] for t in texts]
        return const, deps
    return run


def _failing_annotator():
    def run(texts):
        raise RuntimeError("model failed")
    return run


def test_annotate_with_pluggable(spark):
    df = spark.createDataFrame([("a", "Dog"), ("b", None)], "id string, text string")
    rows = {r.sentence_id: r for r in annotate.annotate_with(df, _toy_annotator).collect()}
    assert rows["a"].constituency == "(ROOT (S (NN Dog)))"
    assert rows["a"].dependency[0].deprel == "root" and rows["a"].dependency[0].head == 0
    assert rows["b"].constituency == "" and rows["b"].dependency == []


def test_annotate_with_failed_batch_gives_empty_trees(spark):
    df = spark.createDataFrame([("a", "Dog")], "id string, text string")
    r = annotate.annotate_with(df, _failing_annotator).first()
    assert r.constituency == "" and r.dependency == []


def test_union_pieces_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "id int, p string")
    b = spark.createDataFrame([("y", 2, 7)], "p string, id int, extra int")
    out = {r.id: r for r in src.union_pieces([a, b], "anli_round", ["r1", "r2"]).collect()}
    assert out[1].anli_round == "r1" and out[1].extra is None
    assert out[2].anli_round == "r2" and out[2].extra == 7


def test_results_csv_sink_sorted(spark, tmp_path):
    from inferna.sources import store
    res = spark.createDataFrame([("e", "fr", "en", 0.5), ("e", "de", "en", 0.25)],
                                "experiment string, predict_dataset string, trained_dataset string, accuracy double")
    path = str(tmp_path / "results")
    store.write_results_csv(res, path)
    back = spark.read.option("header", True).csv(path).collect()
    assert [r.predict_dataset for r in back] == ["de", "fr"]


def test_model_persistence_roundtrip(spark, tmp_path):
    # Fitted PipelineModels are saved per (experiment, training dataset)
    # and reload to the same predictions
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from conftest import SF001
    from inferna.plans import grid
    from inferna.plans import models as ML
    exp = ML.EXPERIMENTS["experiment-1"]
    save = str(tmp_path / "models")
    pred = ML.fit_predict(spark, SF001, exp, save_dir=save)
    got = {(r.model, r.doc_id): r.pred for r in pred.collect()}
    train, test = grid.feature_train_test(spark, SF001)
    _, te = grid.syntactic_vectors(train, test, grid.datasets_of(train), exp.syntactic)
    for m in {k[0] for k in got}:
        model = PipelineModel.load(f"{save}/{exp.key}/{m}")
        rows = model.transform(te.where(F.col("model") == m).select("doc_id", array_to_vector("vec").alias("features")))
        for r in rows.select("doc_id", "prediction").collect():
            assert got[(m, r.doc_id)] == int(r.prediction)
