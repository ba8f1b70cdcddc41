"""The training sample is drawn before the features; scaling by batches."""

from pyspark.sql import functions as F

from inferna.operators import features
from inferna.operators import vectorize as V
from inferna.plans import grid


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def write_documents(spark, folder):
    docs = [(i, ". ".join(f"word{i} number{j} sat here" for j in range(4)), "en" if i // 10 % 2 else "fr") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_only_rows_in_use_are_annotated(spark, tmp_path, monkeypatch):
    write_documents(spark, tmp_path)
    seen, real = [], features.pair_sentences
    monkeypatch.setattr(features, "pair_sentences", lambda pairs: (seen.append(pairs), real(pairs))[1])
    train, test = grid.feature_train_test(spark, str(tmp_path), 20)
    whole = features.pair_features(grid.src.nli_raw(spark, str(tmp_path)))
    assert [seen[0].where(F.col("split") == s).count() for s in ("train", "test", "validation")] == [32, 18, 0]
    for got, of in ((train, "train"), (test, "test")):
        cols = ["pair_id", "dataset", "split", "label", "premise_text", "hypothesis_text", "length_ratio", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("syn")))).alias("syn")]
        kept = whole.where(F.col("split") == of).join(got.select("pair_id"), "pair_id", "left_semi").select(cols)
        assert got.count() == (32 if of == "train" else 18) and kept.exceptAll(got.select(cols)).isEmpty() and got.select(cols).exceptAll(kept).isEmpty()


def test_scaling_by_place(spark):
    df = spark.createDataFrame([(1, [1.0, None, 3.0]), (2, None), (3, []), (4, [4.0, 5.0, 6.0, 7.0])], "id int, a array<double>")
    st = {"mean": [1.0, 1.0, 2.0], "std": [2.0, 0.0, 4.0], "min": [0.0, 1.0, 3.0], "max": [2.0, 1.0, 6.0]}
    both = df.select("id", V.standard_scale(F.col("a"), st).alias("z"), V.standard_scale(F.col("a"), st, False).alias("n"), V.minmax_scale(F.col("a"), st).alias("m"))
    assert "lambda" not in plan(both)
    got = {r.id: (r.z, r.n, r.m) for r in both.collect()}
    assert got[1] == ([0.0, None, 0.25], [0.5, None, 0.75], [0.5, None, 0.0]) and got[2] == (None, None, None) and got[3] == ([], [], [])
    assert got[4] == ([1.5, 4.0, 1.0, None], [2.0, 5.0, 1.5, None], [2.0, 0.0, 1.0, None])
