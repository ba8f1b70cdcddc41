"""Stage tables by unit - built once, resumed after a failure, forced by stage."""

import pytest
from pyspark.sql import functions as F

from inferna.operators import annotate, features
from inferna.plans import preprocess as PP
from inferna.sources import store

RAW = "id string, dataset string, split string, label int, premise_text string, hypothesis_text string"


def raw_frame(spark):
    rows = []
    for d in ("en", "f/r"):
        for s in ("train", "test"):
            rows += [(f"{d}{s}{i}", d, s, i % 4 - 1 if i % 7 else None, f"The cat number {i % 5} sat", f"A dog {i} runs" if i % 6 else " ") for i in range(40)]
    rows += [("x1", "empty", "train", -1, "a", "b"), ("x2", None, "train", 0, "a", "b"), ("x3", "en", "train", 0, None, "b")]
    return spark.createDataFrame(rows, RAW)


def read(spark, run, stage):
    return store.load(spark, run.base, run.table(stage))


def test_built_once_and_equal_to_the_plan_in_one_go(spark, tmp_path):
    raw = raw_frame(spark)
    run = PP.preprocess(spark, raw, str(tmp_path))
    assert run.units == [("empty", "train"), ("en", "test"), ("en", "train"), ("f/r", "test"), ("f/r", "train")]
    assert all(run.built[s] == run.units for s in PP.STAGES)
    again = PP.preprocess(spark, raw, str(tmp_path))
    assert all(again.built[s] == [] for s in PP.STAGES)
    cols = ["pair_id", "dataset", "split", "label", "length_ratio", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("syn")))).alias("syn")]
    want = features.pair_features(raw.where("dataset is not null")).select(cols)
    got = read(spark, run, "features").select(cols)
    assert got.count() > 50 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    counts = {(r.stage, r.dataset, r.split): (r.n_rows, r.n_built) for r in PP.stage_counts(spark, [run, again]).collect()}
    assert counts["raw_input", "empty", "train"] == (1, 1) and counts["features", "empty", "train"] == (0, 1)


def test_force_by_stage_and_new_units(spark, tmp_path):
    raw = raw_frame(spark)
    first = PP.preprocess(spark, raw, str(tmp_path), units=[("en", "train")])
    assert first.built["parses"] == [("en", "train")]
    more = PP.preprocess(spark, raw, str(tmp_path))
    assert ("en", "train") not in more.built["raw_input"] and len(more.built["features"]) == 4
    forced = PP.preprocess(spark, raw, str(tmp_path), force="parses")
    assert [len(forced.built[s]) for s in PP.STAGES] == [0, 0, 0, 5, 5]
    # a unit whose rows are gone from the input is emptied when forced
    gone = PP.preprocess(spark, raw.where("dataset <> 'f/r' or split <> 'test'"), str(tmp_path), force="raw_input", units=[("f/r", "test")])
    assert gone.built["features"] == [("f/r", "test")]
    assert read(spark, gone, "features").where("dataset = 'f/r' and split = 'test'").isEmpty()
    assert not read(spark, gone, "features").where("dataset = 'f/r' and split = 'train'").isEmpty()
    with pytest.raises(ValueError):
        PP.preprocess(spark, raw, str(tmp_path), force="parsing")


def test_resumes_after_a_failed_stage(spark, tmp_path):
    raw = raw_frame(spark)

    def broken(sentences):
        out = annotate.annotate_rules(sentences)
        return out.withColumn("constituency", F.raise_error(F.lit("annotator lost")).cast("string"))

    with pytest.raises(Exception, match="annotator lost"):
        PP.preprocess(spark, raw, str(tmp_path), annotator=broken)
    run = PP.preprocess(spark, raw, str(tmp_path))
    assert [len(run.built[s]) for s in PP.STAGES] == [0, 0, 0, 5, 5]
    assert read(spark, run, "features").count() == read(spark, run, "pairs").count()


def test_sample_and_empty_input(spark, tmp_path):
    raw = raw_frame(spark)
    run = PP.preprocess(spark, raw, str(tmp_path), total_sample=20)
    sizes = {(r.dataset, r.split): r["count"] for r in read(spark, run, "raw_input").groupBy("dataset", "split").count().collect()}
    assert sizes["en", "train"] == 16 and sizes["en", "test"] == 2
    assert run.table("pairs") == "pairs_sample20"
    none = PP.preprocess(spark, raw.limit(0), str(tmp_path / "none"))
    assert none.units == [] and PP.stage_counts(spark, [none]).count() == 0
