"""Feature types (U8), extractors over stored tables (P13), blocks and the float guard."""

import pytest
from pyspark.sql import functions as F

from inferna.operators import feature_sets as FS
from inferna.operators import features

RAW = "id string, dataset string, split string, label int, premise_text string, hypothesis_text string"


def raw_frame(spark):
    return spark.createDataFrame([("a", "en", "train", 0, "The big dog runs", "A dog"), ("b", "en", "train", 1, "Cats sleep 12 hours", "Cats sleep"),
                                  ("c", "en", "test", 2, "x", "The big dog runs"), ("d", "en", "test", -1, "x", "y"), ("e", "en", "test", 0, None, "y")], RAW)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_families_in_the_plan_and_in_the_table(spark):
    raw = raw_frame(spark)
    lexical = FS.typed_features(raw, ["lexical"])
    assert "Join" not in plan(lexical) and "regexp_extract_all" not in plan(lexical) and "syn" not in lexical.columns
    assert "avg_dep_dist" not in plan(FS.typed_features(raw, ["constituency"]))
    assert "count_NP" not in plan(FS.typed_features(raw, ["dependency"])) and "tree_depth_proxy" in plan(FS.typed_features(raw, ["dependency"]))
    # the default is the whole feature table
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("syn")))).alias("syn")
    cols = ["pair_id", "dataset", "split", "label", "length_ratio", "word_overlap_count", text]
    whole = features.pair_features(raw).select(cols)
    assert sorted(FS.typed_features(raw).select(cols).collect()) == sorted(whole.collect())
    both = [set(FS.typed_features(raw, [t]).where("pair_id = 'a'").select(F.map_keys("syn")).first()[0]) for t in ("constituency", "dependency", "syntactic")]
    assert both[0] and both[1] and both[0] | both[1] == both[2] and not both[0] & both[1]


@pytest.mark.parametrize("types", [[], ["bert"], ["lexical", "x"]])
def test_unknown_types(spark, types):
    with pytest.raises(ValueError):
        FS.typed_features(raw_frame(spark), types)


def test_manifest_round_trip_and_missing_columns(spark, tmp_path):
    feats = features.pair_features(raw_frame(spark))
    train, test = (feats.where(F.col("split") == s) for s in ("train", "test"))
    wide = [FS.wide_table(t, features.collect_feature_list(t)) for t in (train, test)]
    for kind in ("lexical", "syntactic", "combined"):
        names = FS.manifest(wide[0], kind)
        FS.save_manifest(spark, names, str(tmp_path / kind))
        assert FS.load_manifest(spark, str(tmp_path / kind)) == names
        out = FS.extract(wide[1], names)
        assert out.columns == ["pair_id", "label", *names]
        row = out.first()
        assert all(row[n] == 0 for n in names if n not in wide[1].columns)
    assert FS.manifest(wide[0], "combined") == sorted(set(FS.manifest(wide[0], "lexical")) | set(FS.manifest(wide[0], "syntactic")))
    assert any(n not in wide[1].columns for n in FS.manifest(wide[0], "syntactic"))
    nulls = FS.extract(wide[1].withColumn("premise_length", F.lit(None).cast("double")), ["premise_length", "no.such"])
    assert [tuple(r)[2:] for r in nulls.collect()] == [(0.0, 0.0)]


def test_blocks_and_floats(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 0.1, 3.0, float("nan"), 1e300, 7.0)],
                               "pair_id string, label int, premise_length double, premise_cls_bert_0 double, hypothesis_dep_x double, hypothesis_cls_bert_0 double, premise_bert_1 double, diff_x double")
    b = FS.pack_blocks(df)
    assert dict(b.dtypes)["premise_parse"] == "array<float>"
    r = b.first()
    assert (r.premise_parse, r.hypothesis_parse, r.hypothesis_embedding) == ([2.0], [3.0], [0.0]) and abs(r.premise_embedding[0] - 0.1) < 1e-7
    assert "premise_embedding" not in FS.pack_blocks(df.drop("premise_cls_bert_0")).columns
    x = spark.createDataFrame([([1.5, None, float("inf"), float("-inf"), float("nan"), 1e300],)], "a array<double>")
    assert x.select(FS.finite_floats(F.col("a")).alias("f")).first().f == [1.5, 0, 0, 0, 0, 0]
