"""Hand-computed frames (FIXTURES §3) for F1-F5, P18, F6-F17, P15."""

import pytest
from pyspark.sql import functions as F

from inferna.functions import parse as P
from inferna.functions import text as T
from inferna.operators import annotate, clean


def stats(spark, p, h):
    df = spark.createDataFrame([(p, h)], "p string, h string")
    return df.select(*T.text_stats_cols(F.col("p"), F.col("h"))).first()


def test_text_stats_example(spark):
    r = stats(spark, "A man is eating", "A man eats food")
    assert (r.premise_length, r.hypothesis_length, r.length_diff, r.length_ratio) == (4, 4, 0, 1.0)
    assert r.word_overlap_count == 2
    assert r.word_overlap_ratio == pytest.approx(2 / 6)


def test_text_stats_empty_side(spark):
    r = stats(spark, "a b c", "")
    assert (r.premise_length, r.hypothesis_length, r.length_diff, r.length_ratio) == (3, 0, 3, 1.0)
    assert (r.word_overlap_count, r.word_overlap_ratio) == (0, 0.0)


def test_text_stats_nulls(spark):
    r = stats(spark, None, None)
    assert tuple(r) == (0, 0, 0, 1.0, 0, 0.0)


def test_const_features(spark):
    t = "(ROOT (S (NP (DT A) (NN man)) (VP (VBZ eats))))"
    m = spark.createDataFrame([(t,)], "t string").select(P.const_features(F.col("t")).alias("m")).first().m
    assert m["tree_depth"] == 0 and m["count_S"] == 1 and m["count_NP"] == 1 and m["count_VP"] == 1
    assert m["count_PP"] == 0 and m["count_SBAR"] == 0


def test_const_features_blank(spark):
    m = spark.createDataFrame([("",)], "t string").select(P.const_features(F.col("t")).alias("m")).first().m
    assert m == {}


EDGES = "array<struct<id:int,text:string,lemma:string,pos:string,head:int,deprel:string>>"


def dep(spark, edges):
    df = spark.createDataFrame([(edges,)], f"e {EDGES}")
    return df.select(P.dep_features(F.col("e")).alias("m")).first().m


def test_dep_features(spark):
    m = dep(spark, [(1, "a", "a", "DET", 2, "det"), (2, "b", "b", "NOUN", 3, "nsubj"),
                    (3, "c", "c", "VERB", 0, "root")])
    assert m["pos_DET"] == m["pos_NOUN"] == m["pos_VERB"] == 1
    assert m["deprel_det"] == m["deprel_nsubj"] == m["deprel_root"] == 1
    assert m["dep_tree_depth_proxy"] == 3
    assert m["avg_dep_dist"] == pytest.approx(1.0)
    assert m["max_dep_dist"] == 1 and m["root_children_count"] == 1


def test_dep_features_empty(spark):
    m = dep(spark, [])
    assert m == {"dep_tree_depth_proxy": 0.0, "avg_dep_dist": 0.0, "max_dep_dist": 0.0,
                 "root_children_count": 0.0}


def test_syntactic_diff(spark):
    df = spark.createDataFrame([({"pos_NOUN": 2.0, "pos_DET": 1.0}, {"pos_NOUN": 1.0, "pos_VERB": 1.0})],
                               "p map<string,double>, h map<string,double>")
    m = df.select(P.pair_syntactic(F.lit(None).cast("map<string,double>"), F.lit(None).cast("map<string,double>"),
                                   F.col("p"), F.col("h")).alias("m")).first().m
    assert m["diff_dep_pos_NOUN"] == 1 and m["diff_dep_pos_DET"] == 1 and m["diff_dep_pos_VERB"] == 1
    assert m["premise_dep_pos_NOUN"] == 2 and m["hypothesis_dep_pos_VERB"] == 1


def test_align_missing_and_extra(spark):
    df = spark.createDataFrame([({"b": 2.0, "c": 3.0},)], "m map<string,double>")
    assert df.select(P.align(F.col("m"), ["a", "b"]).alias("v")).first().v == [0.0, 2.0]


def test_rule_annotator_tree(spark):
    df = spark.createDataFrame([("s1", "The cat sat on it"), ("s2", "...")], "id string, text string")
    rows = {r.sentence_id: r for r in annotate.annotate_rules(df).collect()}
    assert rows["s2"].constituency == "" and rows["s2"].dependency == []
    edges = rows["s1"].dependency
    assert [e.id for e in edges] == [1, 2, 3, 4, 5]
    assert sum(1 for e in edges if e.head == 0) == 1
    assert rows["s1"].constituency.startswith("(ROOT (S")


def test_labels(spark):
    df = spark.createDataFrame([("entailment",), ("neutral",), ("x",), (None,), ("-1",)], "label string")
    out = [r.y for r in clean.clean_labels(df).collect()]
    assert out == [0, 1]
