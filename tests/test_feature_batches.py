"""features worked out by batches, against plain dicts."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inferna.functions import arrow_maps
from inferna.functions import parse as P
from inferna.operators import annotate
from inferna.operators import feature_sets as FS

MAP = pa.map_(pa.string(), pa.float64())


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def odd_maps(seed, n, nulls=True):
    r = random.Random(seed)
    return [None if nulls and r.random() < 0.1 else {k: r.choice([0.0, 1.5, -2.0, float("inf")]) for k in r.sample("abcdefgh", r.randrange(6))} for _ in range(n)]


@pytest.mark.parametrize("cells", [7, 4_000_000])
def test_pair_maps_are_those_of_plain_dicts(cells, monkeypatch):
    monkeypatch.setattr(arrow_maps, "CELLS", cells)
    columns = [odd_maps(s, 50) for s in range(4)]
    # a slice, whose children begin elsewhere
    got = arrow_maps.pair_map(*(pa.array([{"z": 9.0}, *c], MAP).slice(1) for c in columns)).to_pylist()
    for row, *sides in zip(got, *columns):
        pc, hc, pd, hd = (s or {} for s in sides)
        want = [(f"{side}_{family}_{k}", v) for family, both in (("const", (pc, hc)), ("dep", (pd, hd))) for side, m in zip(("premise", "hypothesis"), both) for k, v in m.items()]
        want += [(f"diff_{family}_{k}", abs(p.get(k, 0.0) - h.get(k, 0.0))) for family, p, h in (("const", pc, hc), ("dep", pd, hd)) for k in [*p, *[k for k in h if k not in p]]]
        assert json.dumps(row) == json.dumps(want)
    assert arrow_maps.pair_map(*[pa.array([], MAP)] * 4).to_pylist() == []


def test_map_features_leave_no_lambda_in_the_plan(spark):
    df = spark.createDataFrame([(1, {"a": 1.0, "b": None}), (2, None), (3, {})], "id int, m map<string,double>")
    both = df.select("id", P.align(F.col("m"), ["b", "x", "a", "b"]).alias("a"), P.pair_syntactic(F.col("m"), F.col("m"), P.empty_map(), P.empty_map()).alias("s"))
    assert "lambda" not in plan(both)
    got = {r.id: (r.a, r.s) for r in both.collect()}
    assert got[1][0] == [0.0, 0.0, 1.0, 0.0] and got[2] == ([0.0] * 4, {}) and got[3] == ([0.0] * 4, {})
    assert got[1][1] == {"premise_const_a": 1.0, "premise_const_b": None, "hypothesis_const_a": 1.0, "hypothesis_const_b": None, "diff_const_a": 0.0, "diff_const_b": 0.0}


def test_edge_features_of_odd_lists(spark):
    edge = "struct<id:int,pos:string,head:int,deprel:string>"
    rows = [(1, [(1, "NOUN", 2, "nsubj"), (2, None, 0, "root"), (3, "NOUN", 1, None)]), (2, []), (3, None), (4, [(None, "X", None, "x"), (2, "X", -1, "x")])]
    df = spark.createDataFrame(rows, f"k int, e array<{edge}>")
    got = {r.k: r.d for r in df.select("k", P.dep_features(F.col("e")).alias("d")).collect()}
    assert got[1] == {"pos_NOUN": 2.0, "pos_UNK_POS": 1.0, "deprel_nsubj": 1.0, "deprel_root": 1.0, "deprel_UNK_DEP": 1.0,
                      "dep_tree_depth_proxy": 2.0, "avg_dep_dist": 1.5, "max_dep_dist": 2.0, "root_children_count": 1.0}
    zero = {"dep_tree_depth_proxy": 0.0, "avg_dep_dist": 0.0, "max_dep_dist": 0.0, "root_children_count": 0.0}
    assert got[2] == zero and got[3] == {}
    assert got[4] == {"pos_X": 2.0, "deprel_x": 2.0, **zero, "root_children_count": 1.0}


def test_texts_do_not_travel_with_the_stored_features(spark):
    raw = spark.createDataFrame([("1", "en", "train", 0, "A cat sat", "A dog ran")], "id string, dataset string, split string, label int, premise_text string, hypothesis_text string")
    joined = plan(FS.typed_features(raw))
    assert "premise_text" not in joined[:joined.index("Join")]   # above the joins


def test_trees_of_the_rules_by_batches(spark):
    df = spark.createDataFrame([(1, "9lives a bc def ghijkl"), (2, None), (3, " !"), (4, "ÉÉ"), (5, "to a")], "id int, text string")
    out = annotate.annotate_rules(df)
    assert plan(out).count("lambdafunction") == 1   # the lemmas
    got = {r.sentence_id: (r.constituency, [tuple(e) for e in r.dependency]) for r in out.collect()}
    assert got[1][0] == "(ROOT (S (NP (NUM 9lives) (PP (ADP a)) (PP (ADP bc)) (DET def)) (VP (VERB ghijkl))))"
    assert got[1][1] == [(1, "9lives", "9lives", "NUM", 5, "nummod"), (2, "a", "a", "ADP", 3, "case"), (3, "bc", "bc", "ADP", 4, "case"),
                         (4, "def", "def", "DET", 5, "det"), (5, "ghijkl", "ghijkl", "VERB", 0, "root")]
    assert got[2] == got[3] == ("", [])
    assert got[4] == ("(ROOT (S (VP (PP (ADP ÉÉ)))))", [(1, "ÉÉ", "éé", "ADP", 0, "root")])
    assert got[5] == ("(ROOT (S (VP (PP (ADP to)) (PP (ADP a)))))", [(1, "to", "to", "ADP", 0, "root"), (2, "a", "a", "ADP", 1, "case")])
