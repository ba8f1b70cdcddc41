"""Stored dependency trees: quotes, nulls, garbage and code are read as data or as nothing."""

from pyspark.sql import functions as F

from inferna.operators.annotate import EDGE_TYPE
from inferna.sources.trees_text import edges_of, export_edges, import_edges


def test_stored_trees():
    good = "[{'id': 1, 'text': \"it's\", 'lemma': None, 'pos': 'X', 'head': 0, 'deprel': 'root'}, 7, {'id': '2'}]"
    none = dict.fromkeys(("text", "lemma", "pos", "deprel"))
    assert edges_of(good) == [{"id": 1, "head": 0, "text": "it's", "lemma": None, "pos": "X", "deprel": "root"}, {"id": None, "head": None, **none}]
    for bad in (None, "", "[", "{'id': 1}", "__import__('os').getcwd()", "[f(x)]", "(" * 500, "nan"):
        assert edges_of(bad) == []


def test_round_trip(spark):
    edges = [[(1, "it's", None, "P", 2, "dep"), (2, 'a"b\\n', "b", None, 0, "root")], [], None]
    frame = spark.createDataFrame([(i, e) for i, e in enumerate(edges)], f"i int, e array<{EDGE_TYPE}>")
    back = frame.select("i", import_edges(export_edges(F.col("e"))).alias("e")).orderBy("i").collect()
    assert [[tuple(x) for x in r.e] for r in back] == [edges[0], [], []]
