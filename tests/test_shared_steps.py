"""Steps that many queries share do their work once."""

from pyspark.sql import functions as F

from inferna.operators import dictionary, features
from inferna.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_both_sides_of_a_pair_get_their_sentence(spark):
    once = spark.range(50).groupBy(F.md5(F.col("id").cast("string")).alias("sentence_id")).agg(F.max("id").alias("id"))
    parses = once.select("sentence_id", F.concat(F.lit("worked-out-"), F.col("id").cast("string")).alias("n"))
    pairs = spark.range(49).select("id", F.md5(F.col("id").cast("string")).alias("premise_id"), F.md5((F.col("id") + 1).cast("string")).alias("hypothesis_id"))
    # sides without an entry, null ids and repeated pairs stay
    odd = spark.createDataFrame([(100, "absent", None), (101, None, "absent"), (101, None, "absent")], "id long, premise_id string, hypothesis_id string")
    rows = dictionary.join_pair_parses(pairs.unionByName(odd), parses, ["n"]).select("id", "premise_n", "hypothesis_n").collect()
    want = [(i, f"worked-out-{i}", f"worked-out-{i + 1}") for i in range(49)] + [(100, None, None)] + [(101, None, None)] * 2
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_a_text_is_cut_once(spark):
    docs = spark.createDataFrame([(10, "One. Two! Three", "en", 1, 0), (11, "Alone", "en", 0, 0), (12, None, "en", 0, 0), (13, "", None, None, None), (None, "A. B", "de", 1, 1)],
                                 "doc_id long, text string, lang string, quality int, toxic int")
    pairs = tables.pairs_from_documents(docs)
    assert plan(spark.createDataFrame(docs.rdd, docs.schema).transform(tables.pairs_from_documents)).count("split(text") == 1
    got = {(r.id, r.premise_text, r.hypothesis_text, r.label) for r in pairs.collect()}
    assert {("en_train_10_0", "One", "Two", 0), ("en_train_10_1", "Two", "Three", 0), ("en_train_11_0", "Alone", None, 1)} <= got


def test_sentences_of_both_sides_from_one_scan(spark):
    pairs = spark.createDataFrame([("1", "2", "a", "b"), ("2", "1", "b", "a"), ("2", "2", "b", "b"), ("3", "1", "c", "a")],
                                  "premise_id string, hypothesis_id string, premise_text string, hypothesis_text string")
    s = features.pair_sentences(pairs)
    assert sorted(s.collect()) == [("1", "a"), ("2", "b"), ("3", "c")]
    assert "Union" not in plan(s) and "SortAggregate" not in s._jdf.queryExecution().executedPlan().toString()
