"""what the preprocess job leaves on disk and sends through it."""

from pyspark.sql import functions as F

from inferna.operators import annotate
from inferna.plans import preprocess as PP
from inferna.sources import store


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_trees_do_not_travel_to_their_units(spark):
    rows = [("en", "train", "1", "A cat"), ("en", "test", "1", "A cat"), ("fr", "train", "2", "Le chat"), ("fr", "train", None, "x")]
    s = spark.createDataFrame(rows, "dataset string, split string, id string, text string")
    parses = PP.unit_parses(s, annotate.annotate_rules)
    above = executed(parses)[:executed(parses).index("_rule_trees")]
    assert "Exchange" not in above and "Join" not in above
    by_join = PP.unit_parses(s, lambda x: annotate.annotate_rules(x))   # any other annotator
    assert parses.columns == by_join.columns
    assert sorted(map(str, parses.collect())) == sorted(map(str, by_join.collect())) and parses.count() == 3


def shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = set()
    while files.hasNext():
        found.add(files.next().getName())
    return {f for f in found if f.startswith("shuffle_")}


def test_shuffle_files_go_with_the_stage(spark, tmp_path):
    df = spark.range(1000).withColumn("split", F.lit("a")).withColumn("dataset", F.lit("b")).repartition(3, "id")
    before = shuffle_files(spark)
    store.store(df, str(tmp_path), "t")
    assert shuffle_files(spark) <= before
    assert any(".zstd." in f.name for f in tmp_path.rglob("part-*"))
    assert store.load(spark, str(tmp_path), "t").count() == 1000
    assert df.count() == df.count() == 1000   # a frame that is read again shuffles again


def test_join_groups_hold_every_unit_once():
    units = sorted((d, s) for d in "abcdefg" for s in ("test", "train"))
    groups = PP.join_groups(units)
    assert sorted(u for g in groups for u in g) == units and len(groups) == PP.JOIN_GROUPS
    assert PP.join_groups([]) == [] and PP.join_groups([("a", "b")]) == [[("a", "b")]]
