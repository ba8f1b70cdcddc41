"""The corpus pipeline: quality, lines, near duplicates, benchmarks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and rereads it as the next stage's
``docs``.  All stages but the last return the columns of ``documents``.  Rows
with a null text or key pass through as each operator's docstring says; an empty
table stays empty; extra columns of ``docs``, whatever their names, pass through
all but the last stage.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferna.llm import bag_minhash, cotraining, line_templates, packing, winnow
from inferna.llm.common import apart, restored, row_key, stage

#: Names that the stages and their operators give to columns of their own.
OWN = ("_id", "_k1", "_k2", "_keep", "_content", "_meta", "_score", "_n_lines", "_n_dropped")


def beside_own(function):
    """A stage whose input may have columns named as its own: they are set aside and come back."""
    @wraps(function)
    def run_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        given, back = apart(docs, OWN)
        return restored(function(spark, given, sf_dir), back)
    return run_apart


@beside_own
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cotraining.classify(docs, labels).where("_keep").select(docs.columns)


@beside_own
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring template lines are cut; ``n_chars`` follows the text.  Every document stays."""
    cut = line_templates.drop_recurring(docs)
    return cut.select(*[F.when(F.col("_n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars"
                        else F.col(f"`{c}`") for c in docs.columns])


@beside_own
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that with the least key; of repeated rows one."""
    keep = bag_minhash.near_duplicates(docs).where("keep").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    # rows equal in key and text are copies; rows without a key were never compared
    known = kept.where("doc_id is not null")
    once = known.withColumns(dict(zip(("_k1", "_k2"), row_key("doc_id", "text")))).dropDuplicates(["_k1", "_k2"]).drop("_k1", "_k2")
    return once.unionByName(kept.where("doc_id is null")).select(docs.columns)


@beside_own
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    result = winnow.hit_results(docs, items).select("_k1", "_k2")
    keyed = docs.withColumns(dict(zip(("_k1", "_k2"), row_key("doc_id", "text"))))
    return keyed.join(result, ["_k1", "_k2"], "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, as pieces with their place in a sequence of at most 1024 ids."""
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]

#: SQL cannot express the classifier, the signatures or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; returns the last stage's rows, reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
