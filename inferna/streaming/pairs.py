"""Structured Streaming: the stateless pair operators on a document stream.

Sentence pairing (S4/P4), label join (stream-static equi join with the
labels table), text statistics (F1-F5) and the rule annotator's per-pair
features are projections, so the same column expressions run on
``readStream`` input; each micro-batch lands in the sink (parquet / memory /
foreachBatch) with the checkpoint in the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inferna.functions import text as T
from inferna.session import scratch_path
from inferna.sources import tables as src

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def document_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New parquet files of documents as a stream (explicit schema); ``max_files`` bounds a trigger if given."""
    r = spark.readStream.schema(DOC_SCHEMA)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)


def pair_stats_stream(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents stream ⟕ labels (static) -> pairs -> text statistics."""
    d = docs.select("doc_id", "text", "lang").join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
    pairs = src.pairs_from_documents(d)
    return pairs.select(F.col("id").alias("pair_id"), "dataset", "split", "label",
                        *T.text_stats_cols(F.col("premise_text"), F.col("hypothesis_text")))


def start(df: DataFrame, sink: str, name: str, path: str | None = None) -> StreamingQuery:
    """Start an append-mode query; checkpoint under the shared checkpoint dir."""
    spark = df.sparkSession
    w = (df.writeStream.outputMode("append")
         .option("checkpointLocation", scratch_path(spark, f"stream-{name}")))
    if sink == "memory":
        return w.format("memory").queryName(name).start()
    return w.format(sink).start(path)
