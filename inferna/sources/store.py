"""Stage tables, sinks and the prediction-file source.

Stage tables live under one base folder (on a cluster: a shared folder such
as the session's ``spark.checkpoint.dir`` or a warehouse path), partitioned
by dataset and split so a read of one split prunes the others.  Writes use
dynamic partition overwrite: rewriting one (dataset, split) leaves the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inferna.session import shuffles_released

PARTITIONS = ["dataset", "split"]


def _path(base: str, table: str) -> str:
    return f"{base.rstrip('/')}/{table}"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, base: str, table: str) -> bool:
    """The table folder holds data: a file or partition of its own, not just markers."""
    fs, p = _fs(spark, _path(base, table))
    return bool(fs.exists(p)) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(p))


def _marker(base: str, table: str, dataset: str | None, split: str | None) -> str:
    return f"{_path(base, table)}/_built/{quote(dataset or '*', safe='')},{quote(split or '*', safe='')}"


def built(spark: SparkSession, base: str, table: str, dataset: str | None = None, split: str | None = None) -> bool:
    """S7 probe: this (dataset, split), or what contains it, was written to its end."""
    for d in {dataset, None}:
        for s in {split, None}:
            fs, p = _fs(spark, _marker(base, table, d, s))
            if fs.exists(p):
                return True
    return False


def store(df: DataFrame, base: str, table: str, partition_by: list[str] | None = PARTITIONS) -> None:
    """Overwrite the partitions present in ``df`` (dynamic overwrite)."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    cols = [c for c in (partition_by or []) if c in df.columns]
    if cols:
        w = w.partitionBy(*cols)
    with shuffles_released(df.sparkSession):
        w.parquet(_path(base, table))


def load(spark: SparkSession, base: str, table: str, schema: StructType | None = None,
         dataset: str | None = None, split: str | None = None) -> DataFrame:
    """Read a stage table (pruned to one dataset / split when given);
    an absent table yields an empty frame of ``schema``."""
    if not exists(spark, base, table):
        if schema is None:
            raise FileNotFoundError(_path(base, table))
        return spark.createDataFrame([], schema)
    df = spark.read.parquet(_path(base, table))
    if dataset is not None:
        df = df.where(F.col("dataset") == dataset)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df


def stage(spark: SparkSession, base: str, table: str, build: Callable[[], DataFrame],
          force: bool = False, dataset: str | None = None, split: str | None = None) -> DataFrame:
    """Reuse a materialised stage unless ``force``; else build, write, re-read.

    The unit is the (dataset, split) named, or the whole table.  Each unit is
    marked once its write has ended, so a failed first write is built again
    and asking for another unit builds that one.
    """
    if force or not built(spark, base, table, dataset, split):
        df = build()
        store(df, base, table)
        fs, p = _fs(spark, _marker(base, table, dataset, split))
        fs.create(p, True).close()
        if not exists(spark, base, table):   # nothing was written: an empty unit
            return spark.createDataFrame([], df.schema)
    return load(spark, base, table, None, dataset, split)


def built_units(spark: SparkSession, base: str, table: str) -> set[tuple[str, str]]:
    """The (dataset, split) units of a table that are marked as written to their end (one listing)."""
    fs, p = _fs(spark, f"{_path(base, table)}/_built")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return {(unquote(d), unquote(s)) for d, s in (n.split(",") for n in names)}


def stage_units(spark: SparkSession, base: str, table: str, units: list[tuple[str, str]],
                build: Callable[[list[tuple[str, str]]], DataFrame], force: set[tuple[str, str]] = frozenset()) -> list[tuple[str, str]]:
    """S7 for many units: build those of ``units`` that have no mark, or are in ``force``, in one job; -> the units built.

    A unit loses its mark and rows before the job and is marked after it, so
    a job that dies leaves its units to be built again and all others as they
    are.  A unit without rows is marked too."""
    done = built_units(spark, base, table)
    todo = [u for u in units if u not in done or u in force]
    if todo:
        folder = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        for d, s in todo:
            for path in (_marker(base, table, d, s), f"{_path(base, table)}/{folder('dataset', d)}/{folder('split', s)}"):
                fs, p = _fs(spark, path)
                fs.delete(p, True)
        store(build(todo), base, table)
        for d, s in todo:
            fs, p = _fs(spark, _marker(base, table, d, s))
            fs.create(p, True).close()
    return todo


def write_predictions_csv(pred: DataFrame, path: str) -> None:
    """Prediction files with a header, one folder per grid cell."""
    (pred.write.mode("overwrite").option("header", True).option("escape", '"')
     .partitionBy("experiment", "trained_dataset", "predict_dataset").csv(path))


PRED_SCHEMA = ("pair_id string, premise string, hypothesis string, predicted_label_int int, "
               "predicted_label_str string, true_label_str string, true_label_int int")


def read_predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    """All prediction files; the grid keys are the folders' partition columns, so a filter on them prunes."""
    keys = "experiment string, trained_dataset string, predict_dataset string"
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"') \
        .schema(f"{PRED_SCHEMA}, {keys}").csv(path)


def write_results_csv(results: DataFrame, path: str) -> None:
    """The sorted metrics table as one CSV (it has one row per cell)."""
    (results.orderBy("experiment", "predict_dataset", "trained_dataset")
     .coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path))
