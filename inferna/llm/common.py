"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A table is broadcast only after its rows were counted and their known
#: width times the count stays below this many bytes.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session (tests) may leave the setting unset; it then gets a
    scratch folder.  On a cluster an unset folder is an error, since no other
    place is known to be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inferna-llm-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of a small table that one task writes.
ROWS_PER_FILE = 200_000


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage: later jobs reread the files and survive lost executors.
    ``rows``, a bound known to the caller, keeps small tables in a few files.
    """
    if rows is not None:
        df = df.coalesce(4 + rows // ROWS_PER_FILE)
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast if ``rows`` (already counted) of ``row_bytes`` are few, else a plain shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def row_key(*cols: str | Column) -> list[Column]:
    """128 bits, never null, that are equal for equal rows: columns ``_k1`` and ``_k2``.

    Duplicate input rows share a key, so an operator works on distinct keys
    and joins its result back without multiplying rows.
    """
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    marks = [c.isNull() for c in cs]
    return [F.xxhash64(*cs, *marks).alias("_k1"),
            F.xxhash64(F.lit(7), *marks, *reversed(cs)).alias("_k2")]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def narrowed(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Just the named columns, so that extra columns cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def apart(df: DataFrame, own: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named as one of ``own`` (in any case) set aside under fresh names, and the way back.

    Without such columns ``df`` itself is returned; ``restored`` undoes it.
    """
    own = {c.lower() for c in own}
    taken, names = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.lower() in own:
            fresh = c
            while fresh.lower() in taken | own:
                fresh += "_"
            taken.add(fresh.lower())
            names[c] = fresh
    return df.withColumnsRenamed(names) if names else df, {new: c for c, new in names.items()}


def restored(df: DataFrame, back: dict[str, str]) -> DataFrame:
    """Undoes ``apart``."""
    return df.withColumnsRenamed(back) if back else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once: the optimiser would copy it into each use and each lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)
