"""Approximate nearest neighbours: a forest of sorted hash strings.

Each tree gives a vector a string of sign bits against random directions.  A
tree is the sorted array of its strings.  A query descends in every tree to its
longest common prefix, a run of neighbours in the array, then all trees ascend
together, one bit at a time, until the runs hold enough candidates; those are
scored exactly, in double precision.

Rows are dealt into shards of bounded size, each with a forest of its own, and
every block of queries meets every shard, so the candidates that a query scores
are a bounded share of all rows and no group grows with the data.  Equal vectors
are one entry that lists its smallest ids: more than ``k`` + 1 of them can be in
no answer.  Near copies by the thousand share long strings; their runs are
scored by one matrix product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inferna.llm.common import stage


def valid(vector: str) -> Column:
    """True for vectors that are not null, not empty, not zero and whose components are all finite."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def strings(x: np.ndarray, trees: int, bits: int, seed: int) -> np.ndarray:
    """Hash strings as whole numbers, shape (trees, rows); the first bit is the highest."""
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], trees * bits))
    on = (x @ planes > 0).reshape(len(x), trees, bits)
    return (on @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).T


class Forest:
    """Sorted arrays over the rows of ``x``."""

    def __init__(self, x: np.ndarray, trees: int, bits: int, seed: int):
        self.x, self.args = x, (trees, bits, seed)
        s = strings(x, *self.args)
        self.order = np.argsort(s, axis=1, kind="stable")
        self.sorted = np.take_along_axis(s, self.order, 1)

    def runs(self, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end place, per tree and query, of the rows that share ``depth`` first bits."""
        low = (self.args[1] - depth)
        first = (q >> low) << low
        lo = np.array([np.searchsorted(s, f, "left") for s, f in zip(self.sorted, first)])
        hi = np.array([np.searchsorted(s, f + (1 << low), "left") for s, f in zip(self.sorted, first)])
        return lo, hi

    def candidates(self, q: np.ndarray, enough: float):
        """Per query, rows of the runs at the greatest depth at which the trees together hold ``enough`` entries."""
        h = strings(q, *self.args)
        lo, hi = self.runs(h, 0)
        done = np.zeros(len(q), dtype=bool)
        for depth in range(self.args[1], 0, -1):
            a, b = self.runs(h, depth)
            now = ((b - a).sum(axis=0) >= enough) & ~done
            lo[:, now], hi[:, now] = a[:, now], b[:, now]
            done |= now
            if done.all():
                break
        for i in range(len(q)):
            seen = np.zeros(len(self.x), dtype=bool)
            for t, order in enumerate(self.order):
                seen[order[lo[t, i]:hi[t, i]]] = True
            yield np.flatnonzero(seen)


def nearest(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20,
            trees: int = 40, bits: int = 20, reach: float = 0.8, shard_rows: int = 8192, block_rows: int = 4096,
            seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product found for each query row.

    A query's own id is no candidate.  ``reach`` is how many entries, as a share
    of a shard's rows and summed over trees, a query gathers before it stops
    ascending.  Null, empty, zero and non-finite vectors take no part, nor those
    of another length than most (ties: the longer); null ids take no part;
    repeated rows count once; ties go to smaller ids; no rows: no result.
    """
    t = (vectors.where(valid(f"`{vector}`") & F.col(f"`{key}`").isNotNull())
         .select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"),
                 queries.alias("asks")).withColumn("d", F.size("v")))
    common = t.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    t = (t.where(F.col("d") == common["d"]).withColumn("c1", F.xxhash64("v")).withColumn("c2", F.xxhash64(F.lit(7), "v")))
    # classes of equal vectors; the k + 1 smallest ids of each can answer
    ids = t.select("c1", "c2", "id").distinct()
    few = (ids.withColumn("r", F.row_number().over(Window.partitionBy("c1", "c2").orderBy("id"))).where(F.col("r") <= k + 1)
           .groupBy("c1", "c2").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    classes = stage(t.groupBy("c1", "c2").agg(F.first("v").alias("v"), F.max("asks").alias("asks"))
                    .join(few, ["c1", "c2"]).withColumn("cid", F.xxhash64("c1", "c2", F.element_at("ids", 1))), "forest-classes")
    n, n_asked = classes.count(), classes.where("asks").count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_asked // block_rows))
    spread = lambda what, m: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(what)
    index = classes.select(F.pmod("cid", F.lit(shards)).cast("int").alias("shard"), spread("block", blocks), "ids", "v")
    asked = (classes.where("asks").select(spread("shard", shards), F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int").alias("block"),
                                          "c1", "c2", "v"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols: dict[str, list] = {"c1": [], "c2": [], "id": [], "score": []}
        if len(left) and len(right):
            first = left["ids"].map(lambda i: i[0]).to_numpy()
            left = left.iloc[np.argsort(first, kind="stable")]
            x, q, ids = np.stack(left["v"].to_list()), np.stack(right["v"].to_list()), left["ids"].to_list()
            forest = Forest(x, trees, bits, seed)
            for i, rows in enumerate(forest.candidates(q, reach * len(x))):
                # one order of summing for a pair of vectors, whatever the shard: equal scores stay ties
                score = np.einsum("ij,j->i", x[rows], q[i])
                top = np.lexsort((rows, -score))[:k + 1]
                for r, s in zip(rows[top], score[top]):
                    cols["id"] += list(ids[r])
                    cols["score"] += [s] * len(ids[r])
                    cols["c1"] += [right["c1"].iat[i]] * len(ids[r])
                    cols["c2"] += [right["c2"].iat[i]] * len(ids[r])
        return pd.DataFrame(cols).astype({"c1": "int64", "c2": "int64", "id": "int64", "score": "float64"})

    found = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(
        search, "c1 long, c2 long, id long, score double")
    order = [F.desc("score"), F.asc("id")]
    best = (found.withColumn("r", F.row_number().over(Window.partitionBy("c1", "c2").orderBy(*order)))
            .where(F.col("r") <= k + 1).groupBy("c1", "c2").agg(F.collect_list(F.struct("r", "id", "score")).alias("top")))
    own = t.where("asks").select("c1", "c2", F.col("id").alias("query_id")).distinct()
    hits = F.transform(F.filter(F.sort_array("top"), lambda s: s["id"] != F.col("query_id")), lambda s, i: F.struct(
        (i + 1).cast("int").alias("rank"), s["id"].alias("vec_id"), s["score"].alias("score")))
    return (own.join(best, ["c1", "c2"]).select("query_id", F.explode_outer(F.slice(hits, 1, k)).alias("s"))
            .where("s is not null").select("query_id", "s.*"))
