"""Exact k-nearest-neighbour classification (M5, M10 KNN half, T5).

Training rows of at most ``SENT_CELLS`` cells (the bounded samples) are sent to
every task once and queries meet them where they lie: no query vector is
shuffled, and a query leaves its task as one row with its k neighbours.

A larger training side of every model is cut by hash into blocks of about
``block_rows`` rows and the query side into blocks of about ``query_rows``; each
pair of blocks of a model meets in one task (cogroup, numpy matrix products),
which emits only its k best candidates for each query.  A window over those
<= k x blocks candidates picks the final k, and a k-bounded vote decides.
Nothing is truncated; the work is queries x training rows, so keep the training
sample bounded.

A tile of queries meets the rows in one single-precision product, which rules
out, within its error bound, all that lies beyond the k nearest; what is left is
measured in double precision.

Order of neighbours: distance (rounded to ``tie_decimals`` if given, so that
engines which sum in another order break ties alike), then training id; vote
ties -> smallest label.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 50_000          # training rows aimed at in one block
BLOCK_CELLS = 4_000_000      # rows x dims aimed at in one block (32 MB of float64)
TILE_CELLS = 2_000_000       # cells of one block of differences
SENT_CELLS = 8_000_000       # rows x dims of all models' training rows that are sent to every task (64 MB of float64)
TILE_ROWS = 128              # queries that meet the rows of a block at once
GROUPS = 256                 # groups of rows whose nearest ones bound the k nearest
CAND_SCHEMA = ("model string, doc_id string, dataset string, y int, train_id string, train_label int, "
               "dist double")


def _distances(q: np.ndarray, x: np.ndarray, xnorm: np.ndarray, metric: str, k: int, unit: float = 0.0) -> np.ndarray:
    """Distances of every query to every row; a Euclidean one that surely lies beyond the ``k`` nearest (by more than ``unit``) is infinite."""
    if metric == "cosine":
        qn = np.sqrt(np.einsum("ij,ij->i", q, q))
        dot = q @ x.T
        denom = qn[:, None] * xnorm[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(denom > 0, 1.0 - dot / denom, 1.0)
    # |q|^2 + |x|^2 - 2q.x loses precision for near-identical vectors: it only
    # rules out, within its error bound; what it leaves is measured by differences
    if len(x) <= k:
        near = np.ones((len(q), len(x)), bool)
    else:
        q2, x2 = np.einsum("ij,ij->i", q, q), xnorm * xnorm
        square = q2[:, None] + x2[None, :] - 2.0 * (q @ x.T)
        slack = 4 * (x.shape[1] + 8) * np.finfo(np.float64).eps * (q2 + x2.max())
        kth = np.partition(square, k - 1, axis=1)[:, k - 1]
        near = ~(square > ((np.sqrt(np.maximum(kth + slack, 0.0)) + unit) ** 2 * (1 + 1e-12) + slack)[:, None])
    i, j = np.nonzero(near)
    d = np.full(near.shape, np.inf)
    step = max(1, TILE_CELLS // max(1, x.shape[1]))
    for s in range(0, len(i), step):
        diff = q[i[s:s + step]] - x[j[s:s + step]]
        d[i[s:s + step], j[s:s + step]] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return d


def first_equals(x: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Rows among which the ``k`` nearest always are: of equal vectors the ``k`` of least ``rank``."""
    order = np.lexsort((rank, np.unique(x, axis=0, return_inverse=True)[1].ravel()))
    group = np.concatenate([[True], np.any(x[order[1:]] != x[order[:-1]], axis=1)])
    start = np.flatnonzero(group)
    place = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))
    return np.sort(order[place < k])


def nearest_rows(d: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Per row of distances the ``k`` nearest columns, ties by ``rank``."""
    kk = min(k, d.shape[1])
    kth = np.partition(d, kk - 1, axis=1)[:, kk - 1]
    out = np.empty((len(d), kk), dtype=np.int64)
    for i, (row, most) in enumerate(zip(d, kth)):
        near = np.flatnonzero(row <= most)
        out[i] = near[np.lexsort((rank[near], row[near]))[:kk]]
    return out


class Rows:
    """Training rows of a model, ready to be searched: ``first_equals`` of them, with their labels and ranks by id."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, label: np.ndarray, k: int, metric: str, decimals: int | None):
        rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        kept = first_equals(x, rank, k)
        self.k, self.metric, self.decimals = k, metric, decimals
        self.x, self.rank, self.label, self.ids = x[kept], rank[kept], label[kept], ids[kept]
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        self.unit = 0.0 if decimals is None else 10.0 ** -decimals
        n, dims = self.x.shape
        self.eps = 2.0 * (dims + 8) * float(np.finfo(np.float32).eps)
        if metric == "cosine":     # largest product of unit vectors: nearest
            with np.errstate(divide="ignore", invalid="ignore"):
                side = np.where(self.norm[:, None] > 0, self.x / self.norm[:, None], 0.0)
        else:                      # largest q.x - |x|^2 / 2: nearest
            side = np.concatenate([self.x, -0.5 * (self.norm ** 2)[:, None]], axis=1)
        self.each = -(-n // GROUPS)
        self.side = None
        if n > 4 * k and n > GROUPS and np.isfinite(self.x).all() and np.abs(side).max(initial=0.0) < 1e30:
            # rows are dealt to groups in turn; what fills up the last ones is never near
            fill = np.zeros((self.each * GROUPS - n, side.shape[1]))
            self.side = np.concatenate([side, fill]).astype(np.float32)
            self.most = float(self.norm.max(initial=0.0))

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query the ``k`` nearest rows (their numbers) and distances, ties by rank."""
        out = [self._tile(q[s:s + TILE_ROWS]) for s in range(0, len(q), TILE_ROWS)]
        return np.concatenate([i for i, _ in out]), np.concatenate([d for _, d in out])

    def _rounded(self, d: np.ndarray) -> np.ndarray:
        return d if self.decimals is None else np.round(d, self.decimals)

    def _plain(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self._rounded(_distances(q, self.x, self.norm, self.metric, self.k, self.unit))
        near = nearest_rows(d, self.rank, self.k)
        return near, np.take_along_axis(d, near, axis=1)

    def _tile(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        qn = np.sqrt(np.einsum("ij,ij->i", q, q))
        if self.side is None or not np.isfinite(qn).all() or qn.max(initial=0.0) > 1e15:
            return self._plain(q)
        k, n = self.k, len(q)
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(qn[:, None] > 0, q / qn[:, None], 0.0) if self.metric == "cosine" else np.concatenate([q, np.ones((n, 1))], axis=1)
        near = left.astype(np.float32) @ self.side.T
        near[:, len(self.x):] = -np.inf
        near = near.reshape(n, self.each, GROUPS)
        best = near.max(axis=1)
        top = np.argpartition(best, GROUPS - k, axis=1)[:, GROUPS - k:]
        every = np.arange(n)[:, None]
        if self.metric == "cosine":
            least = best[every, top].min(axis=1).astype(np.float64) - 2 * (self.eps + self.unit)
        else:
            # k rows are this far; a row as near has at most this norm, which bounds the error of its product
            some = near[every, :, top].argmax(axis=2) * GROUPS + top
            diff = q[:, None, :] - self.x[some]
            far = np.sqrt(np.einsum("ijd,ijd->ij", diff, diff)).max(axis=1) * (1 + 1e-12) + 2 * self.unit
            norm = np.minimum(self.most, qn + far)
            least = (qn ** 2 - far ** 2) / 2 - self.eps * (qn * norm + norm ** 2 + qn ** 2)
        least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]
        i, g = np.nonzero(best >= least)
        a, b = np.nonzero(near[i, :, g] >= least[i])
        i, j = i[a], b * GROUPS + g[a]
        d = np.empty(len(i))
        step = max(1, TILE_CELLS // max(1, self.x.shape[1]))
        for s in range(0, len(i), step):
            c = slice(s, s + step)
            if self.metric == "cosine":
                dot, both = np.einsum("ij,ij->i", q[i[c]], self.x[j[c]]), qn[i[c]] * self.norm[j[c]]
                with np.errstate(divide="ignore", invalid="ignore"):
                    d[c] = np.where(both > 0, 1.0 - dot / both, 1.0)
            else:
                diff = q[i[c]] - self.x[j[c]]
                d[c] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        d = self._rounded(d)
        order = np.lexsort((self.rank[j], d, i))
        first = np.searchsorted(i[order], np.arange(n))
        at = order[(first[:, None] + np.arange(k)).ravel()]
        return j[at].reshape(n, k), d[at].reshape(n, k)


def knn_predict(train: DataFrame, test: DataFrame, vec_col: str, k: int = 5, metric: str = "cosine",
                block_rows: int = BLOCK_ROWS, query_rows: int = 5_000, tie_decimals: int | None = None) -> DataFrame:
    """train: model, train_id, label, vec (array<double>);
    test: model, doc_id, dataset, y, vec.  -> model, doc_id, dataset, y, pred."""
    size = train.select(F.max(F.size(vec_col)).alias("d"), F.count("*").alias("n")).first()
    dims = max(1, size["d"] or 1)
    cap = max(1, min(block_rows, BLOCK_CELLS // dims))
    if dims * size["n"] <= SENT_CELLS and size["n"] <= block_rows:
        return _meet_sent(train, test, vec_col, k, metric, tie_decimals)

    def blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy("model").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    cells = blocks(train, cap, "_nb").join(blocks(test, query_rows, "_nq"), "model")

    def spread(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = (test.select("model", "doc_id", "dataset", "y", vec_col).join(cells, "model")
            .withColumn("_q", F.pmod(F.xxhash64("doc_id"), F.col("_nq")).cast("int"))
            .select("*", spread("_nb").alias("_b")).drop("_nb", "_nq"))
    right = (train.select("model", "train_id", "label", vec_col).join(cells, "model")
             .withColumn("_b", F.pmod(F.xxhash64("train_id"), F.col("_nb")).cast("int"))
             .select("*", spread("_nq").alias("_q")).drop("_nb", "_nq"))

    def match(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        cols = [c.split()[0] for c in CAND_SCHEMA.split(", ")]
        if len(q) == 0 or len(t) == 0:
            return pd.DataFrame({c: [] for c in cols}, dtype=object)
        rows = Rows(np.stack(t[vec_col].to_numpy()).astype(np.float64), t["train_id"].to_numpy().astype(str), t["label"].to_numpy(), k, metric, tie_decimals)
        out = []
        for s in range(0, len(q), 256):
            part = q.iloc[s:s + 256]
            near, d = rows.nearest(np.stack(part[vec_col].to_numpy()).astype(np.float64))
            kk = near.shape[1]
            found = part.loc[part.index.repeat(kk), ["model", "doc_id", "dataset", "y"]]
            out.append(found.assign(train_id=rows.ids[near.ravel()], train_label=rows.label[near.ravel()], dist=d.ravel()))
        return pd.concat(out)[cols]

    cands = left.groupBy("model", "_b", "_q").cogroup(right.groupBy("model", "_b", "_q")).applyInPandas(match, CAND_SCHEMA)
    w = Window.partitionBy("model", "doc_id").orderBy("dist", "train_id")   # <= k x blocks rows
    top = cands.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    votes = top.groupBy("model", "doc_id", "dataset", "y").agg(F.collect_list("train_label").alias("labs"))
    counts = {c: F.size(F.filter("labs", lambda x: x == F.lit(c))) for c in (0, 1, 2)}
    return votes.select("model", "doc_id", "dataset", "y", _winner(counts).alias("pred"))


def _winner(counts: dict):
    """The label of most votes, ties to the least."""
    best = F.greatest(*counts.values())
    pred = F.lit(None).cast("int")
    for c in (2, 1, 0):
        pred = F.when(counts[c] == best, F.lit(c)).otherwise(pred)
    return pred


def _meet_sent(train: DataFrame, test: DataFrame, vec_col: str, k: int, metric: str, tie_decimals: int | None) -> DataFrame:
    """``knn_predict`` where the training rows (at most ``SENT_CELLS``) go to every task."""
    table = train.where("model IS NOT NULL").select("model", "train_id", "label", vec_col).toArrow()
    names, ids = np.array(table["model"].to_pylist(), dtype=object), np.array(table["train_id"].to_pylist(), dtype=object).astype(str)
    label = table["label"].fill_null(-1).to_numpy().astype(np.int64)
    x = vectors(table[vec_col].combine_chunks()) if len(table) else []
    models = {m: Rows(np.stack([x[i] for i in at]), ids[at], label[at], k, metric, tie_decimals) for m in sorted(set(names)) if len(at := np.flatnonzero(names == m))}
    sent = test.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            model = np.array(batch.column("model").to_pylist(), dtype=object)
            q = vectors(batch.column(vec_col)) if batch.num_rows else []
            for m in dict.fromkeys(model.tolist()):
                if m not in sent.value:
                    continue
                at, rows = np.flatnonzero(model == m), sent.value[m]
                near, dist = rows.nearest(np.stack([q[i] for i in at]) if isinstance(q, list) else q[at])
                given = rows.label[near]
                votes = np.stack([(given == c).sum(axis=1) for c in (0, 1, 2)], axis=1)
                offset = pa.array(np.arange(len(at) + 1, dtype=np.int32) * near.shape[1], pa.int32())
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("model", "doc_id", "dataset", "y")), pa.array(votes.argmax(axis=1).astype(np.int32)), pa.ListArray.from_arrays(offset, pa.array(dist.ravel())),
                     pa.ListArray.from_arrays(offset, pa.array(rows.rank[near].astype(np.int32).ravel())), pa.ListArray.from_arrays(offset, pa.array(given.astype(np.int32).ravel()))],
                    names=["model", "doc_id", "dataset", "y", "pred", "dist", "rank", "label"])

    test = test.select("model", "doc_id", "dataset", "y", vec_col)
    kind = {f.name: f.dataType.simpleString() for f in test.schema}
    found = test.mapInArrow(run, ", ".join(f"{c} {kind[c]}" for c in ("model", "doc_id", "dataset", "y")) + ", pred int, dist array<double>, rank array<int>, label array<int>")
    twice = test.groupBy(F.xxhash64("model", "doc_id").alias("h")).count().where("count > 1")
    if twice.isEmpty():
        return found.select("model", "doc_id", "dataset", "y", "pred")
    # rows that share a key share their k nearest, as one query
    one = found.groupBy("model", "doc_id").agg(F.collect_list(F.struct("dataset", "y", "pred", "dist", "rank", "label")).alias("l"))
    every = F.flatten(F.transform("l", lambda r: F.transform(F.arrays_zip(r["dist"].alias("dist"), r["rank"].alias("rank"), r["label"].alias("label")),
                                                             lambda e: F.struct(e["dist"], e["rank"], e["label"], r["dataset"].alias("dataset"), r["y"].alias("y")))))
    top = one.select("model", "doc_id", F.explode(F.slice(F.sort_array(every), 1, k)).alias("e")).select("model", "doc_id", "e.dataset", "e.y", "e.label")
    votes = top.groupBy("model", "doc_id", "dataset", "y").agg(*[F.count_if(F.col("label") == c).alias(f"n{c}") for c in (0, 1, 2)])
    return votes.select("model", "doc_id", "dataset", "y", _winner({c: F.col(f"n{c}") for c in (0, 1, 2)}).alias("pred"))


def vectors(column: pa.Array) -> np.ndarray | list:
    """The rows of a list column as a matrix, or as a list of rows if their lengths differ."""
    offset = column.offsets.to_numpy().astype(np.int64)
    n = np.diff(offset)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    if len(n) and (n == n[0]).all():
        return flat[offset[0]:offset[-1]].reshape(len(n), n[0])
    return [flat[a:b] for a, b in zip(offset[:-1], offset[1:])]
