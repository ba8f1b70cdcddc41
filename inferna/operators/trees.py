"""Histogram tree learners over sparse features (M1, M4, M8, M9): one tree, forests, boosting.

All models and all their trees grow together, level by level.  Training rows are
one staged table of (feature, bin) lists.  A level is one job: tasks walk their
rows down the trees grown so far and add up, for the nodes that may still split,
what lies in each (node, feature, bin); Spark sums those histograms, takes every
feature's running totals and keeps the best split of each node.  Only chosen splits
reach the driver, so its share is bounded by the number of nodes, never by rows.

Features are sparse and not negative; absent means 0, which is bin 0.  Other
values are cut per (model, feature) at equal counts into ``bins - 1`` bins, and a
split sends rows whose value is at least the least one of a bin to the right.

Everything that decides (counts, gradients in fixed point, ordering of ties by
score, feature, bin) is exact, so the same rows give the same trees whatever the
number of tasks, and SQL can state the same learner.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inferna.session import materialize

#: Modulus and factors of the number generator behind bootstraps and feature subsets; cumulative Poisson(1) in its units.
PRIME, MUL_A, MUL_B = 2**31 - 1, 48271, 69621
POISSON = [int(c * PRIME) for c in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)]
#: Fixed point of gradients, leaf values and scores; cells of one dense block of rows in a task.
UNIT, DENSE_CELLS = 1 << 20, 1 << 23
#: Frontier nodes up to which their totals are sent to the tasks instead of joined by a shuffle.
SMALL_FRONTIER = 100_000


@dataclass(frozen=True)
class Spec:
    """``trees`` of at most ``depth`` levels over ``bins`` bins; a forest draws rows and features for itself, boosting adds ``stages``."""
    depth: int = 30
    bins: int = 32
    trees: int = 1
    forest: bool = False
    stages: int = 0
    rate: float = 0.1


@dataclass
class Tree:
    """Nodes in order of creation: split feature (-1: leaf), split bin, children, what lies in the node (three sums), its number."""
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    held: list[tuple[int, int, int]] = field(default_factory=list)
    number: list[int] = field(default_factory=list)

    def add(self, number: int, held: tuple[int, int, int]) -> int:
        for column, value in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.held, held), (self.number, number)):
            column.append(value)
        return len(self.number) - 1

    def split(self, at: int, feature: int, bin_: int, right: tuple[int, int, int]) -> tuple[int, int]:
        rest = tuple(a - b for a, b in zip(self.held[at], right))
        self.feature[at], self.bin[at] = feature, bin_
        self.left[at], self.right[at] = self.add(2 * self.number[at], rest), self.add(2 * self.number[at] + 1, right)
        return self.left[at], self.right[at]

    def arrays(self):
        return tuple(np.array(x, np.int64) for x in (self.feature, self.bin, self.left, self.right))


# ---- training table ---------------------------------------------------------

def fit_bins(cells: DataFrame, bins: int) -> DataFrame:
    """(model, f, x, bin) of every distinct value of ``cells`` (model, doc_id, f, x > 0)."""
    n = cells.groupBy("model", "f", "x").agg(F.count("*").alias("n"))
    w = Window.partitionBy("model", "f")
    before = F.coalesce(F.sum("n").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return n.select("model", "f", "x", (1 + F.floor(before * (bins - 1) / F.sum("n").over(w))).cast("int").alias("bin"))


def bootstrap(doc_id: Column, tree: Column) -> Column:
    """How often a forest's tree draws a row: a Poisson(1) number from the row's md5 and the tree."""
    h = F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 7), 16, 10).cast("long")
    u = (h * MUL_A + (tree + 1) * 1_000_003) % PRIME
    u = (((u * MUL_B) % PRIME) * MUL_A) % PRIME
    return sum(F.when(u >= c, 1).otherwise(0) for c in POISSON)


def training_rows(docs: DataFrame, cells: DataFrame, values: DataFrame, spec: Spec) -> DataFrame:
    """(model, doc_id, label, f, b, w): one staged row for each row of ``docs`` (model, doc_id, label) with its bins and, in a forest, its draws."""
    binned = cells.join(values, ["model", "f", "x"]).groupBy("model", "doc_id").agg(F.sort_array(F.collect_list(F.struct("f", "bin"))).alias("c"))
    draws = F.transform(F.sequence(F.lit(0), F.lit(spec.trees - 1)), lambda t: bootstrap(F.col("doc_id"), t)) if spec.forest else F.lit(None)
    rows = docs.select("model", "doc_id", "label").join(binned, ["model", "doc_id"], "left")
    return materialize(rows.select("model", "doc_id", "label", *[F.coalesce(F.col(f"c.{n}"), F.array().cast("array<int>")).alias(o) for n, o in (("f", "f"), ("bin", "b"))],
                                   draws.cast("array<int>").alias("w")))


# ---- tasks ------------------------------------------------------------------

def walk(dense: np.ndarray, tree) -> np.ndarray:
    """The node that each row of ``dense`` reaches."""
    feature, cut, left, right = tree
    at, row = np.zeros(len(dense), np.int64), np.arange(len(dense))
    while True:
        row = row[feature[at[row]] >= 0]
        if not len(row):
            return at
        node = at[row]
        at[row] = np.where(dense[row, feature[node]] >= cut[node], right[node], left[node])


def blocks(batch, width: dict[str, int], value: str, kind):
    """(model, rows, lengths, entries of f, entries of the value, dense matrix) of a batch, by model and in blocks of bounded size."""
    models = np.array(batch.column("model").to_pylist(), dtype=object)
    lists = {c: batch.column(c).combine_chunks() if isinstance(batch.column(c), pa.ChunkedArray) else batch.column(c) for c in ("f", value)}
    offset = lists["f"].offsets.to_numpy().astype(np.int64)
    flat = {c: lists[c].values.to_numpy(zero_copy_only=False) for c in lists}
    for m in dict.fromkeys(models.tolist()):
        every = np.flatnonzero(models == m)
        step = max(1, DENSE_CELLS // max(1, width[m]))
        for s in range(0, len(every), step):
            rows = every[s:s + step]
            n = offset[rows + 1] - offset[rows]
            entry = np.repeat(offset[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            f, v = flat["f"][entry].astype(np.int64), flat[value][entry]
            dense = np.zeros((len(rows), width[m] + 1), kind)
            dense[np.repeat(np.arange(len(rows)), n), f] = v
            yield m, rows, n, f, v, dense


def chosen(f: np.ndarray, tree: int, number: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether a node of a forest's tree looks at a feature: the generator's number for the three is below the node's limit."""
    a = (f * MUL_A + 12345) % PRIME
    b = (tree * MUL_B + number % PRIME * 16807 + 777) % PRIME
    return ((a ^ b) % PRIME * MUL_B) % PRIME < limit


def histograms(forest: dict, frontier: dict, width: dict[str, int], weigh, limits: dict | None, bins: int):
    """A function for mapInArrow: sums (model, tree, node, f, bin, s0, s1, s2) of a task's rows over the frontier nodes.

    ``weigh(model, dense, labels, batch rows, tree)`` gives the three sums of each row.
    """
    def run(batches):
        total: dict = {}
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            draws = batch.column("w") if limits is not None else None
            for m, rows, n, f, b, dense in blocks(batch, width, "b", np.int16):
                entry_row = np.repeat(np.arange(len(rows)), n)
                given = np.array([draws[int(r)].as_py() for r in rows]) if draws is not None else None
                for tree, nodes in frontier.get(m, {}).items():
                    slot = np.full(len(forest[m, tree][0]), -1)
                    slot[nodes] = np.arange(len(nodes))
                    at = slot[walk(dense, forest[m, tree])]
                    sums = weigh(m, dense, label[rows], tree)
                    if given is not None:
                        sums = sums * given[:, tree][:, None]
                    keep = at[entry_row] >= 0
                    if given is not None:
                        keep &= given[entry_row, tree] > 0
                        number, limit = limits[m, tree]
                        keep[keep] = chosen(f[keep], tree, number[at[entry_row[keep]]], limit[at[entry_row[keep]]])
                    key = (at[entry_row[keep]] * (width[m] + 1) + f[keep]) * bins + b[keep]
                    add(total, (m, tree), key, sums[entry_row[keep]])
        names = ["model", "tree", "node", "f", "bin", "s0", "s1", "s2"]
        for (m, tree), parts in total.items():
            key, sums = combined(parts)
            node, rest = np.divmod(key, (width[m] + 1) * bins)
            f, b = np.divmod(rest, bins)
            for s in range(0, len(key), 50_000):
                c = slice(s, s + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(key[c])), pa.array(np.full(len(key[c]), tree, np.int32)), pa.array(np.asarray(frontier[m][tree])[node[c]]),
                                                  pa.array(f[c].astype(np.int32)), pa.array(b[c].astype(np.int32)), *(pa.array(sums[c, i]) for i in range(3))], names=names)
    return run


def add(total: dict, at, key: np.ndarray, sums: np.ndarray) -> None:
    parts = total.setdefault(at, [])
    parts.append(combined([(key, sums)]))
    if sum(len(k) for k, _ in parts) > 2_000_000:
        total[at] = [combined(parts)]


def combined(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key of several (keys, sums)."""
    key, sums = (np.concatenate(x) for x in zip(*parts))
    if not len(key):
        return key, sums
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    return key[first], np.add.reduceat(sums[order], first, axis=0)


HIST = "model string, tree int, node long, f int, bin int, s0 long, s1 long, s2 long"


def best_splits(hist: DataFrame, frontier: list[tuple], score, least: float) -> list:
    """The split of largest score of each frontier node (model, tree, node, t0, t1, t2) that has one; ties: least feature, then bin.

    ``score(s0, s1, s2)`` is what a side is worth; both must hold rows (``size``)."""
    spark = hist.sparkSession
    size, worth = score
    nodes = spark.createDataFrame(frontier, "model string, tree int, node long, t0 long, t1 long, t2 long")
    nodes = F.broadcast(nodes) if len(frontier) <= SMALL_FRONTIER else nodes
    keys = ["model", "tree", "node", "f"]
    w = Window.partitionBy(*keys).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    # one exchange serves the sums and the running totals
    right = (hist.repartition(*keys).groupBy(*keys, "bin").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(3)])
             .select(*keys, "bin", *[F.sum(f"s{i}").over(w).alias(f"r{i}") for i in range(3)]))
    r, t = [F.col(f"r{i}") for i in range(3)], [F.col(f"t{i}") for i in range(3)]
    rest = [a - b for a, b in zip(t, r)]
    gain = worth(*rest) + worth(*r)
    found = (right.join(nodes, keys[:3]).where((size(*rest) > 0) & (size(*r) > 0)).withColumn("score", gain)
             .where(F.col("score") > worth(*t) + least)
             .groupBy(*keys[:3]).agg(F.max(F.struct("score", (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"), *r)).alias("s")))
    return found.collect()  # one row a node


def class_size(a: Column, b: Column, c: Column) -> Column:
    return a + b + c


def class_worth(a: Column, b: Column, c: Column) -> Column:
    """Sum of squared class counts by size: largest where the Gini impurity is least."""
    return (a * a + b * b + c * c).cast("double") / class_size(a, b, c).cast("double")


def grad_worth(n: Column, g: Column, h: Column) -> Column:
    return g.cast("double") * g.cast("double") / n.cast("double")


CLASS, GRADIENT = (class_size, class_worth), (lambda n, g, h: n, grad_worth)


# ---- learners ---------------------------------------------------------------

def grow_classes(rows: DataFrame, width: dict[str, int], spec: Spec) -> dict[tuple[str, int], Tree]:
    """{(model, tree): tree} of classes 0, 1, 2.  ``width``: number of features of each model."""
    per_tree = [F.when(F.col("label") == c, F.get("w", F.lit(t)) if spec.forest else 1).otherwise(0) for t in range(spec.trees) for c in range(3)]
    start = rows.groupBy("model").agg(F.array(*[F.sum(x).cast("long") for x in per_tree]).alias("n"), F.avg(F.size("f")).alias("nnz"), F.count("*").alias("rows")).collect()
    forest, nnz = {}, {r.model: max(1, round(r.nnz)) for r in start}
    for r in start:
        for t in range(spec.trees):
            forest[r.model, t] = Tree()
            forest[r.model, t].add(1, tuple(r.n[3 * t:3 * t + 3]))
    open_ = {k: [0] for k in forest}

    def weigh(m, dense, label, tree):
        return (label[:, None] == np.arange(3)).astype(np.int64)

    for _ in range(spec.depth):
        open_ = {k: [i for i in nodes if sum(c > 0 for c in forest[k].held[i]) > 1] for k, nodes in open_.items()}
        frontier: dict = {}
        for (m, t), nodes in open_.items():
            if nodes:
                frontier.setdefault(m, {})[t] = nodes
        if not frontier:
            break
        limits = None
        if spec.forest:
            limits = {(m, t): (np.array([forest[m, t].number[i] for i in nodes], np.int64), np.array([subset_limit(width[m], sum(forest[m, t].held[i]), nnz[m]) for i in nodes], np.int64))
                      for m, of in frontier.items() for t, nodes in of.items()}
        flat = {k: tree.arrays() for k, tree in forest.items()}
        hist = rows.mapInArrow(histograms(flat, frontier, width, weigh, limits, spec.bins), HIST)
        table = [(m, t, i, *forest[m, t].held[i]) for m, of in frontier.items() for t, nodes in of.items() for i in nodes]
        open_ = {k: [] for k in forest}
        for r in best_splits(hist, table, CLASS, 1e-9):
            open_[r.model, r.tree] += forest[r.model, r.tree].split(r.node, -r.s["f"], -r.s["bin"], (r.s["r0"], r.s["r1"], r.s["r2"]))
    return forest


def subset_limit(features: int, rows: int, nnz: int) -> int:
    """The generator's numbers below which a node of ``rows`` rows looks at a feature: about the root of ``features`` of those that can occur in it."""
    root = int(np.ceil(np.sqrt(features)))
    return min(PRIME, PRIME * root // max(1, min(features, rows * nnz)))


def fixed(x):
    """To whole units, halves up."""
    return np.floor(x * UNIT + 0.5)


def probability(score: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-(score / float(UNIT))))


def leaf_value(held: tuple[int, int, int], rate: float) -> int:
    n, g, h = held
    return int(fixed(rate * (float(g) / float(h)))) if h > 0 else 0


def boost(rows: DataFrame, width: dict[str, int], spec: Spec):
    """One-against-the-rest gradient boosting on logistic loss: ({model: three first scores}, {(model, 3 x stage + class): (tree, leaf values)}, losses).

    ``losses`` holds (model, class, stage, mean training loss before the stage).
    Scores of earlier stages are worked out anew in the tasks, so a stage depends on no task's memory.
    """
    counts = rows.groupBy("model").agg(F.count("*").alias("n"), *[F.sum((F.col("label") == c).cast("long")).alias(f"c{c}") for c in range(3)]).collect()
    first = {r.model: [prior(r[f"c{c}"], r.n) for c in range(3)] for r in counts}
    forest: dict = {}
    values: dict = {}
    losses: list[tuple] = []

    def scores(m, dense, cls, upto, flat, leaves):
        s = np.full(len(dense), first[m][cls], np.int64)
        for stage in range(upto):
            s += leaves[m, 3 * stage + cls][walk(dense, flat[m, 3 * stage + cls])]
        return s

    for stage in range(spec.stages):
        flat, leaves = {k: t.arrays() for k, t in forest.items()}, {k: np.array(v, np.int64) for k, v in values.items()}

        def weigh(m, dense, label, tree, stage=stage, flat=flat, leaves=leaves):
            cls = tree % 3
            p, y = probability(scores(m, dense, cls, stage, flat, leaves)), (label == cls).astype(np.float64)
            return np.stack([np.ones(len(y), np.int64), fixed(y - p).astype(np.int64), fixed(p * (1.0 - p)).astype(np.int64)], axis=1)

        def sums(batches, stage=stage, flat=flat, leaves=leaves, weigh=weigh):
            for batch in batches:
                label = batch.column("label").to_numpy(zero_copy_only=False)
                for m, at, _, _, _, dense in blocks(batch, width, "b", np.int16):
                    for cls in range(3):
                        w = weigh(m, dense, label[at], 3 * stage + cls).sum(axis=0)
                        s = scores(m, dense, cls, stage, flat, leaves) / float(UNIT)
                        loss = int(fixed(np.logaddexp(0, np.where(label[at] == cls, -s, s))).sum())
                        yield pa.RecordBatch.from_pylist([{"model": m, "cls": cls, "n": int(w[0]), "g": int(w[1]), "h": int(w[2]), "loss": loss}])

        root = rows.mapInArrow(sums, "model string, cls long, n long, g long, h long, loss long").groupBy("model", "cls") \
            .agg(*[F.sum(c).alias(c) for c in ("n", "g", "h", "loss")]).collect()
        open_ = {}
        for r in root:
            k = r.model, 3 * stage + r.cls
            forest[k] = Tree()
            open_[k] = [forest[k].add(1, (r.n, r.g, r.h))]
            losses.append((r.model, r.cls, stage, r.loss / UNIT / r.n))
        for _ in range(spec.depth):
            frontier: dict = {}
            for (m, t), nodes in open_.items():
                if nodes:
                    frontier.setdefault(m, {})[t] = nodes
            if not frontier:
                break
            now = {k: forest[k].arrays() for k in open_}
            hist = rows.mapInArrow(histograms(now, frontier, width, weigh, None, spec.bins), HIST)
            table = [(m, t, i, *forest[m, t].held[i]) for m, of in frontier.items() for t, nodes in of.items() for i in nodes]
            open_ = {k: [] for k in open_}
            for r in best_splits(hist, table, GRADIENT, 1e-3):
                open_[r.model, r.tree] += forest[r.model, r.tree].split(r.node, -r.s["f"], -r.s["bin"], (r.s["r0"], r.s["r1"], r.s["r2"]))
        for k in now_stage(forest, stage):
            values[k] = [leaf_value(h, spec.rate) for h in forest[k].held]
    return first, {k: (forest[k], values[k]) for k in forest}, losses


def now_stage(forest: dict, stage: int) -> list:
    return [k for k in forest if k[1] // 3 == stage]


def prior(positive: int, n: int) -> int:
    """First score of a class: its log odds, at most 10 either way."""
    if positive in (0, n):
        return (10 if positive else -10) * UNIT
    return int(fixed(np.log(float(positive) / float(n - positive))))


# ---- fitted models ------------------------------------------------------------

MODEL_SCHEMA = "model string, tree int, node int, f int, threshold double, left int, right int, v0 long, v1 long, v2 long"


def as_table(spark, forest: dict, values: DataFrame, first: dict | None = None) -> DataFrame:
    """A fitted forest, or boosted trees, as a table (MODEL_SCHEMA) with thresholds in place of bins.

    A node's v0..v2 are its votes in billionths (a forest), or its value in units in
    the column of its class (boosting); tree -1 holds first scores.
    """
    rows = []
    for (m, t), tree in forest.items():
        tree, worth = tree if isinstance(tree, tuple) else (tree, None)
        for i, held in enumerate(tree.held):
            v = tuple(c * 10**9 // max(1, sum(held)) for c in held) if worth is None else tuple(worth[i] if c == t % 3 else 0 for c in range(3))
            rows.append((m, t, i, tree.feature[i], tree.bin[i], tree.left[i], tree.right[i], *v))
    rows += [(m, -1, 0, -1, 0, -1, -1, *v) for m, v in (first or {}).items()]
    nodes = spark.createDataFrame(rows, "model string, tree int, node int, f int, bin int, left int, right int, v0 long, v1 long, v2 long")
    cut = values.groupBy("model", "f", "bin").agg(F.min("x").alias("threshold"))
    return nodes.join(cut, ["model", "f", "bin"], "left").select(*[c.split()[0] for c in MODEL_SCHEMA.split(", ")])


def predict(table: DataFrame, docs: DataFrame, cells: DataFrame) -> DataFrame:
    """(model, doc_id, dataset, y, pred) of ``docs`` (model, doc_id, dataset, y) with ``cells`` (model, doc_id, f, x): the largest sum over trees, ties to the least class.

    The model table has as many rows as nodes and goes to every task; cells of features without a split are dropped before rows are gathered.
    """
    table = table.select("*").toPandas()  # bounded by the trees' nodes
    forest, value, width = {}, {}, {}
    for (m, t), part in table.sort_values("node").groupby(["model", "tree"]):
        value[m, t] = part[["v0", "v1", "v2"]].to_numpy(np.int64)
        forest[m, t] = (part["f"].to_numpy(np.int64), part["threshold"].to_numpy(np.float64), part["left"].to_numpy(np.int64), part["right"].to_numpy(np.int64))
        width[m] = max(width.get(m, 0), int(part["f"].max()) + 1)
    of = {m: [t for x, t in forest if x == m] for m in width}
    used = table[table.f >= 0][["model", "f"]].drop_duplicates()
    used = cells.sparkSession.createDataFrame(list(used.itertuples(index=False, name=None)), "model string, f int")
    rows = docs.select("model", "doc_id", "dataset", "y").join(
        cells.join(used, ["model", "f"], "left_semi").groupBy("model", "doc_id").agg(F.collect_list(F.struct("f", "x")).alias("c")), ["model", "doc_id"], "left") \
        .select("model", "doc_id", "dataset", "y", F.coalesce("c.f", F.array().cast("array<int>")).alias("f"), F.coalesce("c.x", F.array().cast("array<double>")).alias("x"))
    rows = rows.where(F.col("model").isin(list(width))) if width else rows.limit(0)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pred = np.zeros(batch.num_rows, np.int32)
            for m, at, _, _, _, dense in blocks(batch, width, "x", np.float64):
                total = np.zeros((len(at), 3), np.int64)
                for t in of[m]:
                    total += value[m, t][walk(dense, forest[m, t])]
                pred[at] = total.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("model", "doc_id", "dataset", "y")), pa.array(pred)], names=["model", "doc_id", "dataset", "y", "pred"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join(f"{c} {kind[c]}" for c in ("model", "doc_id", "dataset", "y")) + ", pred int")
