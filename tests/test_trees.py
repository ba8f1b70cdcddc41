"""Tree learners against plain Python on small frames: splits, ties, bags, boosting, empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inferna.operators import trees

CELLS = "model string, doc_id string, f int, x double"


def small(seed, n=120, features=12):
    r = random.Random(seed)
    docs, cells = [], []
    for m in ("a", "b"):
        for i in range(n):
            x = {f: round(r.choice([1, 2, 3, r.random() + 0.1]), 6) for f in range(features) if r.random() < 0.4}
            label = (x.get(0, 0) > 1) + (x.get(3, 0) > 0.5) if r.random() < 0.9 else r.randrange(3)
            docs.append((m, f"{m}{i}", int(label)))
            cells += [(m, f"{m}{i}", f, float(v)) for f, v in x.items()]
    return docs, cells


def plain_bins(cells, bins):
    out = {}
    for m, f in {(m, f) for m, _, f, _ in cells}:
        xs = sorted(x for a, _, b, x in cells if (a, b) == (m, f))
        for x in set(xs):
            out[m, f, x] = 1 + sum(y < x for y in xs) * (bins - 1) // len(xs)
    return out


def plain_best(rows, worth, features):
    """(f, bin) of the best split of ``rows`` (bins by feature, three sums), or None."""
    add = lambda rs: tuple(sum(r[1][i] for r in rs) for i in range(3))
    best, whole = None, worth(add(rows))
    for f in features:
        for b in sorted({r[0].get(f, 0) for r in rows} - {0}):
            right = [r for r in rows if r[0].get(f, 0) >= b]
            left = [r for r in rows if r[0].get(f, 0) < b]
            if left and right:
                score = worth(add(left)) + worth(add(right))
                if score > whole[0] if isinstance(whole, tuple) else score > whole + 1e-9:
                    if best is None or score > best[0]:
                        best = score, f, b
    return best and best[1:]


def gini(t):
    return float(sum(c * c for c in t)) / float(sum(t))


def plain_tree(rows, depth, number=1):
    """{node number: (f, bin) or counts}"""
    counts = tuple(sum(r[1][i] for r in rows) for i in range(3))
    split = plain_best(rows, gini, range(12)) if depth and sum(c > 0 for c in counts) > 1 else None
    if not split:
        return {number: counts}
    f, b = split
    return {number: split, **plain_tree([r for r in rows if r[0].get(f, 0) < b], depth - 1, 2 * number),
            **plain_tree([r for r in rows if r[0].get(f, 0) >= b], depth - 1, 2 * number + 1)}


def shape(tree):
    return {n: tree.held[i] if tree.feature[i] < 0 else (tree.feature[i], tree.bin[i]) for i, n in enumerate(tree.number)}


def tables(spark, docs, cells, spec):
    d, c = spark.createDataFrame(docs, "model string, doc_id string, label int"), spark.createDataFrame(cells, CELLS)
    values = trees.fit_bins(c, spec.bins)
    return d, c, values, trees.training_rows(d, c, values, spec)


@pytest.mark.parametrize("depth, bins", [(30, 32), (3, 4)])
def test_tree_against_plain_search(spark, depth, bins):
    docs, cells = small(depth)
    spec = trees.Spec(depth=depth, bins=bins)
    d, c, values, rows = tables(spark, docs, cells, spec)
    of = plain_bins(cells, bins)
    assert {(r.model, r.f, r.x): r.bin for r in values.collect()} == of
    forest = trees.grow_classes(rows, {"a": 12, "b": 12}, spec)
    for m in ("a", "b"):
        plain = [({f: of[m, f, x] for _, j, f, x in cells if j == i}, tuple(int(label == k) for k in range(3))) for a, i, label in docs if a == m]
        assert shape(forest[m, 0]) == plain_tree(plain, depth)
    # every training row scored by its own model lands in its leaf
    scored = trees.predict(trees.as_table(spark, forest, values), d.select("model", "doc_id", F.lit("x").alias("dataset"), F.col("label").alias("y")), c)
    right = scored.agg(F.avg((F.col("y") == F.col("pred")).cast("int"))).first()[0]
    assert scored.count() == len(docs) and (right == 1.0 or depth < 30)


def test_forest_is_the_same_twice_and_better_than_one_shallow_tree(spark):
    docs, cells = small(5)
    spec = trees.Spec(depth=6, bins=8, trees=9, forest=True)
    d, c, values, rows = tables(spark, docs, cells, spec)
    width = {"a": 12, "b": 12}
    first = trees.grow_classes(rows, width, spec)
    again = trees.grow_classes(rows.repartition(5), width, spec)
    assert {k: shape(t) for k, t in first.items()} == {k: shape(t) for k, t in again.items()}
    assert len({str(shape(t)) for t in first.values()}) == 18
    draws = np.array([r.w for r in rows.select("w").collect()])
    assert abs(draws.mean() - 1) < 0.1 and draws.max() >= 3 and (draws == 0).mean() > 0.25
    scored = trees.predict(trees.as_table(spark, first, values), d.select("model", "doc_id", F.lit("x").alias("dataset"), F.col("label").alias("y")), c)
    most = max(sum(x[2] == k for x in docs) for k in range(3)) / len(docs)
    assert scored.agg(F.avg((F.col("y") == F.col("pred")).cast("int"))).first()[0] > most + 0.1


def test_boosting_loss_falls_and_first_stage_is_exact(spark):
    docs, cells = small(6)
    spec = trees.Spec(depth=2, bins=8, stages=5, rate=0.3)
    d, c, values, rows = tables(spark, docs, cells, spec)
    first, forest, losses = trees.boost(rows, {"a": 12, "b": 12}, spec)
    by = {}
    for m, k, stage, loss in losses:
        by.setdefault((m, k), []).append(loss)
    assert all(len(x) == 5 and x == sorted(x, reverse=True) and x[-1] < x[0] for x in by.values())
    of = plain_bins(cells, 8)
    for m in ("a", "b"):
        n = sum(x[0] == m for x in docs)
        for k in range(3):
            s = trees.prior(sum(x[0] == m and x[2] == k for x in docs), n)
            assert first[m][k] == s
            p = 1 / (1 + math.exp(-(s / trees.UNIT)))
            plain = [({f: of[m, f, x] for _, j, f, x in cells if j == i},
                      (1, math.floor(((label == k) - p) * trees.UNIT + 0.5), math.floor(p * (1 - p) * trees.UNIT + 0.5))) for a, i, label in docs if a == m]
            tree, values_ = forest[m, k]
            split = plain_best(plain, lambda t: float(t[1]) * float(t[1]) / float(t[0]), range(12))
            assert (tree.feature[0], tree.bin[0]) == split
            assert values_[0] == trees.leaf_value(tuple(sum(r[1][i] for r in plain) for i in range(3)), 0.3)
    scored = trees.predict(trees.as_table(spark, forest, values, first), d.select("model", "doc_id", F.lit("x").alias("dataset"), F.col("label").alias("y")), c)
    assert {r.pred for r in scored.collect()} <= {0, 1, 2}


def test_rows_without_features_one_label_and_no_rows(spark):
    docs = [("a", "1", 2), ("a", "2", 2), ("b", "3", 0), ("b", "4", 1)]
    spec = trees.Spec(depth=4, bins=4)
    d, c, values, rows = tables(spark, docs, [], spec)
    forest = trees.grow_classes(rows, {"a": 0, "b": 0}, spec)
    scored = trees.predict(trees.as_table(spark, forest, values), d.select("model", "doc_id", F.lit("x").alias("dataset"), F.col("label").alias("y")), c)
    assert {(r.doc_id, r.pred) for r in scored.collect()} == {("1", 2), ("2", 2), ("3", 0), ("4", 0)}
    d, c, values, rows = tables(spark, [], [], spec)
    assert trees.grow_classes(rows, {}, spec) == {}
