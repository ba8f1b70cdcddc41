"""The nine models by key, each trained, saved, loaded and evaluated on its own.

A saved model is a folder of tables that holds the models of all training
datasets (``model`` is a column): the vocabularies, the parse-feature list
with its scaling, what the learner fitted, and ``metadata``, written last.

    vocabulary  block, model, term, idx, idf
    scaling     model, feature, pos, shift, scale
    nodes       trees, forests and boosted trees (operators/trees.py)
    classes, weights          multinomial naive Bayes (operators/nb.py)
    vectors     nearest neighbours: the scaled training rows
    weights     logistic regression: model, f, w0, w1, w2 (f = -1: intercepts)
    metadata    key, model, learner, n_train, n_features
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from inferna.functions import arrow_maps
from inferna.operators import metrics, nb, trees
from inferna.operators import vectorize as V
from inferna.operators.knn import knn_predict
from inferna.plans import tree_models as TM
from inferna.session import materialize
from inferna.sources import store


@dataclass(frozen=True)
class ModelSpec:
    """``joined``: one vocabulary of both sides for all blocks, fitted on premise + ' ' + hypothesis.
    ``syntactic``: scaling of the parse features, whose numbers begin at ``offset`` (None: texts alone)."""
    learner: str                             # tree | nb | knn | lr
    blocks: tuple[TM.Block, ...] = ()
    joined: bool = False
    syntactic: str | None = None             # raw | standard | nomean | minmax
    offset: int = 0
    spec: trees.Spec | None = None
    k: int = 5
    steps: int = 50


def _sides(k: int, tfidf: bool, bigrams: bool, stop: bool) -> tuple[TM.Block, ...]:
    spec = V.TermSpec(k, bigrams=bigrams, stop_words=stop)
    return TM.Block("premise_text", spec, 0, tfidf), TM.Block("hypothesis_text", spec, k, tfidf)


def _tree(key: str) -> ModelSpec:
    e = TM.EXPERIMENTS[key]
    return ModelSpec("tree", e.blocks, False, None if e.syntactic is None else "raw", e.syntactic or 0, e.spec)


#: M12.  Steps of logistic regression and the size of trees are those of the registered queries; ``train`` takes any spec.
MODELS = {
    "baseline-1": _tree("baseline-1"),
    "baseline-2": ModelSpec("lr", _sides(10_000, True, True, True), joined=True),
    "baseline-3": ModelSpec("nb", _sides(10_000, False, False, False), joined=True),
    "experiment-1": _tree("experiment-1"),
    "experiment-2": ModelSpec("knn", syntactic="standard"),
    "experiment-3": ModelSpec("lr", _sides(5_000, True, True, True), syntactic="nomean", offset=10_000),
    "experiment-4": ModelSpec("nb", _sides(5_000, False, False, True), syntactic="minmax", offset=10_000),
    "experiment-5": _tree("experiment-5"),
    "experiment-6": _tree("experiment-6"),
}
#: M12, the two keys that are studies: no model outlives them.
STUDIES = {"experiment-7": TM.ablation, "experiment-8": TM.cross_validate}


# ---- features -----------------------------------------------------------

def fit_vocabularies(train: DataFrame, m: ModelSpec) -> DataFrame | None:
    out = None
    for i, block in enumerate(m.blocks):
        source = TM.Block(None, block.spec, block.offset, block.tfidf) if m.joined else block
        if out is None or not m.joined:
            fitted = TM.fit_vocabulary(train, source)
        part = fitted.select(F.lit(i).alias("block"), "model", "term", "idx", "idf")
        out = part if out is None else out.unionByName(part)
    return out


def fit_scaling(train: DataFrame, kind: str) -> DataFrame:
    """(model, feature, pos, shift, scale) of the features that a model's training rows have.

    A row without a feature counts as 0, from the number of rows and not as a
    row of its own: one aggregation over the values that are there."""
    from pyspark.sql import Window
    rows = train.groupBy("model").agg(F.count("*").alias("n"))
    long = train.select("model", F.explode_outer("syn").alias("feature", "v")).where("feature IS NOT NULL")
    seen = long.groupBy("model", "feature").agg(F.count("v").alias("c"), F.avg("v").alias("mu"), F.var_pop("v").alias("var"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    all_ = seen.join(rows, "model")
    mean = F.col("c") * F.col("mu") / F.col("n")
    sd = F.sqrt((F.col("c") * F.col("var") + F.col("c") * (F.col("n") - F.col("c")) / F.col("n") * F.col("mu") * F.col("mu")) / F.col("n"))
    some_miss = F.col("c") < F.col("n")
    lo, hi = (F.when(some_miss, f(F.col(c), F.lit(0.0))).otherwise(F.col(c)) for f, c in ((F.least, "lo"), (F.greatest, "hi")))
    one, zero = F.lit(1.0), F.lit(0.0)
    by_sd = F.when(sd > 0, sd).otherwise(one)
    shift, scale = {"raw": (zero, one), "standard": (mean, by_sd), "nomean": (zero, by_sd),
                    "minmax": (lo, F.when(hi - lo > 0, hi - lo).otherwise(F.lit(float("inf"))))}[kind]
    pos = (F.row_number().over(Window.partitionBy("model").orderBy("feature")) - 1).cast("int")  # bounded by the tag vocabulary
    return all_.select("model", "feature", pos.alias("pos"), shift.alias("shift"), scale.alias("scale"))


def scaled_vectors(docs: DataFrame, scaling: DataFrame) -> DataFrame:
    """``docs`` (model, ..., syn) with ``vec``: the model's features in order of name, missing ones 0, scaled.

    The scaling (models x tag vocabulary) goes to the tasks, which set out whole batches."""
    state: dict = {}
    for r in sorted(scaling.collect(), key=lambda r: (r.model or "", r.pos)):
        state.setdefault(r.model, []).append((r.feature, r.shift, r.scale))
    tables = {m: ([f for f, _, _ in rows], np.array([(a, b) for _, a, b in rows], float).T) for m, rows in state.items() if m is not None}

    @F.arrow_udf(ArrayType(DoubleType()))
    def scaled(model: pa.Array, syn: pa.Array) -> pa.Array:
        names = np.array(model.to_pylist(), dtype=object)
        parts, place = [], np.zeros(len(names), np.int64)
        for m in dict.fromkeys(names.tolist()):
            at = np.flatnonzero(names == m) if m is not None else np.array([i for i, x in enumerate(names) if x is None], np.int64)
            place[at] = np.arange(len(at)) + sum(map(len, parts))
            if m not in tables:
                parts.append(pa.array([[]] * len(at), pa.list_(pa.float64())))
                continue
            features, (shift, scale) = tables[m]
            rows = syn if len(at) == len(names) else syn.take(pa.array(at))
            parts.append(arrow_maps.as_lists((arrow_maps.dense(rows, features) - shift) / scale))
        return pa.concat_arrays(parts).take(pa.array(place)) if len(parts) > 1 else parts[0] if parts else pa.array([], pa.list_(pa.float64()))

    return docs.withColumn("vec", scaled("model", "syn")).drop("syn")


def cells(docs: DataFrame, m: ModelSpec, tables: dict[str, DataFrame], models: list[str], own: bool) -> DataFrame:
    """(model, doc_id, f, x) of ``docs``, under its own model (``own``) or under every one."""
    parts = []
    for i, block in enumerate(m.blocks):
        parts.append(TM.text_cells(docs, tables["vocabulary"].where(F.col("block") == i), block, own))
    if m.syntactic == "raw":
        parts.append(TM.syntactic_cells(docs, tables["scaling"], m.offset, own))
    elif m.syntactic == "nomean":
        keep = ["model"] if own else []
        long = docs.select(*keep, "doc_id", F.explode_outer("syn").alias("feature", "value")).where("value <> 0")
        parts.append(long.join(tables["scaling"], [*keep, "feature"])
                     .select("model", "doc_id", (F.col("pos") + m.offset).cast("int").alias("f"), (F.col("value") / F.col("scale")).alias("x")))
    elif m.syntactic is not None:
        rows = docs.select("model", "doc_id", "syn") if own else under_all(docs.select("doc_id", "syn"), models)
        parts.append(scaled_vectors(rows, tables["scaling"]).select("model", "doc_id", F.posexplode_outer("vec").alias("pos", "x"))
                     .where("x <> 0").select("model", "doc_id", (F.col("pos") + m.offset).cast("int").alias("f"), "x"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def under_all(docs: DataFrame, models: list[str]) -> DataFrame:
    """Every row under every model (a handful of training datasets)."""
    return docs.select(F.explode(F.array(*[F.lit(x) for x in models])).alias("model"), *docs.columns)


# ---- learners -------------------------------------------------------------

def _fit_logistic(spark: SparkSession, rows: DataFrame, x: DataFrame, width: dict[str, int], steps: int) -> DataFrame:
    """One against the rest, L2 with C = 1.  A class without training rows gets no score; a single class always wins."""
    gathered = rows.join(x.groupBy("model", "doc_id").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("c")), ["model", "doc_id"], "left") \
        .select("model", "doc_id", "label", F.coalesce("c", F.array().cast("array<struct<f:int,x:double>>")).alias("c"))
    gathered = materialize(gathered)   # the bounded training sample, read by every fit
    known = gathered.groupBy("model", "label").count().collect()
    out = []
    for name, size in sorted(width.items()):
        n = {r.label: r["count"] for r in known if r.model == name}
        size = max(1, size)
        vector = F.udf(lambda c, size=size: Vectors.sparse(size, [(e.f, e.x) for e in c]), VectorUDT())
        data = gathered.where(F.col("model") == name).orderBy("doc_id").select("label", vector("c").alias("features"))
        fits = {}
        for c in sorted(n):
            if len(n) == 1:
                fits[c] = ([], 0.0)
                continue
            lr = LogisticRegression(regParam=1.0 / sum(n.values()), elasticNetParam=0.0, standardization=False, maxIter=steps, family="binomial")
            fit = lr.fit(data.select((F.col("label") == c).cast("double").alias("label"), "features"))
            fits[c] = (fit.coefficients.toArray(), float(fit.intercept))
        out.append((name, -1, *[fits[c][1] if c in fits else None for c in metrics.CLASSES]))
        for f in range(size if len(n) > 1 else 0):
            w = [float(fits[c][0][f]) if c in fits else 0.0 for c in metrics.CLASSES]
            if any(w):
                out.append((name, f, *w))
    return spark.createDataFrame(out, "model string, f int, w0 double, w1 double, w2 double")


def _score_logistic(weights: DataFrame, docs: DataFrame, x: DataFrame) -> DataFrame:
    sums = x.join(weights.where("f >= 0"), ["model", "f"]).groupBy("model", "doc_id").agg(*[F.sum(F.col("x") * F.col(f"w{c}")).alias(f"s{c}") for c in metrics.CLASSES])
    base = weights.where("f = -1").select("model", *[F.col(f"w{c}").alias(f"b{c}") for c in metrics.CLASSES])
    scored = docs.join(base, "model").join(sums, ["model", "doc_id"], "left")
    score = {c: F.coalesce(F.coalesce(f"s{c}", F.lit(0.0)) + F.col(f"b{c}"), F.lit(float("-inf"))) for c in metrics.CLASSES}
    best, pred = F.greatest(*score.values()), F.lit(None).cast("int")
    for c in reversed(metrics.CLASSES):
        pred = F.when(score[c] == best, F.lit(c)).otherwise(pred)
    return scored.select("model", "doc_id", "dataset", "y", pred.cast("int").alias("pred"))


def fit(spark: SparkSession, train: DataFrame, m: ModelSpec, key: str = "") -> dict[str, DataFrame]:
    """All tables of the models of ``train`` (model, doc_id, label, texts, and syn where parse features are used)."""
    tables: dict[str, DataFrame] = {}
    vocabulary = fit_vocabularies(train, m)
    if vocabulary is not None:
        tables["vocabulary"] = vocabulary
    if m.syntactic is not None:
        tables["scaling"] = materialize(fit_scaling(train, m.syntactic))
    rows = train.select("model", "doc_id", "label")
    size = rows.groupBy("model").agg(F.count("*").alias("n_train"))
    for part in tables.values():
        size = size.unionByName(part.groupBy("model").agg(F.count("*").alias("n_features")), allowMissingColumns=True)
    size = size.groupBy("model").agg(F.max("n_train").alias("n_train"), F.coalesce(F.sum("n_features"), F.lit(0)).cast("long").alias("n_features"))
    size = materialize(size.select(F.lit(key).alias("key"), "model", F.lit(m.learner).alias("learner"), "n_train", "n_features"))
    if m.learner == "knn":
        vec = scaled_vectors(train.select("model", "doc_id", "label", "syn"), tables["scaling"])
        tables["vectors"] = vec.select("model", F.col("doc_id").alias("train_id"), "label", "vec")
        return {**tables, "metadata": size}
    x = materialize(cells(train, m, tables, [], True))
    if m.learner == "nb":
        feats = x.join(rows, ["model", "doc_id"])
        tables["classes"], tables["weights"] = nb.fit(feats, rows, size.select("model", "n_features"), ["model"])
        return {**tables, "metadata": size}
    width = {r.model: r.w or 0 for r in size.select("model").join(x.groupBy("model").agg((F.max("f") + 1).alias("w")), "model", "left").collect()}
    if m.learner == "tree":
        tables["nodes"] = TM.fit(spark, TM.Prepared(rows, x, None, None, width), m.spec)[0]
    else:
        tables["weights"] = _fit_logistic(spark, rows, x, width, m.steps)
    return {**tables, "metadata": size}


def score(test: DataFrame, m: ModelSpec, tables: dict[str, DataFrame]) -> DataFrame:
    """(model, doc_id, dataset, y, pred) of ``test`` (doc_id, dataset, y, texts, and syn where used) under every model."""
    models = sorted(r.model for r in tables["metadata"].select("model").collect())
    if not models:
        return test.limit(0).select(F.lit(None).cast("string").alias("model"), "doc_id", "dataset", "y", F.lit(None).cast("int").alias("pred"))
    if m.learner == "knn":
        q = scaled_vectors(under_all(test.select("doc_id", "dataset", "y", "syn"), models), tables["scaling"])
        return knn_predict(tables["vectors"], q, "vec", m.k, "cosine", tie_decimals=9)
    docs = under_all(test.select("doc_id", "dataset", "y"), models)
    x = cells(test, m, tables, models, False)
    if m.learner == "nb":
        return nb.predict(x, docs, tables["classes"], tables["weights"], ["model"], ["doc_id", "dataset", "y"])
    return trees.predict(tables["nodes"], docs, x) if m.learner == "tree" else _score_logistic(tables["weights"], docs, x)


# ---- store ----------------------------------------------------------------

@dataclass(frozen=True)
class Saved:
    key: str
    path: str
    spec: ModelSpec
    tables: dict[str, DataFrame]

    def predict(self, test: DataFrame) -> DataFrame:
        return score(test, self.spec, self.tables)

    def evaluate(self, test: DataFrame) -> DataFrame:
        """One row of metrics for each training dataset and dataset of ``test``."""
        grid = self.predict(test).select(F.lit(self.key).alias("experiment"), F.col("dataset").alias("predict_dataset"), F.col("model").alias("trained_dataset"), "y", "pred")
        return metrics.evaluate(grid, ["experiment", "predict_dataset", "trained_dataset"], decimals=6)


def versions(spark: SparkSession, base: str, key: str) -> list[str]:
    """Folders of the whole saves of ``key``, oldest first: those whose metadata, written last, is complete."""
    fs, p = store._fs(spark, f"{base.rstrip('/')}/{key}")
    if not fs.exists(p):
        return []
    found = sorted(f.getPath().toString() for f in fs.listStatus(p))
    return [v for v in found if fs.exists(store._fs(spark, f"{v}/metadata/_SUCCESS")[1])]


def save(spark: SparkSession, tables: dict[str, DataFrame], base: str, key: str) -> str:
    """Write a new version; if a table fails its folder goes and the version before stays the one that ``load`` finds."""
    path = f"{base.rstrip('/')}/{key}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    try:
        for name in sorted(tables, key=lambda n: n == "metadata"):
            tables[name].write.parquet(f"{path}/{name}")
    except BaseException:
        fs, p = store._fs(spark, path)
        fs.delete(p, True)
        raise
    return path


def train(spark: SparkSession, key: str, rows: DataFrame, base: str, spec: ModelSpec | None = None) -> str:
    """Fit the models of ``key`` on ``rows`` and save them; -> the folder."""
    return save(spark, fit(spark, rows, spec or MODELS[key], key), base, key)


def load(spark: SparkSession, key: str, base: str, spec: ModelSpec | None = None) -> Saved:
    """The latest whole save of ``key``; ``spec``: the one it was trained with, if not the registry's."""
    found = versions(spark, base, key)
    if not found:
        raise FileNotFoundError(f"no saved model {key} below {base}")
    fs, p = store._fs(spark, found[-1])
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return Saved(key, found[-1], spec or MODELS[key], {n: spark.read.parquet(f"{found[-1]}/{n}") for n in names})


def train_save_evaluate(spark: SparkSession, sf_dir: str, keys: tuple[str, ...], base: str) -> DataFrame:
    """Each of ``keys`` trained on the stratified training samples, saved, loaded and evaluated on every test split."""
    # the samples do not depend on the features: one table serves all keys
    of, test = TM.train_test(spark, sf_dir, any(MODELS[k].syntactic is not None for k in keys))
    out = None
    for key in keys:
        train(spark, key, of, base)
        part = load(spark, key, base).evaluate(test)
        out = part if out is None else out.unionByName(part)
    return out
