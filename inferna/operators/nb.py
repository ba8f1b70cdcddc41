"""Multinomial naive Bayes as relational plans (M3, M7).

Features arrive long: (model..., doc_id, label, f, x).  Training is one
aggregation to per-(class, feature) sums; the model is bounded by the
feature count (max_features), so it is broadcast to score.  Scoring is a
broadcast join plus one aggregation per (model, doc).  Several models (one
per training dataset) are fitted and applied in the same jobs.

Semantics: class prior = log(n_c / n) (no smoothing of priors);
log P(f | c) = log((N_cf + alpha) / (N_c + alpha * F)) with F = number of
features of the model; prediction = argmax, ties -> smallest class id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inferna.operators.metrics import CLASSES

MAX_MODEL_ROWS = 5_000_000   # bound for broadcasting the fitted tables


def fit(feats: DataFrame, docs: DataFrame, n_features: DataFrame, model_cols: list[str],
        alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """-> (classes: model, label, n_c, log_prior, base; features: model, f, d0..d2).

    ``n_features``: model_cols + n_features (F per model).  A negative feature
    value fails the job (V12): the model is not defined for it."""
    negative = F.raise_error(F.lit("multinomial naive Bayes needs feature values of at least 0"))
    feats = feats.withColumn("x", F.when(F.col("x") < 0, negative.cast("double")).otherwise(F.col("x")))
    cls = docs.groupBy(*model_cols, "label").agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy(*model_cols)     # <= 3 rows per model
    ncf = feats.groupBy(*model_cols, "label", "f").agg(F.sum("x").alias("ncf"))
    nc = ncf.groupBy(*model_cols, "label").agg(F.sum("ncf").alias("total_count"))
    classes = (cls.join(nc, [*model_cols, "label"], "left")
               .join(F.broadcast(n_features), model_cols)
               .select(*model_cols, "label", "n_c",
                       F.log(F.col("n_c") / F.sum("n_c").over(w)).alias("log_prior"),
                       F.coalesce("total_count", F.lit(0.0)).alias("total_count"),
                       F.log(F.lit(alpha) / (F.coalesce("total_count", F.lit(0.0)) + alpha * F.col("n_features")))
                       .alias("base")))
    delta = F.log(F.col("ncf") + alpha) - F.log(F.lit(alpha))
    fmodel = ncf.groupBy(*model_cols, "f").agg(
        *[F.sum(F.when(F.col("label") == c, delta).otherwise(F.lit(0.0))).alias(f"d{c}") for c in CLASSES])
    return classes, fmodel


def predict(feats: DataFrame, docs: DataFrame, classes: DataFrame, fmodel: DataFrame,
            model_cols: list[str], doc_cols: list[str]) -> DataFrame:
    """Score every doc under every model it has rows for.

    ``feats``: model_cols + doc_id + f + x; ``docs``: model_cols + doc_cols
    (one row per (model, doc), so docs without any known feature still get
    the prior-only prediction).  Returns model_cols + doc_cols + pred."""
    n_rows = fmodel.count()
    if n_rows > MAX_MODEL_ROWS:
        raise ValueError(f"NB feature table has {n_rows} rows; above the broadcast bound")
    extra = [c for c in doc_cols if c != "doc_id"]
    types = {f.name: f.dataType for f in docs.schema.fields}
    # every (model, doc) gets a zero row carrying the doc attributes, so the
    # aggregation alone yields one row per doc: no join back to ``docs``
    zero = docs.select(*model_cols, "doc_id", *extra, F.lit(None).cast("int").alias("f"),
                       F.lit(0.0).alias("x"))
    rows = feats.select(*model_cols, "doc_id", *[F.lit(None).cast(types[c]).alias(c) for c in extra],
                        F.col("f").cast("int").alias("f"), F.col("x").cast("double").alias("x"))
    rows = rows.unionByName(zero)
    j = rows.join(F.broadcast(fmodel), [*model_cols, "f"], "left")
    sums = j.groupBy(*model_cols, "doc_id").agg(
        F.sum("x").alias("S"),
        *[F.sum(F.col("x") * F.coalesce(F.col(f"d{c}"), F.lit(0.0))).alias(f"s{c}") for c in CLASSES],
        *[F.max(c).alias(c) for c in extra])
    cw = classes.groupBy(*model_cols).agg(
        *[F.max(F.when(F.col("label") == c, F.col("log_prior"))).alias(f"prior{c}") for c in CLASSES],
        *[F.max(F.when(F.col("label") == c, F.col("base"))).alias(f"base{c}") for c in CLASSES])
    sc = sums.join(F.broadcast(cw), model_cols)
    score = {c: F.col(f"prior{c}") + F.col("S") * F.col(f"base{c}") + F.col(f"s{c}") for c in CLASSES}
    best = F.greatest(*score.values())
    pred = F.lit(None).cast("int")
    for c in reversed(CLASSES):
        pred = F.when(score[c] == best, F.lit(c)).otherwise(pred)
    return sc.select(*model_cols, *doc_cols, pred.cast("int").alias("pred"))
