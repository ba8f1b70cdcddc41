"""Classification metrics from one confusion aggregation.

Predictions are reduced to counts per (cell, y, pred) — at most 9 rows per
cell, combined map-side — and every metric is a closed form over those
counts, so the whole experiment grid is scored in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inferna.sources.tables import LABEL_NAMES

CLASSES = sorted(LABEL_NAMES)

METRIC_NAMES = (["accuracy"]
                + [f"precision_{LABEL_NAMES[c]}" for c in CLASSES]
                + [f"recall_{LABEL_NAMES[c]}" for c in CLASSES]
                + [f"f1_{LABEL_NAMES[c]}" for c in CLASSES]
                + ["macro_precision", "macro_recall", "macro_f1",
                   "micro_precision", "micro_recall", "micro_f1",
                   "weighted_precision", "weighted_recall", "weighted_f1", "roc_auc"])


def confusion(pred: DataFrame, cell_cols: list[str], y_col: str = "y", pred_col: str = "pred") -> DataFrame:
    """(cell..., y, pred, n) — partial aggregation, tiny output."""
    return pred.groupBy(*cell_cols, F.col(y_col).alias("y"), F.col(pred_col).alias("pred")) \
               .agg(F.count(F.lit(1)).alias("n"))


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def metrics_from_confusion(conf: DataFrame, cell_cols: list[str], decimals: int | None = None) -> DataFrame:
    """A10-A12 per cell.

    Per class P/R/F1 with zero division -> 0; macro over the classes present
    in y or pred; micro = accuracy; weighted by true support; one-vs-rest
    ROC-AUC on one-hot hard predictions = mean_c (recall_c + specificity_c)/2,
    defined only when all three classes occur in both y and pred."""
    aggs = [F.sum("n").alias("n_total"),
            F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("n_correct")]
    for c in CLASSES:
        aggs += [F.sum(F.when((F.col("y") == c) & (F.col("pred") == c), F.col("n")).otherwise(0)).alias(f"tp{c}"),
                 F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)).alias(f"t{c}"),
                 F.sum(F.when(F.col("pred") == c, F.col("n")).otherwise(0)).alias(f"p{c}")]
    a = conf.groupBy(*cell_cols).agg(*aggs)
    cols = {}
    n = F.col("n_total").cast("double")
    cols["accuracy"] = _div(F.col("n_correct").cast("double"), n)
    P, R, F1, present = {}, {}, {}, {}
    for c in CLASSES:
        tp, t, p = (F.col(f"{x}{c}").cast("double") for x in ("tp", "t", "p"))
        P[c] = _div(tp, p)
        R[c] = _div(tp, t)
        F1[c] = F.when(P[c] + R[c] > 0, 2 * P[c] * R[c] / (P[c] + R[c])).otherwise(F.lit(0.0))
        present[c] = F.when((F.col(f"t{c}") + F.col(f"p{c}")) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    for c in CLASSES:
        cols[f"precision_{LABEL_NAMES[c]}"] = P[c]
    for c in CLASSES:
        cols[f"recall_{LABEL_NAMES[c]}"] = R[c]
    for c in CLASSES:
        cols[f"f1_{LABEL_NAMES[c]}"] = F1[c]
    n_present = sum(present[c] for c in CLASSES)
    for name, m in (("precision", P), ("recall", R), ("f1", F1)):
        cols[f"macro_{name}"] = _div(sum(present[c] * m[c] for c in CLASSES), n_present)
    for name in ("precision", "recall", "f1"):
        cols[f"micro_{name}"] = cols["accuracy"]
    for name, m in (("precision", P), ("recall", R), ("f1", F1)):
        cols[f"weighted_{name}"] = _div(sum(F.col(f"t{c}").cast("double") * m[c] for c in CLASSES), n)
    n_true = sum(F.when(F.col(f"t{c}") > 0, F.lit(1)).otherwise(F.lit(0)) for c in CLASSES)
    n_pred = sum(F.when(F.col(f"p{c}") > 0, F.lit(1)).otherwise(F.lit(0)) for c in CLASSES)
    spec = {c: _div(n - F.col(f"t{c}") - F.col(f"p{c}") + F.col(f"tp{c}"), n - F.col(f"t{c}")) for c in CLASSES}
    auc = sum((R[c] + spec[c]) / 2 for c in CLASSES) / len(CLASSES)
    cols["roc_auc"] = F.when((n_true == 3) & (n_pred == 3), auc)
    return a.select(*cell_cols, F.col("n_total").alias("n"),
                    *[_rounded(cols[m], decimals).alias(m) for m in METRIC_NAMES])


def _rounded(c: Column, decimals: int | None) -> Column:
    return c if decimals is None else F.round(c, decimals)


def evaluate(pred: DataFrame, cell_cols: list[str], y_col: str = "y", pred_col: str = "pred",
             decimals: int | None = None) -> DataFrame:
    """Predictions -> one metrics row per cell."""
    return metrics_from_confusion(confusion(pred, cell_cols, y_col, pred_col), cell_cols, decimals)


def cv_summary(fold_metrics: DataFrame, group_cols: list[str], fold_col: str = "fold",
               decimals: int | None = None) -> DataFrame:
    """Mean and population std over folds, plus the F1 of each fold in order."""
    def r(c):
        return _rounded(c, decimals)
    per_fold = F.sort_array(F.collect_list(F.struct(fold_col, "weighted_f1")))   # one row per fold
    return fold_metrics.groupBy(*group_cols).agg(
        r(F.avg("accuracy")).alias("mean_accuracy"),
        r(F.stddev_pop("accuracy")).alias("std_accuracy"),
        r(F.avg("weighted_precision")).alias("mean_weighted_precision"),
        r(F.avg("weighted_recall")).alias("mean_weighted_recall"),
        r(F.avg("weighted_f1")).alias("mean_weighted_f1"),
        r(F.stddev_pop("weighted_f1")).alias("std_weighted_f1"),
        F.transform(per_fold, lambda s: s["weighted_f1"]).alias("f1_per_fold"),
        F.count(F.lit(1)).alias("n_folds"))
