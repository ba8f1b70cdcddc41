"""Cleaning, label handling and NULL/NaN rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inferna.sources.tables import LABEL_NAMES

# String label -> class id (P5).
LABEL_IDS = {"entailment": 0, "neutral": 1, "contradiction": 2}

TEXT_RENAMES = {"premise": "premise_text", "sentence1": "premise_text",
                "hypothesis": "hypothesis_text", "sentence2": "hypothesis_text"}


def _map_literal(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def label_to_int(label: Column) -> Column:
    """P5 then P1: map names first (fixes D3), then numeric coercion, else -1.

    Whole numbers count in any numeric type ("1.0", 1.0 and 1 are class 1);
    fractions, NaN and ids outside the label map are -1."""
    as_text = F.lower(F.trim(label.cast("string")))
    named = F.try_element_at(_map_literal(LABEL_IDS), as_text)
    number = as_text.try_cast("double")
    numeric = F.when(number.isin(*[float(v) for v in LABEL_IDS.values()]), number.cast("int"))
    return F.coalesce(named, numeric, F.lit(-1)).cast("int")


def label_column(df: DataFrame) -> str:
    """Prefer gold_label, else label."""
    for c in ("gold_label", "label"):
        if c in df.columns:
            return c
    raise ValueError(f"no label column in {df.columns}")


def standardize_columns(df: DataFrame) -> DataFrame:
    """premise/sentence1 -> premise_text, hypothesis/sentence2 -> hypothesis_text."""
    renames = {k: v for k, v in TEXT_RENAMES.items() if k in df.columns and v not in df.columns}
    out = df.withColumnsRenamed(renames) if renames else df
    require_columns(out, ["premise_text", "hypothesis_text"])
    return out


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fail early when a required column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; have {df.columns}")
    return df


def clean_labels(df: DataFrame) -> DataFrame:
    """y = int label (strings mapped by name), rows with y < 0 dropped."""
    lab = label_column(df)
    return df.withColumn("y", label_to_int(F.col(lab))).where(F.col("y") >= 0)


def valid_pairs(df: DataFrame) -> DataFrame:
    """Drop pairs with NULL premise/hypothesis/label or label -1."""
    return df.where(F.col("premise_text").isNotNull() & F.col("hypothesis_text").isNotNull()
                    & F.col("label").isNotNull() & (F.col("label") != -1))


def decode_label(y: Column, unknown: str = "unknown") -> Column:
    """Class id -> name, unknown ids -> ``unknown``."""
    return F.coalesce(F.try_element_at(_map_literal(LABEL_NAMES), y), F.lit(unknown))


def nan_to_zero(c: Column) -> Column:
    """NaN, +-inf and NULL -> 0."""
    return (F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0))
            .otherwise(c))


def fill_feature_nans(df: DataFrame, feature_cols: list[str]) -> DataFrame:
    """length_ratio NaN/+-inf/NULL -> 1.0, every other feature -> 0."""
    exprs = []
    for c in df.columns:
        if c not in feature_cols:
            exprs.append(F.col(c))
        elif c == "length_ratio":
            x = F.col(c)
            exprs.append(F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
                                F.lit(1.0)).otherwise(x).alias(c))
        else:
            exprs.append(nan_to_zero(F.col(c)).alias(c))
    return df.select(*exprs)


def text_guard(text: Column) -> Column:
    """P22 (re-aimed): blank text -> NULL so it yields empty parse trees.

    The reference also cut text to 2000 characters to protect its parser;
    here whole texts are annotated, so no truncation is applied."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit(None)).otherwise(text)


def quality_counts(df: DataFrame, cols: list[str],
                   group_cols: list[str] | None = None) -> DataFrame:
    """NULL count per column and invalid-label count, one pass
    (partial aggregation map-side, so hot groups cost nothing extra)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols]
    if "label" in df.columns:
        aggs.append(F.count_if(F.col("label").isNull() | (F.col("label") < 0)).alias("invalid_label"))
    return df.groupBy(*(group_cols or [])).agg(*aggs)
