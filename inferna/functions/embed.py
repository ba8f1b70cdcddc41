"""Embedding pair features (F19) and feature-block packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_DIMS = 10   # fixed value: the dimensions of each side that the published feature table holds


def _d(a: Column) -> Column:
    return F.transform(a, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))


def embedding_pair_blocks(p: Column, h: Column) -> dict[str, Column]:
    """The four blocks over the whole vectors, as arrays; missing / NaN -> 0."""
    def clean(a):
        return F.transform(_d(a), lambda x: F.when(F.isnan(x), F.lit(0.0)).otherwise(x))

    def zero(x):
        return F.coalesce(x, F.lit(0.0))
    ps, hs = clean(p), clean(h)
    return {"premise_cls_bert": ps, "hypothesis_cls_bert": hs,
            "diff_bert": F.zip_with(ps, hs, lambda a, b: zero(a) - zero(b)),
            "prod_bert": F.zip_with(ps, hs, lambda a, b: zero(a) * zero(b))}


def embedding_pair_cols(p: Column, h: Column, n: int) -> list[Column]:
    """One column for each of the first ``n`` dimensions: premise_cls_bert_j, hypothesis_cls_bert_j, diff_bert_j = p - h,
    prod_bert_j = p * h for j < n; missing / NaN -> 0 (P18)."""
    ps = F.slice(_d(p), 1, n)
    hs = F.slice(_d(h), 1, n)
    diff = F.zip_with(ps, hs, lambda a, b: a - b)
    prod = F.zip_with(ps, hs, lambda a, b: a * b)

    def fix(x):
        return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)
    cols = []
    for name, arr in (("premise_cls_bert", ps), ("hypothesis_cls_bert", hs), ("diff_bert", diff),
                      ("prod_bert", prod)):
        cols += [fix(F.get(arr, j)).alias(f"{name}_{j}") for j in range(n)]
    return cols


def positional_checksum(arr: Column) -> Column:
    """sum_i (i + 1) * x_i of an array<double> — compact check of a block."""
    return F.aggregate(F.transform(arr, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)


def encode_with(sentences: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
                text_col: str = "text", id_col: str = "id", batch: int = 64) -> DataFrame:
    """(id, text) -> (sentence_id, embedding array<float>) by a pluggable encoder.

    ``make_encoder()`` runs once per task (load the model there) and returns
    f(texts) -> matrix; texts reach it ``batch`` at a time, NULL as empty."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for b in batches:
            for s in range(0, len(b), batch):
                part = b.iloc[s:s + batch]
                rows = encode(part[text_col].fillna("").tolist())
                yield pd.DataFrame({"sentence_id": part[id_col].to_numpy(), "embedding": [np.asarray(r, np.float32) for r in rows]})

    kind = sentences.schema[id_col].dataType.simpleString()
    return sentences.select(id_col, text_col).mapInPandas(run, f"sentence_id {kind}, embedding array<float>")


def letter_encoder() -> Callable[[list[str]], np.ndarray]:
    """A plain encoder without a model file: how often each of a-z occurs."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return lambda texts: np.array([[t.count(c) for c in letters] for t in texts], dtype=np.float32)
