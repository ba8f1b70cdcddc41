"""Bag-of-words / TF-IDF vectorisers and scalers.

Two forms over the same fitted state:

* relational (long) form — (doc, term/idx, value) rows built from Spark
  expressions, joins and aggregations; exact and checkable by SQL;
* vector form — ``CountVectorizerModel.from_vocabulary`` + ``IDF`` weights
  applied with ``ElementwiseProduct`` + ``Normalizer``, all JVM-side, for the
  Spark ML learners.

Fitted state (vocabulary, idf, scaling statistics) is bounded by the
``max_features`` / feature-list parameters, so it is the only thing that is
collected or broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from inferna.functions.text import word_tokens

# Spark's default English stop-word list (StopWordsRemover),
# used where the reference asks for English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now i'll you'll "
    "he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's "
    "we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't "
    "don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could "
    "here's how's let's ought that's there's what's when's where's who's why's would"
).split()


@dataclass(frozen=True)
class TermSpec:
    max_features: int = 10_000
    bigrams: bool = False
    stop_words: bool = False


def unigrams(text: Column, spec: TermSpec) -> Column:
    """F21 tokens with optional stop-word removal."""
    toks = word_tokens(text)
    if spec.stop_words:
        toks = F.filter(toks, lambda t: ~t.isin(*STOP_WORDS))   # a set, not a list, once planned
    return toks


def with_bigrams(toks: Column) -> Column:
    """(1,2)-grams of a token-array *column* (bigrams after stop removal)."""
    bi = F.when(F.size(toks) >= 2, F.transform(
        F.sequence(F.lit(1), F.size(toks) - 1),
        lambda i: F.concat(F.get(toks, i - 1), F.lit(" "), F.get(toks, i)))
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(toks, bi)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def term_counts(arr: Column) -> Column:
    """term -> count map of a term-array *column* (narrow: no shuffle).

    The terms are sorted once and each run of equal ones is counted by where
    it and the next begin: n log n for a text of n terms."""
    def runs(s):
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                          lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return _let(begins, lambda b: F.transform(b, lambda at, j: F.struct(
            F.get(s, at).alias("term"), (F.coalesce(F.get(b, j + 1), F.size(s)) - at).cast("long").alias("tf"))))
    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.map_from_entries(_let(F.sort_array(arr), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(none)))


def doc_terms(df: DataFrame, id_col: str, text: Column, spec: TermSpec,
              keep: list[str] | None = None) -> DataFrame:
    """(doc, term, tf) long table; one explode, no shuffle.

    Token arrays are projected as columns before any lambda uses them, so
    the regex runs once per document (a lambda re-evaluates an inlined
    expression for every element)."""
    cols = [id_col, *(keep or [])]
    t = df.select(*cols, unigrams(text, spec).alias("_u"))
    if spec.bigrams:
        t = t.select(*cols, with_bigrams(F.col("_u")).alias("_u"))
    # explode_outer: a plain explode makes the optimizer infer size(x) > 0
    # and push it below the projection, re-deriving the whole array there
    out = t.select(*cols, F.explode_outer(term_counts(F.col("_u"))).alias("term", "tf"))
    return out.where(F.col("term").isNotNull())


def fit_vocab(dterms: DataFrame, k: int) -> DataFrame:
    """T4/V2: the k terms with the largest corpus frequency (ties: term).

    Column index = alphabetical rank among the selected terms.  The top-k
    is a TakeOrdered (k rows kept per task), never a full sort; the index
    window runs over those <= k rows only."""
    return top_terms(dterms.groupBy("term").agg(F.sum("tf").alias("tf_total")), k)


def top_terms(totals: DataFrame, k: int) -> DataFrame:
    """``fit_vocab`` from the corpus frequencies (term, tf_total); further columns stay."""
    top = totals.orderBy(F.desc("tf_total"), "term").limit(k)
    return top.withColumn("idx", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))


def fit_idf(dterms: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """V3 fit: idf = ln((1 + n) / (1 + df)) + 1 over the fitting corpus."""
    n = dterms.select(id_col).distinct().count()
    dfreq = dterms.join(F.broadcast(vocab.select("term")), "term").groupBy("term") \
        .agg(F.count(F.lit(1)).alias("df"))
    return (vocab.join(dfreq, "term", "left")
            .select("term", "idx", F.coalesce("df", F.lit(0)).alias("df"),
                    (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + 1.0)
                    .alias("idf")))


def collect_vocab(vocab: DataFrame, k: int) -> list[str]:
    """Vocabulary in index order; bounded by k (checked)."""
    rows = vocab.orderBy("idx").select("term").limit(k + 1).collect()
    if len(rows) > k:
        raise ValueError("vocabulary larger than max_features")
    return [r.term for r in rows]


# ---- scalers over a fixed feature list (V6-V8) ---------------------------

def column_stats(df: DataFrame, arr_col: str, n: int) -> DataFrame:
    """Per-feature mean, population std, min, max of an array<double>
    column: one row, 4 arrays of length n (bounded by the feature list)."""
    aggs = []
    for i in range(n):
        x = F.get(F.col(arr_col), i)
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggs) if aggs else None
    return row


def fit_scaler(df: DataFrame, arr_col: str, n: int) -> dict[str, list[float]]:
    """Fitted scaling statistics (4 x n doubles) collected to the driver."""
    if n == 0:
        return {"mean": [], "std": [], "min": [], "max": []}
    r = column_stats(df, arr_col, n).first()
    g = lambda p: [float(r[f"{p}{i}"] or 0.0) for i in range(n)]
    return {"mean": g("m"), "std": g("s"), "min": g("lo"), "max": g("hi")}


def standard_scale(arr: Column, st: dict[str, list[float]], with_mean: bool = True) -> Column:
    """V6/V7: (x - mean) / pop_std, std 0 -> divide by 1."""
    mean, std = np.array(st["mean"], float), np.array([v if v > 0 else 1.0 for v in st["std"]], float)
    if not with_mean:
        mean = np.zeros(len(std))
    return _by_place(arr, mean, std)


def minmax_scale(arr: Column, st: dict[str, list[float]]) -> Column:
    """V8: (x - min) / (max - min), constant feature -> 0."""
    lo, hi = np.array(st["min"], float), np.array(st["max"], float)
    return _by_place(arr, lo, np.where(hi - lo > 0, hi - lo, np.inf))


def _by_place(arr: Column, shift: np.ndarray, scale: np.ndarray) -> Column:
    """(x - shift) / scale by place in the array, a batch at a time; null where there is neither, 0 where the scale is infinite."""
    @F.arrow_udf(ArrayType(DoubleType()))
    def scaled(rows: pa.Array) -> pa.Array:
        offset = rows.offsets.to_numpy().astype(np.int64)
        x = rows.values.slice(int(offset[0]), int(offset[-1] - offset[0])) if len(rows) else rows.values
        at = np.arange(len(x)) - np.repeat(offset[:-1] - offset[:1], np.diff(offset))
        gone = ~x.is_valid().to_numpy(zero_copy_only=False) | (at >= len(scale))
        at = np.where(gone, 0, at)
        if not len(scale):
            z = np.zeros(len(x))
        else:
            z = (x.fill_null(0.0).to_numpy(zero_copy_only=False) - shift[at]) / scale[at]
            z[np.isinf(scale[at])] = 0.0
        nulls = {"mask": pa.array(~rows.is_valid().to_numpy(zero_copy_only=False))} if rows.null_count else {}
        return pa.ListArray.from_arrays(pa.array((offset - offset[0]).astype(np.int32), pa.int32()), pa.array(z, mask=gone), **nulls)

    return scaled(arr)
