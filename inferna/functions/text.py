"""Column expressions for pair text statistics and word tokenisation.

All are built-in Spark expressions (JVM side, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace class for "split on runs of whitespace" (Unicode separators too).
WS = r"[\s\p{Z}]+"
# Word token of the bag-of-words vectorisers: runs of >= 2 word characters.
WORD2 = r"[\p{L}\p{N}_]{2,}"
# Word token of the rule annotator: runs of >= 1 word character.
WORD1 = r"[\p{L}\p{N}_]+"


def ws_tokens(text: Column) -> Column:
    """lower(text) split on whitespace, empty pieces dropped; NULL -> []."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), WS)
    return F.array_remove(parts, F.lit(""))


def word_tokens(text: Column) -> Column:
    """vectoriser tokens of lower(text): runs of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD2), 0)


def text_stats_cols(premise: Column, hypothesis: Column) -> list[Column]:
    """F1-F5 + P18 fill rules, as doubles.

    premise_length / hypothesis_length: whitespace tokens (F1);
    length_diff = |p - h| (F2); length_ratio = p / h, 1.0 when h = 0 (F3);
    word_overlap_count = |set(p) ∩ set(h)| (F4);
    word_overlap_ratio = Jaccard, 0 when the union is empty (F5).
    """
    pt = ws_tokens(premise)
    ht = ws_tokens(hypothesis)
    p = F.size(pt).cast("double")
    h = F.size(ht).cast("double")
    inter = F.size(F.array_intersect(pt, ht)).cast("double")
    union = F.size(F.array_union(pt, ht)).cast("double")
    return [
        p.alias("premise_length"),
        h.alias("hypothesis_length"),
        F.abs(p - h).alias("length_diff"),
        F.when(h > 0, p / h).otherwise(F.lit(1.0)).alias("length_ratio"),
        inter.alias("word_overlap_count"),
        F.when(union > 0, inter / union).otherwise(F.lit(0.0)).alias("word_overlap_ratio"),
    ]


TEXT_STAT_NAMES = ["premise_length", "hypothesis_length", "length_diff", "length_ratio",
                   "word_overlap_count", "word_overlap_ratio"]


def pair_text(premise: Column, hypothesis: Column) -> Column:
    """Premise + ' ' + hypothesis with NULL -> ''."""
    return F.concat(F.coalesce(premise, F.lit("")), F.lit(" "), F.coalesce(hypothesis, F.lit("")))
