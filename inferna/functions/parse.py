"""Parse-tree features as Spark map expressions.

Per sentence: a constituency map and a dependency map (string -> double).
Per pair: prefixed side maps plus |p - h| over the union of keys.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, MapType, StringType

from inferna.functions import arrow_maps

FEATURES = MapType(StringType(), DoubleType())

# Phrase labels counted in constituency strings.
PHRASES = ["NP", "VP", "PP", "ADJP", "ADVP", "S", "SBAR", "SBARQ", "SINV", "SQ"]


def empty_map() -> Column:
    return F.create_map().cast("map<string,double>")


def count_literal(s: Column, needle: str) -> Column:
    """Occurrences of a literal substring (no regex)."""
    # bytes: their number is known, that of characters is counted anew each time
    return ((F.octet_length(s) - F.octet_length(F.replace(s, F.lit(needle), F.lit("")))) / len(needle.encode())).cast("double")


def const_features(tree: Column) -> Column:
    """tree_depth = count('(') - count(')') (kept as defined, D13)
    and count_X = occurrences of '(X '; blank or NULL tree -> no keys."""
    kv = [F.lit("tree_depth"), count_literal(tree, "(") - count_literal(tree, ")")]
    for p in PHRASES:
        kv += [F.lit(f"count_{p}"), count_literal(tree, f"({p} ")]
    return F.when(tree.isNull() | (F.trim(tree) == ""), empty_map()).otherwise(F.create_map(*kv))


def max_depth(tree: Column) -> Column:
    """True nesting depth of a bracketed tree (D13): the largest number of open
    brackets at any place; 0 for blank or NULL."""
    steps = F.transform(F.regexp_extract_all(F.coalesce(tree, F.lit("")), F.lit("[()]"), 0),
                        lambda b: F.when(b == "(", F.lit(1)).otherwise(F.lit(-1)))
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))
    return F.aggregate(steps, start, lambda s, d: F.struct(
        (s["open"] + d).alias("open"), F.greatest(s["most"], s["open"] + d).alias("most")), lambda s: s["most"])


def dep_tags(edges: Column) -> tuple[Column, Column]:
    """POS and relation arrays of an edge list (a missing one is null)."""
    return edges["pos"], edges["deprel"]


@F.arrow_udf(FEATURES)
def tag_counts_with_tree_depth_proxy(ids: pa.Array, heads: pa.Array, pos: pa.Array, rel: pa.Array) -> pa.Array:
    return arrow_maps.dep_map(ids, heads, pos, rel)


def dep_features(edges: Column, pos: Column | None = None, rel: Column | None = None) -> Column:
    """F9-F14/F17 over an array<struct<id,pos,head,deprel,...>>.

    pos_TAG / deprel_REL counts (missing -> UNK_POS / UNK_DEP); dep_tree_depth_proxy = max head (>= 0);
    avg/max of |id - head| over edges with id > 0 and head > 0 (avg divides
    by edges - roots, 0 when that is 0); root_children_count = heads = 0.
    NULL edge list (sentence never annotated) -> no keys.  ``pos`` / ``rel``:
    already-projected columns (see ``dep_tags``)."""
    if pos is None or rel is None:
        pos, rel = dep_tags(edges)
    return tag_counts_with_tree_depth_proxy(edges["id"].cast("array<int>"), edges["head"].cast("array<int>"), pos, rel)


@F.arrow_udf(FEATURES)
def _pair_map(pc: pa.Array, hc: pa.Array, pd: pa.Array, hd: pa.Array) -> pa.Array:
    return arrow_maps.pair_map(pc, hc, pd, hd)


def pair_syntactic(pc: Column, hc: Column, pd: Column, hd: Column) -> Column:
    """premise_const_*, hypothesis_const_*, premise_dep_*,
    hypothesis_dep_*, diff_const_*, diff_dep_* in one map<string,double>."""
    return _pair_map(pc, hc, pd, hd)


def align(m: Column, feature_list: list[str]) -> Column:
    """Map -> array<double> in the fitted feature order, missing -> 0.

    Rows are set out by batches: each entry of the map is looked up once."""
    names = list(dict.fromkeys(feature_list))
    if not names:
        return F.array().cast("array<double>")
    at = {k: i for i, k in enumerate(names)}
    columns = None if len(names) == len(feature_list) else [at[k] for k in feature_list]

    @F.arrow_udf(ArrayType(DoubleType()))
    def aligned(maps: pa.Array) -> pa.Array:
        rows = arrow_maps.dense(maps, names)
        return arrow_maps.as_lists(rows if columns is None else rows[:, columns])

    return aligned(m)


# Name fragments that select feature groups.
SYNTACTIC_MARKS = ["_const_", "_dep_", "diff_const_", "diff_dep_", "deprel_", "pos_"]
LEXICAL_MARKS = ["_bert_", "_length", "length_", "overlap", "_tfidf_", "_bow_"]
DEPENDENCY_MARKS = ["_dep_", "deprel_"]
CONSTITUENCY_MARKS = ["_const_"]


def in_group(name: Column, marks: list[str]) -> Column:
    cond = F.lit(False)
    for m in marks:
        cond = cond | F.contains(name, F.lit(m))
    return cond


def group_of(name: str, marks: list[str]) -> bool:
    return any(m in name for m in marks)
