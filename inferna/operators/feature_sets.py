"""Feature families on demand (U8), extractors over stored wide tables (P13) and feature blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inferna.functions import parse as P
from inferna.functions import text as T
from inferna.operators import annotate, dictionary, features

#: "syntactic" stands for both parse families.
FAMILIES = ("lexical", "constituency", "dependency")
DEFAULT_TYPES = ("lexical", "syntactic")


def families(types) -> set[str]:
    """The families that ``types`` name; an unknown or missing name is an error."""
    wanted = {f for t in types for f in (("constituency", "dependency") if t == "syntactic" else (t,))}
    if not wanted or not wanted <= set(FAMILIES):
        raise ValueError(f"feature types are syntactic, {', '.join(FAMILIES)}; got {list(types)}")
    return wanted


def typed_features(raw: DataFrame, types=DEFAULT_TYPES, parses: DataFrame | None = None) -> DataFrame:
    """U8: pair_id, dataset, split, label, the text statistics if wanted, and ``syn`` with the wanted parse features.

    The plan holds the wanted families alone: without parse features nothing is
    annotated or joined and no ``parses`` are read; without text statistics no
    text is carried through the joins; each parse family reads its own tree."""
    wanted = families(types)
    pairs = features.valid_pairs_with_ids(raw)
    stats = T.text_stats_cols(F.col("premise_text"), F.col("hypothesis_text")) if "lexical" in wanted else []
    kept = ["pair_id", "dataset", "split", "label"]
    if wanted == {"lexical"}:
        return pairs.select(*kept, *stats)
    if parses is None:
        parses = annotate.annotate_rules(features.pair_sentences(pairs))
    maps = {"const": "constituency", "dep": "dependency"}
    got = [m for m, family in maps.items() if family in wanted]
    sentence = features.sentence_features(parses).select("sentence_id", *got)
    joined = dictionary.join_pair_parses(pairs.select(*kept, "premise_id", "hypothesis_id", *stats), sentence, got)
    side = {f"{s}_{m}": F.col(f"{s}_{m}") if m in got else P.empty_map() for s in ("premise", "hypothesis") for m in maps}
    syn = P.pair_syntactic(side["premise_const"], side["hypothesis_const"], side["premise_dep"], side["hypothesis_dep"])
    names = T.TEXT_STAT_NAMES if stats else []
    return joined.select(*kept, *names, syn.alias("syn"))


def wide_table(feats: DataFrame, names: list[str]) -> DataFrame:
    """the stored wide form: pair_id, label, the text statistics and a column for each of ``names`` (0 if absent)."""
    a = feats.select("pair_id", "label", *T.TEXT_STAT_NAMES, P.align(F.col("syn"), names).alias("_aligned"))
    return a.select("pair_id", "label", *T.TEXT_STAT_NAMES, *[F.get("_aligned", i).alias(n) for i, n in enumerate(names)])


def manifest(wide: DataFrame, kind: str) -> list[str]:
    """P13 fit: the columns of a stored wide table that an extractor takes: lexical and syntactic in the table's order, combined sorted by name."""
    marks = {"lexical": [P.LEXICAL_MARKS], "syntactic": [P.SYNTACTIC_MARKS], "combined": [P.LEXICAL_MARKS, P.SYNTACTIC_MARKS]}[kind]
    found = [c for c in wide.columns if c not in ("pair_id", "label") and any(P.group_of(c, m) for m in marks)]
    return sorted(found) if kind == "combined" else found


def save_manifest(spark: SparkSession, columns: list[str], path: str) -> None:
    rows = spark.createDataFrame(list(enumerate(columns)), "pos int, feature string")
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def load_manifest(spark: SparkSession, path: str) -> list[str]:
    """One name a feature, so it is bounded as the wide table's schema is."""
    return [r.feature for r in spark.read.parquet(path).orderBy("pos").collect()]


def extract(wide: DataFrame, columns: list[str]) -> DataFrame:
    """pair_id, label and the manifest's columns in its order; columns the table lacks, and nulls, are 0."""
    here = set(wide.columns)
    value = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in here else F.lit(0.0) for c in columns]
    return wide.select("pair_id", "label", *[v.alias(c) for v, c in zip(value, columns)])


def finite_floats(values: Column) -> Column:
    """P20: array of any numbers -> array<float>; null, NaN and infinite entries, and those beyond a float's range, are 0."""
    single = F.transform(values, lambda x: x.cast("float"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.transform(single, lambda x: F.when(bad(x), F.lit(0.0).cast("float")).otherwise(x))


def block_columns(columns: list[str]) -> dict[str, list[str]]:
    """The columns of the four blocks of a wide table by their prefixes, in the table's order."""
    vectors = {s: [c for c in columns if c.startswith(f"{s}_cls_bert_")] for s in ("premise", "hypothesis")}
    out = {f"{s}_parse": [c for c in columns if c.startswith(f"{s}_") and not c.startswith((f"{s}_bert_", f"{s}_cls_bert_"))] for s in vectors}
    return {**out, **{f"{s}_embedding": v for s, v in vectors.items()}}


def pack_blocks(wide: DataFrame) -> DataFrame:
    """pair_id, label and each block that has columns as one array<float>."""
    blocks = {name: cols for name, cols in block_columns([c for c in wide.columns if c not in ("pair_id", "label")]).items() if cols}
    return wide.select("pair_id", "label", *[finite_floats(F.array(*[F.col(f"`{c}`") for c in cols])).alias(name) for name, cols in blocks.items()])
