"""The pair feature table (text stats + syntactic map) as one lazy plan.

    raw ─P8─► pairs(texts, ids) ─F1-F5─► stats
     └─A1─► sentences ─U4─► parses ─F6-F14─► sentence maps
    pairs ⟕ sentence maps (premise) ⟕ sentence maps (hypothesis) ─F15/F16─► syn

Parsing happens once per distinct sentence (the expensive step in a real
annotator); the two joins are shuffle joins on the md5 id that AQE may turn
into broadcasts at runtime and splits when one sentence is very frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inferna.functions import parse as P
from inferna.functions import text as T
from inferna.operators import annotate, dictionary


def valid_pairs_with_ids(raw: DataFrame) -> DataFrame:
    """P8 + J0: valid pairs keeping their texts and hash ids (one projection)."""
    ok = raw.where(
        F.col("premise_text").isNotNull() & (F.trim("premise_text") != "")
        & F.col("hypothesis_text").isNotNull() & (F.trim("hypothesis_text") != "")
        & F.col("label").isNotNull() & (F.col("label") >= 0))
    return ok.select(
        F.col("id").alias("pair_id"), "dataset", "split", "label", "premise_text", "hypothesis_text",
        dictionary.sentence_id(F.col("premise_text")).alias("premise_id"),
        dictionary.sentence_id(F.col("hypothesis_text")).alias("hypothesis_id"))


def sentence_features(parses: DataFrame) -> DataFrame:
    """(sentence_id, const map, dep map) from annotated sentences."""
    pos, rel = P.dep_tags(F.col("dependency"))
    staged = parses.select("sentence_id", "constituency", "dependency", pos.alias("_pos"), rel.alias("_rel"))
    return staged.select("sentence_id",
                         P.const_features(F.col("constituency")).alias("const"),
                         P.dep_features(F.col("dependency"), F.col("_pos"), F.col("_rel")).alias("dep"))


def pair_sentences(pairs: DataFrame) -> DataFrame:
    """Distinct sentences of a pair table (both sides), keyed by hash id."""
    # both sides from one scan, and keys alone, so that the aggregation hashes and need not sort
    sides = F.array(*[F.struct(F.col(f"{s}_id").alias("id"), F.col(f"{s}_text").alias("text")) for s in ("premise", "hypothesis")])
    return pairs.select(F.explode(sides).alias("s")).select("s.id", "s.text").distinct()


def pair_features(raw: DataFrame, parses: DataFrame | None = None) -> DataFrame:
    """Feature table: pair_id, dataset, split, label, texts, 6 stats, syn map."""
    return features_of(valid_pairs_with_ids(raw), parses)


def features_of(pairs: DataFrame, parses: DataFrame | None = None) -> DataFrame:
    """The feature table of valid pairs (``valid_pairs_with_ids``)."""
    if parses is None:
        parses = annotate.annotate_rules(pair_sentences(pairs))
    sf = sentence_features(parses)
    return feature_columns(dictionary.join_pair_parses(pairs, sf, ["const", "dep"]))


def feature_columns(joined: DataFrame) -> DataFrame:
    """The columns of the feature table from pairs joined with the sentence maps of both sides."""
    return joined.select(
        "pair_id", "dataset", "split", "label", "premise_text", "hypothesis_text",
        *T.text_stats_cols(F.col("premise_text"), F.col("hypothesis_text")),
        P.pair_syntactic(F.col("premise_const"), F.col("hypothesis_const"),
                         F.col("premise_dep"), F.col("hypothesis_dep")).alias("syn"))


def feature_list(features: DataFrame, col: str = "syn") -> DataFrame:
    """P15 fit: the sorted distinct feature names seen in ``col`` (a small
    DataFrame: its size is bounded by the annotator's tag vocabulary)."""
    return (features.select(F.explode_outer(F.map_keys(col)).alias("feature"))
            .where(F.col("feature").isNotNull()).distinct().orderBy("feature"))


def collect_feature_list(features: DataFrame, col: str = "syn", limit: int = 100_000) -> list[str]:
    """Fitted feature list as a Python list, with a checked size bound."""
    rows = feature_list(features, col).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct features; refusing to collect")
    return [r.feature for r in rows]


def syn_long(features: DataFrame, col: str = "syn") -> DataFrame:
    """F20 long form: (pair_id, feature, value)."""
    out = features.select("pair_id", F.explode_outer(col).alias("feature", "value"))
    return out.where(F.col("feature").isNotNull())


def syn_wide(features: DataFrame, names: list[str], col: str = "syn") -> DataFrame:
    """F20 wide form for a fixed/fitted list: one column per feature, 0 if absent.

    One aligned array then positional columns: a projection, no pivot shuffle."""
    a = features.select("pair_id", P.align(F.col(col), names).alias("_aligned"))
    return a.select("pair_id", *[F.get("_aligned", i).alias(n) for i, n in enumerate(names)])
