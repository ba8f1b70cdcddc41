"""Sources: the driver tables and the sentence-pair views built from them.

Every view is a lazy DataFrame over the parquet scans, so Catalyst prunes
columns and pushes filters into the scan.  Nothing here collects rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inferna.operators.partitioning import spread

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# The label ids and names of the three classes
# (0 = entailment, 1 = neutral, 2 = contradiction), see SURVEY D2.
LABEL_NAMES = {0: "entailment", 1: "neutral", 2: "contradiction"}

# Logical split name -> stored split name (S2).  'dev' is the
# reference's name for the validation split.
SPLIT_ALIASES = {"train": "train", "dev": "validation", "validation": "validation",
                 "val": "validation", "test": "test"}

# Sentence boundary used to cut documents into sentences.
SENTENCE_SPLIT = r"[.!?]\s+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def split_of(doc_id: Column) -> Column:
    """Deterministic 80/10/10 split assignment of a source row."""
    m = F.pmod(doc_id, F.lit(10))
    return (F.when(m < 8, F.lit("train"))
            .when(m == 8, F.lit("validation"))
            .otherwise(F.lit("test")))


def label_of(quality: Column, toxic: Column) -> Column:
    return (F.when(toxic == 1, F.lit(2))
            .when(quality == 1, F.lit(0))
            .when(quality == 0, F.lit(1))
            .otherwise(F.lit(-1))).cast("int")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⟕ labels on doc_id (equi join; AQE broadcasts labels when
    its runtime size is under the threshold, otherwise sort-merge)."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left")


def nli_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence pairs of every document, over the whole text.

    Each document is cut into sentences; every sentence i is paired with
    sentence i+1 (premise, hypothesis).  A one-sentence document yields one
    pair with a NULL hypothesis.  dataset = language, split from doc_id,
    round = doc_id % 3 + 1, label from ``labels`` (toxic -> 2, quality 1 -> 0,
    quality 0 -> 1, unlabelled -> -1).  Purely narrow after the label join.
    """
    return pairs_from_documents(labelled_documents(spark, sf_dir))


def pairs_from_documents(d: DataFrame) -> DataFrame:
    """documents (doc_id, text, lang, quality, toxic) -> sentence pairs.

    A projection + explode only, so it also runs on a streaming frame."""
    # a projection of its own: inside the explode the text would be cut at each mention
    d = d.select("doc_id", "lang", "quality", "toxic", F.split(F.col("text"), SENTENCE_SPLIT).alias("_sents"))
    sents = F.col("_sents")
    # (s[i], s[i+1]) pairs built inside the row, so an exploded row carries
    # only its own two sentences (not the document's whole sentence array)
    pairs = F.arrays_zip(sents.alias("p"), F.slice(sents, 2, F.greatest(F.size(sents) - 1, F.lit(1))).alias("h"))
    pairs = F.slice(pairs, 1, F.greatest(F.size(sents) - 1, F.lit(1)))
    exploded = d.select(
        "doc_id",
        F.col("lang").alias("dataset"),
        split_of(F.col("doc_id")).alias("split"),
        (F.pmod(F.col("doc_id"), F.lit(3)) + 1).cast("int").alias("round"),
        label_of(F.col("quality"), F.col("toxic")).alias("label"),
        F.posexplode_outer(pairs).alias("pos", "ph"),
    ).where(F.col("pos").isNotNull())
    return exploded.select(
        F.concat_ws("_", "dataset", "split", F.col("doc_id").cast("string"),
                    F.col("pos").cast("string")).alias("id"),
        "dataset", "split", "round", F.col("ph.p").alias("premise_text"),
        F.col("ph.h").alias("hypothesis_text"), "label")


def nli_raw_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant with string labels (for the P5 string map)."""
    names = F.create_map(*[x for k, v in LABEL_NAMES.items() for x in (F.lit(k), F.lit(v))])
    raw = nli_raw(spark, sf_dir)
    return raw.withColumn("label", F.coalesce(F.try_element_at(names, F.col("label")), F.lit("-")))


def nli_raw_s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant with the alternative column names sentence1 / sentence2."""
    return nli_raw(spark, sf_dir).withColumnsRenamed(
        {"premise_text": "sentence1", "hypothesis_text": "sentence2"})


def conv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent conversation turns as unlabelled pairs: turn t ⋈ turn t+1.

    Equi join on (conv_id, turn) — both sides shuffle on conv_id; no
    conversation is gathered into one task.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    a = c.alias("a")
    b = c.alias("b")
    return (a.join(b, (F.col("a.conv_id") == F.col("b.conv_id"))
                   & (F.col("b.turn") == F.col("a.turn") + 1))
            .select(F.concat_ws("_", F.lit("c"), F.col("a.conv_id").cast("string"),
                                F.col("a.turn").cast("string")).alias("id"),
                    F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"),
                    F.col("a.text").alias("premise_text"),
                    F.col("b.text").alias("hypothesis_text")))


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vec_id ⋈ vec_id + 1 as (premise, hypothesis) vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    a = e.alias("a")
    b = e.alias("b")
    return (a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
            .select(F.col("a.vec_id").alias("pair_id"),
                    F.col("a.embedding").alias("premise_emb"),
                    F.col("b.embedding").alias("hypothesis_emb"),
                    F.col("a.label").alias("label")))


def resolve_split(split: str) -> str:
    return SPLIT_ALIASES.get(split, split)


def load_splits(raw: DataFrame, dataset: str | None = None,
                split: str | None = None) -> DataFrame:
    """One split or all splits of one or all datasets (pruning filter)."""
    out = raw
    if dataset is not None:
        out = out.where(F.col("dataset") == dataset)
    if split is not None:
        out = out.where(F.col("split") == resolve_split(split))
    return out


def union_pieces(pieces: list[DataFrame], tag_col: str, tags: list[str]) -> DataFrame:
    """Union-all of separately stored pieces, tagging each with its name;
    columns are matched by name and missing ones become NULL."""
    out = None
    for piece, tag in zip(pieces, tags):
        p = piece.withColumn(tag_col, F.lit(tag))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def round_union(raw: DataFrame) -> DataFrame:
    """S3: the three rounds of a corpus as one frame with a round tag.

    Our source holds all rounds in one scan, so the tag is one projection
    (a single pass) instead of three filtered scans.  Ids carry the dataset,
    split and source key, so they stay unique across rounds (fixes D1)."""
    return raw.withColumn("anli_round", F.concat(F.lit("r"), F.col("round").cast("string")))
