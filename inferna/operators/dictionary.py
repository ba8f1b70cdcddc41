"""Sentence dictionary, pair table and the pair/sentence joins.

The dictionary id is md5(text): computed independently on every row, so the
pair table needs no lookup join (J0) and no global ordinal (no single-task
row_number).  Deduplication is a hash aggregate keyed by the id: partial
aggregation map-side collapses repeated (hot) sentences before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sentence_id(text):
    return F.md5(text)


def _blank(c):
    return c.isNull() | (F.trim(c) == "")


def unique_sentences(raw: DataFrame) -> DataFrame:
    """A1: distinct non-blank texts of both sides -> (id, text, role).

    role = 0 when the text occurs as a premise anywhere, 1 when it only
    occurs as a hypothesis (the reference's premise-first ordering, J6)."""
    sides = (raw.select(F.col("premise_text").alias("text"), F.lit(0).alias("role"))
             .unionByName(raw.select(F.col("hypothesis_text").alias("text"), F.lit(1).alias("role"))))
    return (sides.where(~_blank(F.col("text")))
            .groupBy(sentence_id(F.col("text")).alias("id"))
            .agg(F.any_value("text").alias("text"), F.min("role").alias("role")))


def hypothesis_only(raw: DataFrame) -> DataFrame:
    """Hypothesis texts that never occur as a premise (left anti join on id)."""
    hyp = (raw.where(~_blank(F.col("hypothesis_text")))
           .select(sentence_id(F.col("hypothesis_text")).alias("id"),
                   F.col("hypothesis_text").alias("text")))
    prem = (raw.where(~_blank(F.col("premise_text")))
            .select(sentence_id(F.col("premise_text")).alias("id")))
    return hyp.join(prem, "id", "left_anti").dropDuplicates(["id"])


def build_pairs(raw: DataFrame) -> DataFrame:
    """J0 + P8: (id, premise_id, hypothesis_id, label) for valid pairs.

    A pair is kept when both texts have a dictionary id (non-blank) and the
    label is a valid class.  Ids are hashes, so no join is needed."""
    ok = (~_blank(F.col("premise_text")) & ~_blank(F.col("hypothesis_text"))
          & F.col("label").isNotNull() & (F.col("label") >= 0))
    return raw.where(ok).select(
        "id", "dataset", "split",
        sentence_id(F.col("premise_text")).alias("premise_id"),
        sentence_id(F.col("hypothesis_text")).alias("hypothesis_id"),
        "label")


def pair_filter_report(raw: DataFrame) -> DataFrame:
    """P8 report: per (dataset, split) how many pairs are kept / dropped why."""
    null_text = F.col("premise_text").isNull() | F.col("hypothesis_text").isNull()
    no_id = ~null_text & (_blank(F.col("premise_text")) | _blank(F.col("hypothesis_text")))
    bad_label = F.col("label").isNull() | (F.col("label") < 0)
    return raw.groupBy("dataset", "split").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(~null_text & ~no_id & ~bad_label).alias("kept"),
        F.count_if(null_text).alias("dropped_null_text"),
        F.count_if(no_id).alias("dropped_no_id"),
        F.count_if(~null_text & ~no_id & bad_label).alias("dropped_label"))


def join_pair_text(pairs: DataFrame, sentences: DataFrame) -> DataFrame:
    """Pairs ⟕ sentences (premise) ⟕ sentences (hypothesis).

    Two equi joins on the dictionary id.  Both sides shuffle on the id; AQE
    splits a skewed pair partition (a sentence shared by many pairs) and
    broadcasts the dictionary only when its runtime size is small."""
    s = sentences.select("id", "text")
    p = s.withColumnsRenamed({"id": "premise_id", "text": "premise_text"})
    h = s.withColumnsRenamed({"id": "hypothesis_id", "text": "hypothesis_text"})
    return (pairs.join(p, "premise_id", "left")
            .join(h, "hypothesis_id", "left")
            .select(F.col("id").alias("pair_id"), "dataset", "split", "label",
                    F.coalesce("premise_text", F.lit("")).alias("premise_text"),
                    F.coalesce("hypothesis_text", F.lit("")).alias("hypothesis_text"),
                    "premise_id", "hypothesis_id"))


def join_pair_parses(pairs: DataFrame, parses: DataFrame, cols: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs ⟕ per-sentence table (premise) ⟕ (hypothesis) on sentence id.

    ``cols`` of ``parses`` are brought in prefixed premise_ / hypothesis_;
    ``keys``: columns of both that a sentence id belongs to.  The table is
    partitioned by its id before it is renamed for each side, so that Spark may
    let both joins read one exchange."""
    parses = parses.select(*keys, "sentence_id", *cols).repartition(*keys, "sentence_id")
    p = parses.select(*keys, F.col("sentence_id").alias("premise_id"),
                      *[F.col(c).alias(f"premise_{c}") for c in cols])
    h = parses.select(*keys, F.col("sentence_id").alias("hypothesis_id"),
                      *[F.col(c).alias(f"hypothesis_{c}") for c in cols])
    return pairs.join(p, [*keys, "premise_id"], "left").join(h, [*keys, "hypothesis_id"], "left")
