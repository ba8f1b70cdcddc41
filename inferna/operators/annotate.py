"""U4: annotate each distinct sentence once with a dependency edge list and a
bracketed constituency string.

The default annotator is a deterministic rule tagger: tokens are cut by Spark
(regexp_extract_all) and tagged by Arrow batches (``arrow_maps.rule_trees``), a
narrow projection over the sentence dictionary without a shuffle.
Whole sentences are annotated (no truncation).  A model-based annotator can
be plugged in through ``annotate_with`` (iterator of pandas batches, model
loaded once per task) with the same output schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from inferna.functions import arrow_maps
from inferna.functions.text import WORD1
from inferna.operators.clean import text_guard

EDGE_TYPE = "struct<id:int,text:string,lemma:string,pos:string,head:int,deprel:string>"
PARSE_SCHEMA = f"sentence_id string, constituency string, dependency array<{EDGE_TYPE}>"


TREES = StructType([StructField("constituency", StringType()), StructField("id", ArrayType(IntegerType())), StructField("pos", ArrayType(StringType())),
                    StructField("head", ArrayType(IntegerType())), StructField("deprel", ArrayType(StringType()))])


@F.arrow_udf(TREES)
def _rule_trees(tokens: pa.Array) -> pa.Array:
    return arrow_maps.rule_trees(tokens)


def annotate_rules(sentences: DataFrame, text_col: str = "text", id_col: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """(id, text) -> (sentence_id, constituency, dependency), and the columns ``keep`` as they are.

    Fixed rules: a digit-led token is NUM, one of at most 2 characters ADP, of 3
    DET, of a length divisible by 3 VERB, any other NOUN.  The first VERB (or the
    first token) is the root; DET and ADP hang on the next token, others before
    the root on it, those after it on the token before.  Tokens and lemmas are
    cut here, whole batches of them get their tags, heads and brackets at once."""
    toks = F.regexp_extract_all(F.coalesce(text_guard(F.col(text_col)), F.lit("")), F.lit(WORD1), 0)
    a = sentences.select(F.col(id_col).alias("sentence_id"), *keep, toks.alias("toks"))
    a = a.select("sentence_id", *keep, "toks", _rule_trees("toks").alias("t"))
    edges = F.arrays_zip(F.col("t.id").alias("id"), F.col("toks").alias("text"), F.transform("toks", F.lower).alias("lemma"),
                         F.col("t.pos").alias("pos"), F.col("t.head").alias("head"), F.col("t.deprel").alias("deprel"))
    return a.select("sentence_id", *keep, F.col("t.constituency").alias("constituency"), edges.cast(f"array<{EDGE_TYPE}>").alias("dependency"))


def annotate_with(sentences: DataFrame,
                  make_annotator: Callable[[], Callable[[pd.Series], tuple[list, list]]],
                  text_col: str = "text", id_col: str = "id") -> DataFrame:
    """Pluggable annotator over Arrow batches (mapInPandas).

    ``make_annotator()`` is called once per task (load a model there) and
    returns f(texts) -> (constituency strings, edge lists).  A batch that
    fails is annotated row by row; a failing row gets empty trees and its
    message in ``error`` (null elsewhere)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        annotate = make_annotator()
        for b in batches:
            texts = b[text_col].fillna("")
            try:
                const, deps = annotate(texts)
                error = [None] * len(b)
            except Exception:  # noqa: BLE001 - one bad sentence must not empty its batch
                const, deps, error = [], [], []
                for i in range(len(texts)):
                    try:
                        c, d = annotate(texts.iloc[i:i + 1])
                        row = (c[0], d[0], None)
                    except Exception as e:  # noqa: BLE001
                        row = ("", [], f"{type(e).__name__}: {e}")
                    for out, v in zip((const, deps, error), row):
                        out.append(v)
            yield pd.DataFrame({"sentence_id": b[id_col], "constituency": const,
                                "dependency": deps, "error": error})
    return sentences.select(id_col, text_col).mapInPandas(run, PARSE_SCHEMA + ", error string")
