"""Near duplicates of documents by weighted MinHash over Poisson processes.

A document is the multiset of its five-word shingles.  Every shingle owns a
random process of points (time, component, weight) that is the same in every
document.  Weights are discretised to whole numbers and split into the levels
[0,1), [1,2), [2,4), [4,8) ...; each level is a Poisson process of its own
with a rate as large as its width, so a document of weight w draws only from the
levels below w, and in the last of them keeps the points whose weight lies
below w.  The least time at each component is the signature; two documents
agree at a component with the probability of their weighted Jaccard similarity.
Points come in order of time, and a process ends as soon as its time exceeds the
largest of the document's least times, so a signature costs about one point a
shingle and a few for each component, not shingles x components.

Signatures are banded; texts with an equal band meet in ``near.classes``, which
tests the exact overlap of the multisets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inferna.llm.common import bounded_broadcast, stage
from inferna.llm.near import classes
from inferna.llm.shingles import compare, counted, mix, parcels, shingles

STEP, LEVEL, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x2545F4914F6CDD1D)


def levels(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, level) for every level that a weight reaches into: level 0 is [0,1), level k is [2^(k-1), 2^k)."""
    many = np.ceil(np.log2(weight)).astype(np.int64) + 1
    row = np.repeat(np.arange(len(weight)), many)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


def signatures(h: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Least time at each of ``m`` components for ``docs`` documents; infinite for documents without shingles."""
    sig = np.full(docs * m, np.inf)
    row, level = levels(weight)
    doc, w = doc[row], weight[row]
    width = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    below = np.where(level > 0, width, 0.0)
    seed = mix(h[row] + level.astype(np.uint64) * LEVEL)
    time, j = np.zeros(len(row)), 0
    while len(seed):
        j += 1
        r = mix(seed + np.uint64(j * int(STEP) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((r >> np.uint64(11)) + 0.5) * 2.0**-53) / (width * m)
        s = mix(r ^ OTHER)
        at = doc * m + (s >> np.uint64(40)).astype(np.int64) % m
        ok = below + np.floor((s & np.uint64(0xFFFFFFFF)) * (width * 2.0**-32)) < w
        np.minimum.at(sig, at[ok], time[ok])
        go = time < sig.reshape(docs, m).max(axis=1)[doc]
        doc, w, width, below, seed, time = doc[go], w[go], width[go], below[go], seed[go], time[go]
    return sig.reshape(docs, m)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, -1)
    key = np.full(bits.shape[:2], OTHER) + np.arange(bands, dtype=np.uint64) * STEP
    for i in range(bits.shape[2]):
        key = mix(key ^ bits[:, :, i]) * STEP
    return key.view(np.int64)


def text_comparison(similarity: float, words: int, weighted: bool = True):
    """Comparison for ``near.classes``: exact (multi)set Jaccard of the pair's texts, and b's shingles beyond a's."""
    def compare_pairs(pairs: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                x, y = batch.column("fa").to_pylist(), batch.column("fb").to_pylist()
                for s, e in parcels([p + q for p, q in zip(x, y)]):
                    size_a, size_b, common, excess, pair = compare(x[s:e], y[s:e], words, weighted)
                    near = (common >= similarity * (size_a + size_b - common) - 1e-9) & (common > 0)
                    cut = np.searchsorted(pair, np.arange(e - s + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("a").slice(s, e - s), batch.column("b").slice(s, e - s), pa.array(near), pa.array(size_a.astype(np.int64)),
                         pa.array(size_b.astype(np.int64)), pa.array(common.astype(np.int64)), pa.ListArray.from_arrays(cut, excess.view(np.int64))],
                        names=["a", "b", "near", "size_a", "size_b", "common", "excess"])
        return pairs.select("a", "b", "fa", "fb").mapInArrow(
            run, "a long, b long, near boolean, size_a long, size_b long, common long, excess array<long>")
    return compare_pairs


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, words: int = 5,
                    bands: int = 32, band_rows: int = 8) -> DataFrame:
    """(key, class_id, class_size, keep) for every row of ``docs``.

    Classes are the components of links between texts whose shingle multisets
    have weighted Jaccard similarity of at least ``similarity``; ``class_id`` is
    the least key of the class and its row is kept.  Equal texts are one entry
    (a 64-bit hash).  Rows with null or wordless text are classes of their own;
    null keys are never grouped and kept; repeated rows share a class.
    """
    m = bands * band_rows
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body"))

    def sign(batches):
        for b in batches:
            texts = [t or "" for t in b.column("body").to_pylist()]
            out = []
            for s, e in parcels(texts):
                h, t, c = counted(*shingles(texts[s:e], words))
                sig = signatures(h, t, c, e - s, m)
                keys, some = band_keys(sig, bands), np.isfinite(sig[:, 0])
                out += [k.tolist() if ok else None for k, ok in zip(keys, some)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("entry"), pa.array(out, pa.list_(pa.int64()))], names=["id", "entry", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    signed = stage(rows.select("id", F.xxhash64("body").alias("entry"), "body")
                   .mapInArrow(sign, f"id {kind}, entry long, bands array<long>"), "bag-signatures")
    member = signed.where("bands is not null and id is not null").select("id", "entry", "bands")
    entries = member.groupBy("entry").agg(F.first("bands").alias("bands"))
    buckets = entries.select(F.col("entry").alias("id"), F.explode_outer("bands").alias("bucket"))
    def texts(ids: DataFrame) -> DataFrame:
        """The text of each wanted entry, from the row with its least key."""
        first = stage(member.select("id", "entry").join(ids.withColumnRenamed("id", "entry"), "entry")
                      .groupBy("entry").agg(F.min("id").alias("id")), "bag-first")
        return (rows.withColumn("entry", F.xxhash64("body")).join(bounded_broadcast(first, first.count(), 16), ["id", "entry"])
                .select(F.col("entry").alias("id"), F.col("body").alias("f")).dropDuplicates(["id"]))

    label = classes(buckets, texts, text_comparison(similarity, words), similarity)
    of = member.select("id", "entry").join(label.withColumnRenamed("id", "entry"), "entry", "left") \
        .select("id", "entry", F.coalesce("label", "entry").alias("label"))
    # a table of its own: a join straight from an aggregation would not be split for a hot class
    size = stage(of.groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size")), "bag-classes")
    grouped = of.join(size, "label").select("id", "class_id", "class_size")
    alone = signed.where("bands is null or id is null").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return grouped.unionByName(alone).select(F.col("id").alias(key), "class_id", "class_size",
                                             F.col("id").eqNullSafe(F.col("class_id")).alias("keep"))
