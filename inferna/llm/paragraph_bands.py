"""Substring dedup by banded MinHash over paragraphs.

Paragraphs are of two kinds.  A line of at least ``span + window - 1`` words is
one.  And in every text, lines regardless, the text itself chooses runs of
``span`` words: of each ``window`` neighbouring places the one whose next three
words hash least begins a run (a text of fewer words is one run).  Equal
passages therefore give equal runs whatever surrounds them, inside a line or over
its end, and two texts that share ``span + window - 1`` words in a row always
share a run.

Beside them every place of every text is looked at (``repeated_runs``): the run of
``span`` words from each place meets all others by the least of its shingle hashes,
a MinHash of one row, which runs with equal shingle sets surely share.  Only places
whose least hash lies in several documents go on.  ``repeated_passages`` puts both
together, with near lines and short texts from the bands and runs from every place.

The set of five-word shingles of a paragraph gets a MinHash signature.  Lines, and
texts shorter than a run, are cut into bands chosen for high recall: twelve of
four rows find a pair of similarity 0.8 with probability 0.998.  A run of twelve
words has eight shingles, so two runs are only then 0.8 similar if their sets are
equal: one band of eight rows, that lines have too, finds all of those.  Distinct
paragraphs with an equal band are tested for their exact Jaccard similarity by
``near.classes``, and the components of the links are the classes.  A class that
lies in several documents stays in the first of them (least key); its paragraphs
in the others are removals.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inferna.llm.bag_minhash import OTHER, STEP, text_comparison
from inferna.llm.common import bounded_broadcast, stage
from inferna.llm.near import classes
from inferna.llm.shingles import WORD_FACTORS, mix, parcels, ranges, word_hashes

#: Words as ``word_hashes`` parts them.
WORD = re.compile(r"[^\x00-\x20]+")
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def grams(h: np.ndarray, left: np.ndarray, words: int) -> np.ndarray:
    """Hash of the ``words`` words from each place, or of those left in its text."""
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    total = np.zeros(len(h), np.uint64)
    for j in range(words):
        total += np.where(left > j, padded[j:j + len(h)] * WORD_FACTORS[j], np.uint64(0))
    return mix(total)


def run_starts(h: np.ndarray, first: np.ndarray, span: int, window: int) -> np.ndarray:
    """Places where the chosen runs of all texts begin.

    In a stretch of one repeated word only its beginning is a candidate, as all
    its runs are alike.
    """
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
    value = grams(h, left, 3)
    again = np.zeros(len(h), bool)
    again[1:] = value[1:] == value[:-1]
    value[again] = NEVER
    out = []
    for s, e in zip(first[:-1], first[1:]):
        if s == e:
            continue
        v = value[s:max(s + 1, e - span + 1)]
        if len(v) <= window:
            out.append(s + np.array([np.argmin(v)]))
            continue
        w = np.lib.stride_tricks.sliding_window_view(v, window)
        for at in range(0, len(w), 1 << 16):   # by blocks: a text can be very long
            low = np.unique(w[at:at + (1 << 16)].argmin(axis=1) + np.arange(at, min(at + (1 << 16), len(w))))
            out.append(s + low[v[low] != NEVER])
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)


def entry_hashes(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit hash of the words, in order, of each stretch of ``n`` words from ``start``."""
    cut = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(cut, n)
    part = h[np.repeat(start, n) + place] * (mix(place.astype(np.uint64) + OTHER) | np.uint64(1))
    return mix(np.add.reduceat(part, cut) + n.astype(np.uint64))


def band_signatures(shingle: np.ndarray, start: np.ndarray, n: np.ndarray, words: int, bands: int, band_rows: int,
                    seed: int = 11) -> np.ndarray:
    """Band keys of each stretch; ``shingle`` is the hash of the shingle at each place."""
    ends = np.stack([start, start + np.maximum(n - words + 1, 1)], axis=1).ravel()
    draw = np.random.default_rng(seed).integers(1, 2**62, (bands * band_rows, 2), dtype=np.uint64)
    keys = np.empty((len(start), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(start), mix(np.full(1, b + 1, np.uint64))[0])
        for r in range(band_rows):
            a, c = draw[b * band_rows + r]
            x = shingle * (a | np.uint64(1)) + c
            x ^= x >> np.uint64(32)
            least = np.minimum.reduceat(np.append(x * OTHER, NEVER), ends)[::2]
            key = mix(key ^ least) * STEP
        keys[:, b] = key
    return keys.view(np.int64)


def stretches(texts: list[str], span: int, window: int, chosen: bool = True):
    """(word hashes, first word of each text, (start, length) of every run, (start, length) of every long line).

    Without ``chosen`` the only runs are whole texts shorter than one."""
    lines = [t.split("\n") for t in texts]
    h, line_first = word_hashes([x for t in lines for x in t])
    first = line_first[np.concatenate([[0], np.cumsum([len(t) for t in lines])])]
    brief = first[:-1][(np.diff(first) > 0) & (np.diff(first) < span)]
    start = run_starts(h, first, span, window) if chosen else brief
    n = np.minimum(span, first[np.searchsorted(first, start, "right")] - start)
    size = np.diff(line_first)
    long = size >= span + window - 1
    return h, first, (start, n), (line_first[:-1][long], size[long])


def paragraphs(docs: DataFrame, key: str, text: str, words: int, span: int, window: int,
               bands: int, band_rows: int, run_rows: int, chosen: bool = True) -> DataFrame:
    """(id, at, n, entry, bands) for every paragraph of every row; ``at`` is its first word's number."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body")).where("body is not null and id is not null")
    kind = rows.schema["id"].dataType.simpleString()

    def sign(batches):
        for b in batches:
            for s, texts in portions(b.column("body"), 2 << 20):
                h, first, runs, lines = stretches(texts, span, window, chosen)
                left = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
                shingle = grams(h, left, words)
                short = runs[1] < span
                lines = tuple(np.concatenate([x, y[short]]) for x, y in zip(lines, runs))
                runs = tuple(y[~short] for y in runs)
                for (start, n), many in ((runs, 0), (lines, bands)):
                    if len(start) == 0:
                        continue
                    of = np.searchsorted(first, start, "right") - 1
                    keys = band_signatures(shingle, start, n, words, 1, run_rows, seed=12)
                    if many:
                        keys = np.concatenate([keys, band_signatures(shingle, start, n, words, many, band_rows)], axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id").take(pa.array(s + of)), pa.array((start - first[of]).astype(np.int32)), pa.array(n.astype(np.int32)),
                         pa.array(entry_hashes(h, start, n).view(np.int64)),
                         pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.ravel())],
                        names=["id", "at", "n", "entry", "bands"])

    return rows.mapInArrow(sign, f"id {kind}, at int, n int, entry long, bands array<long>")


def repeated_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, words: int = 5,
                        span: int = 12, window: int = 39, bands: int = 12, band_rows: int = 4,
                        run_rows: int = 8, chosen: bool = True) -> DataFrame:
    """(key, first_word, n_words, class_id, class_doc, class_size, removed): every paragraph whose class lies in several documents.

    ``first_word`` is the number of its first word in the text, from 0;
    ``class_doc`` is the class's least key, whose paragraphs are not removed.
    Paragraphs equal word for word are one entry (64-bit hash; case and spacing
    do not count), so ties need no order.  A run and a line or short text surely
    meet only if their shingle sets are equal.  Null and empty texts, texts without
    words and null keys have no paragraphs; rows of one key are one document, so
    repeated rows alone repeat nothing; empty tables give no rows; other columns
    are not read, whatever their names; very long texts are read whole.  Without
    ``chosen`` there are no runs, for ``repeated_runs`` looks at every place.
    """
    paras = stage(paragraphs(docs, key, text, words, span, window, bands, band_rows, run_rows, chosen), "para-signatures")
    entries = paras.groupBy("entry").agg(F.first("bands").alias("bands"))
    buckets = entries.select(F.col("entry").alias("id"), F.explode_outer("bands").alias("bucket"))
    label = classes(buckets, lambda ids: _texts(docs, key, text, paras, ids), text_comparison(similarity, words, weighted=False), similarity,
                    merge=True)
    return _members(paras, label, key)


def _texts(docs: DataFrame, key: str, text: str, paras: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, f): the words of each wanted entry, from its first occurrence."""
    # the least of each entry first: a hot entry never meets the join as rows
    first = (paras.groupBy("entry").agg(F.min(F.struct("id", "at", "n")).alias("w"))
             .join(ids.withColumnRenamed("id", "entry"), "entry"))
    wanted = stage(first.groupBy("w.id").agg(F.collect_list(F.struct("w.at", "w.n", "entry")).alias("wanted")), "para-first")
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body")).where("body is not null").join(wanted, "id")

    def cut(batches):
        for b in batches:
            for first, texts in portions(b.column("body")):
                ids, out = [], []
                for body, want in zip(texts, b.column("wanted").slice(first, len(texts)).to_pylist()):
                    found = WORD.findall(body)
                    for w in want:
                        ids.append(w["entry"])
                        out.append(" ".join(found[w["at"]:w["at"] + w["n"]]))
                for s, e in parcels(out):   # rows that share a key may differ in text: only equal words count
                    h, at = word_hashes(out[s:e])
                    n = np.diff(at)
                    some = np.flatnonzero(n)
                    same = np.zeros(e - s, bool)
                    if len(some):
                        same[some] = entry_hashes(h, at[:-1][some], n[some]).view(np.int64) == np.array(ids[s:e], np.int64)[some]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s:e], pa.int64()), pa.array(out[s:e], pa.string())], names=["id", "f"]).filter(pa.array(same))

    return rows.select("body", "wanted").mapInArrow(cut, "id long, f string").dropDuplicates(["id"])


def _members(paras: DataFrame, label: DataFrame, key: str) -> DataFrame:
    of = paras.select("id", "at", "n", "entry").distinct().join(label.withColumnRenamed("id", "entry"), "entry", "left") \
        .select("id", "at", "n", F.coalesce("label", "entry").alias("class_id"))
    # a table of its own: a join straight from an aggregation would not be split for a hot class
    many = stage(of.groupBy("class_id").agg(F.count("*").alias("class_size"), F.min("id").alias("first"), F.max("id").alias("last"))
                 .where("first <> last").drop("last"), "para-classes")
    return of.join(many, "class_id").select(
        F.col("id").alias(key), F.col("at").alias("first_word"), F.col("n").alias("n_words"), "class_id",
        F.col("first").alias("class_doc"), "class_size", (F.col("id") != F.col("first")).alias("removed"))


def run_sets(texts: list[str], words: int, span: int):
    """(place of every run of ``span`` words, its text, its place there, least hash of its shingles, key of its shingle set)."""
    h, first = word_hashes(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    left = first[1:][of] - np.arange(len(h))
    many = span - words + 1   # shingles of a run
    value = np.concatenate([grams(h, left, words), np.full(many, NEVER)])
    low, part = value[:len(h)], mix(value + OTHER)
    total = part[:len(h)].copy()
    again = np.zeros(len(value), np.int64)   # how far back the shingle stood last
    for d in range(many - 1, 0, -1):
        low = np.minimum(low, value[d:d + len(h)])
        total += part[d:d + len(h)]
        again[d:][value[d:] == value[:-d]] = d
    # a shingle that stands in its run before counts once
    twice = np.flatnonzero(again[:len(h)])
    extra = np.zeros(len(h) + 1, np.uint64)
    np.add.at(extra, np.maximum(twice - many + 1, 0), part[twice])
    np.subtract.at(extra, twice - again[twice] + 1, part[twice])
    place = np.flatnonzero(left >= span)
    return of[place], place - first[:-1][of[place]], low[place], mix(total - np.cumsum(extra)[:-1])[place]


def portions(column: pa.Array, limit: int = 1 << 20):
    """(first row, texts) of neighbouring rows of about ``limit`` bytes: only they are Python strings at a time."""
    for s, e in ranges(pc.binary_length(column).to_pylist(), limit):
        yield s, column.slice(s, e - s).to_pylist()


def gathered(parts, least: int = 1 << 20):
    """The parts (equally many arrays each) joined end to end, by ``least`` rows or somewhat more."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= least:
            yield [np.concatenate(x) for x in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*held)]


def dense(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each key among the different ones, a row of each rank)."""
    rank = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64) - 1
    return rank, np.unique(rank, return_index=True)[1]


def blobs(bucket: np.ndarray, ids: pa.Array, **columns: np.ndarray) -> pa.RecordBatch:
    """One row a bucket, with the entries of the bucket as lists."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1 if len(bucket) == 0 else bucket[0] - 1))
    ends = pa.array(np.append(cut, len(bucket)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cut], pa.int64()), pa.ListArray.from_arrays(ends, ids.take(pa.array(order)))]
        + [pa.ListArray.from_arrays(ends, pa.array(c[order])) for c in columns.values()], names=["bucket", "ids", *columns])


def flat(column) -> pa.Array:
    """The entries of a column of lists, in one array."""
    return pa.chunked_array(column.chunks, column.type).combine_chunks().flatten()


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any of the columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def recurring_least(rows: DataFrame, kind: str, words: int, span: int, buckets: int) -> DataFrame:
    """(id, least): the least shingle hashes of each document's runs that several documents share."""
    def lows(body):
        for s, texts in portions(body):
            of, _, low, _ = run_sets(texts, words, span)
            new = heads(of, low)
            yield s + of[new], low[new]

    def least(batches):
        for b in batches:
            ids = b.column("id")
            rank, row = dense(ids)
            for of, low in gathered(lows(b.column("body"))):
                of = rank[of]
                order = np.lexsort((of, low))
                of, low = of[order], low[order]
                new = heads(of, low)
                of, low = of[new], low[new]
                # of many documents here the first and the last are told the others; those between already recur
                new = heads(low)
                known = ~new & ~np.append(new[1:], True)
                bucket = (mix(low) % np.uint64(buckets)).astype(np.int64)
                yield blobs(np.where(known, -1 - bucket, bucket), ids.take(pa.array(row[of])), least=low.view(np.int64))

    def share(table):
        ids, low = flat(table.column("ids")), flat(table.column("least")).to_numpy()
        if table.column("bucket")[0].as_py() < 0:
            return pa.table([ids, pa.array(low)], names=["id", "least"])
        rank, row = dense(ids)
        order = np.lexsort((rank, low))
        rank, low = rank[order], low[order]
        new = heads(rank, low)
        rank, low = rank[new], low[new]
        start = np.flatnonzero(heads(low))
        n = np.diff(np.append(start, len(low)))
        several = np.repeat(n > 1, n)
        return pa.table([ids.take(pa.array(row[rank[several]])), pa.array(low[several])], names=["id", "least"])

    return rows.mapInArrow(least, f"bucket long, ids array<{kind}>, least array<long>").groupBy("bucket").applyInArrow(share, f"id {kind}, least long")


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, span: int = 12, most: int = 200_000) -> DataFrame:
    """Rows as of ``repeated_paragraphs`` for the runs of ``span`` words at every place of every text.

    A class are the runs of equal shingle sets (64-bit keys) and counts if it lies
    in several documents.  Neighbouring runs of a document become one row while
    their classes' first occurrences are neighbours too, in one document, and their
    sizes are equal: ``class_id`` is then the class of the first run, ``n_words``
    the whole stretch.  Runs meet in buckets by their least shingle hash; those of
    hashes that more than ``most`` documents share meet row by row instead.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body")).where("body is not null and id is not null")
    kind = rows.schema["id"].dataType.simpleString()
    # about 4 MB of text a bucket, which one task takes whole
    buckets = max(256, (rows.agg(F.sum(F.length("body"))).first()[0] or 0) >> 22)
    shared = stage(recurring_least(rows, kind, words, span, buckets), "run-least")
    hot = stage(shared.groupBy("least").agg(F.count("*").alias("n")).where(F.col("n") > most).select("least"), "run-hot")
    n_hot = hot.count()
    marked = shared.withColumn("hot", F.lit(False))
    if n_hot:
        marked = shared.join(bounded_broadcast(hot.withColumn("hot", F.lit(True)), n_hot, 16), "least", "left").select("id", "least", F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = stage(marked.groupBy("id").agg(F.collect_set(F.when(~F.col("hot"), F.col("least"))).alias("few"),
                                            F.collect_set(F.when(F.col("hot"), F.col("least"))).alias("many")), "run-wanted")

    def shared_places(body, want):
        for s, texts in portions(body):
            of, at, low, entry = run_sets(texts, words, span)
            # a shared hash is shared by every document that has it
            use = np.isin(low.view(np.int64), want.slice(s, len(texts)).flatten().to_numpy())
            yield s + of[use], at[use].astype(np.int32), low[use], entry[use].view(np.int64)

    def places(column: str):
        def read(batches):
            for b in batches:
                for of, at, low, entry in gathered(shared_places(b.column("body"), b.column(column))):
                    ids = b.column("id").take(pa.array(of))
                    if column == "many":
                        yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(entry)], names=["id", "at", "entry"])
                    else:
                        yield blobs((mix(low) % np.uint64(buckets)).astype(np.int64), ids, at=at, entry=entry)
        return read

    def meet(table):
        ids, at, entry = flat(table.column("ids")), flat(table.column("at")).to_numpy(), flat(table.column("entry")).to_numpy()
        rank, row = dense(ids)
        order = np.lexsort((at, rank, entry))
        rank, at, entry = rank[order], at[order], entry[order]
        new = heads(entry, rank, at)   # rows of one key are one document
        rank, at, entry = rank[new], at[new], entry[new]
        start = np.flatnonzero(heads(entry))
        size = np.diff(np.append(start, len(entry)))
        several = np.repeat(rank[start] != rank[start + size - 1], size)
        source, there, size = (np.repeat(x, size)[several] for x in (rank[start], at[start], size))
        rank, at, entry = rank[several], at[several], entry[several]
        order = np.lexsort((there, at, rank))
        rank, at, entry, source, there, size = (x[order] for x in (rank, at, entry, source, there, size))
        step = np.arange(len(rank))
        begin = np.flatnonzero(heads(rank, at - step, source, there - step, size)) if len(rank) else step
        runs = np.diff(np.append(begin, len(rank)))
        return pa.table([ids.take(pa.array(row[rank[begin]])), pa.array(at[begin]), pa.array(runs, pa.int32()), pa.array(entry[begin]),
                         ids.take(pa.array(row[source[begin]])), pa.array(there[begin]), pa.array(size[begin], pa.int64())],
                        names=["id", "at", "runs", "entry", "source", "there", "size"])

    found = rows.join(wanted.where(F.size("few") > 0).select("id", "few"), "id").select("id", "body", "few") \
        .mapInArrow(places("few"), f"bucket long, ids array<{kind}>, at array<int>, entry array<long>") \
        .groupBy("bucket").applyInArrow(meet, f"id {kind}, at int, runs int, entry long, source {kind}, there int, size long")
    if n_hot:
        each = stage(rows.join(wanted.where(F.size("many") > 0).select("id", "many"), "id").select("id", "body", "many")
                     .mapInArrow(places("many"), f"id {kind}, at int, entry long").distinct(), "run-places")
        classes_ = stage(each.groupBy("entry").agg(F.min(F.struct("id", "at")).alias("w"), F.max("id").alias("last"), F.count("*").alias("size"))
                         .where("w.id <> last").select("entry", F.col("w.id").alias("source"), F.col("w.at").alias("there"), "size"), "run-classes")
        found = found.unionByName(each.join(classes_, "entry").withColumn("runs", F.lit(1)))
    # neighbouring runs whose first occurrences are neighbours become one row
    side = ["id", "source", "size", "shift"]
    order = Window.partitionBy(*side).orderBy("at")
    begun = found.withColumn("shift", F.col("there") - F.col("at")) \
        .withColumn("begins", F.coalesce(F.lag(F.col("at") + F.col("runs")).over(order) < F.col("at"), F.lit(True))) \
        .withColumn("part", F.sum(F.col("begins").cast("int")).over(order))
    return begun.groupBy(*side, "part").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("runs")).alias("end"), F.min_by("entry", "at").alias("entry")).select(
        F.col("id").alias(key), F.col("at").alias("first_word"), (F.col("end") - F.col("at") + span - 1).cast("int").alias("n_words"), F.col("entry").alias("class_id"),
        F.col("source").alias("class_doc"), F.col("size").alias("class_size"), (F.col("id") != F.col("source")).alias("removed"))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, words: int = 5,
                      span: int = 12, window: int = 39, bands: int = 12, band_rows: int = 4) -> DataFrame:
    """Near lines and short texts (``repeated_paragraphs`` without its runs), and equal runs of ``span`` words at every place (``repeated_runs``)."""
    near = repeated_paragraphs(docs, key, text, similarity, words, span, window, bands, band_rows, chosen=False)
    return near.unionByName(repeated_runs(docs, key, text, words, span))


def without_words(body: str, spans: list[tuple[int, int]]) -> str:
    """``body`` without the words of the spans (first word, number of words); maximal runs go with the space between their words."""
    found = list(WORD.finditer(body))
    gone = np.zeros(len(found) + 1, bool)
    for at, n in spans:
        gone[at:at + n] = True
    gone[len(found):] = False
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))
    out, done = [], 0
    for s, e in zip(edge[::2], edge[1::2]):
        out.append(body[done:found[s].start()])
        done = found[e - 1].end()
    return "".join(out) + body[done:]


def remove_paragraphs(docs: DataFrame, repeated: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the removed paragraphs' words; every row stays, with its other columns.

    Null texts and keys pass through unchanged; rows of one key lose the same words.
    """
    gone = repeated.where("removed").groupBy(F.col(key).alias("id")).agg(F.collect_set(F.struct("first_word", "n_words")).alias("spans"))
    cut = F.udf(lambda body, spans: without_words(body, spans) if body and spans else body, "string", useArrow=True)
    # one struct holds the row, so no column of ``docs`` can clash
    t = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    t = t.join(gone, F.col("row")[key] == gone["id"], "left")
    return t.select(*[(cut(F.col("row")[text], "spans") if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
