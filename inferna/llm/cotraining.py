"""Quality classifier by co-training on two views of a document.

The content view sees the text: frequencies of hashed byte trigrams, a few
ratios (repetition, cases, digits, marks), and which of the words occur that tell
rejected documents most in the labelled ones.  A document with a toxic label is a
rejected one, whatever its quality.  The metadata view sees source,
language, length and never the text.  Both are logistic regressions.  They start
from labelled documents; in each round each view labels the pool's documents it
is surest of, as many of either class as the labels' shares say, and hands them
to the other view; a good one only if the other view calls it good too, a bad one
unless the other is sure that it is good.  Held-out labels then calibrate each view (a line through its
logit) and weigh both into one probability, with which all documents are scored.

The pool is every unlabelled document.  Its features are written once; each round
scores all of them in a pass that counts scores in narrow bins, takes the
thresholds from those counts, and refits both views by Newton steps whose
gradients and Hessians are summed over the pool in tasks.  Which documents a view
was given follows from the coefficients and thresholds of the rounds before, so
no table of them is kept.  Only the labelled sample, ``max_labelled`` documents of
least hash of their key, is bounded; its features (some 20 MB), the counts and the
sums go through the driver.  Scoring is a pass over the documents without a
shuffle.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inferna.llm.common import apart, bounded_broadcast, restored, stage

BUCKETS, META = 512, 96
RATIOS = 8
WORD = re.compile(r"[^\W\d_]+")


def distinct_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def content_features(text: str, telling: dict[str, tuple[int, float]]) -> np.ndarray:
    """Root frequencies of hashed trigrams of the whole text's bytes, ratios, then the sum and the largest of the
    odds of the words of ``telling`` (word: place, odds) that occur, and 1 for each of them; zeros for an empty text."""
    out = np.zeros(BUCKETS + RATIOS + 2 + len(telling), np.float32)
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    n = len(data)
    if n == 0:
        return out
    d = data.astype(np.uint32)
    if n >= 3:
        tri = ((d[:-2] * 65599 + d[1:-1]) * 65599 + d[2:]) * np.uint32(2654435761) >> np.uint32(23)
        out[:BUCKETS] = np.sqrt(np.bincount(tri, minlength=BUCKETS)[:BUCKETS] / len(tri))
    kinds = np.bincount(data, minlength=256) / n
    words = text.split()
    # a long text repeats more; sizes are compared on a root scale
    out[BUCKETS:BUCKETS + RATIOS] = (kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum(), kinds[33:48].sum() + kinds[58:65].sum(),
                     kinds[91:97].sum() + kinds[123:127].sum(), kinds[32] + kinds[10],
                     len(set(words)) / max(1.0, len(words) ** 0.8), n / max(1, len(words)) / 16)
    found = sorted(telling[w] for w in telling.keys() & distinct_words(text))
    for place, odds in found:
        out[BUCKETS + RATIOS + 2 + place] = 1
        out[BUCKETS + RATIOS] += odds
    out[BUCKETS + RATIOS + 1] = max((odds for _, odds in found), default=0)
    return out


def meta_features(source, lang, size) -> np.ndarray:
    """Hashed source, language and both, and the length on a log scale in steps."""
    out = np.zeros(META, np.float32)
    out[zlib.crc32(f"s{source}".encode()) % 40] = 1
    out[40 + zlib.crc32(f"l{lang}".encode()) % 16] = 1
    out[56 + zlib.crc32(f"{source}|{lang}".encode()) % 24] = 1
    length = np.log1p(max(0, size or 0))
    out[80 + min(14, int(length))] = 1
    out[95] = length / 10
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 25,
                 norm: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Coefficients (the last is the intercept) by damped Newton steps on columns standardised by ``norm`` or their own mean and scale."""
    mean, scale = norm or (x.mean(axis=0), x.std(axis=0) + 1e-6)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge * weight.sum())
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + penalty * w
        s = np.maximum(weight * p * (1 - p), 1e-4)
        step = np.linalg.solve((z * s[:, None]).T @ z + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    out = np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())
    return out


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def telling_words(rows: DataFrame, many: int) -> dict[str, tuple[int, float]]:
    """Word: (place, odds) of the ``many`` words that tell rejected rows of ``rows`` (y, body) most, by log odds times documents.

    A word must occur in three rejected documents at least.
    """
    def words(batches):
        for b in batches:
            found = [(y, w) for y, t in zip(b.column("y").to_pylist(), b.column("body").to_pylist()) for w in distinct_words(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in found], pa.int32()), pa.array([w for _, w in found], pa.string())],
                                             names=["y", "word"])

    n = {x["y"]: x["count"] for x in rows.groupBy("y").count().collect()}
    bad, good = F.sum(1 - F.col("y")), F.sum("y")
    odds = F.log((F.col("bad") + 0.5) / (n.get(0, 0) + 1) * (n.get(1, 0) + 1) / (F.col("good") + 0.5))
    told = (rows.select("y", "body").mapInArrow(words, "y int, word string").groupBy("word").agg(bad.alias("bad"), good.alias("good"))
            .where("bad >= 3").withColumn("odds", odds).where("odds > 0.7").orderBy(F.desc(F.col("bad") * F.col("odds")), "word").limit(many))
    return {x["word"]: (i, x["odds"]) for i, x in enumerate(told.select("word", "odds").collect())}


#: Scores are counted in bins of a hundredth.  A view is sure beyond SURE; rows it was given weigh GIVEN of a labelled one,
#: and together no more than that of all labelled ones.
BINS, SURE, GIVEN = 6001, 1.5, 0.3
#: Parts in which a Hessian travels, and tasks whose sums meet first.
CHUNKS, FAN = 16, 32


def bin_of(s: np.ndarray) -> np.ndarray:
    return np.floor((s + 30) * 100).astype(np.int64)


def given_labels(views: list[np.ndarray], u: np.ndarray, history: list) -> tuple[list[np.ndarray], np.ndarray]:
    """For pool rows: the label that either view was given in the rounds of ``history`` (-1: none), and which rows are left.

    A round is (coefficients, edges) of both views; edges are (low bin, share of it, high bin, share of it).  ``u`` in
    [0, 1), a hash of the key, says which rows of an edge bin belong.
    """
    given, left = [np.full(len(u), -1), np.full(len(u), -1)], np.ones(len(u), bool)
    for models, edges in history:
        s = [logit(x, w) for x, w in zip(views, models)]
        told = []
        for v in (0, 1):
            at, other, (low, low_share, high, high_share) = bin_of(s[v]), s[1 - v], edges[v]
            bad = left & ((at < low) | ((at == low) & (u < low_share))) & (s[v] < -SURE) & (other <= SURE)
            good = left & ((at > high) | ((at == high) & (u < high_share))) & (s[v] > SURE) & (other >= 0)
            told.append(np.where(bad, 0, np.where(good, 1, -1)))
        for v in (0, 1):
            given[v] = np.where(given[v] < 0, told[1 - v], given[v])
        left = left & (told[0] < 0) & (told[1] < 0)
    return given, left


def edge(counts: np.ndarray, many: int) -> tuple[int, float]:
    """The first bin that does not fit into the first ``many`` rows, and the share of it that does."""
    upto = np.cumsum(counts)
    b = int(np.searchsorted(upto, many, side="right"))
    return (b, float((many - (upto[b - 1] if b else 0)) / counts[b])) if b < len(counts) else (b, 0.0)


def newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, norm: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss at ``w`` on standardised columns."""
    z = np.hstack([(x - norm[0]) / norm[1], np.ones((len(x), 1))]).astype(np.float64)
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    return z.T @ (p - y), (z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z


def unpacked(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    views = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float16).astype(np.float32).reshape(batch.num_rows, -1) for c in ("content", "meta")]
    h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
    return views, (h >> np.uint64(11)) * 2.0**-53


def score_counts(pool: DataFrame, models: list[np.ndarray], history: list) -> np.ndarray:
    """How many pool rows that are left have a score in each bin, for either view."""
    def count(batches):
        out = np.zeros((2, BINS), np.int64)
        for b in batches:
            if b.num_rows:
                views, u = unpacked(b)
                left = given_labels(views, u, history)[1]
                for v in (0, 1):
                    out[v] += np.bincount(bin_of(logit(views[v][left], models[v])), minlength=BINS)
        v, at = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(out[v, at])], names=["v", "bin", "n"])

    out = np.zeros((2, BINS), np.int64)
    for x in pool.mapInArrow(count, "v int, bin int, n long").groupBy("v", "bin").agg(F.sum("n").alias("n")).collect():
        out[x["v"], x["bin"]] = x["n"]
    return out


def pool_sums(pool: DataFrame, history: list, at: list[np.ndarray], norms: list) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, gradient, Hessian) of either view over the pool rows it was given, at the coefficients ``at``."""
    widths = [len(w) for w in at]
    upper = [np.triu_indices(k) for k in widths]

    def add(batches):
        from pyspark import TaskContext
        n, g, h = [0, 0], [np.zeros(k) for k in widths], [np.zeros((k, k)) for k in widths]
        for b in batches:
            if b.num_rows:
                views, u = unpacked(b)
                given = given_labels(views, u, history)[0]
                for v in (0, 1):
                    use = given[v] >= 0
                    if use.any():
                        x, y = newton_sums(views[v][use], given[v][use], at[v], norms[v])
                        n[v], g[v], h[v] = n[v] + int(use.sum()), g[v] + x, h[v] + y
        if any(n):
            # single precision is enough for Hessians: they only scale the steps
            parts = [np.concatenate([n, *g]).tobytes()] + [p.tobytes() for p in np.array_split(
                np.concatenate([m[i] for m, i in zip(h, upper)]).astype(np.float32), CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(parts), pa.int32()),
                                              pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "chunk", "data"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(pdf["chunk"].iloc[0])
        kind = np.float32 if chunk else np.float64
        data = sum(np.frombuffer(d, kind).astype(np.float64) for d in pdf.sort_values("part")["data"])
        return pd.DataFrame({"part": [int(pdf["part"].min())], "chunk": [chunk], "data": [data.astype(kind).tobytes()]})

    schema = "part int, chunk int, data binary"
    sums = pool.mapInArrow(add, schema)
    if pool.rdd.getNumPartitions() > FAN:
        sums = sums.groupBy("chunk", F.floor(F.col("part") / FAN).alias("fan")).applyInPandas(total, schema)
    got = {x["chunk"]: x["data"] for x in sums.groupBy("chunk").applyInPandas(total, schema).collect()}
    if not got:
        return [(0, np.zeros(k), np.zeros((k, k))) for k in widths]
    head = np.frombuffer(got[0], np.float64)
    flat = np.concatenate([np.frombuffer(got[c], np.float32) for c in range(1, CHUNKS + 1)]).astype(np.float64)
    out, g, f = [], 2, 0
    for v, k in enumerate(widths):
        full = np.zeros((k, k))
        full[upper[v]] = flat[f:f + len(upper[v][0])]
        out.append((int(head[v]), head[g:g + k], full + np.triu(full, 1).T))
        g, f = g + k, f + len(upper[v][0])
    return out


def co_train(views: list[np.ndarray], y: np.ndarray, held: np.ndarray, pool: DataFrame, rounds: int, share: float,
             ridge: float = 1e-3, steps: int = 8) -> dict:
    """Coefficients of both views, of their calibrations, and of the combination, and the rounds.

    ``views`` and ``y`` (1 or 0) are the labelled rows, ``pool`` (h, content, meta)
    all others.  The rows of ``held`` calibrate and take no part in the fits,
    unless there are few labels or it lacks a class.
    """
    apart = len(y) >= 50 and set(y[held]) == set(y[~held]) == {0, 1}
    train, held = (np.flatnonzero(~held), np.flatnonzero(held)) if apart else (np.arange(len(y)),) * 2
    rate, own = y[train].mean(), [x[train].astype(np.float64) for x in views]
    target = y[train].astype(float)
    # a column without spread among the labelled rows may have some in the pool
    norms = [(x.mean(axis=0), np.where(x.std(axis=0) > 1e-6, x.std(axis=0) + 1e-6, 1.0)) for x in own]

    def raw(w, norm):
        return np.append(w[:-1] / norm[1], w[-1] - (w[:-1] * norm[0] / norm[1]).sum())

    models = [fit_logistic(x, target, np.ones(len(x)), ridge, norm=norm) for x, norm in zip(own, norms)]
    history, seen = [], None
    for _ in range(rounds):
        counts = score_counts(pool, models, history)
        left = int(counts[0].sum())
        seen = left if seen is None else seen
        if left == 0:
            break
        many = max(1, int(left * share))
        edges = []
        for c in counts:
            low, high = edge(c, max(1, int(many * (1 - rate)))), edge(c[::-1], max(1, int(many * rate)))
            edges.append((*low, BINS - 1 - high[0], high[1]))
        history = history + [(models, edges)]
        w = [np.append(m[:-1] * norm[1], m[-1] + (m[:-1] * norm[0]).sum()) for m, norm in zip(models, norms)]
        for _ in range(steps):
            far = 0.0
            for v, (n, g, h) in enumerate(pool_sums(pool, history, w, norms)):
                weight = GIVEN * min(1.0, len(train) / max(1, n))
                g0, h0 = newton_sums(own[v], target, w[v], norms[v])
                penalty = np.full(len(w[v]), ridge * (len(train) + weight * n))
                penalty[-1] = 1e-9
                step = np.linalg.solve(h0 + weight * h + np.diag(penalty), g0 + weight * g + penalty * w[v])
                w[v] = w[v] - step
                far = max(far, float(np.abs(step).max()))
            if far < 5e-3:
                break
        models = [raw(x, norm) for x, norm in zip(w, norms)]
    scores = [logit(views[v][held], models[v])[:, None] for v in (0, 1)]
    one, known = np.ones(len(held)), y[held].astype(float)
    lines = [fit_logistic(r, known, one) for r in scores]
    both = np.hstack([logit(r, w)[:, None] for r, w in zip(scores, lines)])
    return {"content": models[0], "meta": models[1], "line0": lines[0], "line1": lines[1], "both": fit_logistic(both, known, one),
            "history": history, "norms": norms, "pool": seen or 0}


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                lang: str = "lang", label: str = "quality", max_labelled: int = 6000, max_pool: int | None = None, rounds: int = 3,
                share: float = 0.1, toxic: str = "toxic", max_words: int = 128) -> dict | None:
    """The fitted views, or None if the labels do not hold both classes.

    A row with ``toxic`` = 1 counts as quality 0 (labels may lack the column).  A
    key with two labels counts as the lower; labels other than 0 and 1 do not count.
    ``max_pool`` bounds the unlabelled documents in trials; unset, all take part.
    """
    mark = F.when(F.col(label).isin(0, 1), F.col(label).cast("int"))
    if toxic in labels.columns:
        mark = F.when(F.col(toxic) == 1, 0).otherwise(mark)
    marks = stage(labels.select(F.col(f"`{key}`").alias("id"), mark.alias("y")).where("y is not null and id is not null")
                  .groupBy("id").agg(F.min("y").alias("y")), "quality-marks")
    many = marks.count()
    least = marks.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(max_labelled).select("id", "y")
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body"), F.col(f"`{source}`").alias("source"),
                       F.col(f"`{lang}`").alias("lang")).where("id is not null")
    # at most max_labelled rows
    sample = stage(rows.join(F.broadcast(least), "id").dropDuplicates(["id"])
                   .withColumn("held", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(5)) == 0), "quality-sample", max_labelled)
    if {x["y"] for x in sample.select("y").distinct().collect()} != {0, 1}:
        return None
    telling = telling_words(sample.where("not held"), max_words)

    def featured(batches):
        for b in batches:
            texts = [t or "" for t in b.column("body").to_pylist()]
            told = zip(b.column("source").to_pylist(), b.column("lang").to_pylist(), texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("h"), b.column("y"), b.column("held"),
                 pa.array([content_features(t, telling).astype(np.float16).tobytes() for t in texts], pa.binary()),
                 pa.array([meta_features(s, g, len(t)).astype(np.float16).tobytes() for s, g, t in told], pa.binary())],
                names=["id", "h", "y", "held", "content", "meta"])

    def features(t: DataFrame) -> DataFrame:
        kind = t.schema["id"].dataType.simpleString()
        return (t.withColumn("h", F.xxhash64("id")).select("id", "h", "y", "held", "body", "source", "lang")
                .mapInArrow(featured, f"id {kind}, h long, y int, held boolean, content binary, meta binary"))

    pool = rows.join(bounded_broadcast(marks.select("id"), many, 16), "id", "left_anti")
    if max_pool is not None:
        pool = pool.dropDuplicates(["id"]).withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(max_pool)
    pool = stage(features(pool.withColumns({"y": F.lit(-1), "held": F.lit(False)})).select("h", "content", "meta"), "quality-pool")
    pdf = features(sample).toPandas().sort_values("id", ignore_index=True)
    views = [np.stack([np.frombuffer(v, np.float16).astype(np.float32) for v in pdf[c]]) for c in ("content", "meta")]
    return co_train(views, pdf["y"].to_numpy(), pdf["held"].to_numpy(bool), pool, rounds, share) | {"telling": telling}


def score_quality(docs: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text", source: str = "source",
                  lang: str = "lang", threshold: float = 0.5) -> DataFrame:
    """``docs`` with _content, _meta (calibrated probabilities of either view), _score and _keep for every row.

    Null texts count as empty.  Without a model nothing is known: scores are
    null and every row is kept.  A column of ``docs`` named as one of these
    four gives way to it; other columns stay, whatever their names.
    """
    docs = docs.drop("_content", "_meta", "_score", "_keep")
    if model is None:
        none = F.lit(None).cast("double")
        return docs.withColumns({"_content": none, "_meta": none, "_score": none, "_keep": F.lit(True)})

    @F.pandas_udf("content double, meta double, score double")
    def score(body: pd.Series, src: pd.Series, lng: pd.Series) -> pd.DataFrame:
        n = len(body)
        a, b = np.empty(n), np.empty(n)
        for i, (t, s, g) in enumerate(zip(body, src, lng)):
            t = t or ""
            a[i] = logit(content_features(t, model["telling"]), model["content"])
            b[i] = logit(meta_features(s, g, len(t)), model["meta"])
        a, b = logit(a[:, None], model["line0"]), logit(b[:, None], model["line1"])
        both = logit(np.stack([a, b], axis=1), model["both"])
        prob = lambda z: 1 / (1 + np.exp(-z))
        return pd.DataFrame({"content": prob(a), "meta": prob(b), "score": prob(both)})

    docs, back = apart(docs, ("_q",))
    t = docs.withColumn("_q", score(F.col(f"`{text}`"), F.col(f"`{source}`"), F.col(f"`{lang}`")))
    return restored(t.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_q.content").alias("_content"), F.col("_q.meta").alias("_meta"),
                             F.col("_q.score").alias("_score"), (F.col("_q.score") >= threshold).alias("_keep")), back)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit on the labelled sample, score every row of ``docs``."""
    names = {k: v for k, v in options.items() if k in ("key", "text", "source", "lang")}
    threshold = options.pop("threshold", 0.5)
    return score_quality(docs, fit_quality(docs, labels, **options), **names, threshold=threshold)
