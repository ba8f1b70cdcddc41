"""Experiment plans: train one model per training dataset and score every
dataset's test split with every model (M3/M7 + M17 + A13).

The reference ran one process per (model, train set, test set) grid cell;
here all models are fitted in the same jobs (the model id is a column) and
every test pair is scored under every model in one aggregation, so the grid
is a handful of jobs whatever its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inferna.functions.text import pair_text
from inferna.operators import metrics, nb, sample
from inferna.operators import vectorize as V
from inferna.operators.dictionary import sentence_id
from inferna.operators.features import valid_pairs_with_ids
from inferna.session import materialize
from inferna.sources import tables as src

MAX_VOCAB_ROWS = 5_000_000  # bound for the broadcast union of all vocabularies


def datasets_of(df: DataFrame) -> list[str]:
    """The (few) dataset names present — one small distinct aggregation."""
    return sorted(r.dataset for r in df.select("dataset").distinct().collect())


def train_test(spark: SparkSession, sf_dir: str, total_sample: int = 10_000):
    """Valid pairs -> (stratified train sample per dataset, full test split)."""
    pairs = materialize(valid_pairs_with_ids(src.nli_raw(spark, sf_dir)), ["split"])
    train = materialize(sample.stratified_sample(pairs.where(F.col("split") == "train"), total_sample))
    test = pairs.where(F.col("split") == "test")
    return train, test


def whole_splits(spark: SparkSession, sf_dir: str):
    """The whole training and test splits of the valid pairs, for vectorisers: their fits are aggregations, of any size."""
    kept = valid_pairs_with_ids(src.nli_raw(spark, sf_dir)).where(F.col("split").isin("train", "test"))
    pairs = materialize(kept.select("pair_id", "dataset", "split", "label", "premise_text", "hypothesis_text"), ["split"])
    return pairs.where(F.col("split") == "train"), pairs.where(F.col("split") == "test")


def whole_feature_splits(spark: SparkSession, sf_dir: str):
    """The same with the syntactic map alone, for scalers; only the two splits and the columns in use are written."""
    from inferna.operators.feature_sets import typed_features
    feats = typed_features(src.nli_raw(spark, sf_dir).where(F.col("split").isin("train", "test")), ("syntactic",))
    feats = materialize(feats, ["split"])
    return feats.where(F.col("split") == "train"), feats.where(F.col("split") == "test")


def term_totals(train: DataFrame, datasets: list[str], spec: V.TermSpec, text) -> DataFrame:
    """The most frequent terms of each dataset, from one pass over the texts: (model, term, tf_total, idx, df), df the rows with the term.

    Both tables are written once, as every reader would tokenise the texts again."""
    dt = V.doc_terms(train.where(F.col("dataset").isin(datasets)), "pair_id", text, spec, keep=["dataset"])
    totals = materialize(dt.groupBy("dataset", "term").agg(F.sum("tf").alias("tf_total"), F.count(F.lit(1)).alias("df")))
    out = None
    for ds in datasets:
        top = V.top_terms(totals.where(F.col("dataset") == ds).drop("dataset"), spec.max_features).withColumn("model", F.lit(ds))
        out = top if out is None else out.unionByName(top)
    return None if out is None else materialize(out)


def fit_vocabs(train: DataFrame, datasets: list[str], spec: V.TermSpec, text) -> DataFrame:
    """One vocabulary per training dataset: (model, term, idx)."""
    terms = term_totals(train, datasets, spec, text)
    return None if terms is None else terms.select("model", "term", "idx")


def side_features(df: DataFrame, vocabs: DataFrame, spec: V.TermSpec, own_model: bool,
                  keep: list[str] | None = None) -> DataFrame:
    """V4: premise and hypothesis counted with the shared vocabulary of each
    model; feature id f = 2 * idx + side (the two blocks interleaved).

    own_model: training rows only meet their own dataset's vocabulary;
    otherwise every row meets every model's vocabulary (the grid)."""
    n = vocabs.count()
    if n > MAX_VOCAB_ROWS:
        raise ValueError(f"{n} vocabulary rows exceed the broadcast bound")
    v = F.broadcast(vocabs)
    out = None
    for side, col in ((0, "premise_text"), (1, "hypothesis_text")):
        dt = V.doc_terms(df, "pair_id", F.col(col), spec, keep=["dataset", *(keep or [])])
        j = (dt.join(v, (dt.term == v.term) & (dt.dataset == v.model)) if own_model
             else dt.join(v, "term"))
        s = j.select("model", F.col("pair_id").alias("doc_id"), *(keep or []),
                     (F.col("idx") * 2 + side).alias("f"), F.col("tf").cast("double").alias("x"))
        out = s if out is None else out.unionByName(s)
    return out


def nb_bow_grid(spark: SparkSession, sf_dir: str, max_features: int = 10_000, alpha: float = 1.0,
                total_sample: int = 10_000) -> DataFrame:
    """baseline-3: BoW (shared vocabulary fitted on premise + ' ' + hypothesis,
    sides counted separately) -> multinomial NB, per training dataset; every
    test pair of every dataset scored by every model.  Returns predictions
    (model, doc_id, dataset, y, pred)."""
    spec = V.TermSpec(max_features=max_features)
    train, test = train_test(spark, sf_dir, total_sample)
    dsets = datasets_of(train)
    vocabs = fit_vocabs(train, dsets, spec, pair_text(F.col("premise_text"), F.col("hypothesis_text")))
    n_features = vocabs.groupBy("model").agg((F.count(F.lit(1)) * 2).alias("n_features"))
    tr_feats = side_features(train, vocabs, spec, own_model=True, keep=["label"])
    tr_docs = train.select(F.col("dataset").alias("model"), F.col("pair_id").alias("doc_id"), "label")
    classes, fmodel = nb.fit(tr_feats, tr_docs, n_features, ["model"], alpha)
    te_feats = side_features(test, vocabs, spec, own_model=False)
    models = F.array(*[F.lit(d) for d in dsets])
    te_docs = test.select(F.explode(models).alias("model"), F.col("pair_id").alias("doc_id"),
                          "dataset", F.col("label").alias("y"))
    return nb.predict(te_feats, te_docs, classes, fmodel, ["model"], ["doc_id", "dataset", "y"])


def cross_dataset_matrix(pred: DataFrame, experiment: str) -> DataFrame:
    """Metrics per (experiment, predict_dataset, trained_dataset)."""
    cells = pred.select(F.lit(experiment).alias("experiment"), F.col("dataset").alias("predict_dataset"),
                        F.col("model").alias("trained_dataset"), "y", "pred")
    return metrics.evaluate(cells, ["experiment", "predict_dataset", "trained_dataset"], decimals=6)


def fit_tfidf(train: DataFrame, dsets: list[str], spec: V.TermSpec, text) -> DataFrame:
    """V3 fit per training dataset: (model, term, idx, df, idf) with
    idf = ln((1 + n_docs) / (1 + df)) + 1 over that dataset's sample."""
    terms = term_totals(train, dsets, spec, text)
    n = terms.count()
    if n > MAX_VOCAB_ROWS:
        raise ValueError(f"{n} vocabulary rows exceed the broadcast bound")
    ndocs = train.groupBy(F.col("dataset").alias("model")).agg(F.count(F.lit(1)).alias("n_docs"))
    return materialize(terms.join(F.broadcast(ndocs), "model")
                       .select("model", "term", "idx", "df",
                               (F.log((F.col("n_docs") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")))


def tfidf_side(df: DataFrame, idf: DataFrame, spec: V.TermSpec, text_col: str, side: int | None,
               own_model: bool) -> DataFrame:
    """V3 transform of one text column under every model (or the row's own
    model): (model, doc_id, f, x) with x = tf*idf / ||tf*idf||_2 per doc.

    f = idx when ``side`` is None, else 2 * idx + side (V4 blocks)."""
    dt = V.doc_terms(df, "pair_id", F.col(text_col), spec, keep=["dataset"])
    w = F.broadcast(idf.select("model", "term", "idx", "idf"))
    j = (dt.join(w, (dt.term == w.term) & (dt.dataset == w.model)) if own_model
         else dt.join(w, "term"))
    val = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(val * val).over(Window.partitionBy("model", "pair_id")))
    f = F.col("idx") if side is None else F.col("idx") * 2 + side
    return j.select("model", F.col("pair_id").alias("doc_id"), f.cast("int").alias("f"), (val / norm).alias("x"))


def feature_train_test(spark: SparkSession, sf_dir: str, total_sample: int = 10_000):
    """Feature table (text stats + syntactic map) of the stratified training
    sample and of the full test split of the valid pairs.

    The sample is drawn from the pairs, so that only rows that a learner or a
    prediction reads are annotated and joined."""
    from inferna.operators.features import features_of
    raw = src.nli_raw(spark, sf_dir).where(F.col("split").isin("train", "test"))
    # ids are hashes of the texts: worked out again below, not stored
    pairs = materialize(valid_pairs_with_ids(raw).drop("premise_id", "hypothesis_id"), ["split"])
    sampled = sample.stratified_sample(pairs.where(F.col("split") == "train"), total_sample).drop("sample_id")
    used = materialize(sampled.unionByName(pairs.where(F.col("split") == "test")), ["split"])
    ids = {f"{s}_id": sentence_id(F.col(f"{s}_text")) for s in ("premise", "hypothesis")}
    feats = materialize(features_of(used.withColumns(ids)), ["split"])
    return feats.where(F.col("split") == "train"), feats.where(F.col("split") == "test")


def fit_feature_lists(train: DataFrame, marks: list[str] | None = None,
                      limit: int = 1_000_000) -> dict[str, list[str]]:
    """P15 fit for every model at once: model -> sorted feature names seen in
    its training rows (one job; bounded by models x tag vocabulary)."""
    from inferna.functions import parse as P
    rows = (train.select(F.col("dataset").alias("model"), F.explode_outer(F.map_keys("syn")).alias("feature"))
            .where(F.col("feature").isNotNull()).distinct().limit(limit + 1).collect())
    if len(rows) > limit:
        raise ValueError("too many distinct features to collect")
    out: dict[str, list[str]] = {}
    for r in rows:
        if marks is None or P.group_of(r.feature, marks):
            out.setdefault(r.model, []).append(r.feature)
    return {m: sorted(v) for m, v in out.items()}


def fit_scalers(aligned: DataFrame) -> dict[str, dict[str, list[float]]]:
    """V6-V8 fit for every model at once: per (model, position) mean,
    population std, min and max of ``a`` (one aggregation job)."""
    rows = (aligned.select("model", F.posexplode_outer("a").alias("pos", "v")).where(F.col("pos").isNotNull())
            .groupBy("model", "pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"),
                                         F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
    out: dict[str, dict[str, list[float]]] = {}
    for r in sorted(rows, key=lambda r: (r.model, r.pos)):
        d = out.setdefault(r.model, {"mean": [], "std": [], "min": [], "max": []})
        d["mean"].append(float(r.m or 0.0))
        d["std"].append(float(r.s or 0.0))
        d["min"].append(float(r.lo or 0.0))
        d["max"].append(float(r.hi or 0.0))
    return out


def syntactic_vectors(train: DataFrame, test: DataFrame, dsets: list[str], scale: str = "standard",
                      marks: list[str] | None = None):
    """P15 + V6/V7/V8 per model: align the syntactic map to the model's
    fitted feature list (missing -> 0) and scale with the model's training
    statistics.  -> (train rows: model, train_id, label, vec; test rows:
    model, doc_id, dataset, y, vec).  ``marks`` keeps one feature group (P12).
    scale: standard | nomean | minmax | none."""
    from inferna.functions import parse as P
    lists = fit_feature_lists(train, marks)
    tr_al = te_al = None
    for m in dsets:
        arr = P.align(F.col("syn"), lists.get(m, []))
        t = train.where(F.col("dataset") == m).select(
            F.lit(m).alias("model"), F.col("pair_id").alias("train_id"), "label", arr.alias("a"))
        q = test.select(F.lit(m).alias("model"), F.col("pair_id").alias("doc_id"), "dataset",
                        F.col("label").alias("y"), arr.alias("a"))
        tr_al = t if tr_al is None else tr_al.unionByName(t)
        te_al = q if te_al is None else te_al.unionByName(q)
    stats = fit_scalers(tr_al) if scale != "none" else {}

    def scaled(df: DataFrame) -> DataFrame:
        parts = None
        for m in dsets:
            st = stats.get(m, {"mean": [], "std": [], "min": [], "max": []})
            if scale == "standard":
                z = V.standard_scale(F.col("a"), st)
            elif scale == "nomean":
                z = V.standard_scale(F.col("a"), st, with_mean=False)
            elif scale == "minmax":
                z = V.minmax_scale(F.col("a"), st)
            else:
                z = F.col("a")
            p = df.where(F.col("model") == m).withColumn("vec", z).drop("a")
            parts = p if parts is None else parts.unionByName(p)
        return parts
    return scaled(tr_al), scaled(te_al)


def knn_syntactic_grid(spark: SparkSession, sf_dir: str, k: int = 5, metric: str = "cosine",
                       total_sample: int = 10_000, marks: list[str] | None = None) -> DataFrame:
    """experiment-2: z-scored syntactic features -> exact KNN (k=5, cosine)."""
    from inferna.operators.knn import knn_predict
    train, test = feature_train_test(spark, sf_dir, total_sample)
    dsets = datasets_of(train)
    tr, te = syntactic_vectors(train, test, dsets, "standard", marks)
    return knn_predict(tr, te, "vec", k, metric, tie_decimals=9)


def _bow_block(df: DataFrame, vocabs: DataFrame, spec: V.TermSpec, text_col: str, offset: int,
               own_model: bool, keep: list[str]) -> DataFrame:
    dt = V.doc_terms(df, "pair_id", F.col(text_col), spec, keep=["dataset", *keep])
    v = F.broadcast(vocabs)
    j = (dt.join(v, (dt.term == v.term) & (dt.dataset == v.model)) if own_model else dt.join(v, "term"))
    return j.select("model", F.col("pair_id").alias("doc_id"), *keep,
                    (F.col("idx") + offset).cast("int").alias("f"), F.col("tf").cast("double").alias("x"))


SYN_OFFSET = 1 << 24   # feature-id offsets of the blocks (NB is order-free)
HYP_OFFSET = 1 << 23


def nb_bow_syntactic_grid(spark: SparkSession, sf_dir: str, max_features: int = 10_000, alpha: float = 1.0,
                          total_sample: int = 10_000) -> DataFrame:
    """experiment-4: premise BoW (k/2, English stop words) + hypothesis BoW
    (k/2, own vocabulary) + min-max scaled syntactic features (V5+V8+V9)
    -> multinomial NB per training dataset, scored on every test split."""
    train, test = feature_train_test(spark, sf_dir, total_sample)
    dsets = datasets_of(train)
    spec = V.TermSpec(max_features=max_features // 2, stop_words=True)
    vp = fit_vocabs(train, dsets, spec, F.col("premise_text"))
    vh = fit_vocabs(train, dsets, spec, F.col("hypothesis_text"))
    for v in (vp, vh):
        if v.count() > MAX_VOCAB_ROWS:
            raise ValueError("vocabulary rows exceed the broadcast bound")
    tr_syn, te_syn = syntactic_vectors(train, test, dsets, "minmax")

    def syn_long(df: DataFrame, keep: list[str]) -> DataFrame:
        e = df.select("model", F.col(keep[0]).alias("doc_id"), *keep[1:],
                      F.posexplode_outer("vec").alias("pos", "x"))
        return e.where(F.col("pos").isNotNull() & (F.col("x") != 0)).select(
            "model", "doc_id", *keep[1:], (F.col("pos") + SYN_OFFSET).cast("int").alias("f"), "x")

    tr_feats = (_bow_block(train, vp, spec, "premise_text", 0, True, ["label"])
                .unionByName(_bow_block(train, vh, spec, "hypothesis_text", HYP_OFFSET, True, ["label"]))
                .unionByName(syn_long(tr_syn, ["train_id", "label"])))
    te_feats = (_bow_block(test, vp, spec, "premise_text", 0, False, [])
                .unionByName(_bow_block(test, vh, spec, "hypothesis_text", HYP_OFFSET, False, []))
                .unionByName(syn_long(te_syn, ["doc_id"])))
    n_syn = tr_syn.groupBy("model").agg(F.max(F.size("vec")).alias("n_syn"))
    n_features = (vp.groupBy("model").agg(F.count(F.lit(1)).alias("np_"))
                  .join(vh.groupBy("model").agg(F.count(F.lit(1)).alias("nh_")), "model", "full")
                  .join(n_syn, "model", "full")
                  .select("model", (F.coalesce("np_", F.lit(0)) + F.coalesce("nh_", F.lit(0))
                                    + F.coalesce("n_syn", F.lit(0))).alias("n_features")))
    tr_docs = train.select(F.col("dataset").alias("model"), F.col("pair_id").alias("doc_id"), "label")
    classes, fmodel = nb.fit(tr_feats, tr_docs, n_features, ["model"], alpha)
    models = F.array(*[F.lit(d) for d in dsets])
    te_docs = test.select(F.explode(models).alias("model"), F.col("pair_id").alias("doc_id"),
                          "dataset", F.col("label").alias("y"))
    return nb.predict(te_feats, te_docs, classes, fmodel, ["model"], ["doc_id", "dataset", "y"])
