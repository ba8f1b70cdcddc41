"""Spark ML learners of the reference's experiments.

Text blocks become sparse vectors JVM-side (``CountVectorizerModel`` built
from the fitted vocabulary, ``ElementwiseProduct`` with the +1 idf weights,
``Normalizer``); syntactic blocks are the aligned, scaled arrays turned into
vectors; ``VectorAssembler`` concatenates (V9).  One model per training
dataset is fitted on its bounded training sample and applied to every
dataset's full test split; predictions feed the same metrics grid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferna.functions.text import pair_text
from inferna.operators import vectorize as V
from inferna.plans import grid
from inferna.session import materialize


@dataclass(frozen=True)
class TextBlock:
    column: str          # premise_text | hypothesis_text | joined
    spec: V.TermSpec
    tfidf: bool
    fit_on: str          # text the vocabulary is fitted on: same | joined


@dataclass(frozen=True)
class Experiment:
    key: str
    blocks: tuple[TextBlock, ...]
    syntactic: str | None          # None | standard | nomean | minmax | none
    learner: str                   # dt | lr | rf | gbt
    marks: tuple[str, ...] | None = None


BOW10K = V.TermSpec(10_000)
TFIDF10K = V.TermSpec(10_000, bigrams=True, stop_words=True)
TFIDF5K = V.TermSpec(5_000, bigrams=True, stop_words=True)
BOW2500 = V.TermSpec(2_500, stop_words=True)

EXPERIMENTS = {
    "baseline-1": Experiment("baseline-1", (TextBlock("joined", BOW10K, False, "same"),), None, "dt"),
    "baseline-2": Experiment("baseline-2", (TextBlock("premise_text", TFIDF10K, True, "joined"),
                                            TextBlock("hypothesis_text", TFIDF10K, True, "joined")), None, "lr"),
    "experiment-1": Experiment("experiment-1", (), "standard", "dt"),
    "experiment-3": Experiment("experiment-3", (TextBlock("premise_text", TFIDF5K, True, "same"),
                                                TextBlock("hypothesis_text", TFIDF5K, True, "same")),
                               "nomean", "lr"),
    "experiment-5": Experiment("experiment-5", (TextBlock("premise_text", BOW2500, False, "same"),
                                                TextBlock("hypothesis_text", BOW2500, False, "same")),
                               "nomean", "rf"),
    "experiment-6": Experiment("experiment-6", (TextBlock("premise_text", TFIDF5K, True, "same"),
                                                TextBlock("hypothesis_text", TFIDF5K, True, "same")),
                               "nomean", "gbt"),
}


@dataclass(frozen=True)
class Effort:
    """How far the learners go.  Spark grows trees level by level over all
    features, so depth and bins bound the cost on thousands of counts (which
    take few distinct values); the largest depth Spark knows is 30."""
    depth: int = 30
    bins: int = 32
    trees: int = 100
    stages: int = 100
    steps: int = 1000


#: Settings of the registered text-vector queries.
QUERY_EFFORT = Effort(depth=8, bins=4, trees=20, stages=5, steps=50)


def learner(kind: str, n_train: int, label_col: str = "label", features_col: str = "features", effort: Effort = Effort()):
    """Spark ML equivalents with the usual hyper-parameters.

    Logistic regression is L2 one-vs-rest with C = 1 (regParam = 1 / (C * n));
    boosting is one-vs-rest of binary GBTs of depth 3 and step 0.1."""
    cols = dict(labelCol=label_col, featuresCol=features_col)
    tree = dict(maxBins=effort.bins, maxMemoryInMB=1024, cacheNodeIds=True, seed=42)
    if kind == "dt":
        return DecisionTreeClassifier(**cols, maxDepth=effort.depth, **tree)
    if kind == "rf":
        return RandomForestClassifier(**cols, numTrees=effort.trees, maxDepth=effort.depth, featureSubsetStrategy="sqrt", **tree)
    if kind == "lr":
        base = LogisticRegression(regParam=1.0 / max(1, n_train), elasticNetParam=0.0, standardization=False,
                                  maxIter=effort.steps, family="binomial")
        return OneVsRest(classifier=base, **cols)
    if kind == "gbt":
        return OneVsRest(classifier=GBTClassifier(maxIter=effort.stages, maxDepth=3, stepSize=0.1, **tree), **cols)
    raise ValueError(kind)


def _text(df: DataFrame, column: str):
    return pair_text(F.col("premise_text"), F.col("hypothesis_text")) if column == "joined" else F.col(column)


def _vectorize_text(df: DataFrame, block: TextBlock, vocab: list[str], idf: list[float] | None,
                    out: str) -> DataFrame:
    toks = df.withColumn("_u", V.unigrams(_text(df, block.column), block.spec))
    if block.spec.bigrams:
        toks = toks.withColumn("_u", V.with_bigrams(F.col("_u")))
    cv = CountVectorizerModel.from_vocabulary(vocab or ["\u0000"], inputCol="_u", outputCol=f"{out}_tf")
    v = cv.transform(toks).drop("_u")
    if idf is None:
        return v.withColumnRenamed(f"{out}_tf", out)
    w = ElementwiseProduct(scalingVec=Vectors.dense(idf or [0.0]), inputCol=f"{out}_tf", outputCol=f"{out}_w")
    n = Normalizer(p=2.0, inputCol=f"{out}_w", outputCol=out)
    return n.transform(w.transform(v)).drop(f"{out}_tf", f"{out}_w")


def fit_predict(spark: SparkSession, sf_dir: str, exp: Experiment, total_sample: int = 10_000,
                save_dir: str | None = None, effort: Effort = Effort()) -> DataFrame:
    """Fit ``exp`` per training dataset and score every test split.
    -> model, doc_id, dataset, y, pred.  ``save_dir``: persist each fitted
    PipelineModel (S14) under save_dir/<experiment>/<dataset>."""
    prepare = grid.train_test if exp.syntactic is None else grid.feature_train_test
    train, test = prepare(spark, sf_dir, total_sample)
    dsets = grid.datasets_of(train)
    syn_tr = syn_te = None
    if exp.syntactic is not None:
        syn_tr, syn_te = grid.syntactic_vectors(train, test, dsets, exp.syntactic,
                                                list(exp.marks) if exp.marks else None)
    preds = None
    for m in dsets:
        tr = train.where(F.col("dataset") == m)
        te = test
        cols = []
        for i, b in enumerate(exp.blocks):
            fit_text = (pair_text(F.col("premise_text"), F.col("hypothesis_text"))
                        if b.fit_on == "joined" else _text(tr, b.column))
            if b.tfidf:
                idf_df = grid.fit_tfidf(tr, [m], b.spec, fit_text)
                rows = idf_df.orderBy("idx").select("term", "idf").collect()   # <= max_features rows
                vocab, idf = [r.term for r in rows], [float(r.idf) for r in rows]
            else:
                vocab = V.collect_vocab(grid.fit_vocabs(tr, [m], b.spec, fit_text), b.spec.max_features)
                idf = None
            tr = _vectorize_text(tr, b, vocab, idf, f"b{i}")
            te = _vectorize_text(te, b, vocab, idf, f"b{i}")
            cols.append(f"b{i}")
        if syn_tr is not None:
            s_tr = syn_tr.where(F.col("model") == m).select(F.col("train_id").alias("pair_id"),
                                                            array_to_vector("vec").alias("syn_vec"))
            s_te = syn_te.where(F.col("model") == m).select("doc_id", array_to_vector("vec").alias("syn_vec"))
            tr = tr.join(s_tr, "pair_id")
            te = te.join(s_te, te.pair_id == s_te.doc_id).drop("doc_id")
            cols.append("syn_vec")
        asm = VectorAssembler(inputCols=cols, outputCol="features")
        tr_v = asm.transform(tr).select(F.col("label").cast("double").alias("label"), "features")
        tr_v = materialize(tr_v)   # the bounded training sample, read once for each pass of the learner
        n_train = tr_v.count()
        if tr_v.select("label").distinct().count() < 2:   # nothing to separate: no model for this dataset
            continue
        pipe = Pipeline(stages=[learner(exp.learner, n_train, effort=effort)])
        model: PipelineModel = pipe.fit(tr_v)
        if save_dir:
            model.write().overwrite().save(f"{save_dir.rstrip('/')}/{exp.key}/{m}")
        out = model.transform(asm.transform(te)).select(
            F.lit(m).alias("model"), F.col("pair_id").alias("doc_id"), "dataset",
            F.col("label").alias("y"), F.col("prediction").cast("int").alias("pred"))
        preds = out if preds is None else preds.unionByName(out)
    return preds
