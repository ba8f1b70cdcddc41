"""Tree experiments on text and parse features (M1, M4, M8, M9) as Spark jobs over sparse cells.

Every function works on (model, doc_id) keys, so the models of all training
datasets, and equally those of folds or feature groups, are fitted and
scored together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inferna.functions import parse as P
from inferna.functions.text import pair_text
from inferna.operators import trees
from inferna.operators import vectorize as V
from inferna.plans import grid
from inferna.session import materialize


@dataclass(frozen=True)
class Block:
    """Terms of one text column in the features from ``offset`` on; ``tfidf``: weighted and normalised."""
    column: str | None           # None: premise and hypothesis joined
    spec: V.TermSpec
    offset: int
    tfidf: bool = False


@dataclass(frozen=True)
class TreeExperiment:
    blocks: tuple[Block, ...]
    syntactic: int | None        # offset of the syntactic features
    spec: trees.Spec


def _two(k: int, bigrams: bool, tfidf: bool) -> tuple[Block, ...]:
    spec = V.TermSpec(k, bigrams=bigrams, stop_words=True)
    return Block("premise_text", spec, 0, tfidf), Block("hypothesis_text", spec, k, tfidf)


#: Depth, trees and stages of the registered queries; the library takes any.  Each level is a job.
EXPERIMENTS = {
    "baseline-1": TreeExperiment((Block(None, V.TermSpec(10_000), 0),), None, trees.Spec(depth=20, bins=16)),
    "experiment-1": TreeExperiment((), 0, trees.Spec(depth=20, bins=32)),
    "experiment-5": TreeExperiment(_two(2_500, False, False), 5_000, trees.Spec(depth=12, bins=16, trees=20, forest=True)),
    "experiment-6": TreeExperiment(_two(5_000, True, True), 10_000, trees.Spec(depth=3, bins=16, stages=10)),
}


def _text(block: Block) -> Column:
    return pair_text(F.col("premise_text"), F.col("hypothesis_text")) if block.column is None else F.col(block.column)


def fit_vocabulary(train: DataFrame, block: Block) -> DataFrame:
    """(model, term, idx, idf): the most frequent terms of each model's training rows, numbered by term; idf is 1 without tf-idf."""
    terms = V.doc_terms(train, "doc_id", _text(block), block.spec, keep=["model"])
    total = terms.groupBy("model", "term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    first = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("total"), "term"))
    top = total.withColumn("r", first).where(F.col("r") <= block.spec.max_features)
    top = top.withColumn("idx", (F.row_number().over(Window.partitionBy("model").orderBy("term")) - 1).cast("int"))
    if not block.tfidf:
        return materialize(top.select("model", "term", "idx", F.lit(1.0).alias("idf")))
    docs = train.groupBy("model").agg(F.count("*").alias("n"))
    idf = F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0
    return materialize(top.join(docs, "model").select("model", "term", "idx", idf.alias("idf")))


def text_cells(docs: DataFrame, vocabulary: DataFrame, block: Block, own: bool) -> DataFrame:
    """(model, doc_id, f, x) of ``docs`` under its own model's vocabulary, or under every model's."""
    keep = ["model"] if own else []
    terms = V.doc_terms(docs, "doc_id", _text(block), block.spec, keep=keep)
    cells = terms.join(vocabulary, [*keep, "term"]).select("model", "doc_id", (F.col("idx") + block.offset).cast("int").alias("f"), (F.col("tf") * F.col("idf")).alias("x"))
    if block.tfidf:
        norm = cells.groupBy("model", "doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        cells = cells.join(norm, ["model", "doc_id"]).select("model", "doc_id", "f", (F.col("x") / F.col("norm")).alias("x"))
    return cells.select("model", "doc_id", "f", F.round(F.col("x").cast("double"), 6).alias("x")).where("x > 0")


def syntactic_list(train: DataFrame) -> DataFrame:
    """(model, feature, pos): the features that occur in each model's training rows, in order of name."""
    names = train.select("model", F.explode_outer(F.map_keys("syn")).alias("feature")).where("feature is not null").distinct()
    return names.withColumn("pos", (F.row_number().over(Window.partitionBy("model").orderBy("feature")) - 1).cast("int"))


def syntactic_cells(docs: DataFrame, names: DataFrame, offset: int, own: bool) -> DataFrame:
    keep = ["model"] if own else []
    long = docs.select(*keep, "doc_id", F.explode_outer("syn").alias("feature", "value")).where("value > 0")
    return long.join(names, [*keep, "feature"]).select("model", "doc_id", (F.col("pos") + offset).cast("int").alias("f"), F.round("value", 6).alias("x")).where("x > 0")


@dataclass
class Prepared:
    """Cells of training and test rows under every model, and each model's number of features."""
    train: DataFrame      # model, doc_id, label
    cells: DataFrame      # model, doc_id, f, x
    test: DataFrame       # model, doc_id, dataset, y
    test_cells: DataFrame
    width: dict[str, int]


def prepare(train: DataFrame, test: DataFrame, experiment: TreeExperiment) -> Prepared:
    """``train`` (model, doc_id, label, texts, syn) and ``test`` (doc_id, dataset, y, texts, syn), which meets every model, or its own if it has a column model."""
    own = "model" in test.columns
    parts, test_parts = [], []
    for block in experiment.blocks:
        vocabulary = fit_vocabulary(train, block)
        parts.append(text_cells(train, vocabulary, block, True))
        test_parts.append(text_cells(test, vocabulary, block, own))
    if experiment.syntactic is not None:
        names = materialize(syntactic_list(train))
        parts.append(syntactic_cells(train, names, experiment.syntactic, True))
        test_parts.append(syntactic_cells(test, names, experiment.syntactic, own))
    union = lambda x: x[0] if len(x) == 1 else union([x[0].unionByName(x[1]), *x[2:]])
    cells = materialize(union(parts))
    width = {r.model: r.w for r in cells.groupBy("model").agg((F.max("f") + 1).alias("w")).collect()}
    models = train.select("model").distinct()
    width = {r.model: width.get(r.model, 0) for r in models.collect()}
    if own:
        return Prepared(train.select("model", "doc_id", "label"), cells, test.select("model", "doc_id", "dataset", "y"), union(test_parts), width)
    every = F.explode(F.array(*[F.lit(m) for m in sorted(width)])) if width else F.lit(None).cast("string")
    scored = test.select(every.alias("model"), "doc_id", "dataset", "y").where("model is not null")
    return Prepared(train.select("model", "doc_id", "label"), cells, scored, union(test_parts), width)


def fit(spark: SparkSession, data: Prepared, spec: trees.Spec):
    """(model table, training losses by stage) of all models of ``data``."""
    values = materialize(trees.fit_bins(data.cells, spec.bins))
    rows = trees.training_rows(data.train, data.cells, values, spec)
    if spec.stages:
        first, forest, losses = trees.boost(rows, data.width, spec)
        return trees.as_table(spark, forest, values, first), losses
    return trees.as_table(spark, trees.grow_classes(rows, data.width, spec), values), []


def train_test(spark: SparkSession, sf_dir: str, syntactic: bool, total_sample: int = 10_000):
    """Training sample as (model, doc_id, label, texts, syn), test split as (doc_id, dataset, y, texts, syn)."""
    train, test = (grid.feature_train_test if syntactic else grid.train_test)(spark, sf_dir, total_sample)
    syn = [F.col("syn")] if syntactic else []
    return (train.select(F.col("dataset").alias("model"), F.col("pair_id").alias("doc_id"), "label", "premise_text", "hypothesis_text", *syn),
            test.select(F.col("pair_id").alias("doc_id"), "dataset", F.col("label").alias("y"), "premise_text", "hypothesis_text", *syn))


def fit_predict(spark: SparkSession, sf_dir: str, key: str, spec: trees.Spec | None = None) -> DataFrame:
    """Predictions (model, doc_id, dataset, y, pred) of every model on every test pair."""
    experiment = EXPERIMENTS[key]
    train, test = train_test(spark, sf_dir, experiment.syntactic is not None)
    data = prepare(train, test, experiment)
    table, _ = fit(spark, data, spec or experiment.spec)
    return trees.predict(table, data.test, data.test_cells)


def ablation(spark: SparkSession, sf_dir: str, spec: trees.Spec, k: int = 5, total_sample: int = 10_000) -> DataFrame:
    """Tree and exact nearest neighbours on each feature group alone, scored on the validation split.

    The model key is dataset|group, so all trees grow together and all neighbour
    searches are one job.  -> metrics by (learner, dataset, feature_group)."""
    from inferna.operators import metrics, sample
    from inferna.operators.features import pair_features
    from inferna.operators.knn import knn_predict
    from inferna.sources import tables as src
    feats = pair_features(src.nli_raw(spark, sf_dir)).select("pair_id", "dataset", "split", "label", "syn").where("split <> 'test'")
    feats = materialize(feats, ["split"])
    sampled = materialize(sample.stratified_sample(feats.where("split = 'train'"), total_sample).select("pair_id", "dataset", "label", "syn"))
    valid = feats.where("split = 'validation'")
    groups = {"dependency": P.DEPENDENCY_MARKS, "constituency": P.CONSTITUENCY_MARKS}
    train, tr, te = None, None, None
    for name, marks in groups.items():
        part = sampled.select(F.concat("dataset", F.lit(f"|{name}")).alias("model"), F.col("pair_id").alias("doc_id"), "label",
                              F.map_filter("syn", lambda key, _: P.in_group(key, marks)).alias("syn"))
        train = part if train is None else train.unionByName(part)
        x, q = grid.syntactic_vectors(sampled, valid, grid.datasets_of(sampled), "standard", marks)
        x, q = (t.withColumn("model", F.concat("model", F.lit(f"|{name}"))) for t in (x, q.where("model = dataset")))
        tr, te = (x, q) if tr is None else (tr.unionByName(x), te.unionByName(q))
    data = prepare(train, valid.select(F.col("pair_id").alias("doc_id"), "dataset", F.col("label").alias("y"), "syn"), TreeExperiment((), 0, spec))
    own = F.startswith("model", F.concat("dataset", F.lit("|")))
    table, _ = fit(spark, data, spec)
    tree = trees.predict(table, data.test.where(own), data.test_cells)
    near = knn_predict(tr, te, "vec", k, "euclidean", tie_decimals=9)
    both = tree.withColumn("learner", F.lit("decision_tree")).unionByName(near.withColumn("learner", F.lit("knn")))
    cells = both.select("learner", "dataset", F.split_part("model", F.lit("|"), F.lit(2)).alias("feature_group"), "y", "pred")
    return metrics.evaluate(cells, ["learner", "dataset", "feature_group"], decimals=6)


#: Learners of the cross-validation that are tree learners, with the effort of the registered queries.
CV_TREES = {"decision_tree": EXPERIMENTS["experiment-1"].spec, "random_forest": EXPERIMENTS["experiment-5"].spec, "gradient_boosting": EXPERIMENTS["experiment-6"].spec}


def cross_validate(spark: SparkSession, sf_dir: str, learners: tuple[str, ...] = ("decision_tree", "knn"), folds: int = 5, k: int = 5,
                   total_sample: int = 10_000) -> DataFrame:
    """Stratified folds of each training sample on parse features; learners are knn and the keys of CV_TREES.

    The model key is dataset|fold: every row trains the models of the other folds and
    is scored by its own fold's, so a learner fits and scores all folds in one go.
    -> A14 summary by (learner, dataset)."""
    from inferna.operators import metrics, sample
    from inferna.operators.features import pair_features
    from inferna.operators.knn import knn_predict
    from inferna.sources import tables as src
    feats = pair_features(src.nli_raw(spark, sf_dir).where("split = 'train'")).select("pair_id", "dataset", "split", "label", "syn")
    sampled = sample.kfold(sample.stratified_sample(feats, total_sample), folds, group_cols=["dataset"])
    sampled = materialize(sampled.select("pair_id", "dataset", "label", "syn", "fold"))
    model = F.concat("dataset", F.lit("|"), F.col("m").cast("string"))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda i: i != F.col("fold")))
    train = sampled.select("*", others.alias("m")).select(model.alias("model"), F.col("pair_id").alias("doc_id"), "label", "syn")
    test = sampled.withColumn("m", F.col("fold")).select(model.alias("model"), F.col("pair_id").alias("doc_id"), model.alias("dataset"), F.col("label").alias("y"), "syn")
    pred = []
    for name in learners:
        if name == "knn":
            # the vectors of each fold model, scaled with its own training rows
            as_train = train.select("doc_id", F.col("model").alias("dataset"), "label", "syn").withColumnRenamed("doc_id", "pair_id")
            as_test = test.select("doc_id", "dataset", F.col("y").alias("label"), "syn").withColumnRenamed("doc_id", "pair_id")
            tr, te = fold_vectors(as_train, as_test)
            found = knn_predict(tr, te, "vec", k, "euclidean", tie_decimals=9)
        else:
            spec = CV_TREES[name]
            data = prepare(train, test, TreeExperiment((), 0, spec))
            found = trees.predict(fit(spark, data, spec)[0], data.test, data.test_cells)
        pred.append(found.select(F.lit(name).alias("learner"), F.split_part("dataset", F.lit("|"), F.lit(1)).alias("dataset"),
                                 F.split_part("dataset", F.lit("|"), F.lit(2)).cast("int").alias("fold"), "y", "pred"))
    every = pred[0]
    for p in pred[1:]:
        every = every.unionByName(p)
    per_fold = metrics.evaluate(every, ["learner", "dataset", "fold"], decimals=6)
    return metrics.cv_summary(per_fold, ["learner", "dataset"], decimals=6)


def fold_vectors(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Z-scored aligned vectors of rows (pair_id, dataset, label, syn) whose dataset names their model; each test row under its own."""
    lists = syntactic_list(train.withColumnRenamed("dataset", "model"))
    dense = lists.groupBy("model").agg(F.sort_array(F.collect_list("feature")).alias("names"))  # bounded by the tag vocabulary

    def aligned(df: DataFrame) -> DataFrame:
        value = F.transform("names", lambda n: F.coalesce(F.try_element_at("syn", n), F.lit(0.0)))
        return df.join(dense, df["dataset"] == dense["model"]).select("model", "pair_id", "dataset", "label", value.alias("a"))

    a = materialize(aligned(train))
    stats = a.select("model", F.posexplode_outer("a").alias("pos", "v")).groupBy("model", "pos").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd")) \
        .groupBy("model").agg(F.sort_array(F.collect_list(F.struct("pos", "mu", "sd"))).alias("st"))

    def scaled(df: DataFrame) -> DataFrame:
        z = F.zip_with("a", "st", lambda x, s: (x - s["mu"]) / F.when(s["sd"] > 0, s["sd"]).otherwise(1.0))
        return df.join(stats, "model").withColumn("vec", z)

    return (scaled(a).select("model", F.col("pair_id").alias("train_id"), "label", "vec"),
            scaled(aligned(test)).select("model", F.col("pair_id").alias("doc_id"), "dataset", F.col("label").alias("y"), "vec"))
