"""Registry of named queries: a Spark builder and (where SQL can express it)
an independent DuckDB oracle string.  ``__spark_entry__`` only re-exports.

Every builder takes (spark, sf_dir) and returns a lazy DataFrame over the
whole driver tables.  Floating results are rounded to 6 decimals on both
sides so that the two engines' summation order cannot change the hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inferna.functions import text as T
from inferna.operators import clean
from inferna.plans.oracle import text_stats_select, with_ctes
from inferna.sources import tables as src

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---- step 1: sources, cleaning ------------------------------------------

@register("load_splits", with_ctes(["nli_raw"], "SELECT * FROM nli_raw"))
def q_load_splits(spark, sf):
    return src.load_splits(src.nli_raw(spark, sf))


@register("load_dev_alias", with_ctes(["nli_raw"],
          "SELECT id, dataset, label FROM nli_raw WHERE split = 'validation'"))
def q_load_dev_alias(spark, sf):
    # The logical split 'dev' resolves to the stored split 'validation'
    return src.load_splits(src.nli_raw(spark, sf), split="dev").select("id", "dataset", "label")


@register("round_union", with_ctes(["nli_raw"],
          "SELECT id, round, 'r' || CAST(round AS VARCHAR) AS anli_round FROM nli_raw"))
def q_round_union(spark, sf):
    return src.round_union(src.nli_raw(spark, sf)).select("id", "round", "anli_round")


@register("label_map_strings", with_ctes(["nli_raw_str"], """
SELECT id, label, CAST(coalesce(CASE lower(trim(label)) WHEN 'entailment' THEN 0 WHEN 'neutral' THEN 1
       WHEN 'contradiction' THEN 2 END, TRY_CAST(lower(trim(label)) AS INTEGER), -1) AS INTEGER) AS y
FROM nli_raw_str"""))
def q_label_map_strings(spark, sf):
    raw = src.nli_raw_str(spark, sf)
    return raw.select("id", "label", clean.label_to_int(F.col("label")).alias("y"))


@register("clean_labels", with_ctes(["nli_raw_str"], """
SELECT id, dataset, split, y FROM (
  SELECT id, dataset, split, CAST(coalesce(CASE lower(trim(label)) WHEN 'entailment' THEN 0 WHEN 'neutral' THEN 1
         WHEN 'contradiction' THEN 2 END, TRY_CAST(lower(trim(label)) AS INTEGER), -1) AS INTEGER) AS y
  FROM nli_raw_str) t WHERE y >= 0"""))
def q_clean_labels(spark, sf):
    return clean.clean_labels(src.nli_raw_str(spark, sf)).select("id", "dataset", "split", "y")


@register("standardize_columns", with_ctes(["nli_raw"],
          "SELECT id, premise_text, hypothesis_text FROM nli_raw"))
def q_standardize_columns(spark, sf):
    return clean.standardize_columns(src.nli_raw_s12(spark, sf)).select(
        "id", "premise_text", "hypothesis_text")


@register("quality_counts", with_ctes(["nli_raw"], """
SELECT dataset, split, count(*) AS n_rows,
  count_if(premise_text IS NULL) AS null_premise_text,
  count_if(hypothesis_text IS NULL) AS null_hypothesis_text,
  count_if(label IS NULL OR label < 0) AS invalid_label
FROM nli_raw GROUP BY dataset, split"""))
def q_quality_counts(spark, sf):
    return clean.quality_counts(src.nli_raw(spark, sf), ["premise_text", "hypothesis_text"],
                                group_cols=["dataset", "split"])


# ---- step 3: text statistics -------------------------------------------

def text_stats(df: DataFrame, keep: list[str]) -> DataFrame:
    stats = T.text_stats_cols(F.col("premise_text"), F.col("hypothesis_text"))
    out = df.select(F.col("id").alias("pair_id"), *keep, *stats)
    return out.withColumns({"length_ratio": r6("length_ratio"),
                            "word_overlap_ratio": r6("word_overlap_ratio")})


@register("text_stats", with_ctes(["valid_pairs"], text_stats_select("valid_pairs", extra="label,")))
def q_text_stats(spark, sf):
    return text_stats(clean.valid_pairs(src.nli_raw(spark, sf)), ["label"])


@register("conv_text_stats", with_ctes(["conv_pairs"], text_stats_select("conv_pairs")))
def q_conv_text_stats(spark, sf):
    return text_stats(src.conv_pairs(spark, sf), [])


@register("nan_fill", with_ctes(["nli_raw"], text_stats_select("nli_raw", extra="label,")))
def q_nan_fill(spark, sf):
    # P18 on all pairs, NULL hypotheses included: ratio of an empty side -> 1.0
    raw = src.nli_raw(spark, sf)
    feats = text_stats(raw, ["label"])
    return clean.fill_feature_nans(feats, T.TEXT_STAT_NAMES)


# ---- step 2: dictionary + joins -----------------------------------------
from inferna.functions import parse as P  # noqa: E402
from inferna.operators import annotate, dictionary, features  # noqa: E402


@register("unique_sentences", with_ctes(["sentences_all"], "SELECT id, text, role FROM sentences_all"))
def q_unique_sentences(spark, sf):
    return dictionary.unique_sentences(src.nli_raw(spark, sf))


@register("hypothesis_only", with_ctes(["nli_raw"], """
SELECT DISTINCT md5(hypothesis_text) AS id, hypothesis_text AS text FROM nli_raw
WHERE hypothesis_text IS NOT NULL AND trim(hypothesis_text) <> ''
  AND md5(hypothesis_text) NOT IN (SELECT md5(premise_text) FROM nli_raw
                                   WHERE premise_text IS NOT NULL AND trim(premise_text) <> '')"""))
def q_hypothesis_only(spark, sf):
    return dictionary.hypothesis_only(src.nli_raw(spark, sf))


@register("build_pairs", with_ctes(["vpairs"], """
SELECT pair_id AS id, dataset, split, premise_id, hypothesis_id, label FROM vpairs"""))
def q_build_pairs(spark, sf):
    return dictionary.build_pairs(src.nli_raw(spark, sf))


@register("pair_filter_report", with_ctes(["nli_raw"], """
SELECT dataset, split, count(*) AS n_pairs,
  count_if(NOT nt AND NOT ni AND NOT bl) AS kept, count_if(nt) AS dropped_null_text,
  count_if(ni) AS dropped_no_id, count_if(NOT nt AND NOT ni AND bl) AS dropped_label
FROM (SELECT dataset, split,
        premise_text IS NULL OR hypothesis_text IS NULL AS nt,
        premise_text IS NOT NULL AND hypothesis_text IS NOT NULL
          AND (trim(premise_text) = '' OR trim(hypothesis_text) = '') AS ni,
        label IS NULL OR label < 0 AS bl FROM nli_raw) t
GROUP BY dataset, split"""))
def q_pair_filter_report(spark, sf):
    return dictionary.pair_filter_report(src.nli_raw(spark, sf))


@register("join_pair_text", with_ctes(["vpairs", "sentences_all"], """
SELECT p.pair_id, p.dataset, p.split, p.label, coalesce(a.text, '') AS premise_text,
       coalesce(b.text, '') AS hypothesis_text, p.premise_id, p.hypothesis_id
FROM vpairs p LEFT JOIN sentences_all a ON a.id = p.premise_id
LEFT JOIN sentences_all b ON b.id = p.hypothesis_id"""))
def q_join_pair_text(spark, sf):
    raw = src.nli_raw(spark, sf)
    return dictionary.join_pair_text(dictionary.build_pairs(raw), dictionary.unique_sentences(raw))


# ---- step 4: annotation + parse features --------------------------------

def _pairs(spark, sf):
    return features.valid_pairs_with_ids(src.nli_raw(spark, sf))


def _parses(spark, sf):
    return annotate.annotate_rules(features.pair_sentences(_pairs(spark, sf)))


def _sentence_feats(spark, sf):
    return features.sentence_features(_parses(spark, sf))


def _pair_features(spark, sf):
    return features.pair_features(src.nli_raw(spark, sf))


@register("parse_trees", with_ctes(["const_str"], "SELECT sid AS sentence_id, constituency FROM const_str"))
def q_parse_trees(spark, sf):
    return _parses(spark, sf).select("sentence_id", "constituency")


@register("dep_edges", with_ctes(["dep_edges"], """
SELECT sid AS sentence_id, CAST(id AS BIGINT) AS id, text, lemma, pos, CAST(head AS BIGINT) AS head, deprel
FROM dep_edges"""))
def q_dep_edges(spark, sf):
    e = _parses(spark, sf).select("sentence_id", F.explode_outer("dependency").alias("e")) \
        .where(F.col("e").isNotNull())
    return e.select("sentence_id", F.col("e.id").cast("long").alias("id"), "e.text", "e.lemma", "e.pos",
                    F.col("e.head").cast("long").alias("head"), "e.deprel")


@register("import_trees", SQL["dep_edges"])
def q_import_trees(spark, sf):
    # Trees stored as text, read back into typed edges
    from inferna.sources.trees_text import export_edges, import_edges
    stored = _parses(spark, sf).select("sentence_id", export_edges(F.col("dependency")).alias("tree"))
    e = stored.select("sentence_id", F.explode_outer(import_edges(F.col("tree"))).alias("e")).where(F.col("e").isNotNull())
    return e.select("sentence_id", F.col("e.id").cast("long").alias("id"), "e.text", "e.lemma", "e.pos",
                    F.col("e.head").cast("long").alias("head"), "e.deprel")


_CONST_KEYS = ["tree_depth"] + [f"count_{p}" for p in P.PHRASES]


@register("const_counts", with_ctes(["sfeat"], "SELECT sid AS sentence_id, "
          + ", ".join(f"max(CASE WHEN k = '{k}' THEN v END) AS {k}" for k in _CONST_KEYS)
          + " FROM sfeat WHERE kind = 'const' GROUP BY sid"))
def q_const_counts(spark, sf):
    parses = _parses(spark, sf).where(F.trim("constituency") != "")   # F17: blank tree -> no keys
    s = features.sentence_features(parses)
    return s.select("sentence_id", *[F.col("const")[k].alias(k) for k in _CONST_KEYS])


def _dep_counts(spark, sf, prefix, name):
    s = _sentence_feats(spark, sf).select("sentence_id", F.explode_outer("dep").alias("k", "v"))
    s = s.where(F.col("k").isNotNull() & F.col("k").startswith(prefix))
    return s.select("sentence_id", F.expr(f"substring(k, {len(prefix) + 1})").alias(name),
                    F.col("v").cast("long").alias("n"))


@register("dep_pos_counts", with_ctes(["dep_edges"],
          "SELECT sid AS sentence_id, pos, count(*) AS n FROM dep_edges GROUP BY sid, pos"))
def q_dep_pos_counts(spark, sf):
    return _dep_counts(spark, sf, "pos_", "pos")


@register("dep_deprel_counts", with_ctes(["dep_edges"],
          "SELECT sid AS sentence_id, deprel, count(*) AS n FROM dep_edges GROUP BY sid, deprel"))
def q_dep_deprel_counts(spark, sf):
    return _dep_counts(spark, sf, "deprel_", "deprel")


@register("dep_distances", with_ctes(["dstats"], """
SELECT sid AS sentence_id, dep_tree_depth_proxy, round(avg_dep_dist, 6) AS avg_dep_dist,
       max_dep_dist, root_children_count FROM dstats"""))
def q_dep_distances(spark, sf):
    s = _sentence_feats(spark, sf)
    return s.select("sentence_id", F.col("dep")["dep_tree_depth_proxy"].alias("dep_tree_depth_proxy"),
                    r6(F.col("dep")["avg_dep_dist"]).alias("avg_dep_dist"),
                    F.col("dep")["max_dep_dist"].alias("max_dep_dist"),
                    F.col("dep")["root_children_count"].alias("root_children_count"))


@register("syntactic_diff", with_ctes(["pfeat"], """
SELECT pair_id, feature, round(value, 6) AS value FROM pfeat WHERE feature LIKE 'diff\\_%' ESCAPE '\\'"""))
def q_syntactic_diff(spark, sf):
    long = features.syn_long(_pair_features(spark, sf))
    return long.where(F.col("feature").startswith("diff_")).withColumn("value", r6("value"))


# Fixed feature list used to check schema padding (P17): present and absent keys.
WIDE_FEATURES = ["premise_const_count_NP", "hypothesis_const_count_NP", "diff_const_count_PP",
                 "premise_dep_pos_VERB", "hypothesis_dep_pos_NUM", "diff_dep_deprel_nsubj",
                 "diff_dep_avg_dep_dist", "premise_dep_root_children_count",
                 "hypothesis_const_count_SQ", "diff_dep_pos_X"]


@register("syntactic_wide", with_ctes(["vpairs", "pfeat"], "SELECT p.pair_id, "
          + ", ".join(f"round(coalesce(max(CASE WHEN f.feature = '{n}' THEN f.value END), 0), 6) AS {n}"
                      for n in WIDE_FEATURES)
          + " FROM vpairs p LEFT JOIN pfeat f ON f.pair_id = p.pair_id GROUP BY p.pair_id"))
def q_syntactic_wide(spark, sf):
    w = features.syn_wide(_pair_features(spark, sf), WIDE_FEATURES)
    return w.select("pair_id", *[r6(n).alias(n) for n in WIDE_FEATURES])


def _group_flags(name):
    return [P.in_group(name, P.SYNTACTIC_MARKS).alias("is_syntactic"),
            P.in_group(name, P.LEXICAL_MARKS).alias("is_lexical"),
            P.in_group(name, P.DEPENDENCY_MARKS).alias("is_dependency"),
            P.in_group(name, P.CONSTITUENCY_MARKS).alias("is_constituency")]


def _group_flags_sql(col):
    def any_of(marks):
        return "(" + " OR ".join(f"contains({col}, '{m}')" for m in marks) + ")"
    return (f"{any_of(P.SYNTACTIC_MARKS)} AS is_syntactic, {any_of(P.LEXICAL_MARKS)} AS is_lexical, "
            f"{any_of(P.DEPENDENCY_MARKS)} AS is_dependency, {any_of(P.CONSTITUENCY_MARKS)} AS is_constituency")


@register("feature_groups", with_ctes(["pfeat"], f"""
SELECT feature, {_group_flags_sql('feature')} FROM (
  SELECT DISTINCT feature FROM pfeat
  UNION SELECT unnest(['premise_length', 'hypothesis_length', 'length_diff', 'length_ratio',
                       'word_overlap_count', 'word_overlap_ratio'])) t"""))
def q_feature_groups(spark, sf):
    names = features.feature_list(_pair_features(spark, sf)).select("feature")
    stats = spark.createDataFrame([(n,) for n in T.TEXT_STAT_NAMES], "feature string")
    allf = names.unionByName(stats).distinct()
    return allf.select("feature", *_group_flags(F.col("feature")))


@register("feature_align", with_ctes(["vpairs", "pfeat"], """
, flist AS (SELECT feature, row_number() OVER (ORDER BY feature) AS pos FROM (
    SELECT DISTINCT f.feature FROM pfeat f JOIN vpairs p ON f.pair_id = p.pair_id WHERE p.split = 'train') t)
SELECT p.pair_id, n.nf AS n_features, coalesce(a.nnz, 0) AS n_nonzero, round(coalesce(a.cs, 0), 6) AS checksum
FROM vpairs p CROSS JOIN (SELECT count(*) AS nf FROM flist) n
LEFT JOIN (SELECT f.pair_id, count_if(f.value <> 0) AS nnz, sum(f.value * l.pos) AS cs
           FROM pfeat f JOIN flist l ON f.feature = l.feature GROUP BY f.pair_id) a ON p.pair_id = a.pair_id"""))
def q_feature_align(spark, sf):
    from inferna.session import materialize
    feats = materialize(_pair_features(spark, sf))   # read twice: fit the list, then align
    names = features.collect_feature_list(feats.where(F.col("split") == "train"))
    arr = P.align(F.col("syn"), names)
    return feats.select(
        "pair_id", F.lit(len(names)).cast("long").alias("n_features"),
        F.size(F.filter(arr, lambda x: x != 0)).cast("long").alias("n_nonzero"),
        r6(F.aggregate(F.transform(arr, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b))
        .alias("checksum"))


# ---- step 5: sampling & splits ------------------------------------------
from inferna.operators import sample as S  # noqa: E402

SAMPLE_TOTAL = 10_000   # the reference's preprocessing sample size (8000/1000/1000)


@register("split_sizes", with_ctes(["vpairs"], """
SELECT dataset, t AS total, CAST(floor(t * CAST(0.8 AS DOUBLE)) AS BIGINT) AS train_n,
  CAST(floor(t * CAST(0.1 AS DOUBLE)) AS BIGINT) AS val_n,
  t - CAST(floor(t * CAST(0.8 AS DOUBLE)) AS BIGINT) - CAST(floor(t * CAST(0.1 AS DOUBLE)) AS BIGINT) AS test_n,
  ut AS u_train_n, uv AS u_val_n, t - ut - uv AS u_test_n
FROM (SELECT *, least(CASE WHEN floor(t * CAST(0.1 AS DOUBLE)) = 0 AND t - ut > 0 THEN 1
                           ELSE CAST(floor(t * CAST(0.1 AS DOUBLE)) AS BIGINT) END, t - ut) AS uv
  FROM (SELECT *, CASE WHEN floor(t * CAST(0.8 AS DOUBLE)) = 0 AND t >= 1 THEN 1
                       ELSE CAST(floor(t * CAST(0.8 AS DOUBLE)) AS BIGINT) END AS ut
    FROM (SELECT dataset, count(*) AS t FROM vpairs GROUP BY dataset) a) b) c"""))
def q_split_sizes(spark, sf):
    totals = _pairs(spark, sf).groupBy("dataset").agg(F.count(F.lit(1)).alias("total"))
    return totals.select("dataset", "total", *S.split_sizes_cols(F.col("total")))


def _targets(spark):
    return spark.createDataFrame(list(S.split_targets(SAMPLE_TOTAL).items()), "split string, t long")


@register("strata_sizes", with_ctes(["strata"], "SELECT dataset, split, label, c, n, n_labels FROM strata"))
def q_strata_sizes(spark, sf):
    return S.strata_sizes(_pairs(spark, sf), ["dataset", "split"], _targets(spark))


@register("stratified_sample", with_ctes(["strata"], """
SELECT p.pair_id, p.dataset, p.split, p.label, 'sample' || CAST(z.t AS VARCHAR) AS sample_id
FROM (SELECT pair_id, dataset, split, label,
        row_number() OVER (PARTITION BY dataset, split, label ORDER BY md5('42:' || pair_id)) AS rk
      FROM vpairs) p
JOIN strata z ON z.dataset = p.dataset AND z.split = p.split AND z.label = p.label
WHERE p.rk <= z.n"""))
def q_stratified_sample(spark, sf):
    s = S.stratified_sample(_pairs(spark, sf), SAMPLE_TOTAL)
    return s.select("pair_id", "dataset", "split", "label", "sample_id")


@register("simple_sample", with_ctes(["vpairs", "tg"], """
SELECT pair_id, dataset, split FROM (
  SELECT v.pair_id, v.dataset, v.split, tg.t,
         row_number() OVER (PARTITION BY v.dataset, v.split ORDER BY md5('42:' || v.pair_id)) AS rk
  FROM vpairs v JOIN tg ON tg.split = v.split) x WHERE rk <= t"""))
def q_simple_sample(spark, sf):
    p = _pairs(spark, sf).withColumn("_ok", S.order_key(F.col("pair_id")))
    quotas = _targets(spark).withColumnRenamed("t", "n")
    quotas = p.select("dataset", "split").distinct().join(quotas, "split")
    return S.take_first_n(p, ["dataset", "split"], quotas, "_ok").select("pair_id", "dataset", "split")


@register("train_val_split", with_ctes(["vpairs"], """
SELECT pair_id, dataset, label, CASE WHEN rk <= q THEN 'validation' ELSE 'train' END AS part FROM (
  SELECT pair_id, dataset, label,
    row_number() OVER (PARTITION BY dataset, label ORDER BY md5('42:' || pair_id)) AS rk,
    CAST(round_even(count(*) OVER (PARTITION BY dataset, label) * CAST(0.2 AS DOUBLE), 0) AS BIGINT) AS q
  FROM vpairs WHERE split = 'train') x"""))
def q_train_val_split(spark, sf):
    tr = _pairs(spark, sf).where(F.col("split") == "train").select("pair_id", "dataset", "label")
    return S.train_val_split(tr, 0.2, group_cols=["dataset"]).select("pair_id", "dataset", "label", "part")


@register("kfold_assign", with_ctes(["vpairs"], """
SELECT pair_id, dataset, label,
  CAST((row_number() OVER (PARTITION BY dataset, label ORDER BY md5('42:' || pair_id)) - 1) % 5 AS INTEGER) AS fold
FROM vpairs WHERE split = 'train'"""))
def q_kfold_assign(spark, sf):
    tr = _pairs(spark, sf).where(F.col("split") == "train").select("pair_id", "dataset", "label")
    return S.kfold(tr, 5, group_cols=["dataset"]).select("pair_id", "dataset", "label", "fold")


@register("limit_rows", with_ctes(["vpairs"],
          "SELECT pair_id, label FROM vpairs ORDER BY pair_id LIMIT 100"))
def q_limit_rows(spark, sf):
    return S.limit_rows(_pairs(spark, sf).select("pair_id", "label"), 100)


# ---- steps 6-8: vectorisers, naive Bayes, metrics, grid ----------------
from inferna.operators import metrics as M  # noqa: E402
from inferna.operators import nb as NB  # noqa: E402
from inferna.operators import vectorize as V  # noqa: E402
from inferna.plans import grid  # noqa: E402
from inferna.plans.oracle import WHOLE_TRAIN, metrics_sql  # noqa: E402

_BOW = V.TermSpec(max_features=10_000)


def _train_vocabs(spark, sf, splits=grid.train_test):
    train, test = splits(spark, sf)
    dsets = grid.datasets_of(train)
    vocabs = grid.fit_vocabs(train, dsets, _BOW, T.pair_text(F.col("premise_text"), F.col("hypothesis_text")))
    return train, test, dsets, vocabs


@register("vocab_topk", with_ctes(["vocab_bow"], "SELECT model, term, idx FROM vocab_bow", WHOLE_TRAIN))
def q_vocab_topk(spark, sf):
    return _train_vocabs(spark, sf, grid.whole_splits)[3]


@register("bow_counts", with_ctes(["te_feat"], "SELECT model, doc_id, CAST(f AS INTEGER) AS f, x FROM te_feat", WHOLE_TRAIN))
def q_bow_counts(spark, sf):
    _, test, _, vocabs = _train_vocabs(spark, sf, grid.whole_splits)
    return grid.side_features(test, vocabs, _BOW, own_model=False).select(
        "model", "doc_id", F.col("f").cast("int").alias("f"), "x")


def _nb_model(spark, sf):
    train, test, dsets, vocabs = _train_vocabs(spark, sf)
    n_features = vocabs.groupBy("model").agg((F.count(F.lit(1)) * 2).alias("n_features"))
    tr_feats = grid.side_features(train, vocabs, _BOW, own_model=True, keep=["label"])
    tr_docs = train.select(F.col("dataset").alias("model"), F.col("pair_id").alias("doc_id"), "label")
    return NB.fit(tr_feats, tr_docs, n_features, ["model"])


@register("mnb_params", with_ctes(["nb_cls"], """
SELECT model, label, n_c, round(log_prior, 6) AS log_prior, round(total_count, 6) AS total_count, round(base, 6) AS base
FROM nb_cls"""))
def q_mnb_params(spark, sf):
    classes, _ = _nb_model(spark, sf)
    return classes.select("model", "label", "n_c", r6("log_prior").alias("log_prior"),
                          r6("total_count").alias("total_count"), r6("base").alias("base"))


@register("mnb_feature_logprob", with_ctes(["nb_feat"], """
SELECT model, CAST(f AS INTEGER) AS f, round(d0, 6) AS d0, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM nb_feat"""))
def q_mnb_feature_logprob(spark, sf):
    _, fmodel = _nb_model(spark, sf)
    return fmodel.select("model", F.col("f").cast("int").alias("f"), *[r6(f"d{c}").alias(f"d{c}") for c in M.CLASSES])


@register("mnb_predict", with_ctes(["nb_pred"], "SELECT model, doc_id, dataset, y, pred FROM nb_pred"))
def q_mnb_predict(spark, sf):
    return grid.nb_bow_grid(spark, sf)


@register("cross_dataset_matrix", with_ctes(["nb_pred"], metrics_sql(
    "(SELECT 'baseline-3' AS experiment, dataset AS predict_dataset, model AS trained_dataset, y, pred "
    "FROM nb_pred) g", ["experiment", "predict_dataset", "trained_dataset"])))
def q_cross_dataset_matrix(spark, sf):
    return grid.cross_dataset_matrix(grid.nb_bow_grid(spark, sf), "baseline-3")


# synthetic predictions over every valid pair (FIXTURES: predictions for metric ops)
_SYN_PRED_SQL = ("(SELECT dataset, label AS y, CAST((label + length(premise_text) % 4 % 3) % 3 AS INTEGER) AS pred "
                 "FROM vpairs) s")


def _syn_pred(spark, sf):
    p = _pairs(spark, sf)
    return p.select("dataset", F.col("label").alias("y"),
                    ((F.col("label") + F.length("premise_text") % 4 % 3) % 3).cast("int").alias("pred"))


@register("confusion", with_ctes(["vpairs"],
          f"SELECT dataset, y, pred, count(*) AS n FROM {_SYN_PRED_SQL} GROUP BY dataset, y, pred"))
def q_confusion(spark, sf):
    return M.confusion(_syn_pred(spark, sf), ["dataset"])


@register("full_metrics", with_ctes(["vpairs"], metrics_sql(_SYN_PRED_SQL, ["dataset"])))
def q_full_metrics(spark, sf):
    return M.evaluate(_syn_pred(spark, sf), ["dataset"], decimals=6)


@register("weighted_prf", with_ctes(["vpairs"],
          "SELECT dataset, n, accuracy, weighted_precision, weighted_recall, weighted_f1 FROM ("
          + metrics_sql(_SYN_PRED_SQL, ["dataset"]) + ") m"))
def q_weighted_prf(spark, sf):
    return M.evaluate(_syn_pred(spark, sf), ["dataset"], decimals=6).select(
        "dataset", "n", "accuracy", "weighted_precision", "weighted_recall", "weighted_f1")


@register("auc_ovr_hard", with_ctes(["vpairs"],
          "SELECT dataset, roc_auc FROM (" + metrics_sql(_SYN_PRED_SQL, ["dataset"]) + ") m"))
def q_auc_ovr_hard(spark, sf):
    return M.evaluate(_syn_pred(spark, sf), ["dataset"], decimals=6).select("dataset", "roc_auc")


# ---- TF-IDF (V3-V5) -------------------------------------------------------
from inferna.plans.oracle import tfidf_sql  # noqa: E402

_TFIDF_SIDE = V.TermSpec(max_features=5_000, bigrams=True, stop_words=True)     # V5: k/2 per side
_TFIDF_SHARED = V.TermSpec(max_features=10_000, bigrams=True, stop_words=True)  # V4: shared


def _tt(spark, sf):
    train, test = grid.whole_splits(spark, sf)
    return train, test, grid.datasets_of(train)


@register("bigram_vocab", with_ctes(["vocab_prem"], "SELECT model, term, idx FROM vocab_prem", WHOLE_TRAIN))
def q_bigram_vocab(spark, sf):
    train, _, dsets = _tt(spark, sf)
    return grid.fit_vocabs(train, dsets, _TFIDF_SIDE, F.col("premise_text"))


@register("tfidf_idf", with_ctes(["idf_prem"],
          "SELECT model, term, idx, df, round(idf, 6) AS idf FROM idf_prem", WHOLE_TRAIN))
def q_tfidf_idf(spark, sf):
    train, _, dsets = _tt(spark, sf)
    idf = grid.fit_tfidf(train, dsets, _TFIDF_SIDE, F.col("premise_text"))
    return idf.select("model", "term", "idx", F.col("df").cast("long").alias("df"), r6("idf").alias("idf"))


@register("tfidf_l2", with_ctes(["idf_prem", "test_s"],
          "SELECT model, doc_id, f, round(x, 6) AS x FROM ("
          + tfidf_sql("idf_prem", "test_s", "premise_text", True, True, None) + ") q", WHOLE_TRAIN))
def q_tfidf_l2(spark, sf):
    train, test, dsets = _tt(spark, sf)
    idf = grid.fit_tfidf(train, dsets, _TFIDF_SIDE, F.col("premise_text"))
    out = grid.tfidf_side(test, idf, _TFIDF_SIDE, "premise_text", None, own_model=False)
    return out.withColumn("x", r6("x"))


@register("shared_vocab_sides", with_ctes(["idf_shared", "test_s"],
          "SELECT model, doc_id, f, round(x, 6) AS x FROM ("
          + tfidf_sql("idf_shared", "test_s", "premise_text", True, True, 0) + " UNION ALL "
          + tfidf_sql("idf_shared", "test_s", "hypothesis_text", True, True, 1) + ") q", WHOLE_TRAIN))
def q_shared_vocab_sides(spark, sf):
    train, test, dsets = _tt(spark, sf)
    idf = grid.fit_tfidf(train, dsets, _TFIDF_SHARED, T.pair_text(F.col("premise_text"), F.col("hypothesis_text")))
    p = grid.tfidf_side(test, idf, _TFIDF_SHARED, "premise_text", 0, own_model=False)
    h = grid.tfidf_side(test, idf, _TFIDF_SHARED, "hypothesis_text", 1, own_model=False)
    return p.unionByName(h).withColumn("x", r6("x"))


# ---- KNN (M5, M10) --------------------------------------------------------
from inferna.plans.oracle import knn_sql  # noqa: E402


@register("knn_cosine", knn_sql("cosine"))
def q_knn_cosine(spark, sf):
    return grid.knn_syntactic_grid(spark, sf, 5, "cosine")


@register("knn_euclid", knn_sql("euclidean"))
def q_knn_euclid(spark, sf):
    return grid.knn_syntactic_grid(spark, sf, 5, "euclidean")


# ---- embeddings (F19, P9, U5) and scalers (V6-V8, V12) ---------------------
from inferna.functions import embed as E  # noqa: E402
from inferna.plans.oracle import emb_sql, scaled_sql, checksum_sql  # noqa: E402


@register("embedding_pair_features", emb_sql())
def q_embedding_pair_features(spark, sf):
    ep = src.embedding_pairs(spark, sf)
    cols = E.embedding_pair_cols(F.col("premise_emb"), F.col("hypothesis_emb"), E.FIRST_DIMS)
    return ep.select("pair_id", "label", *[F.round(c, 6).alias(c._jc.toString().split(" AS ")[-1].strip("`"))
                                           for c in cols])


@register("feature_blocks", with_ctes(["emb_pairs"], f"""
SELECT pair_id, label, CAST(len(premise_emb) AS BIGINT) AS n_premise, CAST(len(hypothesis_emb) AS BIGINT) AS n_hypothesis,
  round({checksum_sql('list_transform(premise_emb, lambda x: coalesce(CAST(x AS DOUBLE), 0))')}, 5) AS premise_checksum,
  round({checksum_sql('list_transform(hypothesis_emb, lambda x: coalesce(CAST(x AS DOUBLE), 0))')}, 5) AS hypothesis_checksum
FROM emb_pairs"""))
def q_feature_blocks(spark, sf):
    # Premise / hypothesis embedding blocks packed as array<double> + label
    ep = src.embedding_pairs(spark, sf)
    p = F.transform("premise_emb", lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    h = F.transform("hypothesis_emb", lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    blocks = ep.select("pair_id", "label", p.alias("pb"), h.alias("hb"))
    return blocks.select("pair_id", "label", F.size("pb").cast("long").alias("n_premise"),
                         F.size("hb").cast("long").alias("n_hypothesis"),
                         F.round(E.positional_checksum(F.col("pb")), 5).alias("premise_checksum"),
                         F.round(E.positional_checksum(F.col("hb")), 5).alias("hypothesis_checksum"))


def _scaled(spark, sf, kind):
    train, test = grid.whole_feature_splits(spark, sf)
    _, te = grid.syntactic_vectors(train, test, grid.datasets_of(train), kind)
    return te.select("model", "doc_id", F.round(E.positional_checksum(F.col("vec")), 5).alias("checksum"),
                     F.size("vec").cast("long").alias("n_features"))


@register("standard_scale", scaled_sql("standard"))
def q_standard_scale(spark, sf):
    return _scaled(spark, sf, "standard")


@register("std_no_mean", scaled_sql("nomean"))
def q_std_no_mean(spark, sf):
    return _scaled(spark, sf, "nomean")


@register("minmax_scale", scaled_sql("minmax"))
def q_minmax_scale(spark, sf):
    return _scaled(spark, sf, "minmax")


# ---- experiment-4 (M7) ------------------------------------------------------
from inferna.plans.oracle import nb_pred_sql  # noqa: E402


@register("mnb_syntactic", with_ctes(["m7_tr", "m7_te", "m7_nf", "test_s", "train_s"],
                                     nb_pred_sql("m7_tr", "m7_te", "m7_nf")))
def q_mnb_syntactic(spark, sf):
    return grid.nb_bow_syntactic_grid(spark, sf)


# ---- Spark ML experiments (rows-only: learner internals differ) ----------
from inferna.plans import models as ML  # noqa: E402


def _ml(key, effort=ML.Effort()):
    def q(spark, sf):
        return ML.fit_predict(spark, sf, ML.EXPERIMENTS[key], effort=effort)
    return q


# No SQL: a solver's internals cannot equal another library's.
QUERIES["lr_tfidf"] = _ml("baseline-2", ML.QUERY_EFFORT)


# ---- tree learners (M1, M4, M8, M9): exact, so SQL states them level by level ----
from inferna.plans import oracle_trees as OT  # noqa: E402
from inferna.plans import tree_models as TM  # noqa: E402


def _trees(name: str, key: str):
    spec = TM.EXPERIMENTS[key].spec
    sql = (OT.boost_sql if spec.stages else OT.classes_sql)(key, spec)

    @register(name, sql)
    def q(spark, sf):
        return TM.fit_predict(spark, sf, key)


_trees("dt_bow", "baseline-1")
_trees("dt_syntactic", "experiment-1")
_trees("rf_bow_syntactic", "experiment-5")
_trees("gbt_tfidf_syntactic", "experiment-6")


@register("feature_ablation", OT.ablation_sql(TM.EXPERIMENTS["experiment-1"].spec))
def q_feature_ablation(spark, sf):
    # {tree, nearest neighbours} x {dependency, constituency} on the validation split
    return TM.ablation(spark, sf, TM.EXPERIMENTS["experiment-1"].spec)


@register("cross_validate", OT.cross_validate_sql(TM.EXPERIMENTS["experiment-1"].spec))
def q_cross_validate(spark, sf):
    # Five folds; tree and nearest neighbours, whose results SQL can state
    return TM.cross_validate(spark, sf)


# ---- batch prediction (M15, P21), grid (M17), CV summary (A14) -----------
from inferna.plans.oracle import cte as _cte  # noqa: E402

_cte("pred_batch", """
SELECT p.doc_id AS pair_id, t.premise_text AS premise, t.hypothesis_text AS hypothesis,
  p.pred AS predicted_label_int,
  CASE p.pred WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' WHEN 2 THEN 'contradiction' ELSE 'unknown' END
    AS predicted_label_str,
  CASE p.y WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' WHEN 2 THEN 'contradiction' ELSE 'unknown' END
    AS true_label_str,
  p.y AS true_label_int, 'baseline-3' AS experiment, p.model AS trained_dataset, p.dataset AS predict_dataset
FROM nb_pred p JOIN test_s t ON t.pair_id = p.doc_id""", ["nb_pred", "test_s"])


def predictions_table(pred: DataFrame, test: DataFrame, experiment: str) -> DataFrame:
    """M15 + P21: the predictions file layout of the reference, per grid cell."""
    t = test.select(F.col("pair_id").alias("doc_id"), F.col("premise_text").alias("premise"),
                    F.col("hypothesis_text").alias("hypothesis"))
    return pred.join(t, "doc_id").select(
        F.col("doc_id").alias("pair_id"), "premise", "hypothesis",
        F.col("pred").alias("predicted_label_int"), clean.decode_label(F.col("pred")).alias("predicted_label_str"),
        clean.decode_label(F.col("y")).alias("true_label_str"), F.col("y").alias("true_label_int"),
        F.lit(experiment).alias("experiment"), F.col("model").alias("trained_dataset"),
        F.col("dataset").alias("predict_dataset"))


@register("predict_batch", with_ctes(["pred_batch"], "SELECT * FROM pred_batch"))
def q_predict_batch(spark, sf):
    _, test = grid.train_test(spark, sf)
    return predictions_table(grid.nb_bow_grid(spark, sf), test, "baseline-3")


@register("evaluate_prediction_files", with_ctes(["pred_batch"], metrics_sql(
    "(SELECT experiment, predict_dataset, trained_dataset, true_label_int AS y, predicted_label_int AS pred "
    "FROM pred_batch) g", ["experiment", "predict_dataset", "trained_dataset"])))
def q_evaluate_prediction_files(spark, sf):
    # S11 -> S12 -> A13: write the prediction files, read them back by glob
    # with the grid keys taken from the folder names, score every cell.
    from inferna.session import scratch_path
    from inferna.sources import store
    import uuid
    _, test = grid.train_test(spark, sf)
    path = scratch_path(spark, f"predictions-{uuid.uuid4().hex}")
    store.write_predictions_csv(predictions_table(grid.nb_bow_grid(spark, sf), test, "baseline-3"), path)
    back = store.read_predictions_csv(spark, path)
    cells = back.select("experiment", "predict_dataset", "trained_dataset",
                        F.col("true_label_int").alias("y"), F.col("predicted_label_int").alias("pred"))
    return M.evaluate(cells, ["experiment", "predict_dataset", "trained_dataset"], decimals=6)


# The reference's model keys (M12) in grid order.
MODEL_KEYS = ["baseline-1", "baseline-2", "baseline-3", "experiment-1", "experiment-2", "experiment-3",
              "experiment-4", "experiment-5", "experiment-6"]


@register("experiment_grid", with_ctes(["vpairs"], """
SELECT m.model_key, t.dataset AS trained_dataset, p.dataset AS predict_dataset
FROM (SELECT unnest(['""" + "', '".join(MODEL_KEYS) + """']) AS model_key) m
CROSS JOIN (SELECT DISTINCT dataset FROM vpairs) t CROSS JOIN (SELECT DISTINCT dataset FROM vpairs) p"""))
def q_experiment_grid(spark, sf):
    # Every model x train set x test set.  The dataset list is a tiny
    # distinct aggregate; cells are generated by exploding literal arrays.
    dsets = grid.datasets_of(_pairs(spark, sf))
    arr = F.array(*[F.lit(d) for d in dsets])
    keys = F.array(*[F.lit(k) for k in MODEL_KEYS])
    base = _pairs(spark, sf).select("dataset").distinct()
    return (base.select(F.col("dataset").alias("trained_dataset"))
            .select(F.explode(keys).alias("model_key"), "trained_dataset")
            .select("model_key", "trained_dataset", F.explode(arr).alias("predict_dataset")))


@register("cv_summary", with_ctes(["vpairs"], """
, f AS (SELECT dataset, label AS y, CAST((label + length(premise_text) % 4 % 3) % 3 AS INTEGER) AS pred,
           CAST((row_number() OVER (PARTITION BY dataset, label ORDER BY md5('42:' || pair_id)) - 1) % 5 AS INTEGER)
             AS fold
         FROM vpairs WHERE split = 'train'),
m AS (""" + metrics_sql("f", ["dataset", "fold"]) + """)
SELECT dataset, round(avg(accuracy), 6) AS mean_accuracy, round(stddev_pop(accuracy), 6) AS std_accuracy,
  round(avg(weighted_precision), 6) AS mean_weighted_precision, round(avg(weighted_recall), 6) AS mean_weighted_recall,
  round(avg(weighted_f1), 6) AS mean_weighted_f1, round(stddev_pop(weighted_f1), 6) AS std_weighted_f1,
  list(weighted_f1 ORDER BY fold) AS f1_per_fold, count(*) AS n_folds
FROM m GROUP BY dataset"""))
def q_cv_summary(spark, sf):
    # A8 folds + A11 per fold + A14 summary, on the synthetic predictions
    tr = _pairs(spark, sf).where(F.col("split") == "train")
    folds = S.kfold(tr, 5, group_cols=["dataset"])
    pred = folds.select("dataset", "fold", F.col("label").alias("y"),
                        ((F.col("label") + F.length("premise_text") % 4 % 3) % 3).cast("int").alias("pred"))
    per_fold = M.evaluate(pred, ["dataset", "fold"], decimals=6)
    return M.cv_summary(per_fold, ["dataset"], decimals=6)


# ---- label and embedding variants ----------------------------------------

@register("float_labels", with_ctes(["nli_raw"], """
SELECT id, CAST(label AS INTEGER) AS y FROM nli_raw WHERE label >= 0"""))
def q_float_labels(spark, sf):
    # P1/P7 on labels stored as doubles, as frames with missing labels hold them
    raw = src.nli_raw(spark, sf).withColumn("label", F.col("label").cast("double"))
    return clean.clean_labels(raw).select("id", "y")


def _blocks_sql() -> str:
    p = "list_transform(premise_emb, lambda x: coalesce(CAST(x AS DOUBLE), 0))"
    h = "list_transform(hypothesis_emb, lambda x: coalesce(CAST(x AS DOUBLE), 0))"
    pair = f"list_transform(list_zip({p}, {h}), lambda z: "
    blocks = {"premise_cls_bert": p, "hypothesis_cls_bert": h, "diff_bert": pair + "coalesce(z[1], 0) - coalesce(z[2], 0))",
              "prod_bert": pair + "coalesce(z[1], 0) * coalesce(z[2], 0))"}
    return with_ctes(["emb_pairs"], "SELECT pair_id, label, " + ", ".join(
        f"round({checksum_sql(b)}, 5) AS {n}" for n, b in blocks.items()) + " FROM emb_pairs")


@register("embedding_pair_blocks", _blocks_sql())
def q_embedding_pair_blocks(spark, sf):
    # All four blocks over all dimensions, a checksum of each
    ep = src.embedding_pairs(spark, sf)
    blocks = E.embedding_pair_blocks(F.col("premise_emb"), F.col("hypothesis_emb"))
    t = ep.select("pair_id", "label", *[b.alias(n) for n, b in blocks.items()])
    return t.select("pair_id", "label", *[F.round(E.positional_checksum(F.col(n)), 5).alias(n) for n in blocks])


@register("encode_sentences", with_ctes(["sentences_all"], "SELECT id AS sentence_id, "
          + ", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS BIGINT) AS {c}" for c in "aeiou")
          + " FROM (SELECT DISTINCT id, text FROM sentences_all)"))
def q_encode_sentences(spark, sf):
    # Every distinct sentence once through the pluggable encoder
    s = dictionary.unique_sentences(src.nli_raw(spark, sf)).select("id", "text").distinct()
    e = E.encode_with(s, E.letter_encoder)
    return e.select("sentence_id", *[F.get("embedding", ord(c) - ord("a")).cast("long").alias(c) for c in "aeiou"])


@register("const_max_depth", with_ctes(["const_str"], """
, b AS (SELECT sid, unnest(list_transform(regexp_extract_all(constituency, '[()]'), lambda x: CASE WHEN x = '(' THEN 1 ELSE -1 END)) AS step,
        unnest(range(len(regexp_extract_all(constituency, '[()]')))) AS place FROM const_str),
r AS (SELECT sid, sum(step) OVER (PARTITION BY sid ORDER BY place) AS depth FROM b)
SELECT c.sid AS sentence_id, CAST(coalesce(max(r.depth), 0) AS INTEGER) AS const_max_depth
FROM const_str c LEFT JOIN r ON c.sid = r.sid GROUP BY c.sid"""))
def q_const_max_depth(spark, sf):
    # True nesting depth
    return _parses(spark, sf).select("sentence_id", P.max_depth(F.col("constituency")).alias("const_max_depth"))


@register("nan_fill_raw", with_ctes(["nli_raw"], """
SELECT id, CASE WHEN coalesce(length(hypothesis_text), 0) = 0 THEN 1.0
  ELSE round(coalesce(length(premise_text), 0) / length(hypothesis_text), 6) END AS length_ratio,
  CASE WHEN coalesce(length(hypothesis_text), 0) = 0 THEN 0.0
  ELSE round(1.0 / length(hypothesis_text), 6) END AS per_char
FROM nli_raw"""))
def q_nan_fill_raw(spark, sf):
    # P18 on raw divisions: 0/0 is NaN and x/0 infinite before the fill
    def length(c):
        return F.coalesce(F.length(c), F.lit(0)).cast("double")

    def divide(a, b):
        return F.when(b != 0, a / b).when(a == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    p, h = length("premise_text"), length("hypothesis_text")
    raw = src.nli_raw(spark, sf).select("id", divide(p, h).alias("length_ratio"), divide(F.lit(1.0), h).alias("per_char"))
    filled = clean.fill_feature_nans(raw, ["length_ratio", "per_char"])
    return filled.select("id", F.round("length_ratio", 6).alias("length_ratio"), F.round("per_char", 6).alias("per_char"))


@register("shuffle_head", with_ctes(["vpairs"], "SELECT pair_id, md5('42:' || pair_id) AS order_key FROM vpairs"))
def q_shuffle_head(spark, sf):
    # Every row in the reproducible shuffled order, with the key that orders it
    return S.shuffle_rows(_pairs(spark, sf)).select("pair_id", S.order_key(F.col("pair_id")).alias("order_key"))


@register("label_realign", with_ctes(["train_s", "pfeat"], """
SELECT t.pair_id, t.dataset, t.label, length(t.premise_text) AS premise_chars, f.n_features
FROM train_s t JOIN (SELECT pair_id, count(*) AS n_features FROM pfeat WHERE contains(feature, '_dep_') GROUP BY pair_id) f ON f.pair_id = t.pair_id"""))
def q_label_realign(spark, sf):
    # J4 + J7: texts and parse features that were cleaned apart, kept where both sides are left; the label travels with its row
    train, _ = grid.train_test(spark, sf)
    from inferna.session import materialize
    feats = src_features(spark, sf)
    counted = feats.select("pair_id", F.size(F.map_filter("syn", lambda k, _: F.contains(k, F.lit("_dep_")))).cast("long").alias("n_features"))
    sides = materialize(counted).where("n_features > 0")   # read twice, and no filter below the maps that derives them again
    labels = train.select("pair_id", "dataset", "label").join(sides, "pair_id", "left_semi")
    texts = train.select("pair_id", F.length("premise_text").cast("long").alias("premise_chars"))
    return labels.join(texts, "pair_id").join(sides, "pair_id").select("pair_id", "dataset", "label", "premise_chars", "n_features")


def src_features(spark, sf) -> DataFrame:
    from inferna.operators.features import pair_features
    return pair_features(src.nli_raw(spark, sf).where("split = 'train'"))


# ---- preprocess job (U6), feature types (U8), extractors and blocks (P13, P9, P20) ----

@register("preprocess_stages", with_ctes(["nli_raw", "vpairs"], """
, units AS (SELECT DISTINCT dataset, split FROM nli_raw),
sides AS (SELECT dataset, split, premise_id AS id FROM vpairs UNION SELECT dataset, split, hypothesis_id FROM vpairs),
counts AS (
  SELECT 'raw_input' AS stage, dataset, split, count(*) AS n FROM nli_raw GROUP BY dataset, split
  UNION ALL SELECT unnest(['pairs', 'features']), dataset, split, count(*) FROM vpairs GROUP BY dataset, split
  UNION ALL SELECT unnest(['sentences', 'parses']), dataset, split, count(*) FROM sides GROUP BY dataset, split),
stages AS (SELECT unnest(['raw_input', 'pairs', 'sentences', 'parses', 'features']) AS stage)
SELECT s.stage, u.dataset, u.split, CAST(coalesce(c.n, 0) AS BIGINT) AS n_rows,
  CAST(CASE WHEN s.stage IN ('parses', 'features') THEN 2 ELSE 1 END AS BIGINT) AS n_built
FROM units u CROSS JOIN stages s
LEFT JOIN counts c ON c.stage = s.stage AND c.dataset = u.dataset AND c.split = u.split"""))
def q_preprocess_stages(spark, sf):
    # All stages built, then reused, then forced from the parses on
    import uuid
    from inferna.plans import preprocess as PP
    from inferna.session import scratch_path
    raw, base = src.nli_raw(spark, sf), scratch_path(spark, f"preprocess-{uuid.uuid4().hex}")
    runs = [PP.preprocess(spark, raw, base, force=force) for force in (None, None, "parses")]
    return PP.stage_counts(spark, runs)


from inferna.operators import feature_sets as FS  # noqa: E402
from inferna.plans.oracle import cte as _feature_cte  # noqa: E402

_feature_cte("vstats", text_stats_select("vpairs", "pair_id", "split, label,"), ["vpairs"])
_STATS = ", ".join(f"s.{n}" for n in T.TEXT_STAT_NAMES)


@register("feature_types", with_ctes(["vstats", "pfeat"], f"""
SELECT s.pair_id, s.label, {_STATS}, CAST(coalesce(f.n, 0) AS BIGINT) AS n_syn, round(coalesce(f.v, 0), 6) AS sum_syn
FROM vstats s LEFT JOIN (SELECT pair_id, count(*) AS n, sum(value) AS v FROM pfeat WHERE contains(feature, '_const_') GROUP BY pair_id) f
ON f.pair_id = s.pair_id"""))
def q_feature_types(spark, sf):
    # U8: text statistics and constituency features; the dependency family is not in the plan
    t = FS.typed_features(src.nli_raw(spark, sf), ("lexical", "constituency"))
    total = F.aggregate(F.map_values("syn"), F.lit(0.0), lambda a, x: a + x)
    return t.select("pair_id", "label", *[r6(n).alias(n) for n in T.TEXT_STAT_NAMES], F.size("syn").cast("long").alias("n_syn"), r6(total).alias("sum_syn"))


def _stored_wide(spark, sf, splits: list[str]) -> list[DataFrame]:
    """The stored wide tables of the named splits, each with the features that its own rows have."""
    from inferna.session import materialize
    raw = src.nli_raw(spark, sf)
    raw = raw if "all" in splits else raw.where(F.col("split").isin(splits))
    # text statistics before the joins: no text travels through them
    feats = materialize(FS.typed_features(raw).select("pair_id", "split", "label", *T.TEXT_STAT_NAMES, "syn"), ["split"])
    parts = [feats if s == "all" else feats.where(F.col("split") == s) for s in splits]
    return [materialize(FS.wide_table(p, features.collect_feature_list(p))) for p in parts]


def _extracted(spark, sf, kind: str) -> tuple[DataFrame, list[str]]:
    """The test split's table by the manifest that was fitted on the training split's and stored."""
    import uuid
    from inferna.session import scratch_path
    train, test = _stored_wide(spark, sf, ["train", "test"])
    path = scratch_path(spark, f"manifest-{uuid.uuid4().hex}")
    FS.save_manifest(spark, FS.manifest(train, kind), path)
    names = FS.load_manifest(spark, path)
    return FS.extract(test, names), names


@register("lexical_features", with_ctes(["vstats"], f"SELECT pair_id, label, {_STATS} FROM vstats s WHERE split = 'test'"))
def q_lexical_features(spark, sf):
    t, names = _extracted(spark, sf, "lexical")
    return t.select("pair_id", "label", *[r6(n).alias(n) for n in names])


@register("combined_features", with_ctes(["vpairs", "vstats", "pfeat"], """
, long AS (SELECT p.split, f.pair_id, f.feature, f.value FROM pfeat f JOIN vpairs p ON p.pair_id = f.pair_id
  UNION ALL SELECT split, pair_id, feature, value FROM (
    SELECT * EXCLUDE (label) FROM vstats) UNPIVOT (value FOR feature IN (""" + ", ".join(T.TEXT_STAT_NAMES) + """))),
names AS (SELECT feature, row_number() OVER (ORDER BY feature) AS pos FROM (
  SELECT DISTINCT feature FROM long WHERE split = 'train' UNION SELECT unnest(['""" + "', '".join(T.TEXT_STAT_NAMES) + """'])) t)
SELECT l.pair_id, any_value(p.label) AS label, (SELECT count(*) FROM names) AS n_columns,
  CAST(count_if(n.pos IS NOT NULL AND l.value <> 0) AS BIGINT) AS n_nonzero, round(coalesce(sum(l.value * n.pos), 0), 4) AS checksum
FROM long l JOIN vpairs p ON p.pair_id = l.pair_id LEFT JOIN names n ON n.feature = l.feature
WHERE l.split = 'test' GROUP BY l.pair_id"""))
def q_combined_features(spark, sf):
    t, names = _extracted(spark, sf, "combined")
    # the two ratios at the six decimals of the stored statistics
    value = [r6(n) if n in T.TEXT_STAT_NAMES else F.col(n) for n in names]
    a = t.select("pair_id", "label", F.array(*value).alias("a"))
    return a.select("pair_id", "label", F.lit(len(names)).cast("long").alias("n_columns"),
                    F.size(F.filter("a", lambda x: x != 0)).cast("long").alias("n_nonzero"), F.round(E.positional_checksum(F.col("a")), 4).alias("checksum"))


def _parse_block_sql(side: str) -> str:
    return f"""{side}n AS (SELECT feature, row_number() OVER (ORDER BY first, feature) AS pos FROM (
  SELECT DISTINCT feature, 1 AS first FROM pfeat WHERE starts_with(feature, '{side}_') UNION ALL SELECT '{side}_length', 0) t),
{side}b AS (SELECT l.pair_id, sum(CAST(CAST(l.value AS FLOAT) AS DOUBLE) * n.pos) AS c FROM (
  SELECT pair_id, feature, value FROM pfeat UNION ALL SELECT pair_id, '{side}_length', {side}_length FROM vstats) l JOIN {side}n n ON n.feature = l.feature GROUP BY l.pair_id)"""


@register("parse_feature_blocks", with_ctes(["vstats", "pfeat"], f"""
, {_parse_block_sql('premise')}, {_parse_block_sql('hypothesis')}
SELECT s.pair_id, s.label, (SELECT count(*) FROM premisen) AS n_premise, (SELECT count(*) FROM hypothesisn) AS n_hypothesis,
  round(p.c, 4) AS premise_checksum, round(h.c, 4) AS hypothesis_checksum
FROM vstats s JOIN premiseb p ON p.pair_id = s.pair_id JOIN hypothesisb h ON h.pair_id = s.pair_id"""))
def q_parse_feature_blocks(spark, sf):
    # The two parse blocks of the stored wide table as float arrays (the embedding blocks: feature_blocks)
    b = FS.pack_blocks(_stored_wide(spark, sf, ["all"])[0])
    total = lambda c: F.round(E.positional_checksum(F.transform(c, lambda x: x.cast("double"))), 4)
    return b.select("pair_id", "label", F.size("premise_parse").cast("long").alias("n_premise"), F.size("hypothesis_parse").cast("long").alias("n_hypothesis"),
                    total(F.col("premise_parse")).alias("premise_checksum"), total(F.col("hypothesis_parse")).alias("hypothesis_checksum"))


# ---- models trained, saved, loaded and evaluated apart (M2, M6, M12-M14, S14) ----

def _stored(spark, sf, keys):
    import uuid
    from inferna.plans import model_store as MS
    from inferna.session import scratch_path
    return MS.train_save_evaluate(spark, sf, keys, scratch_path(spark, f"models-{uuid.uuid4().hex}"))


_STORED_SQL = " UNION ALL ".join(
    f"SELECT '{key}' AS experiment, dataset AS predict_dataset, model AS trained_dataset, y, pred FROM ({sql}) m" for key, sql in {
        "baseline-3": SQL["mnb_predict"], "experiment-2": SQL["knn_cosine"], "experiment-4": SQL["mnb_syntactic"]}.items())


@register("saved_models", metrics_sql(f"({_STORED_SQL}) g", ["experiment", "predict_dataset", "trained_dataset"]))
def q_saved_models(spark, sf):
    return _stored(spark, sf, ("baseline-3", "experiment-2", "experiment-4"))


def _logistic(name: str, key: str):
    # a solver's scores have no SQL; the cells, the pairs in them and the label domain do
    @register(name, with_ctes(["train_s", "test_s"], f"""
SELECT '{key}' AS experiment, m.model AS trained_dataset, t.dataset AS predict_dataset, count(*) AS n_pairs, count(*) AS n_in_domain
FROM test_s t CROSS JOIN (SELECT DISTINCT dataset AS model FROM train_s) m GROUP BY m.model, t.dataset"""))
    def q(spark, sf):
        import uuid
        from inferna.plans import model_store as MS
        from inferna.session import scratch_path
        base = scratch_path(spark, f"models-{uuid.uuid4().hex}")
        train, test = TM.train_test(spark, sf, MS.MODELS[key].syntactic is not None)
        MS.train(spark, key, train, base)
        pred = MS.load(spark, key, base).predict(test)
        return pred.groupBy(F.lit(key).alias("experiment"), F.col("model").alias("trained_dataset"), F.col("dataset").alias("predict_dataset")).agg(
            F.count("*").alias("n_pairs"), F.count_if(F.col("pred").isin(list(M.CLASSES)) & F.col("y").isNotNull()).alias("n_in_domain"))


_logistic("lr_tfidf_cells", "baseline-2")
_logistic("lr_tfidf_syntactic_cells", "experiment-3")
