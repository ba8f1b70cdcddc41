"""DuckDB SQL of the tree learners, level by level over the same cells, bins and fixed-point sums."""

from __future__ import annotations

from inferna.operators.trees import MUL_A, MUL_B, POISSON, PRIME, UNIT, Spec
from inferna.plans.oracle import CTE, DEPS, JOINED, cte, grams_sql, idf_sql, tok_sql, vocab_sql, with_ctes


def _terms(src: str, text: str, stop: bool, bigrams: bool) -> str:
    return f"""(SELECT pair_id, dataset, term, count(*) AS tf FROM (
  SELECT pair_id, dataset, unnest({grams_sql('tk', bigrams)}) AS term FROM (SELECT pair_id, dataset, {tok_sql(text, stop)} AS tk FROM {src}) a) u
  GROUP BY ALL)"""


def count_cells(src: str, vocab: str, text: str, offset: int, own: bool, stop: bool) -> str:
    on = "v.term = s.term" + " AND v.model = s.dataset" * own
    return f"""SELECT v.model, s.pair_id AS doc_id, CAST(v.idx + {offset} AS INTEGER) AS f, CAST(s.tf AS DOUBLE) AS x
FROM {_terms(src, text, stop, False)} s JOIN {vocab} v ON {on}"""


def tfidf_cells(src: str, idf: str, text: str, offset: int, own: bool) -> str:
    on = "v.term = s.term" + " AND v.model = s.dataset" * own
    return f"""SELECT model, doc_id, f, x FROM (SELECT model, doc_id, f, round(x / sqrt(sum(x * x) OVER (PARTITION BY model, doc_id)), 6) AS x FROM (
  SELECT v.model, s.pair_id AS doc_id, CAST(v.idx + {offset} AS INTEGER) AS f, s.tf * v.idf AS x
  FROM {_terms(src, text, True, True)} s JOIN {idf} v ON {on}) a) b WHERE x > 0"""


def syntactic_cells(src: str, offset: int, own: bool, names: str = "knn_flist") -> str:
    on = "l.feature = p.feature" + " AND l.model = t.dataset" * own
    return f"""SELECT l.model, t.pair_id AS doc_id, CAST(l.pos - 1 + {offset} AS INTEGER) AS f, round(CAST(p.value AS DOUBLE), 6) AS x
FROM {src} t JOIN pfeat p ON p.pair_id = t.pair_id JOIN {names} l ON {on} WHERE p.value > 0 AND round(CAST(p.value AS DOUBLE), 6) > 0"""


cte("vocab_r5p", vocab_sql("train_s", "premise_text", 2500, True, False), ["train_s"])
cte("vocab_r5h", vocab_sql("train_s", "hypothesis_text", 2500, True, False), ["train_s"])
cte("vocab_hyp", vocab_sql("train_s", "hypothesis_text", 5000, True, True), ["train_s"])
cte("idf_hyp", idf_sql("vocab_hyp", "train_s", "hypothesis_text", True, True), ["vocab_hyp", "train_s"])
#: Cells of training and test rows by model key, and the tables they stand on.
CELLS = {
    "baseline-1": ([lambda s, own: count_cells(s, "vocab_bow", JOINED, 0, own, False)], ["vocab_bow"]),
    "experiment-1": ([lambda s, own: syntactic_cells(s, 0, own)], ["knn_flist", "pfeat"]),
    "experiment-5": ([lambda s, own: count_cells(s, "vocab_r5p", "premise_text", 0, own, True),
                      lambda s, own: count_cells(s, "vocab_r5h", "hypothesis_text", 2500, own, True),
                      lambda s, own: syntactic_cells(s, 5000, own)], ["vocab_r5p", "vocab_r5h", "knn_flist", "pfeat"]),
    "experiment-6": ([lambda s, own: tfidf_cells(s, "idf_prem", "premise_text", 0, own),
                      lambda s, own: tfidf_cells(s, "idf_hyp", "hypothesis_text", 5000, own),
                      lambda s, own: syntactic_cells(s, 10000, own)], ["idf_prem", "idf_hyp", "knn_flist", "pfeat"]),
}

GINI = "({0}0 * {0}0 + {0}1 * {0}1 + {0}2 * {0}2)::DOUBLE / ({0}0 + {0}1 + {0}2)::DOUBLE"
GRAD = "{0}1::DOUBLE * {0}1::DOUBLE / {0}0::DOUBLE"


def binned(bins: int) -> str:
    return f"""
tv AS MATERIALIZED (SELECT model, f, x, CAST(1 + (coalesce(sum(n) OVER (PARTITION BY model, f ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {bins - 1})
    // (sum(n) OVER (PARTITION BY model, f)) AS INTEGER) AS bin FROM (SELECT model, f, x, count(*) AS n FROM tr GROUP BY ALL)),
bc AS MATERIALIZED (SELECT tr.model, tr.doc_id, tr.f, tv.bin, (tr.f::BIGINT * {MUL_A} + 12345) % {PRIME} AS fh FROM tr JOIN tv ON tr.model = tv.model AND tr.f = tv.f AND tr.x = tv.x),
lo AS MATERIALIZED (SELECT model, f, bin, min(x) AS cut FROM tv GROUP BY ALL),"""


def level(name: str, d: int, rows: str, scored: str, worth: str, size: str, least: str, impure: str, look: str = "") -> str:
    """CTEs of one level: nodes, histograms, splits and where training and test rows go.  ``rows``/``scored`` end in the level's number."""
    a, e = f"{rows}{d}", f"{scored}{d}"
    return f"""
n_{name}{d} AS MATERIALIZED (SELECT n.*{look} FROM (SELECT model, tree, node, sum(v0)::BIGINT AS t0, sum(v1)::BIGINT AS t1, sum(v2)::BIGINT AS t2 FROM {a} WHERE node >= {2 ** d} GROUP BY ALL) n
  {"JOIN wd ON wd.model = n.model" if look else ""} WHERE {impure}),
h_{name}{d} AS (SELECT a.model, a.tree, a.node, c.f, c.bin, sum(a.v0)::BIGINT AS s0, sum(a.v1)::BIGINT AS s1, sum(a.v2)::BIGINT AS s2
  FROM {a} a JOIN n_{name}{d} n ON a.model = n.model AND a.tree = n.tree AND a.node = n.node JOIN bc c ON c.model = a.model AND c.doc_id = a.doc_id
  {f'WHERE ((xor(c.fh, n.nh) % {PRIME}) * {MUL_B}) % {PRIME} < n.lim' if look else ''} GROUP BY ALL),
r_{name}{d} AS (SELECT h.model, h.tree, h.node, f, bin, t0, t1, t2, {', '.join(f'(sum(s{i}) OVER w)::BIGINT AS r{i}' for i in range(3))}
  FROM h_{name}{d} h JOIN n_{name}{d} n ON h.model = n.model AND h.tree = n.tree AND h.node = n.node
  WINDOW w AS (PARTITION BY h.model, h.tree, h.node, f ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s_{name}{d} AS MATERIALIZED (SELECT s.model, s.tree, s.node, s.f, s.bin, lo.cut FROM (
    SELECT *, row_number() OVER (PARTITION BY model, tree, node ORDER BY score DESC, f, bin) AS k FROM (
      SELECT *, {worth.format('l')} + {worth.format('r')} AS score, {worth.format('t')} AS whole FROM (
        SELECT *, t0 - r0 AS l0, t1 - r1 AS l1, t2 - r2 AS l2 FROM r_{name}{d}) WHERE {size.format('l')} > 0 AND {size.format('r')} > 0) WHERE score > whole + {least}) s
  JOIN lo ON lo.model = s.model AND lo.f = s.f AND lo.bin = s.bin WHERE k = 1),
{rows}{d + 1} AS MATERIALIZED (SELECT a.* EXCLUDE (node), CASE WHEN s.f IS NULL THEN a.node WHEN coalesce(c.bin, 0) >= s.bin THEN 2 * a.node + 1 ELSE 2 * a.node END AS node
  FROM {a} a LEFT JOIN s_{name}{d} s ON s.model = a.model AND s.tree = a.tree AND s.node = a.node
  LEFT JOIN bc c ON c.model = a.model AND c.doc_id = a.doc_id AND c.f = s.f),
{scored}{d + 1} AS MATERIALIZED (SELECT e.* EXCLUDE (node), CASE WHEN s.f IS NULL THEN e.node WHEN coalesce(c.x, 0) >= s.cut THEN 2 * e.node + 1 ELSE 2 * e.node END AS node
  FROM {e} e LEFT JOIN s_{name}{d} s ON s.model = e.model AND s.tree = e.tree AND s.node = e.node
  LEFT JOIN te c ON c.model = e.model AND c.doc_id = e.doc_id AND c.f = s.f),"""


def _draws(trees: int) -> str:
    u = f"((((CAST('0x' || substr(md5(pair_id), 1, 7) AS BIGINT) * {MUL_A} + (tree + 1) * 1000003) % {PRIME}) * {MUL_B}) % {PRIME} * {MUL_A}) % {PRIME}"
    times = " + ".join(f"(CASE WHEN u >= {c} THEN 1 ELSE 0 END)" for c in POISSON)
    return f"SELECT dataset AS model, tree, pair_id AS doc_id, label, {times} AS w FROM (SELECT *, {u} AS u FROM (SELECT *, unnest(range({trees})) AS tree FROM train_s))"


def _start(key: str, spec: Spec, train: str = "train_s", test: str = "test_s") -> tuple[list[str], str]:
    parts, deps = CELLS[key]
    body = f"""
, tr AS MATERIALIZED ({' UNION ALL '.join(p(train, True) for p in parts)}),
te AS MATERIALIZED ({' UNION ALL '.join(p(test, False) for p in parts)}),{binned(spec.bins)}"""
    return [train, test, *deps], body


def classes_sql(key: str, spec: Spec, train: str = "train_s", test: str = "test_s") -> str:
    """One tree or a forest: predictions (model, doc_id, dataset, y, pred)."""
    deps, body = _start(key, spec, train, test)
    rows = _draws(spec.trees) if spec.forest else "SELECT dataset AS model, 0 AS tree, pair_id AS doc_id, label, 1 AS w FROM {train}".format(train=train)
    look = ""
    if spec.forest:
        body += f"""
wd AS MATERIALIZED (SELECT m.model, coalesce(max(f), -1) + 1 AS width, CAST(floor(greatest(1, floor(count(f)::DOUBLE / any_value(m.n) + 0.5))) AS BIGINT) AS nnz
  FROM (SELECT dataset AS model, count(*) AS n FROM train_s GROUP BY dataset) m LEFT JOIN tr ON tr.model = m.model GROUP BY m.model),"""
        look = f""", (n.tree * {MUL_B} + n.node % {PRIME} * 16807 + 777) % {PRIME} AS nh,
  least({PRIME}, ({PRIME} * CAST(ceil(sqrt(wd.width)) AS BIGINT)) // greatest(1, least(wd.width, (t0 + t1 + t2) * wd.nnz))) AS lim"""
    body += f"""
a0 AS MATERIALIZED (SELECT model, tree, doc_id, CASE WHEN label = 0 THEN w ELSE 0 END AS v0, CASE WHEN label = 1 THEN w ELSE 0 END AS v1, CASE WHEN label = 2 THEN w ELSE 0 END AS v2, 1::BIGINT AS node
  FROM ({rows}) WHERE w > 0),
e0 AS MATERIALIZED (SELECT m.model, tree, t.pair_id AS doc_id, t.dataset, t.label AS y, 1::BIGINT AS node FROM {test} t CROSS JOIN (SELECT DISTINCT model, tree FROM a0) m),"""
    for d in range(spec.depth):
        body += level("c", d, "a", "e", GINI, "({0}0 + {0}1 + {0}2)", "1e-9", "(CASE WHEN t0 > 0 THEN 1 ELSE 0 END) + (CASE WHEN t1 > 0 THEN 1 ELSE 0 END) + (CASE WHEN t2 > 0 THEN 1 ELSE 0 END) > 1", look)
    return with_ctes(deps, body + f"""
leaf AS (SELECT model, tree, node, {', '.join(f'sum(v{i})::BIGINT * 1000000000 // sum(v0 + v1 + v2)::BIGINT AS p{i}' for i in range(3))} FROM a{spec.depth} GROUP BY model, tree, node)
SELECT model, doc_id, dataset, y, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS pred FROM (
  SELECT e.model, doc_id, dataset, y, {', '.join(f'sum(p{i}) AS p{i}' for i in range(3))}
  FROM e{spec.depth} e JOIN leaf l ON l.model = e.model AND l.tree = e.tree AND l.node = e.node GROUP BY ALL)""")


def boost_sql(key: str, spec: Spec) -> str:
    """One-against-the-rest boosting: predictions (model, doc_id, dataset, y, pred)."""
    deps, body = _start(key, spec)
    body += f"""
fs AS MATERIALIZED (SELECT model, cls, CASE WHEN pos = 0 THEN -10 * {UNIT} WHEN pos = n THEN 10 * {UNIT} ELSE CAST(floor(ln(pos::DOUBLE / (n - pos)::DOUBLE) * {UNIT} + 0.5) AS BIGINT) END AS s
  FROM (SELECT dataset AS model, cls, count(*) AS n, sum(CASE WHEN label = cls THEN 1 ELSE 0 END)::BIGINT AS pos FROM (SELECT *, unnest(range(3)) AS cls FROM train_s) GROUP BY ALL)),
t_0 AS (SELECT t.dataset AS model, f.cls, t.pair_id AS doc_id, CASE WHEN t.label = f.cls THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, f.s FROM train_s t JOIN fs f ON f.model = t.dataset),
u_0 AS (SELECT f.model, f.cls, t.pair_id AS doc_id, t.dataset, t.label AS y, f.s FROM test_s t CROSS JOIN fs f),"""
    for g in range(spec.stages):
        rows, scored, name = f"b{g}_", f"f{g}_", f"g{g}_"
        body += f"""
{rows}0 AS MATERIALIZED (SELECT model, cls AS tree, doc_id, hit, s, 1 AS v0, CAST(floor((hit - p) * {UNIT} + 0.5) AS BIGINT) AS v1, CAST(floor(p * (1.0::DOUBLE - p) * {UNIT} + 0.5) AS BIGINT) AS v2, 1::BIGINT AS node
  FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(s::DOUBLE / {UNIT}.0::DOUBLE))) AS p FROM t_{g})),
{scored}0 AS MATERIALIZED (SELECT model, cls AS tree, doc_id, dataset, y, s, 1::BIGINT AS node FROM u_{g}),"""
        for d in range(spec.depth):
            body += level(name, d, rows, scored, GRAD, "{0}0", "1e-3", "TRUE")
        body += f"""
l_{g} AS MATERIALIZED (SELECT model, tree, node, CASE WHEN sum(v2) > 0 THEN CAST(floor({spec.rate}::DOUBLE * (sum(v1)::BIGINT::DOUBLE / sum(v2)::BIGINT::DOUBLE) * {UNIT} + 0.5) AS BIGINT) ELSE 0 END AS gain
  FROM {rows}{spec.depth} GROUP BY model, tree, node),
t_{g + 1} AS MATERIALIZED (SELECT r.model, r.tree AS cls, r.doc_id, r.hit, r.s + l.gain AS s FROM {rows}{spec.depth} r JOIN l_{g} l ON l.model = r.model AND l.tree = r.tree AND l.node = r.node),
u_{g + 1} AS MATERIALIZED (SELECT r.model, r.tree AS cls, r.doc_id, r.dataset, r.y, r.s + l.gain AS s FROM {scored}{spec.depth} r JOIN l_{g} l ON l.model = r.model AND l.tree = r.tree AND l.node = r.node),"""
    return with_ctes(deps, body + f"""
z AS (SELECT model, doc_id, dataset, y, {', '.join(f'max(CASE WHEN cls = {i} THEN s END) AS s{i}' for i in range(3))} FROM u_{spec.stages} GROUP BY ALL)
SELECT model, doc_id, dataset, y, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS pred FROM z""")


# ---- ablation (M10): the model is a dataset and a feature group ------------------
GROUPS = {"dependency": "contains(f.feature, '_dep_') OR contains(f.feature, 'deprel_')", "constituency": "contains(f.feature, '_const_')"}
cte("abl_tr", " UNION ALL ".join(f"SELECT pair_id, dataset || '|{g}' AS dataset, label FROM train_s" for g in GROUPS), ["train_s"])
cte("abl_te", "SELECT pair_id, dataset, label FROM vpairs WHERE split = 'validation'", ["vpairs"])
cte("abl_flist", "SELECT model, feature, row_number() OVER (PARTITION BY model ORDER BY feature) AS pos FROM ("
    + " UNION ".join(f"SELECT t.dataset || '|{g}' AS model, f.feature FROM train_s t JOIN pfeat f ON f.pair_id = t.pair_id WHERE {on}" for g, on in GROUPS.items()) + ")", ["train_s", "pfeat"])
CELLS["experiment-7"] = ([lambda s, own: syntactic_cells(s, 0, own, "abl_flist")], ["abl_flist", "pfeat"])
cte("abl_trd", """
SELECT l.model, t.pair_id, t.label, l.feature, l.pos, coalesce(f.value, 0) AS v
FROM abl_tr t JOIN abl_flist l ON l.model = t.dataset LEFT JOIN pfeat f ON f.pair_id = t.pair_id AND f.feature = l.feature""", ["abl_tr", "abl_flist", "pfeat"])
cte("abl_st", "SELECT model, feature, avg(v) AS mu, stddev_pop(v) AS sd FROM abl_trd GROUP BY model, feature", ["abl_trd"])
cte("abl_trv", """
SELECT d.model, d.pair_id AS train_id, d.label, list((d.v - s.mu) / CASE WHEN s.sd > 0 THEN s.sd ELSE 1 END ORDER BY d.pos) AS vec
FROM abl_trd d JOIN abl_st s ON s.model = d.model AND s.feature = d.feature GROUP BY d.model, d.pair_id, d.label""", ["abl_trd", "abl_st"])
cte("abl_tev", """
SELECT l.model, t.pair_id AS doc_id, t.dataset, t.label AS y, list((coalesce(f.value, 0) - s.mu) / CASE WHEN s.sd > 0 THEN s.sd ELSE 1 END ORDER BY l.pos) AS vec
FROM abl_te t JOIN abl_flist l ON starts_with(l.model, t.dataset || '|') JOIN abl_st s ON s.model = l.model AND s.feature = l.feature
LEFT JOIN pfeat f ON f.pair_id = t.pair_id AND f.feature = l.feature GROUP BY l.model, t.pair_id, t.dataset, t.label""", ["abl_te", "abl_flist", "abl_st", "pfeat"])


def ablation_sql(spec: Spec, k: int = 5) -> str:
    """Metrics of tree and nearest neighbours by dataset and feature group on the validation split."""
    from inferna.plans.oracle import metrics_sql
    tree = classes_sql("experiment-7", spec, "abl_tr", "abl_te")
    head, tail = tree[:tree.rindex("\nSELECT model, doc_id")], tree[tree.rindex("\nSELECT model, doc_id"):]
    knn = with_ctes(["abl_trv", "abl_tev"], "").removeprefix("WITH ").rstrip()
    return head + f""",
tree_pred AS ({tail}),
knn_pred AS (WITH {knn},
dist AS (SELECT q.model, q.doc_id, q.dataset, q.y, r.label, r.train_id, round(list_distance(q.vec, r.vec), 9) AS d FROM abl_tev q JOIN abl_trv r ON r.model = q.model)
SELECT model, doc_id, dataset, y, CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END AS pred
FROM (SELECT model, doc_id, dataset, y, count_if(label = 0) AS c0, count_if(label = 1) AS c1, count_if(label = 2) AS c2
  FROM (SELECT model, doc_id, dataset, y, label, row_number() OVER (PARTITION BY model, doc_id ORDER BY d, train_id) AS rk FROM dist) n
  WHERE rk <= {k} GROUP BY model, doc_id, dataset, y) v),
both_pred AS (SELECT 'decision_tree' AS learner, dataset, split_part(model, '|', 2) AS feature_group, y, pred FROM tree_pred WHERE starts_with(model, dataset || '|')
  UNION ALL SELECT 'knn', dataset, split_part(model, '|', 2), y, pred FROM knn_pred)
""" + metrics_sql("both_pred", ["learner", "dataset", "feature_group"])


# ---- cross-validation (M11): the model is a dataset and a fold --------------------
cte("cv_folds", """
SELECT pair_id, dataset, label, CAST((row_number() OVER (PARTITION BY dataset, label ORDER BY md5('42:' || pair_id)) - 1) % 5 AS INTEGER) AS fold FROM train_s""", ["train_s"])
cte("cv_tr", "SELECT pair_id, dataset || '|' || m AS dataset, label FROM (SELECT *, unnest(range(5)) AS m FROM cv_folds) WHERE m <> fold", ["cv_folds"])
cte("cv_te", "SELECT pair_id, dataset || '|' || fold AS dataset, label FROM cv_folds", ["cv_folds"])
cte("cv_flist", """SELECT model, feature, row_number() OVER (PARTITION BY model ORDER BY feature) AS pos FROM (
  SELECT DISTINCT t.dataset AS model, f.feature FROM cv_tr t JOIN pfeat f ON f.pair_id = t.pair_id)""", ["cv_tr", "pfeat"])
CELLS["experiment-8"] = ([lambda s, own: syntactic_cells(s, 0, True, "cv_flist")], ["cv_flist", "pfeat"])
for _name in ("trd", "st", "trv"):
    cte(f"cv_{_name}", CTE[f"abl_{_name}"].replace("abl_", "cv_"), [d.replace("abl_", "cv_") for d in DEPS[f"abl_{_name}"]])
cte("cv_tev", CTE["abl_tev"].replace("abl_", "cv_").replace("starts_with(l.model, t.dataset || '|')", "l.model = t.dataset"), ["cv_te", "cv_flist", "cv_st", "pfeat"])


def cross_validate_sql(spec: Spec) -> str:
    """Summary over folds of tree and nearest neighbours by dataset."""
    from inferna.plans.oracle import metrics_sql
    tree = classes_sql("experiment-8", spec, "cv_tr", "cv_te").replace("FROM cv_te t CROSS JOIN (SELECT DISTINCT model, tree FROM a0) m", "FROM cv_te t JOIN (SELECT DISTINCT model, tree FROM a0) m ON m.model = t.dataset")
    both = ablation_sql(spec)
    body = both[both.index("knn_pred AS ("):both.index("both_pred AS (")]
    knn = "knn_pred AS (WITH " + with_ctes(["cv_trv", "cv_tev"], "").removeprefix("WITH ").rstrip() + body[body.index(",\ndist AS"):].replace("abl_", "cv_")
    cut = tree.rindex("\nSELECT model, doc_id")
    part = lambda t, n: f"SELECT '{n}' AS learner, split_part(dataset, '|', 1) AS dataset, CAST(split_part(dataset, '|', 2) AS INTEGER) AS fold, y, pred FROM {t}"
    return tree[:cut] + f""",
tree_pred AS ({tree[cut:]}),
{knn}both_pred AS ({part('tree_pred', 'decision_tree')} UNION ALL {part('knn_pred', 'knn')}),
m AS ({metrics_sql('both_pred', ['learner', 'dataset', 'fold'])})
SELECT learner, dataset, round(avg(accuracy), 6) AS mean_accuracy, round(stddev_pop(accuracy), 6) AS std_accuracy,
  round(avg(weighted_precision), 6) AS mean_weighted_precision, round(avg(weighted_recall), 6) AS mean_weighted_recall,
  round(avg(weighted_f1), 6) AS mean_weighted_f1, round(stddev_pop(weighted_f1), 6) AS std_weighted_f1,
  list(weighted_f1 ORDER BY fold) AS f1_per_fold, count(*) AS n_folds
FROM m GROUP BY learner, dataset"""
