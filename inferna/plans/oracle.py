"""DuckDB SQL building blocks for the independent correctness oracle.

Each constant is one named CTE body over the driver's pre-registered views;
``with_ctes`` strings the needed ones together in dependency order.  These
strings are only handed to DuckDB by the check tool; Spark never runs them.
"""

from __future__ import annotations

CTE: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def cte(name: str, body: str, deps: list[str] | None = None) -> None:
    CTE[name] = body
    DEPS[name] = deps or []


def with_ctes(names: list[str], select: str, bodies: dict[str, str] | None = None) -> str:
    """``bodies``: other definitions of some tables, for this query alone."""
    bodies = {**CTE, **(bodies or {})}
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = ",\n".join(f"{n} AS (\n{bodies[n]}\n)" for n in order)
    return f"WITH {parts}\n{select}"


# ---- sources -------------------------------------------------------------
cte("nli_raw", r"""
SELECT concat_ws('_', dataset, split, CAST(doc_id AS VARCHAR), CAST(i - 1 AS VARCHAR)) AS id,
       dataset, split, round, s[i] AS premise_text, s[i + 1] AS hypothesis_text, label
FROM (
  SELECT doc_id, dataset, split, round, label, s,
         unnest(generate_series(1, greatest(len(s) - 1, 1))) AS i
  FROM (
    SELECT d.doc_id, d.lang AS dataset,
      CASE WHEN d.doc_id % 10 < 8 THEN 'train' WHEN d.doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split,
      CAST(d.doc_id % 3 + 1 AS INTEGER) AS round,
      CAST(CASE WHEN l.toxic = 1 THEN 2 WHEN l.quality = 1 THEN 0 WHEN l.quality = 0 THEN 1 ELSE -1 END AS INTEGER) AS label,
      regexp_split_to_array(d.text, '[.!?]\s+') AS s
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x) y""")

cte("nli_raw_str", """
SELECT id, dataset, split, round, premise_text, hypothesis_text,
  CASE label WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' WHEN 2 THEN 'contradiction' ELSE '-' END AS label
FROM nli_raw""", ["nli_raw"])

cte("conv_pairs", """
SELECT concat_ws('_', 'c', CAST(a.conv_id AS VARCHAR), CAST(a.turn AS VARCHAR)) AS id,
       a.conv_id, a.turn, a.text AS premise_text, b.text AS hypothesis_text
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")

cte("valid_pairs", """
SELECT * FROM nli_raw
WHERE premise_text IS NOT NULL AND hypothesis_text IS NOT NULL AND label IS NOT NULL AND label <> -1""",
    ["nli_raw"])

# whitespace tokens of lower(text), empties dropped (F1)
WS_TOK = r"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[\s\p{{Z}}]+'), lambda x: x <> '')"


def ws_tok(t: str) -> str:
    return WS_TOK.format(t=t)


def text_stats_select(src: str, id_col: str = "id", extra: str = "") -> str:
    """F1-F5 over a pair source; ``extra`` = pass-through columns with a trailing comma."""
    return f"""
SELECT pair_id, {extra}
  CAST(len(pt) AS DOUBLE) AS premise_length,
  CAST(len(ht) AS DOUBLE) AS hypothesis_length,
  CAST(abs(len(pt) - len(ht)) AS DOUBLE) AS length_diff,
  round(CASE WHEN len(ht) > 0 THEN len(pt) / len(ht) ELSE 1.0 END, 6) AS length_ratio,
  CAST(len(list_intersect(pt, ht)) AS DOUBLE) AS word_overlap_count,
  round(CASE WHEN len(list_distinct(list_concat(pt, ht))) > 0
             THEN len(list_intersect(pt, ht)) / len(list_distinct(list_concat(pt, ht))) ELSE 0.0 END, 6)
    AS word_overlap_ratio
FROM (SELECT {id_col} AS pair_id, {extra} {ws_tok('premise_text')} AS pt,
             {ws_tok('hypothesis_text')} AS ht FROM {src}) z"""


# ---- dictionary, pairs ----------------------------------------------------
cte("sentences_all", """
SELECT md5(t) AS id, any_value(t) AS text, min(role) AS role
FROM (SELECT premise_text AS t, 0 AS role FROM nli_raw UNION ALL SELECT hypothesis_text, 1 FROM nli_raw) u
WHERE t IS NOT NULL AND trim(t) <> '' GROUP BY md5(t)""", ["nli_raw"])

cte("vpairs", """
SELECT id AS pair_id, dataset, split, label, premise_text, hypothesis_text,
       md5(premise_text) AS premise_id, md5(hypothesis_text) AS hypothesis_id
FROM nli_raw
WHERE premise_text IS NOT NULL AND trim(premise_text) <> '' AND hypothesis_text IS NOT NULL
  AND trim(hypothesis_text) <> '' AND label IS NOT NULL AND label >= 0""", ["nli_raw"])

cte("psent", """
SELECT id, any_value(text) AS text FROM (
  SELECT premise_id AS id, premise_text AS text FROM vpairs
  UNION ALL SELECT hypothesis_id, hypothesis_text FROM vpairs) u GROUP BY id""", ["vpairs"])

# ---- rule annotator (U4) ---------------------------------------------------
cte("tok", r"""
SELECT sid, i, a[i] AS tok FROM (
  SELECT sid, a, unnest(generate_series(1, len(a))) AS i
  FROM (SELECT id AS sid, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+') AS a FROM psent) x
  WHERE len(a) > 0) y""", ["psent"])

cte("tagged", """
SELECT sid, i, tok, CASE WHEN tok >= '0' AND tok < ':' THEN 'NUM' WHEN length(tok) <= 2 THEN 'ADP'
  WHEN length(tok) = 3 THEN 'DET' WHEN length(tok) % 3 = 0 THEN 'VERB' ELSE 'NOUN' END AS pos
FROM tok""", ["tok"])

cte("sroot", """
SELECT sid, max(i) AS n, coalesce(min(CASE WHEN pos = 'VERB' THEN i END), 1) AS root
FROM tagged GROUP BY sid""", ["tagged"])

cte("dep_edges", """
SELECT t.sid, CAST(t.i AS INTEGER) AS id, t.tok AS text, lower(t.tok) AS lemma, t.pos,
  CAST(CASE WHEN t.i = r.root THEN 0 WHEN t.pos IN ('DET', 'ADP') AND t.i < r.n THEN t.i + 1
       WHEN t.i < r.root THEN r.root ELSE t.i - 1 END AS INTEGER) AS head,
  CASE WHEN t.i = r.root THEN 'root' WHEN t.pos = 'DET' THEN 'det' WHEN t.pos = 'ADP' THEN 'case'
       WHEN t.pos = 'NUM' THEN 'nummod' WHEN t.pos = 'VERB' THEN 'conj' WHEN t.i < r.root THEN 'nsubj'
       ELSE 'obj' END AS deprel
FROM tagged t JOIN sroot r ON t.sid = r.sid""", ["tagged", "sroot"])

LEAF = "CASE WHEN e.pos = 'ADP' THEN ' (PP (ADP ' || e.text || '))' ELSE ' (' || e.pos || ' ' || e.text || ')' END"

cte("const_str", f"""
SELECT s.id AS sid, coalesce(c.tree, '') AS constituency FROM psent s LEFT JOIN (
  SELECT e.sid, '(ROOT (S'
    || CASE WHEN max(r.root) > 1
            THEN ' (NP' || string_agg({LEAF}, '' ORDER BY e.id) FILTER (WHERE e.id < r.root) || ')'
            ELSE '' END
    || ' (VP' || string_agg({LEAF}, '' ORDER BY e.id) FILTER (WHERE e.id >= r.root) || ')))' AS tree
  FROM dep_edges e JOIN sroot r ON e.sid = r.sid GROUP BY e.sid) c ON s.id = c.sid""",
    ["psent", "dep_edges", "sroot"])


def count_sql(s: str, needle: str) -> str:
    return f"CAST((length({s}) - length(replace({s}, '{needle}', ''))) / {len(needle)} AS DOUBLE)"


PHRASES_SQL = ["NP", "VP", "PP", "ADJP", "ADVP", "S", "SBAR", "SBARQ", "SINV", "SQ"]

cte("dstats", """
SELECT s.id AS sid,
  CAST(greatest(coalesce(a.mh, 0), 0) AS DOUBLE) AS dep_tree_depth_proxy,
  CASE WHEN coalesce(a.ne, 0) - coalesce(a.nr, 0) > 0 THEN a.td / (a.ne - a.nr) ELSE 0.0 END AS avg_dep_dist,
  CAST(coalesce(a.md, 0) AS DOUBLE) AS max_dep_dist,
  CAST(coalesce(a.nr, 0) AS DOUBLE) AS root_children_count
FROM psent s LEFT JOIN (
  SELECT sid, max(head) AS mh, count(*) AS ne, count_if(head = 0) AS nr,
    coalesce(sum(abs(id - head)) FILTER (WHERE id > 0 AND head > 0), 0) AS td,
    max(abs(id - head)) FILTER (WHERE id > 0 AND head > 0) AS md
  FROM dep_edges GROUP BY sid) a ON s.id = a.sid""", ["psent", "dep_edges"])

_const_rows = [f"SELECT sid, 'const' AS kind, 'tree_depth' AS k, "
               f"{count_sql('constituency', '(')} - {count_sql('constituency', ')')} AS v "
               f"FROM const_str WHERE trim(constituency) <> ''"]
_const_rows += [f"SELECT sid, 'const', 'count_{p}', {count_sql('constituency', '(' + p + ' ')} "
                f"FROM const_str WHERE trim(constituency) <> ''" for p in PHRASES_SQL]
cte("sfeat", "\nUNION ALL ".join(_const_rows + [
    "SELECT sid, 'dep', 'pos_' || pos, CAST(count(*) AS DOUBLE) FROM dep_edges GROUP BY sid, pos",
    "SELECT sid, 'dep', 'deprel_' || deprel, CAST(count(*) AS DOUBLE) FROM dep_edges GROUP BY sid, deprel",
    "SELECT sid, 'dep', 'dep_tree_depth_proxy', dep_tree_depth_proxy FROM dstats",
    "SELECT sid, 'dep', 'avg_dep_dist', avg_dep_dist FROM dstats",
    "SELECT sid, 'dep', 'max_dep_dist', max_dep_dist FROM dstats",
    "SELECT sid, 'dep', 'root_children_count', root_children_count FROM dstats",
]), ["const_str", "dep_edges", "dstats"])

cte("pk", "SELECT p.pair_id, f.kind, f.k, f.v FROM vpairs p JOIN sfeat f ON f.sid = p.premise_id",
    ["vpairs", "sfeat"])
cte("hk", "SELECT p.pair_id, f.kind, f.k, f.v FROM vpairs p JOIN sfeat f ON f.sid = p.hypothesis_id",
    ["vpairs", "sfeat"])
cte("pfeat", """
SELECT pair_id, 'premise_' || kind || '_' || k AS feature, v AS value FROM pk
UNION ALL SELECT pair_id, 'hypothesis_' || kind || '_' || k, v FROM hk
UNION ALL SELECT coalesce(pk.pair_id, hk.pair_id), 'diff_' || coalesce(pk.kind, hk.kind) || '_' || coalesce(pk.k, hk.k),
                 abs(coalesce(pk.v, 0) - coalesce(hk.v, 0))
FROM pk FULL OUTER JOIN hk ON pk.pair_id = hk.pair_id AND pk.kind = hk.kind AND pk.k = hk.k""", ["pk", "hk"])


# ---- sampling ---------------------------------------------------------------
cte("tg", "SELECT * FROM (VALUES ('train', 8000), ('validation', 1000), ('test', 1000)) v(split, t)")
cte("strata", """
SELECT dataset, split, label, c, CASE WHEN t <= 0 THEN 0 WHEN t >= N THEN c ELSE least(c, greatest(q, 0)) END AS n,
       n_labels, t
FROM (SELECT *, q0 + CASE WHEN big = 1 THEN t - sum(q0) OVER (PARTITION BY dataset, split) ELSE 0 END AS q
  FROM (SELECT c.dataset, c.split, c.label, c.c, tg.t, sum(c.c) OVER g AS N, count(*) OVER g AS n_labels,
          CAST(round_even((c.c / sum(c.c) OVER g) * tg.t, 0) AS BIGINT) AS q0,
          row_number() OVER (PARTITION BY c.dataset, c.split ORDER BY c.c DESC, c.label) AS big
        FROM (SELECT dataset, split, label, count(*) AS c FROM vpairs GROUP BY dataset, split, label) c
        JOIN tg ON tg.split = c.split WINDOW g AS (PARTITION BY c.dataset, c.split)) s) s2""", ["vpairs", "tg"])


# ---- vectorisers + naive Bayes grid -------------------------------------------
W2 = r"'[\p{L}\p{N}_]{2,}'"

cte("train_s", """
SELECT p.pair_id, p.dataset, p.split, p.label, p.premise_text, p.hypothesis_text FROM (
  SELECT v.*, row_number() OVER (PARTITION BY dataset, split, label ORDER BY md5('42:' || pair_id)) AS rk
  FROM vpairs v WHERE split = 'train') p
JOIN strata z ON z.dataset = p.dataset AND z.split = p.split AND z.label = p.label
WHERE p.rk <= z.n""", ["vpairs", "strata"])
cte("test_s", "SELECT * FROM vpairs WHERE split = 'test'", ["vpairs"])

#: Vectorisers and scalers are fitted on the whole training split; only learners take the sample.
WHOLE_TRAIN = {"train_s": "SELECT * FROM vpairs WHERE split = 'train'"}


def stop_list_sql() -> str:
    from inferna.operators.vectorize import STOP_WORDS
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"


def tok_sql(text: str, stop: bool = False) -> str:
    """F21 tokens (+ stop filter) as a DuckDB list expression."""
    toks = f"regexp_extract_all(lower(coalesce({text}, '')), {W2})"
    if stop:
        toks = f"list_filter({toks}, lambda x: NOT list_contains({stop_list_sql()}, x))"
    return toks


def grams_sql(tk: str, bigrams: bool) -> str:
    """Unigrams (+ bigrams) of the token-list column ``tk``."""
    if not bigrams:
        return tk
    return (f"list_concat({tk}, CASE WHEN len({tk}) >= 2 THEN list_transform(generate_series(1, len({tk}) - 1), "
            f"lambda i: {tk}[i] || ' ' || {tk}[i + 1]) ELSE [] END)")


def vocab_sql(src: str, text: str, k: int, stop: bool = False, bigrams: bool = False) -> str:
    return f"""
SELECT model, term, tf_total, CAST(row_number() OVER (PARTITION BY model ORDER BY term) - 1 AS INTEGER) AS idx
FROM (SELECT model, term, tf_total, row_number() OVER (PARTITION BY model ORDER BY tf_total DESC, term) AS r
  FROM (SELECT dataset AS model, term, count(*) AS tf_total FROM (
          SELECT dataset, unnest({grams_sql('tk', bigrams)}) AS term
          FROM (SELECT dataset, {tok_sql(text, stop)} AS tk FROM {src}) a) t
        GROUP BY dataset, term) b) c
WHERE r <= {k}"""


cte("vocab_bow", vocab_sql("train_s", "coalesce(premise_text, '') || ' ' || coalesce(hypothesis_text, '')", 10000),
    ["train_s"])


def side_terms_sql(src: str, extra: str) -> str:
    return f"""
SELECT pair_id, dataset, {extra} side, term, count(*) AS tf FROM (
  SELECT pair_id, dataset, {extra} 0 AS side,
         unnest(regexp_extract_all(lower(coalesce(premise_text, '')), {W2})) AS term FROM {src}
  UNION ALL
  SELECT pair_id, dataset, {extra} 1, unnest(regexp_extract_all(lower(coalesce(hypothesis_text, '')), {W2}))
  FROM {src}) t
GROUP BY ALL"""


cte("tr_side", side_terms_sql("train_s", "label,"), ["train_s"])
cte("te_side", side_terms_sql("test_s", ""), ["test_s"])
cte("tr_feat", """
SELECT v.model, s.pair_id AS doc_id, s.label, 2 * v.idx + s.side AS f, CAST(s.tf AS DOUBLE) AS x
FROM tr_side s JOIN vocab_bow v ON v.model = s.dataset AND v.term = s.term""", ["tr_side", "vocab_bow"])
cte("te_feat", """
SELECT v.model, s.pair_id AS doc_id, 2 * v.idx + s.side AS f, CAST(s.tf AS DOUBLE) AS x
FROM te_side s JOIN vocab_bow v ON v.term = s.term""", ["te_side", "vocab_bow"])
cte("nb_cls", """
SELECT c.model, c.label, c.n_c, ln(c.n_c / sum(c.n_c) OVER (PARTITION BY c.model)) AS log_prior,
  CAST(coalesce(n.total_count, 0) AS DOUBLE) AS total_count,
  ln(1.0 / (coalesce(n.total_count, 0) + 1.0 * nf.n_features)) AS base
FROM (SELECT dataset AS model, label, count(*) AS n_c FROM train_s GROUP BY dataset, label) c
LEFT JOIN (SELECT model, label, sum(x) AS total_count FROM tr_feat GROUP BY model, label) n
  ON n.model = c.model AND n.label = c.label
JOIN (SELECT model, 2 * count(*) AS n_features FROM vocab_bow GROUP BY model) nf ON nf.model = c.model""",
    ["train_s", "tr_feat", "vocab_bow"])
cte("nb_feat", """
SELECT model, f, sum(CASE WHEN label = 0 THEN d ELSE 0 END) AS d0, sum(CASE WHEN label = 1 THEN d ELSE 0 END) AS d1,
       sum(CASE WHEN label = 2 THEN d ELSE 0 END) AS d2
FROM (SELECT model, label, f, ln(sum(x) + 1.0) - ln(1.0) AS d FROM tr_feat GROUP BY model, label, f) t
GROUP BY model, f""", ["tr_feat"])
cte("nb_pred", """
SELECT model, doc_id, dataset, y,
  CASE WHEN sc0 = best THEN 0 WHEN sc1 = best THEN 1 WHEN sc2 = best THEN 2 END AS pred
FROM (SELECT *, greatest(sc0, sc1, sc2) AS best FROM (
  SELECT d.model, d.doc_id, d.dataset, d.y,
    c.prior0 + coalesce(s.S, 0) * c.base0 + coalesce(s.s0, 0) AS sc0,
    c.prior1 + coalesce(s.S, 0) * c.base1 + coalesce(s.s1, 0) AS sc1,
    c.prior2 + coalesce(s.S, 0) * c.base2 + coalesce(s.s2, 0) AS sc2
  FROM (SELECT m.model, t.pair_id AS doc_id, t.dataset, t.label AS y
        FROM test_s t CROSS JOIN (SELECT DISTINCT dataset AS model FROM train_s) m) d
  LEFT JOIN (SELECT f.model, f.doc_id, sum(f.x) AS S, sum(f.x * coalesce(m.d0, 0)) AS s0,
                    sum(f.x * coalesce(m.d1, 0)) AS s1, sum(f.x * coalesce(m.d2, 0)) AS s2
             FROM te_feat f LEFT JOIN nb_feat m ON m.model = f.model AND m.f = f.f
             GROUP BY f.model, f.doc_id) s ON s.model = d.model AND s.doc_id = d.doc_id
  JOIN (SELECT model, max(CASE WHEN label = 0 THEN log_prior END) AS prior0,
               max(CASE WHEN label = 1 THEN log_prior END) AS prior1,
               max(CASE WHEN label = 2 THEN log_prior END) AS prior2,
               max(CASE WHEN label = 0 THEN base END) AS base0, max(CASE WHEN label = 1 THEN base END) AS base1,
               max(CASE WHEN label = 2 THEN base END) AS base2
        FROM nb_cls GROUP BY model) c ON c.model = d.model) a) b""",
    ["test_s", "train_s", "te_feat", "nb_feat", "nb_cls"])

NAMES = {0: "entailment", 1: "neutral", 2: "contradiction"}


def metrics_sql(src: str, cells: list[str]) -> str:
    """A10-A12 closed forms over (cells, y, pred) rows of ``src``."""
    cl = ", ".join(cells)
    aggs = ["sum(n) AS n_total", "sum(CASE WHEN y = pred THEN n ELSE 0 END) AS n_correct"]
    for c in (0, 1, 2):
        aggs += [f"sum(CASE WHEN y = {c} AND pred = {c} THEN n ELSE 0 END) AS tp{c}",
                 f"sum(CASE WHEN y = {c} THEN n ELSE 0 END) AS t{c}",
                 f"sum(CASE WHEN pred = {c} THEN n ELSE 0 END) AS p{c}"]

    def div(a, b):
        return f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END)"
    P = {c: div(f"CAST(tp{c} AS DOUBLE)", f"p{c}") for c in (0, 1, 2)}
    R = {c: div(f"CAST(tp{c} AS DOUBLE)", f"t{c}") for c in (0, 1, 2)}
    F1 = {c: f"(CASE WHEN {P[c]} + {R[c]} > 0 THEN 2 * {P[c]} * {R[c]} / ({P[c]} + {R[c]}) ELSE 0.0 END)"
          for c in (0, 1, 2)}
    pres = {c: f"(CASE WHEN t{c} + p{c} > 0 THEN 1.0 ELSE 0.0 END)" for c in (0, 1, 2)}
    npres = " + ".join(pres.values())
    acc = div("CAST(n_correct AS DOUBLE)", "n_total")
    out = {"accuracy": acc}
    for nm, m in (("precision", P), ("recall", R), ("f1", F1)):
        for c in (0, 1, 2):
            out[f"{nm}_{NAMES[c]}"] = m[c]
    for nm, m in (("precision", P), ("recall", R), ("f1", F1)):
        out[f"macro_{nm}"] = div(" + ".join(f"{pres[c]} * {m[c]}" for c in (0, 1, 2)), npres)
    for nm in ("precision", "recall", "f1"):
        out[f"micro_{nm}"] = acc
    for nm, m in (("precision", P), ("recall", R), ("f1", F1)):
        out[f"weighted_{nm}"] = div(" + ".join(f"t{c} * {m[c]}" for c in (0, 1, 2)), "n_total")
    spec = {c: div(f"CAST(n_total - t{c} - p{c} + tp{c} AS DOUBLE)", f"n_total - t{c}") for c in (0, 1, 2)}
    auc = "(" + " + ".join(f"({R[c]} + {spec[c]}) / 2" for c in (0, 1, 2)) + ") / 3"
    ntrue = " + ".join(f"(CASE WHEN t{c} > 0 THEN 1 ELSE 0 END)" for c in (0, 1, 2))
    npred = " + ".join(f"(CASE WHEN p{c} > 0 THEN 1 ELSE 0 END)" for c in (0, 1, 2))
    out["roc_auc"] = f"CASE WHEN {ntrue} = 3 AND {npred} = 3 THEN {auc} END"
    order = (["accuracy"] + [f"precision_{NAMES[c]}" for c in (0, 1, 2)] + [f"recall_{NAMES[c]}" for c in (0, 1, 2)]
             + [f"f1_{NAMES[c]}" for c in (0, 1, 2)]
             + [f"{a}_{b}" for a in ("macro", "micro", "weighted") for b in ("precision", "recall", "f1")]
             + ["roc_auc"])
    sel = ", ".join(f"round({out[m]}, 6) AS {m}" for m in order)
    return f"""
SELECT {cl}, n_total AS n, {sel} FROM (
  SELECT {cl}, {', '.join(aggs)} FROM (
    SELECT {cl}, y, pred, count(*) AS n FROM {src} GROUP BY {cl}, y, pred) conf
  GROUP BY {cl}) a"""


def idf_sql(vocab: str, src: str, text: str, stop: bool, bigrams: bool) -> str:
    """V3 fit over ``src`` (one model per dataset) for vocabulary CTE ``vocab``."""
    return f"""
SELECT v.model, v.term, v.idx, CAST(coalesce(d.df, 0) AS BIGINT) AS df,
       ln((n.n_docs + 1.0) / (coalesce(d.df, 0) + 1.0)) + 1.0 AS idf
FROM {vocab} v
LEFT JOIN (SELECT t.dataset AS model, t.term, count(*) AS df FROM (
    SELECT DISTINCT pair_id, dataset, unnest({grams_sql('tk', bigrams)}) AS term
    FROM (SELECT pair_id, dataset, {tok_sql(text, stop)} AS tk FROM {src}) a) t
  GROUP BY t.dataset, t.term) d ON d.model = v.model AND d.term = v.term
JOIN (SELECT dataset AS model, count(*) AS n_docs FROM {src} GROUP BY dataset) n ON n.model = v.model"""


def tfidf_sql(idf: str, src: str, text: str, stop: bool, bigrams: bool, side: int | None) -> str:
    f = "w.idx" if side is None else f"2 * w.idx + {side}"
    return f"""
SELECT model, doc_id, f, x / sqrt(sum(x * x) OVER (PARTITION BY model, doc_id)) AS x FROM (
  SELECT w.model, t.pair_id AS doc_id, CAST({f} AS INTEGER) AS f, t.tf * w.idf AS x
  FROM (SELECT pair_id, term, count(*) AS tf FROM (
          SELECT pair_id, unnest({grams_sql('tk', bigrams)}) AS term
          FROM (SELECT pair_id, {tok_sql(text, stop)} AS tk FROM {src}) a) u
        GROUP BY pair_id, term) t
  JOIN {idf} w ON w.term = t.term) z"""


JOINED = "coalesce(premise_text, '') || ' ' || coalesce(hypothesis_text, '')"
cte("vocab_prem", vocab_sql("train_s", "premise_text", 5000, True, True), ["train_s"])
cte("idf_prem", idf_sql("vocab_prem", "train_s", "premise_text", True, True), ["vocab_prem", "train_s"])
cte("vocab_shared", vocab_sql("train_s", JOINED, 10000, True, True), ["train_s"])
cte("idf_shared", idf_sql("vocab_shared", "train_s", JOINED, True, True), ["vocab_shared", "train_s"])


# ---- KNN on z-scored syntactic features (M5) --------------------------------
cte("knn_flist", """
SELECT model, feature, row_number() OVER (PARTITION BY model ORDER BY feature) AS pos FROM (
  SELECT DISTINCT t.dataset AS model, f.feature FROM train_s t JOIN pfeat f ON f.pair_id = t.pair_id) x""",
    ["train_s", "pfeat"])
cte("knn_trd", """
SELECT l.model, t.pair_id, t.label, l.feature, l.pos, coalesce(f.value, 0) AS v
FROM train_s t JOIN knn_flist l ON l.model = t.dataset
LEFT JOIN pfeat f ON f.pair_id = t.pair_id AND f.feature = l.feature""", ["train_s", "knn_flist", "pfeat"])
cte("knn_st", "SELECT model, feature, avg(v) AS mu, stddev_pop(v) AS sd FROM knn_trd GROUP BY model, feature",
    ["knn_trd"])
cte("knn_trv", """
SELECT d.model, d.pair_id AS train_id, d.label,
       list((d.v - s.mu) / CASE WHEN s.sd > 0 THEN s.sd ELSE 1 END ORDER BY d.pos) AS vec
FROM knn_trd d JOIN knn_st s ON s.model = d.model AND s.feature = d.feature
GROUP BY d.model, d.pair_id, d.label""", ["knn_trd", "knn_st"])
cte("knn_tev", """
SELECT l.model, t.pair_id AS doc_id, t.dataset, t.label AS y,
       list((coalesce(f.value, 0) - s.mu) / CASE WHEN s.sd > 0 THEN s.sd ELSE 1 END ORDER BY l.pos) AS vec
FROM test_s t CROSS JOIN knn_flist l
JOIN knn_st s ON s.model = l.model AND s.feature = l.feature
LEFT JOIN pfeat f ON f.pair_id = t.pair_id AND f.feature = l.feature
GROUP BY l.model, t.pair_id, t.dataset, t.label""", ["test_s", "knn_flist", "knn_st", "pfeat"])


def knn_sql(metric: str, k: int = 5) -> str:
    if metric == "cosine":
        d = ("CASE WHEN sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(r.vec, r.vec)) > 0 "
             "THEN 1 - list_dot_product(q.vec, r.vec) / (sqrt(list_dot_product(q.vec, q.vec)) "
             "* sqrt(list_dot_product(r.vec, r.vec))) ELSE 1 END")
    else:
        d = "list_distance(q.vec, r.vec)"
    # distances are projected to scalars first, so the ranking window never
    # carries the vectors of the (query x training) rows
    return with_ctes(["knn_trv", "knn_tev"], f"""
, dist AS (SELECT q.model, q.doc_id, q.dataset, q.y, r.label, r.train_id, round({d}, 9) AS d
           FROM knn_tev q JOIN knn_trv r ON r.model = q.model)
SELECT model, doc_id, dataset, y,
  CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END AS pred
FROM (SELECT model, doc_id, dataset, y, count_if(label = 0) AS c0, count_if(label = 1) AS c1,
             count_if(label = 2) AS c2
  FROM (SELECT model, doc_id, dataset, y, label,
          row_number() OVER (PARTITION BY model, doc_id ORDER BY d, train_id) AS rk FROM dist) n
  WHERE rk <= {k} GROUP BY model, doc_id, dataset, y) v""")


# ---- embeddings (F19, P9) ------------------------------------------------------
cte("emb_pairs", """
SELECT a.vec_id AS pair_id, a.embedding AS premise_emb, b.embedding AS hypothesis_emb, a.label
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")


def emb_sql() -> str:
    cols = []
    for j in range(10):
        p, h = f"coalesce(CAST(premise_emb[{j + 1}] AS DOUBLE), 0)", f"coalesce(CAST(hypothesis_emb[{j + 1}] AS DOUBLE), 0)"
        cols += [f"round({p}, 6) AS premise_cls_bert_{j}", f"round({h}, 6) AS hypothesis_cls_bert_{j}",
                 f"round({p} - {h}, 6) AS diff_bert_{j}", f"round({p} * {h}, 6) AS prod_bert_{j}"]
    return with_ctes(["emb_pairs"], "SELECT pair_id, label, " + ", ".join(cols) + " FROM emb_pairs")


def checksum_sql(vec: str) -> str:
    return f"list_sum(list_transform({vec}, lambda x, i: x * i))"


def scaled_sql(kind: str) -> str:
    """V6 (standard), V7 (no mean), V8 (min-max) of the test split with the
    whole training split's per-model statistics; one checksum per (model, doc)."""
    if kind == "standard":
        z = "(coalesce(f.value, 0) - s.mu) / CASE WHEN s.sd > 0 THEN s.sd ELSE 1 END"
    elif kind == "nomean":
        z = "coalesce(f.value, 0) / CASE WHEN s.sd > 0 THEN s.sd ELSE 1 END"
    else:
        z = "CASE WHEN s.hi - s.lo > 0 THEN (coalesce(f.value, 0) - s.lo) / (s.hi - s.lo) ELSE 0.0 END"
    return with_ctes(["knn_trd", "knn_flist", "test_s", "pfeat"], f"""
, st AS (SELECT model, feature, avg(v) AS mu, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi
         FROM knn_trd GROUP BY model, feature)
SELECT model, doc_id, round({checksum_sql('vec')}, 5) AS checksum, CAST(len(vec) AS BIGINT) AS n_features FROM (
  SELECT l.model, t.pair_id AS doc_id, list({z} ORDER BY l.pos) AS vec
  FROM test_s t CROSS JOIN knn_flist l
  JOIN st s ON s.model = l.model AND s.feature = l.feature
  LEFT JOIN pfeat f ON f.pair_id = t.pair_id AND f.feature = l.feature
  GROUP BY l.model, t.pair_id) q""", WHOLE_TRAIN)


# ---- experiment-4: BoW per side + min-max syntactic -> NB -----------------------
cte("vocab_p5", vocab_sql("train_s", "premise_text", 5000, True, False), ["train_s"])
cte("vocab_h5", vocab_sql("train_s", "hypothesis_text", 5000, True, False), ["train_s"])
cte("mm_st", "SELECT model, feature, min(v) AS lo, max(v) AS hi FROM knn_trd GROUP BY model, feature", ["knn_trd"])


def _bow_side_sql(src: str, vocab: str, text: str, offset: int, own: bool, extra: str) -> str:
    on = "v.term = s.term AND v.model = s.dataset" if own else "v.term = s.term"
    return f"""
SELECT v.model, s.pair_id AS doc_id, {extra} CAST(v.idx + {offset} AS INTEGER) AS f, CAST(s.tf AS DOUBLE) AS x
FROM (SELECT pair_id, dataset, {extra} term, count(*) AS tf FROM (
        SELECT pair_id, dataset, {extra} unnest({tok_sql(text, True)}) AS term FROM {src}) u
      GROUP BY ALL) s
JOIN {vocab} v ON {on}"""


def _syn_mm_sql(src: str, own: bool, extra: str) -> str:
    on = "l.model = t.dataset" if own else "TRUE"
    z = "CASE WHEN s.hi - s.lo > 0 THEN (coalesce(f.value, 0) - s.lo) / (s.hi - s.lo) ELSE 0.0 END"
    return f"""
SELECT * FROM (
  SELECT l.model, t.pair_id AS doc_id, {extra} CAST(l.pos - 1 + {1 << 24} AS INTEGER) AS f, {z} AS x
  FROM {src} t JOIN knn_flist l ON {on}
  JOIN mm_st s ON s.model = l.model AND s.feature = l.feature
  LEFT JOIN pfeat f ON f.pair_id = t.pair_id AND f.feature = l.feature) q WHERE x <> 0"""


cte("m7_tr", " UNION ALL ".join([
    _bow_side_sql("train_s", "vocab_p5", "premise_text", 0, True, "label,"),
    _bow_side_sql("train_s", "vocab_h5", "hypothesis_text", 1 << 23, True, "label,"),
    _syn_mm_sql("train_s", True, "t.label,")]), ["train_s", "vocab_p5", "vocab_h5", "knn_flist", "mm_st", "pfeat"])
cte("m7_te", " UNION ALL ".join([
    _bow_side_sql("test_s", "vocab_p5", "premise_text", 0, False, ""),
    _bow_side_sql("test_s", "vocab_h5", "hypothesis_text", 1 << 23, False, ""),
    _syn_mm_sql("test_s", False, "")]), ["test_s", "vocab_p5", "vocab_h5", "knn_flist", "mm_st", "pfeat"])
cte("m7_nf", """
SELECT m.model, coalesce(a.n, 0) + coalesce(b.n, 0) + coalesce(c.n, 0) AS n_features
FROM (SELECT DISTINCT dataset AS model FROM train_s) m
LEFT JOIN (SELECT model, count(*) AS n FROM vocab_p5 GROUP BY model) a ON a.model = m.model
LEFT JOIN (SELECT model, count(*) AS n FROM vocab_h5 GROUP BY model) b ON b.model = m.model
LEFT JOIN (SELECT model, count(*) AS n FROM knn_flist GROUP BY model) c ON c.model = m.model""",
    ["train_s", "vocab_p5", "vocab_h5", "knn_flist"])


def nb_pred_sql(tr: str, te: str, nf: str, alpha: float = 1.0) -> str:
    """Relational multinomial NB over long feature CTEs (fit + argmax)."""
    return f"""
, cls AS (
  SELECT c.model, c.label, ln(c.n_c / sum(c.n_c) OVER (PARTITION BY c.model)) AS log_prior,
         ln({alpha} / (coalesce(n.tot, 0) + {alpha} * nf.n_features)) AS base
  FROM (SELECT dataset AS model, label, count(*) AS n_c FROM train_s GROUP BY dataset, label) c
  LEFT JOIN (SELECT model, label, sum(x) AS tot FROM {tr} GROUP BY model, label) n
    ON n.model = c.model AND n.label = c.label
  JOIN {nf} nf ON nf.model = c.model),
fm AS (
  SELECT model, f, sum(CASE WHEN label = 0 THEN d ELSE 0 END) AS d0, sum(CASE WHEN label = 1 THEN d ELSE 0 END) AS d1,
         sum(CASE WHEN label = 2 THEN d ELSE 0 END) AS d2
  FROM (SELECT model, label, f, ln(sum(x) + {alpha}) - ln({alpha}) AS d FROM {tr} GROUP BY model, label, f) t
  GROUP BY model, f),
cw AS (
  SELECT model, max(CASE WHEN label = 0 THEN log_prior END) AS prior0, max(CASE WHEN label = 1 THEN log_prior END) AS prior1,
         max(CASE WHEN label = 2 THEN log_prior END) AS prior2, max(CASE WHEN label = 0 THEN base END) AS base0,
         max(CASE WHEN label = 1 THEN base END) AS base1, max(CASE WHEN label = 2 THEN base END) AS base2
  FROM cls GROUP BY model)
SELECT model, doc_id, dataset, y, CASE WHEN sc0 = best THEN 0 WHEN sc1 = best THEN 1 WHEN sc2 = best THEN 2 END AS pred
FROM (SELECT *, greatest(sc0, sc1, sc2) AS best FROM (
  SELECT d.model, d.doc_id, d.dataset, d.y,
    c.prior0 + coalesce(s.S, 0) * c.base0 + coalesce(s.s0, 0) AS sc0,
    c.prior1 + coalesce(s.S, 0) * c.base1 + coalesce(s.s1, 0) AS sc1,
    c.prior2 + coalesce(s.S, 0) * c.base2 + coalesce(s.s2, 0) AS sc2
  FROM (SELECT m.model, t.pair_id AS doc_id, t.dataset, t.label AS y
        FROM test_s t CROSS JOIN (SELECT DISTINCT dataset AS model FROM train_s) m) d
  LEFT JOIN (SELECT f.model, f.doc_id, sum(f.x) AS S, sum(f.x * coalesce(m.d0, 0)) AS s0,
                    sum(f.x * coalesce(m.d1, 0)) AS s1, sum(f.x * coalesce(m.d2, 0)) AS s2
             FROM {te} f LEFT JOIN fm m ON m.model = f.model AND m.f = f.f
             GROUP BY f.model, f.doc_id) s ON s.model = d.model AND s.doc_id = d.doc_id
  JOIN cw c ON c.model = d.model) a) b"""
