"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return put


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _op10_sql() -> str:
    fits = " UNION ALL ".join(
        f"SELECT page_id, url, '{h}{p}' AS rule, '{v}' AS verdict FROM u "
        f"WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, v in URL_RULES)
    return rf"""
WITH u AS (SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
fit AS ({fits}),
best AS (SELECT page_id, url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fit GROUP BY page_id, url)
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM u LEFT JOIN best b ON u.page_id = b.page_id AND u.url = b.url"""


@register("op10_url_filter", _op10_sql())
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inferna.llm.url_filter import filter_urls
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex, body FROM p),
b AS (SELECT hex, payload_bytes, max(page_id) AS best FROM d GROUP BY hex, payload_bytes)
SELECT d.page_id, d.payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(d.hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN d.page_id IS NOT DISTINCT FROM b.best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id IS NOT DISTINCT FROM b.best THEN NULL ELSE b.best END AS refers_to
FROM d JOIN b ON d.hex = b.hex AND d.payload_bytes = b.payload_bytes"""


@register("op2_warc_zip", OP2_SQL)
def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inferna.llm.warc_zip import round_trip
    return round_trip(table(spark, sf_dir, "pages"))


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
OP6_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bn AS (SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
         FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
ns AS (SELECT DISTINCT n FROM bwin),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns)),
hit AS (SELECT DISTINCT d.doc_id, d.n, d.i, b.item_id FROM dwin d JOIN bwin b ON d.n = b.n AND d.win = b.win),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w) AS n_words, coalesce(hw.n_hit, 0) AS n_hit, coalesce(hi.n_items, 0) AS n_items,
  coalesce(hi.sha, sha256('')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw ON dw.doc_id = hw.doc_id LEFT JOIN hi ON dw.doc_id = hi.doc_id"""


@register("op6_winnow_decontaminate", OP6_SQL)
def op6_winnow_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inferna.llm.winnow import decontaminate
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from inferna.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op3_hash_forest")
def op3_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from inferna.llm.hash_forest import nearest
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@register("op9_bag_minhash")
def op9_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inferna.llm.bag_minhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op8_line_templates")
def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from inferna.llm.line_templates import drop_recurring
    cut = drop_recurring(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register("op7_cotraining_quality")
def op7_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from inferna.llm.cotraining import classify
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.col("_content").alias("content_score"), F.col("_meta").alias("meta_score"),
                         F.col("_score").alias("score"), F.col("_keep").alias("keep"))


@register("op4_paragraph_bands")
def op4_paragraph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inferna.llm.paragraph_bands import repeated_passages
    return repeated_passages(table(spark, sf_dir, "documents"))


@register("op1_prefix_free_dedup")
def op1_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from inferna.llm.prefix_free import remove_repeats
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op11_pigeonring")
def op11_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from inferna.llm.pigeonring import near_duplicates
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


#: CRC-32 of the decimal id, bit by bit, as the row expression ``h``.
_CRC = """(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(conv_id::VARCHAR)), lambda i:
      CASE WHEN i % 8 = 0 THEN 2 + ascii(substr(conv_id::VARCHAR, (i // 8 + 1)::BIGINT, 1))::BIGINT ELSE 1::BIGINT END)),
    lambda crc, b: CASE WHEN xor(crc, CASE WHEN b > 1 THEN b - 2 ELSE 0 END) & 1 = 1
      THEN xor(xor(crc, CASE WHEN b > 1 THEN b - 2 ELSE 0 END) >> 1, 3988292384::BIGINT)
      ELSE xor(crc, CASE WHEN b > 1 THEN b - 2 ELSE 0 END) >> 1 END), 4294967295::BIGINT) % 4)"""
OP12_SQL = rf"""
WITH c AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, {_CRC} AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns
      FROM h LEFT JOIN h b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d AS depth, turns[1:d] AS path, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
        CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[depth].text, '[^ 	-
]+')) END AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
      FROM p GROUP BY depth, path),
k AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS MATERIALIZED (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.depth = k.depth AND n.path = k.path),
t AS (SELECT a AS depth, path[1:a] AS path, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
      FROM (SELECT *, unnest(range(depth + 1)) AS a FROM m) GROUP BY ALL)
SELECT m.conv_id, m.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, t.n_leaves, t.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN t ON m.depth = t.depth AND m.path = t.path LEFT JOIN n q ON m.depth > 0 AND q.depth = m.depth - 1 AND q.path = m.path[1:m.depth - 1]"""


@register("op12_prefix_trie", OP12_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inferna.llm.prefix_trie import rebuilt_trie
    return rebuilt_trie(table(spark, sf_dir, "conversations")).drop("k1", "k2")


def _op13_sql() -> str:
    rounds, near = "", """near{i} AS MATERIALIZED (SELECT rid, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (
  SELECT p.rid, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x))::BIGINT AS far FROM p JOIN book{i} b ON p.part = b.part AND p.place = b.place
  GROUP BY p.rid, p.part, b.entry) GROUP BY rid, part)"""
    for i in range(4):
        rounds += near.format(i=i) + f""",
book{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.x)::BIGINT AS x
  FROM book{i} b LEFT JOIN (SELECT p.part, n.entry, p.place, sum(p.x)::BIGINT AS s, count(*) AS n FROM p JOIN near{i} n ON p.rid = n.rid AND p.part = n.part GROUP BY ALL) m
  ON b.part = m.part AND b.entry = m.entry AND b.place = m.place),
"""
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, (i * 4) // n AS part, i % (n // 4) AS place, floor(1024 * v[i + 1])::BIGINT AS x
  FROM (SELECT rid, v, len(v) AS n, unnest(range(len(v))) AS i FROM kept)),
book0 AS MATERIALIZED (SELECT p.part, s.entry, p.place, p.x FROM p JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256) s ON p.rid = s.rid),
{rounds}{near.format(i=4)},
e AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM near4 GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) FROM book4) AS codebooks_sha256
FROM kept JOIN e ON kept.rid = e.rid"""


@register("op13_orchard_codes", _op13_sql())
def op13_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inferna.llm.orchard_codes import compress
    return compress(table(spark, sf_dir, "embeddings"))
