"""URL filter: sort-merge range join of urls with nested prefix rules.

A rule is (host, path, verdict).  It fits its host and all subdomains when the
url's path starts with the rule's path; the longest fitting rule (host and path
together, then the longer host) wins.

Canonical keys are the reversed host labels, ``/``, the path, as bytes
(``org.example//es/``).  No host holds a ``/``, so a rule fits a url exactly if
the rule's key is a prefix of the url's key cut at the rule's host depth.  A
prefix is the interval [key, key + 0xFF): 0xFF never occurs in UTF-8.  Intervals
of prefixes nest, so a sweep over sorted starts, ends and points needs a stack:
a start pushes its rule, an end pops to the rule below.  What a point needs is
the top of the stack, so a start event carries its rule, an end event the rule
below it, and a point takes the last event before it.  The sweep is dealt out by
key ranges; each range takes over the top that the ranges before it left.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inferna.llm.common import ascii_lower, narrowed, stage

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: str):
    """Columns (host, path) of a url column; both empty for null or without ``://``."""
    c = F.col(f"`{url}`")
    host = ascii_lower(F.regexp_extract(c, PARTS, 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(c, PARTS, 2), F.lit(""))


def _key(reversed_host, path):
    return F.concat(reversed_host, F.lit("/"), path).cast("binary")


def _reversed_labels(host):
    return F.reverse(F.split(host, r"\.", -1))


def rule_events(rules: DataFrame) -> DataFrame:
    """Starts and ends of the rules' intervals with the top of the stack after each.

    The rule below is the longest proper prefix among the rules: each rule's key
    is cut at every length and joined with the keys (rules x key length rows).
    Rules with the same host and path count once, ``block`` before ``allow``.
    """
    r = (narrowed(rules, ["host", "path", "verdict"]).na.drop(subset=["host", "verdict"])
         .withColumn("host", ascii_lower(F.col("host"))).withColumn("path", F.coalesce("path", F.lit("")))
         .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
         .withColumn("labels", _reversed_labels(F.col("host")))
         .select(_key(F.array_join("labels", "."), F.col("path")).alias("key"),
                 F.struct(F.concat("host", "path").alias("rule"), "verdict",
                          F.size("labels").alias("depth")).alias("top")))
    cuts = (r.select(F.col("key").alias("child"),
                     F.explode(F.sequence(F.lit(1), F.length("key") - 1)).alias("n"))
            .select("child", F.expr("substring(child, 1, n)").alias("key")))
    below = cuts.join(r, "key").groupBy("child").agg(F.max_by("top", F.length("key")).alias("below"))
    both = r.join(below, r["key"] == below["child"], "left").select("key", "top", "below")
    starts = both.select("key", F.lit(1).alias("kind"), "top", F.lit(True).alias("event"))
    ends = both.select(F.concat("key", F.lit(bytearray(b"\xff"))).alias("key"), F.lit(0).alias("kind"),
                       F.col("below").alias("top"), F.lit(True).alias("event"))
    return starts.unionByName(ends)


def sweep(points: DataFrame, events: DataFrame) -> DataFrame:
    """``points`` (key, columns) with ``top``, the innermost rule whose interval holds the key (or null)."""
    extra = [c for c in points.columns if c != "key"]
    p = points.select("key", F.lit(2).alias("kind"), F.lit(False).alias("event"), *extra)
    dealt = (events.unionByName(p, allowMissingColumns=True)
             .repartitionByRange("key", "kind").withColumn("pid", F.spark_partition_id()))
    dealt = stage(dealt, "url-sweep")
    # One row for each range: what its last event left, then what the ranges before it left.
    left = dealt.where("event").groupBy("pid").agg(F.max_by(F.struct("top"), F.struct("key", "kind")).alias("left"))
    pids = dealt.select("pid").distinct().join(left, "pid", "left")
    before = pids.select("pid", F.last("left", True).over(
        Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    w = Window.partitionBy("pid").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("seen", F.last(F.when(F.col("event"), F.struct("top")), True).over(w))
    return (swept.where(~F.col("event")).join(before, "pid", "left")
            .select("key", F.coalesce("seen", "before")["top"].alias("top"), *extra))


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
                default: str = "allow") -> DataFrame:
    """Verdict for every row of ``pages``: (key, host, path, rule, verdict).

    Only distinct (host, path) pairs are swept, once for each host depth that
    rules have; repeated urls come back by a join, whose hot keys adaptive
    execution splits.  Null urls and urls without ``://`` have empty host and
    path, fit no rule and get ``default``; repeated rows are all returned; null
    keys are kept; empty tables give no rows; no rules give ``default``.
    """
    host, path = url_parts(url)
    rows = pages.select(F.col(f"`{key}`").alias(key), host.alias("host"), path.alias("path"))
    depth = rules.select(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 0
    labels = F.slice(_reversed_labels(F.col("host")), 1, max(1, depth))
    points = (rows.select("host", "path").where("host <> ''").distinct()
              .withColumn("labels", labels)
              .select("host", "path", F.explode(F.transform(
                  F.sequence(F.lit(1), F.size("labels")),
                  lambda n: _key(F.array_join(F.slice(F.col("labels"), F.lit(1), n), "."), F.col("path")))).alias("key")))
    swept = sweep(points, rule_events(rules)).where("top is not null")
    best = swept.groupBy("host", "path").agg(
        F.max_by("top", F.struct(F.length("top.rule"), "top.depth")).alias("top"))
    return rows.join(best, ["host", "path"], "left").select(
        key, "host", "path", F.col("top.rule").alias("rule"),
        F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
