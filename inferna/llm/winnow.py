"""Benchmark decontamination by winnowing.

Every text becomes words; k-gram hashes; and, for every run of ``window - k + 1``
of them, the least one.  Two texts that share ``window`` words share the run of
k-grams in it, so also its least: joining the chosen fingerprints of documents
and items finds every shared window, with about 2 / (window - k + 2) of the
k-grams joined.  Hits are then extended: in documents with a hit, the windows
whose fingerprint was hit are compared word for word with the items' windows.
Items shorter than ``window`` words are one window; their one fingerprint is the
hash of all their words, joined at that length.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inferna.llm.common import ascii_lower, bounded_broadcast, let, row_key, stage

#: Fixed value: what parts words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    """Words of a whole text, A-Z lower-cased; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), NOT_WORD, -1), lambda w: w != "")


def grams(words: Column, n: int) -> Column:
    """Hash of each run of ``n`` words, in order; empty for fewer words."""
    return F.when(F.size(words) >= n, F.transform(
        F.sequence(F.lit(1), F.size(words) - (n - 1)),
        lambda i: F.xxhash64(F.slice(words, i, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))


def fingerprints(words: Column, n: int, window: int, k: int) -> Column:
    """Fingerprint of each window of ``n`` words: the least of its k-grams, or for short windows its own hash."""
    run = window - k + 1
    if n < window:
        return grams(words, n)
    return let(grams(words, k), lambda kg: F.when(F.size(kg) >= run, F.transform(
        F.sequence(F.lit(1), F.size(kg) - (run - 1)),
        lambda i: F.array_min(F.slice(kg, i, F.lit(run))))).otherwise(F.array().cast("array<bigint>")))


def item_windows(items: DataFrame, item: str, text: str, window: int, k: int) -> DataFrame:
    """(item, n, fp, win): each distinct window of each item, its words joined by blanks, and its fingerprint."""
    w = items.select(F.col(f"`{item}`").cast("string").alias("item"), words_of(f"`{text}`").alias("words")).where("size(words) > 0")
    long = (w.where(F.size("words") >= window)
            .select("item", "words", F.posexplode_outer(fingerprints(F.col("words"), window, window, k)).alias("i", "fp"))
            .select("item", F.lit(window).alias("n"), "fp", F.array_join(F.expr(f"slice(words, i + 1, {window})"), " ").alias("win")))
    short = w.where(F.size("words") < window).select(
        "item", F.size("words").alias("n"), F.xxhash64("words").alias("fp"), F.array_join("words", " ").alias("win"))
    return long.unionByName(short).distinct()


def hit_results(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                item_text: str = "text", window: int = 10, k: int = 7) -> DataFrame:
    """(_k1, _k2, n_hit, n_items, items_sha256) of the documents with hit words, by ``row_key(key, text)``."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body"))
    rows = rows.select("id", "body", *row_key("id", "body"))
    wins = stage(item_windows(items, item, item_text, window, k), "winnow-items")
    n_wins = wins.count()
    lengths = [r["n"] for r in wins.select("n").distinct().orderBy("n").collect()]  # at most ``window`` numbers
    none = F.array().cast("array<struct<n:int,fp:bigint>>")

    # Every document: its distinct fingerprints against those of the items.
    def chosen(w: Column, n: int) -> Column:
        return F.transform(F.array_distinct(fingerprints(w, n, window, k)), lambda x: F.struct(F.lit(n).alias("n"), x.alias("fp")))

    per = let(words_of("body"), lambda w: F.concat(none, *[chosen(w, n) for n in lengths]))
    probe = rows.select("_k1", "_k2", F.explode_outer(per).alias("x")).select("_k1", "_k2", "x.n", "x.fp")
    keys = bounded_broadcast(wins.select("n", "fp").distinct(), n_wins, 16)
    hits = probe.join(keys, ["n", "fp"], "left_semi").groupBy("_k1", "_k2").agg(F.collect_set(F.struct("n", "fp")).alias("hits"))
    hits = stage(hits, "winnow-hits")

    # Documents with a hit: the windows whose fingerprint was hit, compared word for word.
    def spots_of(w: Column, n: int) -> Column:
        hit = F.transform(fingerprints(w, n, window, k), lambda x, i: F.struct(
            F.lit(n).alias("n"), x.alias("fp"), i.alias("at")))
        hit = F.filter(hit, lambda s: F.array_contains("hits", F.struct(s["n"].alias("n"), s["fp"].alias("fp"))))
        return F.transform(hit, lambda s: F.struct(s["n"].alias("n"), s["fp"].alias("fp"), s["at"].alias("at"), F.array_join(
            F.slice(w, s["at"] + 1, s["n"]), " ").alias("win")))

    found = rows.drop("id").join(hits.hint("merge"), ["_k1", "_k2"])
    none = F.array().cast("array<struct<n:int,fp:bigint,at:int,win:string>>")
    spots = (found.select("_k1", "_k2", F.explode_outer(let(words_of("body"), lambda w: F.concat(
                 none, *[spots_of(w, n) for n in lengths]))).alias("s")).select("_k1", "_k2", "s.*"))
    known = bounded_broadcast(wins.select("n", "fp", "win").distinct(), n_wins, 400)
    true = stage(spots.join(known, ["n", "fp", "win"], "left_semi").distinct(), "winnow-true")

    # Hit words: the windows' union, as gaps between running ends.
    before = Window.partitionBy("_k1", "_k2").orderBy("at", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    ends = true.withColumn("reach", F.coalesce(F.max(F.col("at") + F.col("n")).over(before), F.lit(0)))
    n_hit = ends.groupBy("_k1", "_k2").agg(F.sum(F.greatest(
        F.lit(0), F.col("at") + F.col("n") - F.greatest("at", "reach"))).cast("long").alias("n_hit"))
    of_items = (true.select("_k1", "_k2", "n", "fp", "win").distinct()
                .join(bounded_broadcast(wins, n_wins, 420), ["n", "fp", "win"]).where("item is not null")
                .select("_k1", "_k2", "item").distinct().groupBy("_k1", "_k2")
                .agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256")))
    return stage(n_hit.join(of_items, ["_k1", "_k2"], "left"), "winnow-result")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = 10, k: int = 7) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    A word counts as hit if it lies in any window of ``window`` words that also
    is a window of an item.  Equal rows are worked out once and all returned;
    null and empty texts have no words and no hits; null keys are kept; null item
    ids count as no item; no items: nothing is hit.
    """
    result = hit_results(docs, items, key, text, item, item_text, window, k)
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body"))
    n_words = rows.select("id", *row_key("id", "body"), F.size(words_of("body")).cast("long").alias("n_words"))
    return n_words.join(result, ["_k1", "_k2"], "left").select(
        F.col("id").alias(key), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"))
