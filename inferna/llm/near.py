"""Near-duplicate classes from banded signatures, shared by the two operators that band.

Entries are distinct texts.  Entries with an equal band share a bucket.  Pairs
of a bucket are not formed.  Every member meets its bucket's leader, the member
that shares most buckets with others: in a group of edited copies that is the
text nearest to all, and most copies join its class at once.  Members left
outside choose a second leader among themselves.

What is left are pairs of one leader's members in different classes.  Let I be
what a member has in common with the leader l and E its shingles beyond l's.
Two members u, v have at most min(Iu, Iv) + |Eu and Ev| in common, and must have
s / (1 + s) x (|u| + |v|) to be near.  So only those pairs are formed, and then
tested, that share excess shingles (an equi-join on them, with min(|Eu|, |Ev|) in
place of the shared ones as its condition) or pass without any.  A member v must
share at least s |v| - Iv of its excess, so all but one of that many are left out
of the join on both sides, the commonest first (prefix filtering).
That bound is exact: no link between two members of a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inferna.llm.common import bounded_broadcast, stage


def components(ids: DataFrame, links: DataFrame, n_links: int) -> DataFrame:
    """(id, label): least id of the component of every row of ``ids`` under ``n_links`` rows of ``links`` (a, b).

    Each round a label becomes the least of itself, its neighbours' labels and
    its label's label, so chains shrink by halves; each is a table in the shared
    folder.
    """
    n = 2 * n_links
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                 "near-links", n)
    active = stage(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("l")).select("id", F.least("id", "l").alias("label")),
                   "near-labels", n)
    while True:
        told = (both.join(bounded_broadcast(active.select(F.col("id").alias("b"), F.col("label").alias("l")), n, 16), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("l").alias("l")))
        jump = active.select(F.col("id").alias("label"), F.col("label").alias("far"))
        nxt = (active.join(bounded_broadcast(told, n, 16), "id").join(bounded_broadcast(jump, n, 16), "label", "left")
               .select("id", F.col("label").alias("was"), F.least("label", "l", "far").alias("label")))
        active = stage(nxt, "near-labels", n)
        if active.where("was <> label").isEmpty():
            break
        active = active.select("id", "label")
    touched = active.select("id", F.col("label").alias("l"))
    return ids.join(bounded_broadcast(touched, n, 16), "id", "left").select("id", F.coalesce("l", "id").alias("label"))


def classes(buckets: DataFrame, features: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame], DataFrame],
            similarity: float, merge: bool = False) -> DataFrame:
    """(id, label) for every id that shares a bucket in ``buckets`` (distinct id, bucket); label is the class's least id.

    ``features`` takes the ids (id) that share a bucket and returns (id, f);
    ``compare`` takes distinct pairs (a, b, fa, fb) and returns (a, b, near,
    size_a, size_b, common, excess) as ``shingles.compare`` defines them.  With
    ``merge`` the buckets meet their counts in a merge join at every size.
    """
    # a table of its own: a join straight from an aggregation would not be split for a hot bucket
    several = stage(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "near-several")
    shared = stage(buckets.join(several.hint("merge") if merge else several, "bucket"), "near-buckets")
    n = shared.count()
    # how many others an entry meets, over all its buckets
    ids = stage(shared.groupBy("id").agg(F.sum("n").alias("met")), "near-ids", n)
    n_ids = ids.count()
    feats = stage(features(ids.select("id")), "near-features")
    shared = stage(shared.select("id", "bucket").join(bounded_broadcast(ids, n_ids, 16), "id"), "near-met", n)

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        return stage(compare(pairs.join(feats.select(F.col("id").alias("a"), F.col("f").alias("fa")), "a")
                             .join(feats.select(F.col("id").alias("b"), F.col("f").alias("fb")), "b")), name)

    def against_leaders(held: DataFrame, name: str) -> DataFrame:
        """Each member of a bucket against its leader, the member that meets most."""
        lead = held.groupBy("bucket").agg(F.min_by("id", F.struct(-F.col("met"), "id")).alias("a"))
        return compared(held.join(bounded_broadcast(lead, n, 16), "bucket").where("id <> a")
                        .select("a", F.col("id").alias("b")).distinct(), name)

    first = against_leaders(shared, "near-first")
    links = first.where("near").select("a", "b")
    n_links = links.count()
    if n_links:
        label = stage(components(ids.select("id"), links, n_links), "near-classes", n_ids)
    else:
        label = stage(ids.select("id", F.col("id").alias("label")), "near-classes", n_ids)

    # members outside their first leader's class choose leaders among themselves
    held = shared.join(bounded_broadcast(label, n_ids, 16), "id")
    most = held.groupBy("bucket").agg(F.min_by("label", F.struct(-F.col("met"), "id")).alias("top"))
    outside = held.join(bounded_broadcast(most, n, 16), "bucket").where("label <> top").select("id", "bucket", "met")
    second = against_leaders(outside, "near-second")
    more = second.where("near").select("a", "b")
    n_more = more.count()
    if n_more:
        links, n_links = links.unionByName(more), n_links + n_more
        label = stage(components(ids.select("id"), links, n_links), "near-classes", n_ids)

    # pairs of one leader's members in different classes that can still be near
    share = similarity / (1 + similarity)
    lab = bounded_broadcast(label, n_ids, 16)
    group = (first.select("a", F.col("b").alias("id"), "near", F.col("size_b").alias("size"), "common", "excess")
             .join(lab, "id"))
    torn = group.where("not near").select("a").distinct()
    group = stage(group.join(torn, "a", "left_semi"), "near-torn")
    # each member's excess in one order, the commonest first, without as many as a near pair can spare
    exploded = group.withColumn("x", F.explode_outer("excess")).drop("excess").where("x is not null")
    often = exploded.groupBy("a", "x").agg(F.count("*").alias("often"))
    turn = F.row_number().over(Window.partitionBy("a", "id").orderBy(F.desc("often"), "x"))
    spare = F.greatest(F.lit(0), F.ceil(similarity * F.col("size") - F.col("common") - 1e-6) - 1)
    kept = stage(exploded.join(often, ["a", "x"]).withColumn("turn", turn).withColumn("spare", spare)
                 .where("turn > spare").drop("often", "turn"), "near-excess")

    def named(t: DataFrame, side: str) -> DataFrame:
        return t.select("a", *[F.col(c).alias(c + side) for c in t.columns if c not in ("a", "x", "excess", "near")],
                        *[c for c in t.columns if c == "x"])

    least = share * (F.col("size1") + F.col("size2")) - 1e-6
    common, other = F.least("common1", "common2"), F.col("label1") != F.col("label2")
    excess = F.least(F.col("size1") - F.col("common1"), F.col("size2") - F.col("common2"))
    plain = (named(group.where("not near"), "1").join(named(group, "2"), "a").where(other & (common >= least)).select("id1", "id2"))
    sharing = (named(kept.where("not near"), "1").join(named(kept, "2"), ["a", "x"]).where(other & (common + excess >= least))
               .groupBy("a", "id1", "id2", "size1", "size2", "common1", "common2", "spare1", "spare2")
               .agg(F.count("*").alias("both"))
               .where(common + F.col("both") + F.col("spare1") + F.col("spare2") >= least).select("id1", "id2"))
    pairs = plain.unionByName(sharing).select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()
    last = compared(pairs, "near-last").where("near").select("a", "b")
    n_last = last.count()
    if n_last:
        label = stage(components(ids.select("id"), links.unionByName(last) if links is not None else last, n_links + n_last),
                      "near-classes", n_ids)
    return label
