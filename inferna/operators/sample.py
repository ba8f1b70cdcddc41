"""Reproducible sampling, split sizing, train/validation split and k-fold
assignment (A2-A8, T2, T6) — exact and skew-safe.

Row order inside a group is md5(seed ':' key): engine-independent, so the
SQL oracle can reproduce it.  No step sorts a whole group in one task:

* ``group_rank`` gives the exact 1-based rank of every row inside its group
  by splitting each group into hash buckets small enough for one task; the
  rank is (rows of the group in earlier buckets) + (rank inside the bucket).
  A group holding a third of all rows is spread over many buckets.
* ``take_first_n`` (quota sampling) first keeps only rows under a per-group
  hash threshold that is checked to contain at least the quota, then ranks
  that small candidate set — the n smallest hashes are provably inside it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

SEED = 42
HASH_BITS = 60          # bits of the md5 prefix used for bucketing
BUCKET_ROWS = 200_000   # rows per bucket aimed at by group_rank
MAX_GROUPS = 1_000_000  # bound for the per-group tables that get broadcast


def order_key(key: Column, seed: int = SEED) -> Column:
    """md5 hex of seed:key — the sampling order of a row."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _h60(md5hex: Column) -> Column:
    return F.conv(F.substring(md5hex, 1, HASH_BITS // 4), 16, 10).cast("long")


def _frac(md5hex: Column) -> Column:
    return _h60(md5hex).cast("double") / float(1 << HASH_BITS)


def _check_groups(n: int) -> None:
    if n > MAX_GROUPS:
        raise ValueError(f"{n} groups exceed the broadcast bound {MAX_GROUPS}")


def group_rank(df: DataFrame, group_cols: list[str], ok_col: str, rank_col: str = "rank",
               max_group: int | None = None) -> DataFrame:
    """Exact 1-based rank by ``ok_col`` (an md5 hex column) within each group.

    ``max_group`` (largest group size) is measured when not given."""
    if max_group is None:
        stats = df.groupBy(*group_cols).count() \
            .agg(F.max("count").alias("mx"), F.count(F.lit(1)).alias("g")).first()
        if stats is None or stats["mx"] is None:
            return df.withColumn(rank_col, F.lit(None).cast("long"))
        _check_groups(stats["g"])
        max_group = stats["mx"]
    bits = max(0, min(40, math.ceil(math.log2(max(1, max_group) / BUCKET_ROWS)) + 1))
    if bits == 0:
        # every group fits one task: a plain window is exact and cheapest
        return df.withColumn(rank_col, F.row_number().over(
            Window.partitionBy(*group_cols).orderBy(ok_col)).cast("long"))
    b = df.withColumn("_bucket", F.shiftright(_h60(F.col(ok_col)), HASH_BITS - bits))
    hist = b.groupBy(*group_cols, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.select(*group_cols, "_bucket", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    joined = b.join(offsets, [*group_cols, "_bucket"])
    local = F.row_number().over(Window.partitionBy(*group_cols, "_bucket").orderBy(ok_col))
    return joined.withColumn(rank_col, (F.col("_off") + local).cast("long")).drop("_bucket", "_off")


def take_first_n(df: DataFrame, group_cols: list[str], quotas: DataFrame, ok_col: str,
                 slack: float = 1.2, counts: DataFrame | None = None) -> DataFrame:
    """Rows whose rank by ``ok_col`` inside their group is <= quota ``n``.

    ``quotas``: group_cols + n; ``counts`` (optional): group_cols + _size, the
    group sizes when already known.  Both are one row per group (small);
    they are collected once (bounded by MAX_GROUPS) and broadcast back."""
    spark = df.sparkSession
    if counts is None:
        counts = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_size"))
    rows = quotas.join(counts, group_cols).where(F.col("n") > 0).limit(MAX_GROUPS + 1).collect()
    _check_groups(len(rows))
    keys = quotas.join(counts, group_cols).select(*group_cols).schema
    schema = StructType([*keys.fields, StructField("n", LongType()), StructField("_tau", DoubleType())])
    table = {tuple(r[g] for g in group_cols): [int(r["n"]), int(r["_size"])] for r in rows}
    # hash-fraction threshold: expected n*slack rows plus 6 sigma
    tau = {k: min(1.0, (n * slack + 6 * math.sqrt(n) + 16) / N) for k, (n, N) in table.items()}
    while True:   # a threshold of 1.0 holds its whole group, so this ends
        qdf = spark.createDataFrame([(*k, n, tau[k]) for k, (n, N) in table.items()], schema)
        cand = df.join(F.broadcast(qdf), group_cols).where(_frac(F.col(ok_col)) <= F.col("_tau"))
        got = {tuple(r[g] for g in group_cols): r["_c"]
               for r in cand.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_c")).collect()}
        short = [k for k, (n, N) in table.items() if got.get(k, 0) < min(n, N)]
        if not short:
            break
        for k in short:
            tau[k] = min(1.0, tau[k] * 4)
    biggest = max(got.values()) if got else 0
    ranked = group_rank(cand.drop("_tau"), group_cols, ok_col, "_rank", max_group=biggest)
    return ranked.where(F.col("_rank") <= F.col("n")).drop("_rank", "n")


# ---- sizes ---------------------------------------------------------------

def split_sizes_cols(total: Column, train_ratio: float = 0.8, val_ratio: float = 0.1) -> list[Column]:
    """A6, both versions, as column expressions of a total.

    pipeline: train = floor(t*r_train), val = floor(t*r_val), test = rest.
    utility:  same, but train/val bumped to 1 when they round to 0 and room
    is left; test takes the rest."""
    t = total.cast("long")
    tr = F.floor(t * train_ratio).cast("long")
    va = F.floor(t * val_ratio).cast("long")
    u_tr = F.when((tr == 0) & (t >= 1), F.lit(1)).otherwise(tr).cast("long")
    rem = t - u_tr
    u_va = F.least(F.when((va == 0) & (rem > 0), F.lit(1)).otherwise(va), rem).cast("long")
    return [tr.alias("train_n"), va.alias("val_n"), (t - tr - va).alias("test_n"),
            u_tr.alias("u_train_n"), u_va.alias("u_val_n"), (t - u_tr - u_va).alias("u_test_n")]


def split_targets(total_sample: int, train_ratio: float = 0.8, val_ratio: float = 0.1) -> dict[str, int]:
    """Target rows per split for a total sample size (pipeline version)."""
    tr = int(total_sample * train_ratio)
    va = int(total_sample * val_ratio)
    return {"train": tr, "validation": va, "test": total_sample - tr - va}


def strata_sizes(df: DataFrame, group_cols: list[str], targets: DataFrame,
                 label_col: str = "label") -> DataFrame:
    """A2/A3: per (group, label) available rows and target rows.

    q = round_half_even(c / N * t); the rounding remainder goes to the
    largest stratum (ties: smallest label).  t >= N keeps everything.
    ``targets`` has group_cols + t.  Output: group_cols, label, c, n."""
    c = df.groupBy(*group_cols, label_col).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*group_cols)   # <= number of classes rows per group
    on = [g for g in group_cols if g in targets.columns]
    s = (c.join(F.broadcast(targets), on)
         .withColumn("N", F.sum("c").over(w))
         .withColumn("n_labels", F.count(F.lit(1)).over(w))
         .withColumn("q0", F.bround((F.col("c") / F.col("N")) * F.col("t"), 0).cast("long"))
         .withColumn("big", F.row_number().over(w.orderBy(F.desc("c"), F.col(label_col))))
         .withColumn("q", F.col("q0") + F.when(F.col("big") == 1,
                                               F.col("t") - F.sum("q0").over(w)).otherwise(F.lit(0))))
    n = (F.when(F.col("t") <= 0, F.lit(0))
         .when(F.col("t") >= F.col("N"), F.col("c"))
         .otherwise(F.least(F.col("c"), F.greatest(F.col("q"), F.lit(0))))).cast("long")
    return s.select(*group_cols, label_col, F.col("c").cast("long").alias("c"), n.alias("n"),
                    F.col("n_labels").cast("long").alias("n_labels"))


def stratified_sample(df: DataFrame, total_sample: int, key_col: str = "pair_id",
                      label_col: str = "label", seed: int = SEED) -> DataFrame:
    """A4/A5 per (dataset, split): exact stratified sample of the split's
    target size (simple sample when the split has one label), with a
    ``sample_id`` column naming the target (fixes D5)."""
    spark = df.sparkSession
    tg = split_targets(total_sample)
    targets = spark.createDataFrame(list(tg.items()), "split string, t long")
    groups = ["dataset", "split"]
    sizes = strata_sizes(df, groups, targets, label_col)
    keyed = df.withColumn("_ok", order_key(F.col(key_col), seed))
    out = take_first_n(keyed, [*groups, label_col], sizes.select(*groups, label_col, "n"), "_ok",
                       counts=sizes.select(*groups, label_col, F.col("c").alias("_size")))
    sid = F.concat(F.lit("sample"), F.element_at(
        F.create_map(*[x for k, v in tg.items() for x in (F.lit(k), F.lit(str(v)))]), F.col("split")))
    return out.drop("_ok").withColumn("sample_id", sid)


def train_val_split(df: DataFrame, val_fraction: float = 0.2, key_col: str = "pair_id",
                    label_col: str = "label", group_cols: list[str] | None = None,
                    seed: int = SEED) -> DataFrame:
    """Stratified split — per label the first round_half_even(c * f)
    rows by hash order are validation, the rest train (column ``part``)."""
    groups = [*(group_cols or []), label_col]
    keyed = df.withColumn("_ok", order_key(F.col(key_col), seed))
    ranked = group_rank(keyed, groups, "_ok", "_rank")
    c = keyed.groupBy(*groups).agg(F.count(F.lit(1)).alias("_c"))
    quota = c.select(*groups, F.bround(F.col("_c") * val_fraction, 0).cast("long").alias("_q"))
    return (ranked.join(F.broadcast(quota), groups)
            .withColumn("part", F.when(F.col("_rank") <= F.col("_q"), F.lit("validation"))
                        .otherwise(F.lit("train")))
            .drop("_ok", "_rank", "_q"))


def kfold(df: DataFrame, k: int = 5, key_col: str = "pair_id", label_col: str = "label",
          group_cols: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """Stratified k-fold — fold = (rank within label - 1) mod k."""
    groups = [*(group_cols or []), label_col]
    keyed = df.withColumn("_ok", order_key(F.col(key_col), seed))
    ranked = group_rank(keyed, groups, "_ok", "_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_ok", "_rank")


def limit_rows(df: DataFrame, n: int, key_col: str = "pair_id") -> DataFrame:
    """The first n rows by key (TakeOrdered: bounded by n per task)."""
    return df.orderBy(key_col).limit(n)


def shuffle_rows(df: DataFrame, key_col: str = "pair_id", seed: int = SEED) -> DataFrame:
    """A reproducible shuffled order (range-partitioned global sort)."""
    return df.orderBy(order_key(F.col(key_col), seed), key_col)
