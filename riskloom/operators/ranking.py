"""Exact ranks without single-task windows.

``row_number() OVER (PARTITION BY class ORDER BY key)`` puts a whole class into
one task; with two classes that is half the data per task. Both helpers here
produce the same exact numbers while bounding every window by a bucket:

* :func:`hashed_rank` orders by a seeded md5 key. The key is uniform, so its
  hex prefix splits each group into equal range buckets; a window ranks inside
  (group, bucket) and a prefix sum over the small bucket-count table adds the
  offset of all earlier buckets of the group.
* :func:`dense_ids` numbers rows 1..N in an arbitrary total order by range
  partitioning, cutting lineage in the shared checkpoint folder (so partition
  ids are stable), then adding per-partition offsets (one count per partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import stored


def attach_group_values(df: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    """Add per-group values (one row per group) to every row of ``df``.

    With group keys this is an equi-join in which NULL keys match; the planner sees the
    size of the aggregate and picks the strategy. Without keys the single aggregate row
    is a scalar subquery of the same plan: no join without a key, and no job before.
    """
    if keys:
        return null_safe_join(df, per_group, keys)
    row = per_group.select(F.struct(*per_group.columns).alias("_gv_row")).scalar()
    wide = df.withColumn("_gv_row", row)
    return wide.withColumns({c: F.col("_gv_row")[c] for c in per_group.columns}).drop("_gv_row")


def null_safe_join(df: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which NULL equals NULL; the keys come once, from ``df``."""
    renamed = right.withColumnsRenamed({k: f"_ns_{k}" for k in keys})
    match = [df[k].eqNullSafe(renamed[f"_ns_{k}"]) for k in keys]
    return df.join(renamed, match, "inner").drop(*[f"_ns_{k}" for k in keys])


# 16**5 = 1,048,576 range buckets per group: at 10^12 rows a bucket holds ~10^6 rows.
DEFAULT_BUCKET_HEX_DIGITS = 5


def md5_key(id_col: str, seed: int | str | None) -> Column:
    """Seeded pseudo-random order key (same text in Spark and DuckDB)."""
    ident = F.col(id_col).cast("string")
    if seed is None:
        return F.md5(ident)
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), ident))


def hashed_rank(
    df: DataFrame,
    group_cols: list[str],
    id_col: str,
    seed: int | str | None = None,
    out: str = "rank_in_group",
    bucket_hex_digits: int = DEFAULT_BUCKET_HEX_DIGITS,
) -> DataFrame:
    """1-based rank of each row inside its group, ordered by (md5 key, id)."""
    key, bucket, local, offset = "_rk_key", "_rk_bucket", "_rk_local", "_rk_offset"
    keyed = df.withColumn(key, md5_key(id_col, seed)).withColumn(
        bucket, F.conv(F.substring(F.col(key), 1, bucket_hex_digits), 16, 10).cast("long")
    )
    counts = keyed.groupBy(*group_cols, bucket).agg(F.count(F.lit(1)).alias("_rk_n"))
    before = Window.partitionBy(*group_cols).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group_cols, bucket, F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).alias(offset)
    )
    ranked = keyed.withColumn(
        local, F.row_number().over(Window.partitionBy(*group_cols, bucket).orderBy(key, id_col))
    )
    joined = null_safe_join(ranked, offsets, [*group_cols, bucket])
    return joined.withColumn(out, (F.col(offset) + F.col(local)).cast("long")).drop(key, bucket, local, offset)


def dense_ids(df: DataFrame, order_cols: list, out: str = "row_id", start: int = 1, num_partitions: int | None = None) -> DataFrame:
    """Number rows ``start..start+N-1`` in ``order_cols`` order (the order must be total)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    pid, mono = "_di_pid", "_di_mono"
    # landed with each row's partition and place, so that both are stable and later reads prune columns
    tagged = stored(ordered.withColumn(pid, F.spark_partition_id()).withColumn(mono, F.monotonically_increasing_id()), "ordered")
    # One row per partition: the offset table is bounded by the partition count, never by the data.
    sizes = sorted(
        (r[pid], r["n"]) for r in tagged.groupBy(pid).agg(F.count(F.lit(1)).alias("n")).collect()
    )
    rows, running = [], 0
    for p, cnt in sizes:
        rows.append((int(p), int(running)))
        running += cnt
    offsets = spark.createDataFrame(rows or [(0, 0)], "_di_p INT, _di_off LONG")
    local = F.col(mono) - F.shiftleft(F.col(pid).cast("long"), 33)
    joined = tagged.join(F.broadcast(offsets), tagged[pid] == offsets["_di_p"], "inner")
    return joined.withColumn(out, (F.col("_di_off") + local + F.lit(start)).cast("long")).drop(
        pid, mono, "_di_p", "_di_off"
    )


SPLITS = 256  # ranges per group of a prefix scan; a power of two


def ordered_prefix_sums(
    df: DataFrame,
    group_cols: list[str],
    order_col: str,
    value_cols: list[str],
    splits: int = SPLITS,
    suffix: str = "_cum",
) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in ascending ``order_col`` within each group, NULL first.

    ``df`` must have one row per (group, order value), e.g. scores grouped with their
    counts. A two-phase prefix scan: quantile splitters of each group (a sketch with a
    guaranteed rank error, merged from all tasks) cut it into ``splits`` ranges of
    nearly equal row counts, however the values are spread; every row finds its range
    by binary search; a window inside (group, range) gives local sums, and a prefix
    over the range totals (``splits`` rows per group) gives each range's offset. The
    rows cross the network once.
    """
    if splits & (splits - 1):
        raise ValueError("splits must be a power of two")
    keys = list(group_cols)
    shares = ", ".join(f"{i / splits}D" for i in range(1, splits))
    cuts = df.withColumn("_ps_x", F.col(order_col).cast("double")).groupBy(*keys)
    cuts = cuts.agg(F.expr(f"percentile_approx(_ps_x, array({shares}), {16 * splits})").alias("_ps_cuts"))
    halves = F.array(*[F.lit(splits >> i) for i in range(1, splits.bit_length())])  # binary search for the cuts up to the value
    value = F.col(order_col).cast("double")
    at = F.aggregate(halves, F.lit(0), lambda pos, step: F.when(F.element_at("_ps_cuts", pos + step) <= value, pos + step).otherwise(pos))
    placed = attach_group_values(df, cuts, keys).withColumn("_ps_b", at).drop("_ps_cuts")
    totals = placed.groupBy(*keys, "_ps_b").agg(*[F.sum(v).alias(f"_ps_t_{v}") for v in value_cols])
    before = Window.partitionBy(*keys).orderBy("_ps_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_ps_b", *[F.coalesce(F.sum(f"_ps_t_{v}").over(before), F.lit(0)).alias(f"_ps_o_{v}") for v in value_cols]
    )
    upto = Window.partitionBy(*keys, "_ps_b").orderBy(F.col(order_col).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(v).over(upto).alias(f"_ps_l_{v}") for v in value_cols])
    out = null_safe_join(local, offsets, [*keys, "_ps_b"])
    return out.select(
        *[c for c in df.columns],
        *[(F.col(f"_ps_o_{v}") + F.col(f"_ps_l_{v}")).alias(f"{v}{suffix}") for v in value_cols],
    )
