"""Data-quality profile (A1-A4): quality row, per-column missing, target distribution.

Every profile is one scan: per-column counts are columns of one global
aggregate, unpivoted afterwards; duplicate detection is one group-by on all
columns (map-side combined, so a hot duplicate group is pre-aggregated).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _null_count(columns: list[str]):
    return sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0).cast("long"))


def quality_row(df: DataFrame, dataset: str, target_col: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A1: rows, columns, missing cells, missing % (3 dp; 0 if empty), duplicate rows (+ target column)."""
    cols = columns or df.columns
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    total = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"),
        F.coalesce(F.sum(F.col("_n") * _null_count(cols)), F.lit(0)).cast("long").alias("missing_cells"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
    )
    n_cols = len(cols)
    return total.select(
        F.lit(dataset).alias("dataset"),
        "rows",
        F.lit(n_cols).cast("long").alias("columns"),
        "missing_cells",
        F.when(F.col("rows") * n_cols > 0, F.round(F.col("missing_cells") * 100.0 / (F.col("rows") * n_cols), 3))
        .otherwise(F.lit(0.0))
        .cast("double")
        .alias("missing_percent"),
        "duplicate_rows",
        F.lit(target_col if target_col in cols else None).cast("string").alias("target_column"),
    )


def missing_rows(df: DataFrame, dataset: str, columns: list[str] | None = None) -> DataFrame:
    """A2: per column missing count and % (3 dp), in column order."""
    cols = columns or df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(cols)])
    long = wide.select(
        "_rows",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("column_order"), F.lit(c).alias("column"), F.col(f"_m{i}").alias("m")) for i, c in enumerate(cols)])
        ).alias("x"),
    )
    return long.select(
        F.lit(dataset).alias("dataset"),
        F.col("x.column_order").alias("column_order"),
        F.col("x.column").alias("column"),
        F.col("x.m").cast("long").alias("missing_count"),
        F.when(F.col("_rows") > 0, F.round(F.col("x.m") * 100.0 / F.col("_rows"), 3)).otherwise(F.lit(0.0)).cast("double").alias("missing_percent"),
    )


def target_rows(df: DataFrame, dataset: str, target_col: str) -> DataFrame:
    """A3: value counts including NULL; value ascending, NULL last; % of all rows (3 dp)."""
    counts = df.groupBy(F.col(target_col).alias("_v")).agg(F.count(F.lit(1)).alias("count"))
    # the window runs over the distinct target values only
    total = F.sum("count").over(Window.partitionBy())
    return counts.orderBy(F.asc_nulls_last("_v")).select(
        F.lit(dataset).alias("dataset"),
        F.lit(target_col).alias("target_column"),
        F.col("_v").cast("string").alias("target_value"),
        F.col("count").cast("long").alias("count"),
        F.round(F.col("count") * 100.0 / total, 3).cast("double").alias("percent"),
    )


def duplicate_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A4: rows minus distinct rows (NULLs compare equal)."""
    cols = columns or df.columns
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows")
    )


def dedup_keep_first(df: DataFrame, columns: list[str], order_col: str) -> DataFrame:
    """A5: exact duplicates on ``columns`` collapse to one row carrying the first ``order_col``."""
    return df.groupBy(*columns).agg(F.min(order_col).alias(order_col))
