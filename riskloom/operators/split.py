"""Seeded, exact, stratified splits and resampling.

All randomness is a seeded md5 order key, so the same rows come out on every
run, on every engine, and after any task retry. Counts follow the reference:
test size ``ceil(0.2 n)`` shared across classes by largest remainder, folds
``(rank_in_class - 1) % k``, undersampling to exactly the minority size,
oversampling to exactly the majority size with replacement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import specs
from riskloom.operators.permute import Permutation
from riskloom.operators.ranking import dense_ids, hashed_rank, null_safe_join
from riskloom.session import stored


def class_counts(df: DataFrame, label_col: str) -> DataFrame:
    """(label, n) — one row per class."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_class"))


def test_allocation(counts: DataFrame, label_col: str, test_size: float = specs.TEST_SIZE) -> DataFrame:
    """Per-class test counts: total ceil(test_size*n), floor shares, then largest remainders.

    Input and output have one row per class; the windows here run over classes only.
    """
    all_rows = Window.partitionBy()
    n_total = F.sum("n_class").over(all_rows)
    n_test = F.ceil(n_total * F.lit(test_size)).cast("long")
    share = F.col("n_class") * n_test / n_total
    base = counts.withColumn("_share", share).withColumn("_floor", F.floor("_share").cast("long"))
    base = base.withColumn("_left", n_test - F.sum("_floor").over(all_rows)).withColumn(
        "_order", F.row_number().over(Window.orderBy(F.desc(F.col("_share") - F.col("_floor")), F.col(label_col)))
    )
    return base.select(
        label_col,
        "n_class",
        (F.col("_floor") + F.when(F.col("_order") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("n_test"),
    )


def stratified_split(
    df: DataFrame,
    label_col: str,
    id_col: str,
    test_size: float = specs.TEST_SIZE,
    seed: int | str | None = specs.RANDOM_STATE,
    out: str = "is_test",
) -> DataFrame:
    """Adds boolean ``is_test``; per-class test counts equal the reference's."""
    ranked = hashed_rank(df, [label_col], id_col, seed=seed, out="_rank_in_class")
    alloc = test_allocation(class_counts(df, label_col), label_col, test_size).select(label_col, "n_test")
    joined = null_safe_join(ranked, alloc, [label_col])
    return joined.withColumn(out, F.col("_rank_in_class") <= F.col("n_test")).drop("_rank_in_class", "n_test")


def stratified_kfold(
    df: DataFrame,
    label_col: str,
    id_col: str,
    k: int = specs.CV_SPLITS,
    seed: int | str | None = specs.RANDOM_STATE,
    fold_col: str = "fold",
) -> DataFrame:
    """fold = (rank in class by seeded key - 1) mod k; per-class fold sizes differ by <= 1."""
    ranked = hashed_rank(df, [label_col], id_col, seed=seed, out="_rank_in_class")
    return ranked.withColumn(fold_col, ((F.col("_rank_in_class") - 1) % k).cast("int")).drop("_rank_in_class")


def majority_minority(df: DataFrame, label_col: str) -> DataFrame:
    """One row (major, minor, n_major, n_minor); ties -> the smaller class is the majority."""
    counts = class_counts(df, label_col)
    w_major = Window.orderBy(F.desc("n_class"), F.asc(label_col))
    w_minor = Window.orderBy(F.asc("n_class"), F.desc(label_col))
    tagged = counts.withColumn("_ra", F.row_number().over(w_major)).withColumn("_ri", F.row_number().over(w_minor))
    return tagged.agg(
        F.max(F.when(F.col("_ra") == 1, F.col(label_col))).alias("major"),
        F.max(F.when(F.col("_ri") == 1, F.col(label_col))).alias("minor"),
        F.max(F.when(F.col("_ra") == 1, F.col("n_class"))).alias("n_major"),
        F.max(F.when(F.col("_ri") == 1, F.col("n_class"))).alias("n_minor"),
    )


def undersample(df: DataFrame, label_col: str, id_col: str, seed: int | str | None = specs.RANDOM_STATE) -> DataFrame:
    """B1: all minority rows + exactly n_minority majority rows drawn without replacement; other classes go.

    Equal class sizes are a no-op (both classes kept whole).
    """
    mm = majority_minority(df, label_col).first()  # one row: class sizes only
    if mm is None or mm["n_major"] == mm["n_minor"]:
        return df
    ranked = hashed_rank(df, [label_col], id_col, seed=seed, out="_rank_in_class")
    label = F.col(label_col)
    keep = label.eqNullSafe(F.lit(mm["minor"])) | (label.eqNullSafe(F.lit(mm["major"])) & (F.col("_rank_in_class") <= F.lit(mm["n_minor"])))
    return ranked.filter(keep).select(*df.columns)


def oversample(
    df: DataFrame, label_col: str, id_col: str, seed: int | str | None = specs.RANDOM_STATE
) -> DataFrame:
    """B2: all majority rows + exactly n_major minority draws with replacement.

    Draw j (0..n_major-1) picks minority index floor(u_j * n_minor), u_j a seeded
    uniform from md5; the draw ids come from ``spark.range`` and are spread over
    all tasks, and each draw joins one minority row on its index.
    """
    spark = df.sparkSession
    mm_row = majority_minority(df, label_col).first()
    if mm_row is None or mm_row["n_major"] == mm_row["n_minor"]:
        return df.withColumn("draw", F.lit(None).cast("long"))
    major, minor, n_major, n_minor = mm_row["major"], mm_row["minor"], mm_row["n_major"], mm_row["n_minor"]
    minority = hashed_rank(df.filter(F.col(label_col) == F.lit(minor)), [label_col], id_col, seed=seed, out="_idx")
    minority = minority.withColumn("_idx", F.col("_idx") - 1)
    draws = spark.range(0, n_major).withColumnRenamed("id", "draw")
    draws = draws.withColumn("_idx", F.floor(uniform01(F.col("draw"), seed) * F.lit(n_minor)).cast("long"))
    drawn = draws.join(minority, on="_idx", how="inner").select(*df.columns, "draw")
    majority = df.filter(F.col(label_col) == F.lit(major)).withColumn("draw", F.lit(None).cast("long"))
    return majority.unionByName(drawn)


def uniform01(c, seed: int | str | None):
    """Seeded uniform in [0, 1) from the first 13 hex digits of md5(seed:value)."""
    text = c.cast("string") if seed is None else F.concat(F.lit(str(seed)), F.lit(":"), c.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def column_permutation(
    df: DataFrame, id_col: str, value_col: str, seed: int | str = 7, out: str = "pv"
) -> DataFrame:
    """Value column re-dealt over rows: row i by id gets the value of row ``Permutation(n, seed)(i)``.

    The bijection is arithmetic on the dense row number, so that only (row, value)
    pairs move: each value is sent to its destination.
    """
    rows = stored(dense_ids(df.select(id_col, value_col), [F.col(id_col)], out="_r", start=0), "permutation")
    dealt = Permutation(rows.count(), str(seed))
    sent = rows.select(dealt.of(F.col("_r"), inverse=True).alias("_r"), F.col(value_col).alias(out))
    return rows.select(id_col, "_r").join(sent, "_r").select(id_col, out)
