"""Exact classification metrics as DataFrame aggregates.

Nothing is collected: confusion counts are conditional counts; the threshold
sweep maps each score to the index of the highest grid threshold <= score and
reads every threshold's counts off suffix sums of a (<= 18 x 2)-row table;
exact ROC-AUC (ties count half), average precision (step) and PR-AUC
(trapezoid, starting at recall 0 / precision 1) use scores grouped to distinct
values and bucketed prefix sums, so no window ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import specs
from riskloom.operators.ranking import attach_group_values, ordered_prefix_sums


def _ratio(num: Column, den: Column) -> Column:
    """num/den, 0 when den == 0 (zero_division=0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def rates(tn: Column, fp: Column, fn: Column, tp: Column) -> list[Column]:
    """A10: accuracy, precision, recall, f1 from confusion counts (0 on empty denominators)."""
    precision = _ratio(tp, tp + fp)
    recall = _ratio(tp, tp + fn)
    return [
        _ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def confusion(df: DataFrame, label: str, score: str, threshold: float | Column, group_cols=()) -> DataFrame:
    """A9 + A10: pred = score >= threshold; tn, fp, fn, tp and the four rates."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = F.col(score) >= thr
    y = F.col(label) == 1
    counts = df.groupBy(*group_cols).agg(
        F.count_if(~pred & ~y).alias("tn"),
        F.count_if(pred & ~y).alias("fp"),
        F.count_if(~pred & y).alias("fn"),
        F.count_if(pred & y).alias("tp"),
    )
    c = {k: F.col(k).cast("long") for k in ("tn", "fp", "fn", "tp")}
    return counts.select(
        *group_cols,
        F.lit(float(threshold) if not isinstance(threshold, Column) else None).cast("double").alias("threshold"),
        *rates(c["tn"], c["fp"], c["fn"], c["tp"]),
        *[v.alias(k) for k, v in c.items()],
    )


def score_counts(df: DataFrame, label: str, score: str, group_cols=()) -> DataFrame:
    """Scores grouped to distinct values: (groups, score, pos, neg, n) — map-side combined."""
    return df.groupBy(*group_cols, F.col(score).alias("_s")).agg(
        F.count_if(F.col(label) == 1).cast("long").alias("_pos"),
        F.count_if(F.col(label) != 1).cast("long").alias("_neg"),
    )


def _with_totals(g: DataFrame, group_cols) -> DataFrame:
    keys = list(group_cols)
    tot = g.groupBy(*keys).agg(F.sum("_pos").alias("_tpos"), F.sum("_neg").alias("_tneg"))
    return attach_group_values(g, tot, keys)


def roc_auc(df: DataFrame, label: str, score: str, group_cols=()) -> DataFrame:
    """Exact AUC = sum(pos * (neg below + neg tied / 2)) / (P * N); NULL with one class."""
    g = score_counts(df, label, score, group_cols)
    cum = ordered_prefix_sums(g, list(group_cols), "_s", ["_pos", "_neg"])  # same columns on both sides: one exchange, read twice
    below = F.col("_neg_cum") - F.col("_neg")
    agg = cum.groupBy(*group_cols).agg(
        F.sum(F.col("_pos") * below + F.col("_pos") * F.col("_neg") * F.lit(0.5)).alias("_u"),
        F.sum("_pos").alias("_tpos"),
        F.sum("_neg").alias("_tneg"),
    )
    return agg.select(
        *group_cols,
        F.when((F.col("_tpos") > 0) & (F.col("_tneg") > 0), F.col("_u") / (F.col("_tpos").cast("double") * F.col("_tneg"))).alias("roc_auc"),
    )


def _desc_points(df: DataFrame, label: str, score: str, group_cols) -> DataFrame:
    """Per distinct score (descending view): cumulative tp / count at >= score and the previous point."""
    g = score_counts(df, label, score, group_cols).withColumn("_cnt", F.col("_pos") + F.col("_neg"))
    cum = ordered_prefix_sums(g, list(group_cols), "_s", ["_pos", "_cnt"])
    cum = _with_totals(cum, group_cols).withColumn("_tall", F.col("_tpos") + F.col("_tneg"))
    ctp = F.col("_tpos") - F.col("_pos_cum") + F.col("_pos")
    cc = F.col("_tall") - F.col("_cnt_cum") + F.col("_cnt")
    return cum.withColumn("_ctp", ctp).withColumn("_cc", cc).withColumn("_cfp", F.col("_cc") - F.col("_ctp"))


def pr_summary(df: DataFrame, label: str, score: str, group_cols=()) -> DataFrame:
    """A12 + A13: average precision (step) and trapezoid PR-AUC (from recall 0, precision 1)."""
    p = _desc_points(df, label, score, group_cols)
    prec = F.col("_ctp") / F.col("_cc")
    prev_cc = F.col("_cc") - F.col("_cnt")
    prev_prec = F.when(prev_cc > 0, (F.col("_ctp") - F.col("_pos")) / prev_cc).otherwise(F.lit(1.0))
    drec = _ratio(F.col("_pos"), F.col("_tpos"))  # 0 without positives
    return p.groupBy(*group_cols).agg(
        F.sum(drec * prec).alias("average_precision"),
        F.sum(drec * (prec + prev_prec) / 2).alias("pr_auc"),
    )


def roc_points(df: DataFrame, label: str, score: str, group_cols=()) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score."""
    p = _desc_points(df, label, score, group_cols)
    return p.select(
        *group_cols,
        F.col("_s").alias("threshold"),
        _ratio(F.col("_cfp"), F.col("_tneg")).alias("fpr"),
        _ratio(F.col("_ctp"), F.col("_tpos")).alias("tpr"),
    )


def pr_points(df: DataFrame, label: str, score: str, group_cols=()) -> DataFrame:
    """(threshold, precision, recall) per distinct score."""
    p = _desc_points(df, label, score, group_cols)
    return p.select(
        *group_cols,
        F.col("_s").alias("threshold"),
        (F.col("_ctp") / F.col("_cc")).alias("precision"),
        _ratio(F.col("_ctp"), F.col("_tpos")).alias("recall"),
    )


def threshold_sweep(
    df: DataFrame, label: str, score: str, thresholds=specs.THRESHOLD_GRID, group_cols=(), with_auc: bool = True
) -> DataFrame:
    """M11 (J7): metrics at every grid threshold in one pass over the scores.

    bucket(score) = number of grid thresholds <= score; threshold i (1-based,
    ascending) predicts positive exactly for buckets >= i. The scores collapse to
    a (groups x 18 x label) count table; each bucket adds its counts to
    thresholds 1..bucket (``explode(sequence(1, b))`` on that tiny table).
    """
    grid = sorted(float(t) for t in thresholds)
    keys = list(group_cols)
    bucket = sum((F.col(score) >= F.lit(t)).cast("int") for t in grid)
    b = df.groupBy(*keys, bucket.alias("_b")).agg(
        F.count_if(F.col(label) == 1).cast("long").alias("_pos"), F.count_if(F.col(label) != 1).cast("long").alias("_neg")
    )
    contrib = (
        b.filter(F.col("_b") >= 1)
        .select(*keys, F.explode(F.sequence(F.lit(1), F.col("_b"))).alias("_i"), "_pos", "_neg")
        .groupBy(*keys, "_i")
        .agg(F.sum("_pos").alias("_tp"), F.sum("_neg").alias("_fp"))
    )
    totals = b.groupBy(*keys).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    full = totals.select(*keys, "_P", "_N", F.explode(F.sequence(F.lit(1), F.lit(len(grid)))).alias("_i")).join(
        contrib, on=[*keys, "_i"], how="left"
    )
    tp = F.coalesce(F.col("_tp"), F.lit(0)).cast("long")
    fp = F.coalesce(F.col("_fp"), F.lit(0)).cast("long")
    fn = (F.col("_P") - tp).cast("long")
    tn = (F.col("_N") - fp).cast("long")
    threshold = F.element_at(F.array(*[F.lit(t) for t in grid]), F.col("_i"))
    out = full.select(
        *keys, threshold.alias("threshold"), *rates(tn, fp, fn, tp), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), tp.alias("tp")
    )
    if with_auc:
        out = attach_group_values(out, roc_auc(df, label, score, keys), keys)
    return out


def select_threshold(sweep: DataFrame, recall_floor=specs.THRESHOLD_RECALL_FLOOR, precision_floor=specs.THRESHOLD_PRECISION_FLOOR, group_cols=()) -> DataFrame:
    """W6 + F6: among thresholds meeting both floors (else all), max recall, f1, precision, threshold."""
    ok = ((F.col("recall") >= recall_floor) & (F.col("precision") >= precision_floor)).cast("int")
    w = Window.partitionBy(*group_cols).orderBy(ok.desc(), F.desc("recall"), F.desc("f1"), F.desc("precision"), F.desc("threshold"))
    return sweep.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r").withColumn(
        "meets_floors", ok.cast("boolean")
    )


def cv_summary(per_fold: DataFrame, candidate_cols: list[str], metrics=("accuracy", "precision", "recall", "f1", "roc_auc")) -> DataFrame:
    """Mean and population std over folds of each metric, per candidate."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"mean_test_{m}"), F.stddev_pop(m).alias(f"std_test_{m}")]
    return per_fold.groupBy(*candidate_cols).agg(*aggs, F.count(F.lit(1)).cast("long").alias("n_folds"))


def grid_rank(summary: DataFrame, order_col: str = "candidate_order", metric: str = "mean_test_recall") -> DataFrame:
    """rank_test_<metric> = min-rank by mean metric (ties share); best = first in grid order."""
    w_rank = Window.orderBy(F.desc(metric))
    w_best = Window.orderBy(F.desc(metric), F.asc(order_col))
    return summary.withColumn(f"rank_test_{metric.replace('mean_test_', '')}", F.rank().over(w_rank)).withColumn(
        "is_best", F.row_number().over(w_best) == 1
    )


def select_best(comparison: DataFrame, group_cols=("dataset",), precision_floor: float | None = None) -> DataFrame:
    """Tuned, non-baseline rows; optional cv precision floor (else all); max recall, f1, auc."""
    cand = comparison.filter((F.col("variant") == "tuned") & (F.col("model") != "MajorityBaseline"))
    ok = (F.col("cv_precision_mean") >= precision_floor).cast("int") if precision_floor is not None else F.lit(1)
    w = Window.partitionBy(*group_cols).orderBy(ok.desc(), F.desc("cv_recall_mean"), F.desc("cv_f1_mean"), F.desc("cv_roc_auc_mean"), "model")
    return cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def comparison_table(scored: DataFrame, label: str, score: str, candidate_cols: list[str], fold: str = "fold") -> DataFrame:
    """M7/M8: cross-validation means and deviations of all candidates at 0.5, measured together in one job.

    ``scored`` has a row per candidate and row, with the fold that held the row out.
    """
    keys = [*candidate_cols, fold]
    per_fold = attach_group_values(confusion(scored, label, score, 0.5, group_cols=keys), roc_auc(scored, label, score, group_cols=keys), keys)
    summary = cv_summary(per_fold, candidate_cols)
    names = {f"{stat}_test_{m}": f"cv_{m}_{stat}" for stat in ("mean", "std") for m in ("accuracy", "precision", "recall", "f1", "roc_auc")}
    return summary.select(*candidate_cols, *[F.col(a).alias(b) for a, b in names.items()], "n_folds")


def majority_scores(df: DataFrame, label: str, fold: str = "fold", group_cols=(), out: str = "p") -> DataFrame:
    """M3: the baseline's probability out of fold: 1 where the other folds have more rows of class 1 than of class 0."""
    keys = [*group_cols, fold]
    counts = df.groupBy(*keys).agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group_cols)  # over one row per fold
    others = counts.select(*keys, (F.sum("_pos").over(whole) - F.col("_pos")).alias("_pos"), (F.sum("_n").over(whole) - F.col("_n")).alias("_n"))
    constant = others.select(*keys, F.when(2 * F.col("_pos") > F.col("_n"), 1.0).otherwise(0.0).alias(out))
    return df.drop(out).join(F.broadcast(constant), keys)  # one row per group and fold


def threshold_report(scored: DataFrame, label: str, score: str, split: str = "split", tune_on: str = "train_oof") -> DataFrame:
    """S8 + M11: the sweeps of all splits, with the threshold that ``tune_on`` selects marked in each of them."""
    sweep = threshold_sweep(scored, label, score, group_cols=[split])
    chosen = select_threshold(sweep.filter(F.col(split) == tune_on)).select(F.col("threshold").alias("selected_threshold"))
    marked = attach_group_values(sweep, chosen, [])
    return marked.withColumn("is_selected", F.col("threshold") == F.col("selected_threshold"))
