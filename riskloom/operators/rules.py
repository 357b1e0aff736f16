"""Plausibility rules: compile, apply (R1), report.

A rule becomes an ``invalid`` predicate column; applying all rules is one
projection. The report needs one global aggregate for the counts and a bounded
top-10 of distinct invalid values per column (distinct pairs first, so a hot
invalid value never lands in one task; then a per-column row_number <= 10 that
Spark evaluates with a partial group limit before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.specs import SET_MISSING, Rule


def invalid_predicate(c: Column, rule: Rule) -> Column:
    """non-null and (outside [min, max] | not in the allowed set); NULL passes."""
    return c.isNotNull() & F.coalesce(rule.outside(c), F.lit(False))


def active_rules(df: DataFrame, rules: dict[str, Rule]) -> list[tuple[int, str, Rule]]:
    """Rules in declaration order, skipping columns the frame does not have."""
    return [(i, name, rule) for i, (name, rule) in enumerate(rules.items()) if name in df.columns]


def apply_rules(df: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """One projection that sets the values breaking a rule to NULL."""
    return df.withColumns({name: F.when(~invalid_predicate(F.col(name), rule), F.col(name)) for _, name, rule in active_rules(df, rules)})


def rule_report(df: DataFrame, rules: dict[str, Rule], dataset: str, sample_size: int = 10) -> DataFrame:
    """R2: per rule: invalid_count, first ``sample_size`` distinct invalid values ascending, action, note.

    Columns: dataset, rule_order, column, rule, invalid_count, invalid_values, action, note.
    """
    spark = df.sparkSession
    active = active_rules(df, rules)
    flags = {i: invalid_predicate(F.col(name).cast("double"), rule) for i, name, rule in active}

    # One scan: only invalid cells are exploded and counted per (rule, value) with
    # map-side combine; totals and the first-k sample both read that one exchange.
    cells = df.select(
        F.explode(
            F.filter(
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("rule_order"),
                            F.col(name).cast("double").alias("value"),
                            flags[i].alias("bad"),
                        )
                        for i, name, _ in active
                    ]
                ),
                lambda x: x["bad"],
            )
        ).alias("c")
    ).select("c.rule_order", "c.value")
    pairs = cells.groupBy("rule_order", "value").agg(F.count(F.lit(1)).alias("_n"))
    counts = pairs.groupBy("rule_order").agg(F.sum("_n").alias("invalid_count"))
    first_k = pairs.withColumn(
        "_rn", F.row_number().over(Window.partitionBy("rule_order").orderBy("value"))
    ).filter(F.col("_rn") <= sample_size)
    samples = first_k.groupBy("rule_order").agg(
        F.concat_ws(
            "; ",
            F.transform(
                # carries the pair count too, so both branches read one identical exchange (reused)
                F.array_sort(F.collect_list(F.struct("value", value_text(F.col("value")).alias("t"), F.col("_n")))),
                lambda x: x["t"],
            ),
        ).alias("invalid_values")
    )

    meta = spark.createDataFrame(
        [(i, dataset, name, rule.text, SET_MISSING, rule.note) for i, name, rule in active],
        "rule_order INT, dataset STRING, column STRING, rule STRING, rule_action STRING, note STRING",
    )
    out = meta.join(counts, "rule_order", "left").join(samples, "rule_order", "left")
    return out.select(
        "dataset",
        "rule_order",
        "column",
        "rule",
        F.coalesce(F.col("invalid_count"), F.lit(0)).cast("long").alias("invalid_count"),
        F.coalesce(F.col("invalid_values"), F.lit("")).alias("invalid_values"),
        F.when(F.coalesce(F.col("invalid_count"), F.lit(0)) > 0, F.col("rule_action")).otherwise(F.lit("none")).alias("action"),
        "note",
    )


def value_text(c: Column) -> Column:
    """Report text of a numeric value (6 dp, then the engine's shortest double text)."""
    return F.round(c, 6).cast("string")
