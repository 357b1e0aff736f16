"""Constraint audit over stored tables.

Every audit is a count, never a row dump: CHECK and NOT NULL audits are one
global aggregate per table (``count_if(NOT cond)``; NULL passes a CHECK),
key audits are a group-by on the key with map-side combine, FK audits are
left-anti joins. Results are small ``(table, check, violations)`` frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import specs


def _between(c: str, lo, hi) -> Column:
    return F.col(c).between(F.lit(lo), F.lit(hi))


def _in(c: str, values) -> Column:
    return F.col(c).isin(*values)


def rule_check(c: str, rule: specs.Rule) -> Column:
    return _in(c, rule.values) if isinstance(rule, specs.OneOf) else _between(c, rule.low, rule.high)


def star_checks() -> dict[str, dict[str, Column]]:
    """The CHECK clauses of the star's DDL, per table (bounds from the shared rules)."""
    r1, r2 = specs.DATA1_RANGE_RULES, specs.DATA2_RANGE_RULES
    return {
        "data_sources": {
            "source_dataset_in_set": _in("source_dataset", ("Data1", "Data2")),
            "loaded_row_count_nonnegative": F.col("loaded_row_count") >= 0,
        },
        "pregnancies": {
            "source_row_id_nonnegative": F.col("source_row_id") >= 0,
            "target_risk_binary": _in("target_risk", (0, 1)),
            "age_range": rule_check("age", r1["age"]),
            "pregnancy_weeks_range": rule_check("pregnancy_weeks", r2["pregnancy_weeks"]),
        },
        "vitals": {
            f"{c}_range": rule_check(c, rule)
            for c, rule in [
                ("systolic_bp", r1["systolic_bp"]),
                ("diastolic_bp", r1["diastolic_bp"]),
                ("heart_rate", r1["heart_rate"]),
                ("body_temp_f", r1["body_temp_f"]),
                ("weight_kg", r2["weight_kg"]),
                ("height_cm", r2["height_cm"]),
                ("height_m", r2["height_m"]),
                ("bmi", r1["bmi"]),
            ]
        },
        "medical_history": {
            **{f"{c}_binary": rule_check(c, r1[c]) for c in ("previous_complications", "preexisting_diabetes", "gestational_diabetes", "mental_health")},
            **{f"{c}_ordinal": rule_check(c, r2[c]) for c in ("gravida_n", "tt_injection_n")},
        },
        "lab_tests": {
            "blood_sugar_range": rule_check("blood_sugar", r1["blood_sugar"]),
            **{f"{c}_binary": rule_check(c, r2[c]) for c in ("urine_sugar_yes", "vdrl_positive", "hrsag_positive")},
        },
        "obstetric_observations": {"fetal_heartbeat_bpm_range": rule_check("fetal_heartbeat_bpm", r2["fetal_heartbeat_bpm"])},
    }


def model_checks() -> dict[str, dict[str, Column]]:
    """The CHECK clauses of the two model log tables."""
    unit = lambda c: _between(c, 0, 1)
    return {
        "model_runs": {
            "dataset_name_in_set": _in("dataset_name", ("Data1", "Data2", "Combined")),
            **{f"{c}_range": unit(c) for c in ("auc", "accuracy", "precision", "recall", "f1", "threshold")},
        },
        "predictions": {
            "predicted_probability_range": unit("predicted_probability"),
            "predicted_class_binary": _in("predicted_class", (0, 1)),
            "risk_label_in_set": _in("risk_label", tuple(specs.RISK_LABELS.values())),
        },
    }


STAR_NOT_NULL = {
    "data_sources": ["source_dataset", "cleaned_file", "loaded_row_count", "loaded_at"],
    "pregnancies": ["pregnancy_id", "source_dataset", "source_row_id", "target_risk", "created_at"],
    "vitals": ["vitals_id", "pregnancy_id"],
    "medical_history": ["history_id", "pregnancy_id"],
    "lab_tests": ["lab_id", "pregnancy_id"],
    "obstetric_observations": ["obs_id", "pregnancy_id"],
}
MODEL_NOT_NULL = {
    "model_runs": ["model_run_id", "model_name", "dataset_name", "trained_at"],
    "predictions": ["prediction_id", "created_at", "model_name", "input_json", "predicted_probability", "predicted_class", "risk_label"],
}
MODEL_KEYS = {"model_runs": [["model_run_id"]], "predictions": [["prediction_id"]]}
MODEL_FKS = [("predictions", "model_run_id", "model_runs", "model_run_id")]
STAR_KEYS = {
    "data_sources": [["source_dataset"]],
    "pregnancies": [["pregnancy_id"], ["source_dataset", "source_row_id"]],
    "vitals": [["vitals_id"], ["pregnancy_id"]],
    "medical_history": [["history_id"], ["pregnancy_id"]],
    "lab_tests": [["lab_id"], ["pregnancy_id"]],
    "obstetric_observations": [["obs_id"], ["pregnancy_id"]],
}
STAR_FKS = [
    ("pregnancies", "source_dataset", "data_sources", "source_dataset"),
    ("vitals", "pregnancy_id", "pregnancies", "pregnancy_id"),
    ("medical_history", "pregnancy_id", "pregnancies", "pregnancy_id"),
    ("lab_tests", "pregnancy_id", "pregnancies", "pregnancy_id"),
    ("obstetric_observations", "pregnancy_id", "pregnancies", "pregnancy_id"),
]
SATELLITES = ["vitals", "medical_history", "lab_tests", "obstetric_observations"]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def check_audit(tables: dict[str, DataFrame], checks: dict[str, dict[str, Column]]) -> DataFrame:
    """(table_name, check_name, violations); a NULL condition passes."""
    parts = []
    for table, conds in checks.items():
        wide = tables[table].agg(*[F.count_if(~cond).alias(f"v{i}") for i, cond in enumerate(conds.values())])
        parts.append(
            wide.select(
                F.explode(
                    F.array(
                        *[
                            F.struct(F.lit(table).alias("table_name"), F.lit(name).alias("check_name"), F.col(f"v{i}").cast("long").alias("violations"))
                            for i, name in enumerate(conds)
                        ]
                    )
                ).alias("x")
            ).select("x.*")
        )
    return _union(parts)


def constraint_audit(tables: dict[str, DataFrame], checks: dict[str, dict[str, Column]], required: dict[str, list[str]]) -> DataFrame:
    """R4 + R5: CHECK and NOT NULL counts of each table in one aggregate over it."""
    both = {t: {**checks.get(t, {}), **{f"{c}_not_null": F.col(c).isNotNull() for c in required.get(t, [])}} for t in {**checks, **required}}
    return check_audit(tables, both)


def full_audit(
    tables: dict[str, DataFrame], checks: dict[str, dict[str, Column]], required: dict[str, list[str]], keys: dict[str, list[list[str]]], fks: list[tuple]
) -> DataFrame:
    """R4-R7 as one report (table_name, check_name, violations), with every count of each table."""
    uniques = unique_audit(tables, keys).select("table_name", "check_name", "violations")
    foreign = fk_audit(tables, fks).select(F.split_part("check_name", F.lit("."), F.lit(1)).alias("table_name"), "check_name", F.col("issue_count").alias("violations"))
    return _union([constraint_audit(tables, checks, required), uniques, foreign])


def not_null_audit(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> DataFrame:
    """(table_name, check_name, violations) for NOT NULL columns."""
    return check_audit(tables, {t: {f"{c}_not_null": F.col(c).isNotNull() for c in cols} for t, cols in required.items()})


def key_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(_k0.., _n): rows per key without a NULL, map-side combined, so that a hot key is one row in the shuffle.

    Key and foreign-key audits of one report count their keys by this same plan: equal
    columns of a table cross the network once for all of them.
    """
    keys = [f"_k{i}" for i in range(len(cols))]
    found = df.select(*[F.col(c).alias(k) for k, c in zip(keys, cols, strict=True)])
    for k in keys:
        found = found.filter(F.col(k).isNotNull())
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def unique_audit(tables: dict[str, DataFrame], keys: dict[str, list[list[str]]]) -> DataFrame:
    """Per key: duplicated key values and the rows they cover beyond the first; keys with a NULL are no duplicates."""
    parts = []
    for table, key_sets in keys.items():
        for cols in key_sets:
            floating = [c for c in cols if tables[table].schema[c].dataType.typeName() in ("float", "double")]
            rows = tables[table].dropna(subset=floating) if floating else tables[table]  # NaN is no key either
            parts.append(
                key_counts(rows, cols).agg(
                    F.lit(table).alias("table_name"),
                    F.lit("unique(" + ",".join(cols) + ")").alias("check_name"),
                    F.count_if(F.col("_n") > 1).cast("long").alias("duplicate_keys"),
                    F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).cast("long").alias("violations"),
                )
            )
    return _union(parts)


def orphan_count(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose non-NULL FK has no parent.

    Child and parent keys are counted per key first (:func:`key_counts`), then
    joined; the row counts of the unmatched keys are summed. (An anti-join would be
    pushed below the child's count and exchange its rows once more.)
    """
    parents = key_counts(parent, [pk]).select("_k0", F.col("_n").alias("_parents"))
    found = key_counts(child, [fk]).join(parents, "_k0", "left")
    missing = F.sum(F.when(F.col("_parents").isNull(), F.col("_n")))
    return found.agg(F.coalesce(missing, F.lit(0)).cast("long").alias("issue_count"))


def childless_count(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    """Parent rows without any child (left-anti join)."""
    keys = child.select(F.col(fk).alias("_k")).distinct()  # map-side deduplicated
    return parent.select(F.col(pk).alias("_k")).join(keys, "_k", "left_anti").agg(
        F.count(F.lit(1)).cast("long").alias("issue_count")
    )


def fk_audit(tables: dict[str, DataFrame], fks=STAR_FKS) -> DataFrame:
    """(check_name, issue_count) per declared foreign key."""
    return _union(
        [
            orphan_count(tables[c], fk, tables[p], pk).select(
                F.lit(f"{c}.{fk}->{p}.{pk}").alias("check_name"), "issue_count"
            )
            for c, fk, p, pk in fks
        ]
    )


def parents_without_child(star: dict[str, DataFrame]) -> DataFrame:
    """Pregnancies without each satellite."""
    return _union(
        [
            childless_count(star["pregnancies"], "pregnancy_id", star[s], "pregnancy_id").select(
                F.lit(f"pregnancies_without_{s}").alias("check_name"), "issue_count"
            )
            for s in SATELLITES
        ]
    )


def orphans(star: dict[str, DataFrame]) -> DataFrame:
    """Satellite rows without a pregnancy."""
    return _union(
        [
            orphan_count(star[s], "pregnancy_id", star["pregnancies"], "pregnancy_id").select(
                F.lit(f"orphan_{s}").alias("check_name"), "issue_count"
            )
            for s in SATELLITES
        ]
    )


def count_reconciliation(star: dict[str, DataFrame]) -> DataFrame:
    """Per source: expected (lineage) vs loaded pregnancies and the difference."""
    per_source = star["pregnancies"].groupBy("source_dataset").agg(F.count("pregnancy_id").alias("_n"))
    j = star["data_sources"].join(per_source, "source_dataset", "left")
    actual = F.coalesce(F.col("_n"), F.lit(0)).cast("long")
    return j.select(
        "source_dataset",
        F.col("loaded_row_count").cast("long").alias("expected_rows"),
        actual.alias("pregnancy_rows"),
        (actual - F.col("loaded_row_count")).cast("long").alias("row_count_difference"),
    )


def target_counts(star: dict[str, DataFrame]) -> DataFrame:
    """Rows by (source, target), ordered."""
    return (
        star["pregnancies"]
        .groupBy("source_dataset", "target_risk")
        .agg(F.count(F.lit(1)).cast("long").alias("rows"))
        .orderBy("source_dataset", "target_risk")
    )


def table_counts(star: dict[str, DataFrame], views: dict[str, DataFrame]) -> DataFrame:
    """A8 + F7: satellite row counts, view row counts and the NULL-target count."""
    parts = [star[s].agg(F.lit(f"{s}_rows").alias("output_name"), F.count(F.lit(1)).cast("long").alias("rows")) for s in SATELLITES]
    parts += [v.agg(F.lit(f"{k} modelling_rows").alias("output_name"), F.count(F.lit(1)).cast("long").alias("rows")) for k, v in views.items()]
    parts.append(
        star["pregnancies"].agg(
            F.lit("missing_target_values").alias("output_name"), F.count_if(F.col("target_risk").isNull()).cast("long").alias("rows")
        )
    )
    return _union(parts)


def require_complete(star: dict[str, DataFrame], expected: dict[str, int]) -> None:
    """One aggregate over all tables; every deviation from the expected rows is named at once."""
    sources = star["pregnancies"].groupBy(F.concat(F.lit("pregnancies of "), "source_dataset").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    tables = [star[s].agg(F.lit(s).alias("what"), F.count(F.lit(1)).alias("n")) for s in SATELLITES]
    broken = fk_audit(star).agg(F.lit("rows without their parent").alias("what"), F.coalesce(F.sum("issue_count"), F.lit(0)).alias("n"))
    found = {r["what"]: r["n"] for r in _union([sources, *tables, broken]).collect()}  # a row per source and table
    wanted = {f"pregnancies of {k}": n for k, n in expected.items()} | dict.fromkeys(SATELLITES, sum(expected.values()))
    wanted["rows without their parent"] = 0
    wrong = [f"{k}: {found.get(k, 0)} instead of {wanted.get(k, 0)}" for k in sorted(wanted.keys() | found.keys()) if found.get(k, 0) != wanted.get(k, 0)]
    if wrong:
        raise ValueError("the star is not complete; " + ", ".join(wrong))
