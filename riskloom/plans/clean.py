"""E1 — the clean job for both raw intakes, plus its cleaning log.

Order is part of the semantics and follows the reference: parse -> drop missing
target -> rules -> (intake 2: drop rows with any missing feature) -> exact
dedup keeping the first row -> (intake 2: integer narrowing).

Each function returns a lazy DataFrame. The cleaning logs are single-pass: the
parsed rows are grouped once on every clean column (map-side combined), and all
log counters are conditional sums over those groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import specs
from riskloom.functions import parse
from riskloom.operators.profile import dedup_keep_first
from riskloom.operators.rules import apply_rules
from riskloom.sources import ingest

DATA1_COLUMNS = [*specs.DATA1_COLUMN_MAP.values(), "risk"]
DATA2_COLUMNS = [
    "age",
    "gravida_n",
    "tt_injection_n",
    "pregnancy_weeks",
    "weight_kg",
    "height_cm",
    "height_m",
    "systolic_bp",
    "diastolic_bp",
    "fetal_heartbeat_bpm",
    "urine_sugar_yes",
    "vdrl_positive",
    "hrsag_positive",
    "bmi_calc",
    "high_risk",
]


# ----------------------------------------------------------------------------- intake 1
def parse_data1(raw: DataFrame) -> DataFrame:
    """P5 + P8 + P14: (row_pos, 11 numeric features, risk) with risk NULL when unmapped."""
    raw = ingest.strip_headers(raw)
    ingest.require_columns(raw, [*specs.DATA1_COLUMN_MAP, specs.DATA1_TARGET_SOURCE], "Data1")
    return raw.select(
        "row_pos",
        *[parse.to_number(F.col(f"`{src}`")).alias(dst) for src, dst in specs.DATA1_COLUMN_MAP.items()],
        parse.label_map(F.col(f"`{specs.DATA1_TARGET_SOURCE}`"), specs.DATA1_TARGET_MAP).alias("risk"),
    )


def clean_data1(raw: DataFrame) -> DataFrame:
    """Clean intake 1: feature NULLs kept for imputation; 12 columns + first row_pos."""
    parsed = parse_data1(raw).filter(F.col("risk").isNotNull())
    ruled = apply_rules(parsed, specs.DATA1_RANGE_RULES)
    return dedup_keep_first(ruled, DATA1_COLUMNS, "row_pos").select("row_pos", *DATA1_COLUMNS)


def cleaning_log_data1(raw: DataFrame) -> DataFrame:
    """A6 for intake 1 in one pass."""
    parsed = apply_rules(parse_data1(raw), specs.DATA1_RANGE_RULES)
    groups = parsed.groupBy(*DATA1_COLUMNS).agg(F.count(F.lit(1)).alias("_n"))
    has_target = F.col("risk").isNotNull()
    return groups.agg(
        F.lit("Data1").alias("dataset"),
        F.sum("_n").cast("long").alias("raw_rows"),
        F.sum(F.when(~has_target, F.col("_n")).otherwise(0)).cast("long").alias("rows_dropped_missing_target"),
        F.lit(0).cast("long").alias("rows_dropped_missing_features"),
        F.sum(F.when(has_target, F.col("_n") - 1).otherwise(0)).cast("long").alias("rows_removed_exact_duplicates"),
        F.count_if(has_target).cast("long").alias("final_rows"),
        F.lit(len(DATA1_COLUMNS)).cast("long").alias("final_columns"),
    )


# ----------------------------------------------------------------------------- intake 2
def promote_data2(cells: DataFrame) -> tuple[DataFrame, int]:
    """Header row found by content, promoted, renamed, checked."""
    header_pos, named = ingest.find_header(cells)
    body = ingest.promote_header(cells, header_pos, named)
    body = body.withColumnsRenamed({k: v for k, v in specs.DATA2_RENAME.items() if k in body.columns})
    ingest.require_columns(body, specs.DATA2_REQUIRED, "Data2")
    return body, header_pos


def parse_data2_frame(body: DataFrame, keep: tuple[str, ...] = ("row_pos",)) -> DataFrame:
    """P6 on every cell, then P8-P16 — the 15 clean columns (features still float).

    Staged projections: each parsed value is computed once and referenced by name,
    so Catalyst keeps non-cheap parsers in their own projection instead of copying
    them into every later use (height -> height_m -> bmi_calc -> rules).
    """
    stripped = body.select(*keep, *[parse.strip(F.col(c)).alias(c) for c in specs.DATA2_REQUIRED])
    texts = stripped.select(*keep, *[F.when(~F.col(c).isin(*specs.MISSING_TOKENS_STRIPPED), F.col(c)).alias(c) for c in specs.DATA2_REQUIRED])
    words = ("gravida", "tt_injection", "urine_sugar", "vdrl", "hrsag_test", "high_risk_pregnancy")
    texts = texts.withColumns({"height": parse.height_text("height"), **{c: F.lower(c) for c in words}})
    feet, inches, height = parse.height_parts("height")
    systolic, diastolic = parse.bp_parts("blood_pressure")
    numbers = {c: parse.first_number_text(c) for c in ("pregnancy_duration", "weight", "fetal_heartbeat")}
    numbers |= {"_feet": feet, "_inches": inches, "height": height, "_systolic": systolic, "_diastolic": diastolic}
    texts = texts.withColumns(numbers)
    numbers = texts.withColumns({c: parse.matched(c) for c in numbers})
    parsed = numbers.select(
        *keep,
        parse.to_number("age").alias("age"),
        parse.ordinal("gravida", normalized=True).alias("gravida_n"),
        parse.ordinal("tt_injection", normalized=True).alias("tt_injection_n"),
        F.col("pregnancy_duration").alias("pregnancy_weeks"),
        F.col("weight").alias("weight_kg"),
        parse.height_cm("_feet", "_inches", "height").alias("height_cm"),
        F.col("_systolic").alias("systolic_bp"),
        F.col("_diastolic").alias("diastolic_bp"),
        F.col("fetal_heartbeat").alias("fetal_heartbeat_bpm"),
        parse.yes_no("urine_sugar", normalized=True).alias("urine_sugar_yes"),
        parse.yes_no("vdrl", normalized=True).alias("vdrl_positive"),
        parse.yes_no("hrsag_test", normalized=True).alias("hrsag_positive"),
        parse.yes_no("high_risk_pregnancy", normalized=True).alias("high_risk"),
    )
    derived = parsed.withColumn("height_m", parse.cm_to_m("height_cm"))
    return derived.select(
        *keep,
        *[
            parse.bmi_exact("weight_kg", "height_m").alias(c) if c == "bmi_calc"
            else F.col(c)
            for c in DATA2_COLUMNS
        ],
    )


def parse_data2(cells: DataFrame) -> DataFrame:
    """Parsed intake 2 rows (row_pos + 15 columns), before any row is dropped."""
    body, _ = promote_data2(cells)
    return parse_data2_frame(body)


def _complete(columns: list[str]):
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return cond


def clean_data2(cells: DataFrame) -> DataFrame:
    """Clean intake 2: complete numeric rows, first row_pos kept, integer columns narrowed."""
    return clean_parsed_data2(parse_data2(cells))


def clean_parsed_data2(parsed: DataFrame) -> DataFrame:
    """The clean rows of :func:`parse_data2`'s rows.

    Rows are deduplicated on every clean column first and incomplete groups are
    dropped after the aggregate: completeness is a function of the group key, so
    the result is the same as filtering first, but the filter then cannot be
    pushed below the parsers (which would evaluate every parser twice).
    """
    ruled = apply_rules(parsed, specs.DATA2_RANGE_RULES)
    groups = ruled.groupBy(*DATA2_COLUMNS).agg(
        F.min("row_pos").alias("row_pos"), F.max((~_complete(DATA2_COLUMNS)).cast("int")).alias("_incomplete")
    )
    return groups.filter(F.col("_incomplete") == 0).select(
        "row_pos",
        *[parse.narrow_int(c).alias(c) if c in specs.DATA2_INTEGER_COLUMNS else F.col(c) for c in DATA2_COLUMNS],
    )


def cleaning_log_data2(cells: DataFrame) -> DataFrame:
    """A6 for intake 2 in one pass over the raw cells (title and header rows included).

    Every raw row is tagged (0 = at/above the header, 1 = all-NULL, 2 = data),
    parsed and ruled, and grouped once on (tag, clean columns).
    """
    header_pos, named = ingest.find_header(cells)
    names = [n for _, n in named]
    body = cells.select("row_pos", *[F.col(c).alias(n) for c, n in named])
    body = body.withColumnsRenamed({k: v for k, v in specs.DATA2_RENAME.items() if k in body.columns})
    ingest.require_columns(body, specs.DATA2_REQUIRED, "Data2")
    renamed = [specs.DATA2_RENAME.get(n, n) for n in names]
    all_null = F.lit(True)
    for c in renamed:
        all_null = all_null & F.col(c).isNull()
    kind = F.when(F.col("row_pos") <= header_pos, 0).when(all_null, 1).otherwise(2)
    parsed = parse_data2_frame(body.withColumn("_kind", kind), keep=("_kind",))
    ruled = apply_rules(parsed, specs.DATA2_RANGE_RULES)
    groups = ruled.groupBy("_kind", *DATA2_COLUMNS).agg(F.count(F.lit(1)).alias("_n"))
    data = F.col("_kind") == 2
    has_target = data & F.col("high_risk").isNotNull()
    complete = has_target & _complete([c for c in DATA2_COLUMNS if c != "high_risk"])
    return groups.agg(
        F.lit("Data2").alias("dataset"),
        F.sum("_n").cast("long").alias("raw_rows_including_metadata"),
        F.lit(header_pos).cast("long").alias("header_row_zero_based"),
        F.sum(F.when(data, F.col("_n")).otherwise(0)).cast("long").alias("data_rows_after_header"),
        F.sum(F.when(data & ~has_target, F.col("_n")).otherwise(0)).cast("long").alias("rows_dropped_missing_target"),
        F.sum(F.when(has_target & ~complete, F.col("_n")).otherwise(0)).cast("long").alias("rows_dropped_missing_features"),
        F.sum(F.when(complete, F.col("_n") - 1).otherwise(0)).cast("long").alias("rows_removed_exact_duplicates"),
        F.count_if(complete).cast("long").alias("final_rows"),
        F.lit(len(DATA2_COLUMNS)).cast("long").alias("final_columns"),
    )


def run_clean(raw1: DataFrame, cells2: DataFrame, out_path: str) -> dict:
    """E1 job: clean both intakes and write the clean tables, the four reports and the
    cleaning log (S8 + S9). Returns the cleaning-log rows (two small dicts)."""
    import json

    from riskloom.operators import profile, rules

    out = out_path.rstrip("/")
    c1, c2 = clean_data1(raw1), clean_data2(cells2)
    c1.write.mode("overwrite").parquet(f"{out}/data1_clean")
    c2.write.mode("overwrite").parquet(f"{out}/data2_clean")
    spark = raw1.sparkSession
    c1, c2 = spark.read.parquet(f"{out}/data1_clean"), spark.read.parquet(f"{out}/data2_clean")
    raw_cols = [c for c in raw1.columns if c != "row_pos"]
    cell_cols = [c for c in cells2.columns if c != "row_pos"]
    quality = (
        profile.quality_row(raw1, "Data1 raw", specs.DATA1_TARGET_SOURCE, raw_cols)
        .unionByName(profile.quality_row(c1, "Data1 clean", "risk", DATA1_COLUMNS))
        .unionByName(profile.quality_row(cells2, "Data2 raw including metadata", None, cell_cols))
        .unionByName(profile.quality_row(c2, "Data2 clean", "high_risk", DATA2_COLUMNS))
    )
    missing = (
        profile.missing_rows(raw1, "Data1 raw", raw_cols)
        .unionByName(profile.missing_rows(c1, "Data1 clean", DATA1_COLUMNS))
        .unionByName(profile.missing_rows(c2, "Data2 clean", DATA2_COLUMNS))
    )
    targets = (
        profile.target_rows(raw1, "Data1 raw", specs.DATA1_TARGET_SOURCE)
        .unionByName(profile.target_rows(c1, "Data1 clean", "risk"))
        .unionByName(profile.target_rows(c2, "Data2 clean", "high_risk"))
    )
    plaus = rules.rule_report(parse_data1(raw1).filter("risk IS NOT NULL"), specs.DATA1_RANGE_RULES, "Data1").unionByName(
        rules.rule_report(parse_data2(cells2).filter("high_risk IS NOT NULL"), specs.DATA2_RANGE_RULES, "Data2")
    )
    for name, df in [("data_quality_summary", quality), ("missing_values_summary", missing), ("target_distribution_summary", targets), ("plausibility_summary", plaus)]:
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/{name}")
    log = {"data1": cleaning_log_data1(raw1).first().asDict(), "data2": cleaning_log_data2(cells2).first().asDict()}
    spark.createDataFrame([(json.dumps(log, sort_keys=True),)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{out}/cleaning_log")
    return log
