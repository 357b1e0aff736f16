"""DuckDB oracle SQL for the registered queries (independent re-statement in SQL).

The driver runs these on the same parquet tables (pre-registered views) and
compares them with the Spark results. Lenses come from the shared lens text.
"""

from __future__ import annotations

import hashlib

from riskloom import specs
from riskloom.functions.parse import NUMBER_PATTERN
from riskloom.sources import lenses

Q = "'"


def lit(s: str) -> str:
    return Q + str(s).replace(Q, Q + Q) + Q


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def na_token(x: str) -> str:
    return f"CASE WHEN {x} IN {in_list(specs.CSV_NA_TOKENS)} THEN NULL ELSE {x} END"


def p6(x: str) -> str:
    return f"CASE WHEN {strip(x)} IN {in_list(specs.MISSING_TOKENS_STRIPPED)} THEN NULL ELSE {strip(x)} END"


def to_number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {lit(NUMBER_PATTERN)}) THEN TRY_CAST({strip(x)} AS DOUBLE) END"


def num_first(x: str) -> str:
    return f"TRY_CAST(regexp_extract({x}, {lit(specs.FIRST_NUMBER_PATTERN)}, 1) AS DOUBLE)"


def yes_no(x: str) -> str:
    t = f"lower({strip(x)})"
    return (
        f"CASE WHEN {t} IN {in_list(specs.YES_TOKENS)} THEN CAST(1 AS DOUBLE) "
        f"WHEN {t} IN {in_list(specs.NO_TOKENS)} THEN CAST(0 AS DOUBLE) END"
    )


def ordinal(x: str) -> str:
    t = f"lower({strip(x)})"
    return "CASE " + " ".join(f"WHEN {t} = {lit(k)} THEN CAST({v} AS DOUBLE)" for k, v in specs.ORDINAL_TOKENS.items()) + " END"


def label_map(x: str, mapping) -> str:
    t = f"lower({strip(x)})"
    return "CASE " + " ".join(f"WHEN {t} = {lit(k)} THEN {v}" for k, v in mapping.items()) + " END"


def height_cm(x: str) -> str:
    t = f"replace(replace(lower({strip(x)}), chr(34), ''), chr(39)||chr(39), chr(39))"
    fi = r"'([0-9]+)\s*' || chr(39) || '\s*([0-9]+)'"
    feet = f"TRY_CAST(regexp_extract({t}, {fi}, 1) AS DOUBLE)"
    inch = f"TRY_CAST(regexp_extract({t}, {fi}, 2) AS DOUBLE)"
    n = num_first(t)
    return (
        f"CASE WHEN {feet} IS NOT NULL THEN ({feet}*12+{inch})*CAST(2.54 AS DOUBLE) "
        f"WHEN {n} <= 8 THEN {n}*CAST(30.48 AS DOUBLE) WHEN {n} > 100 THEN {n} END"
    )


BP = r"'([0-9]{2,3})\s*/\s*([0-9]{2,3})'"


def bp(x: str, part: int) -> str:
    return f"TRY_CAST(regexp_extract({x}, {BP}, {part}) AS DOUBLE)"


def bad(x: str, rule: specs.Rule) -> str:
    if isinstance(rule, specs.OneOf):
        cond = f"{x} NOT IN ({', '.join(str(float(v)) for v in rule.values)})"
    else:
        cond = f"({x} < {float(rule.low)} OR {x} > {float(rule.high)})"
    return f"({x} IS NOT NULL AND coalesce({cond}, false))"


def ruled(x: str, rule: specs.Rule) -> str:
    return f"CASE WHEN {bad(x, rule)} THEN NULL ELSE {x} END"


# ------------------------------------------------------------------ lens A / clean A
A_RAW = ", ".join(
    [f"{na_token(c)} AS {c}" for c in ["age", "systolic_bp", "diastolic", "bs", "body_temp", "bmi", "prev_comp", "pre_diab", "gest_diab", "mental", "heart_rate", "risk_level"]]
)
A_SRC = dict(zip(specs.DATA1_COLUMN_MAP.values(), ["age", "systolic_bp", "diastolic", "bs", "body_temp", "bmi", "prev_comp", "pre_diab", "gest_diab", "mental", "heart_rate"]))
D1 = list(specs.DATA1_COLUMN_MAP.values())


def with_a() -> str:
    parsed = ", ".join(f"{to_number(src)} AS {dst}" for dst, src in A_SRC.items())
    rules_sel = ", ".join(ruled(c, specs.DATA1_RANGE_RULES[c]) + f" AS {c}" for c in D1)
    return f"""WITH intake_a AS ({lenses.duck(lenses.INTAKE_A_SQL)}),
raw_a AS (SELECT row_pos, {A_RAW} FROM intake_a),
parsed_a AS (SELECT row_pos, {parsed}, {label_map('risk_level', specs.DATA1_TARGET_MAP)} AS risk FROM raw_a),
ruled_a AS (SELECT row_pos, {rules_sel}, risk FROM parsed_a),
clean_a AS (SELECT min(row_pos) AS row_pos, {', '.join(D1)}, risk FROM ruled_a WHERE risk IS NOT NULL GROUP BY {', '.join(D1)}, risk)"""


# ------------------------------------------------------------------ lens B / clean B
B_NAMES = {
    "c0": "age",
    "c1": "gravida",
    "c2": "tt_injection",
    "c3": "pregnancy_duration",
    "c4": "weight",
    "c5": "height",
    "c6": "blood_pressure",
    "c8": "fetal_heartbeat",
    "c9": "urine_sugar",
    "c10": "vdrl",
    "c11": "hrsag_test",
    "c12": "high_risk_pregnancy",
}
D2 = [
    "age", "gravida_n", "tt_injection_n", "pregnancy_weeks", "weight_kg", "height_cm", "height_m", "systolic_bp",
    "diastolic_bp", "fetal_heartbeat_bpm", "urine_sugar_yes", "vdrl_positive", "hrsag_positive", "bmi_calc", "high_risk",
]


def with_b() -> str:
    header_cond = " AND ".join(
        f"list_contains([{', '.join('lower(' + strip('c' + str(i)) + ')' for i in range(13))}], {lit(m)})"
        for m in specs.DATA2_HEADER_MARKERS
    )
    body_cols = ", ".join(f"{c} AS {n}" for c, n in B_NAMES.items())
    not_all_null = " OR ".join(f"{c} IS NOT NULL" for c in B_NAMES)
    texts = ", ".join(f"{p6(n)} AS {n}" for n in B_NAMES.values())
    rules_sel = ", ".join(ruled(c, specs.DATA2_RANGE_RULES[c]) + f" AS {c}" if c in specs.DATA2_RANGE_RULES else c for c in D2)
    return f"""WITH intake_b AS ({lenses.duck(lenses.INTAKE_B_SQL)}),
hdr AS (SELECT min(row_pos) AS h FROM intake_b WHERE {header_cond}),
body_b AS (SELECT row_pos, {body_cols} FROM intake_b WHERE row_pos > (SELECT h FROM hdr) AND ({not_all_null})),
text_b AS (SELECT row_pos, {texts} FROM body_b),
p1_b AS (SELECT row_pos, {to_number('age')} AS age, {ordinal('gravida')} AS gravida_n, {ordinal('tt_injection')} AS tt_injection_n,
  {num_first('pregnancy_duration')} AS pregnancy_weeks, {num_first('weight')} AS weight_kg, {height_cm('height')} AS height_cm,
  {bp('blood_pressure', 1)} AS systolic_bp, {bp('blood_pressure', 2)} AS diastolic_bp, {num_first('fetal_heartbeat')} AS fetal_heartbeat_bpm,
  {yes_no('urine_sugar')} AS urine_sugar_yes, {yes_no('vdrl')} AS vdrl_positive, {yes_no('hrsag_test')} AS hrsag_positive,
  {yes_no('high_risk_pregnancy')} AS high_risk FROM text_b),
parsed_b AS (SELECT row_pos, age, gravida_n, tt_injection_n, pregnancy_weeks, weight_kg, height_cm, height_cm/100.0 AS height_m,
  systolic_bp, diastolic_bp, fetal_heartbeat_bpm, urine_sugar_yes, vdrl_positive, hrsag_positive,
  weight_kg/((height_cm/100.0)*(height_cm/100.0)) AS bmi_calc, high_risk FROM p1_b),
ruled_b AS (SELECT row_pos, {rules_sel} FROM parsed_b),
clean_b AS (SELECT min(row_pos) AS row_pos,
  {', '.join(f'trunc({c})::INTEGER AS {c}' if c in specs.DATA2_INTEGER_COLUMNS else c for c in D2)}
  FROM ruled_b WHERE {' AND '.join(f'{c} IS NOT NULL' for c in D2)} GROUP BY {', '.join(D2)})"""


def rule_report_sql(frame: str, rules: dict, dataset: str) -> str:
    parts = []
    for i, (name, rule) in enumerate(rules.items()):
        parts.append(
            f"SELECT {i} AS rule_order, {lit(name)} AS col, {lit(rule.text)} AS rule, {lit(specs.SET_MISSING)} AS rule_action, "
            f"{lit(rule.note)} AS note, CAST({name} AS DOUBLE) AS v, {bad('CAST(' + name + ' AS DOUBLE)', rule)} AS is_bad FROM {frame}"
        )
    cells = " UNION ALL ".join(parts)
    return f""",
cells AS ({cells}),
dv AS (SELECT rule_order, v, row_number() OVER (PARTITION BY rule_order ORDER BY v) AS rn FROM (SELECT DISTINCT rule_order, v FROM cells WHERE is_bad) d),
samples AS (SELECT rule_order, string_agg(CAST(round(v, 6) AS VARCHAR), '; ' ORDER BY v) AS invalid_values FROM dv WHERE rn <= 10 GROUP BY rule_order),
counts AS (SELECT rule_order, col, rule, rule_action, note, count_if(is_bad) AS n FROM cells GROUP BY rule_order, col, rule, rule_action, note)
SELECT {lit(dataset)} AS dataset, c.rule_order, c.col AS "column", c.rule, CAST(c.n AS BIGINT) AS invalid_count,
 coalesce(s.invalid_values, '') AS invalid_values, CASE WHEN c.n > 0 THEN c.rule_action ELSE 'none' END AS action, c.note
FROM counts c LEFT JOIN samples s ON s.rule_order = c.rule_order"""


def quality_sql(frame: str, cols: list[str], dataset: str, target: str | None) -> str:
    nulls = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in cols)
    n = len(cols)
    tgt = lit(target) if target else "CAST(NULL AS VARCHAR)"
    return f"""SELECT {lit(dataset)} AS dataset, CAST(sum(k) AS BIGINT) AS rows, CAST({n} AS BIGINT) AS columns,
 CAST(sum(k*m) AS BIGINT) AS missing_cells,
 CASE WHEN sum(k) > 0 THEN round(CAST(sum(k*m) AS DOUBLE)*100/CAST(sum(k)*{n} AS DOUBLE), 3) ELSE 0.0 END AS missing_percent,
 CAST(sum(k-1) AS BIGINT) AS duplicate_rows, {tgt} AS target_column
FROM (SELECT count(*) AS k, any_value({nulls}) AS m FROM {frame} GROUP BY {', '.join(cols)}) g"""


def missing_sql(frame: str, cols: list[str], dataset: str, labels: list[str] | None = None) -> str:
    labels = labels or cols
    parts = [
        f"SELECT {lit(dataset)} AS dataset, {i} AS column_order, {lit(labels[i])} AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS missing_count, "
        f"CASE WHEN count(*) > 0 THEN round(CAST(count_if({c} IS NULL) AS DOUBLE)*100/CAST(count(*) AS DOUBLE), 3) ELSE 0.0 END AS missing_percent FROM {frame}"
        for i, c in enumerate(cols)
    ]
    return " UNION ALL ".join(parts)


def target_sql(frame: str, col: str, dataset: str, label: str | None = None) -> str:
    return f"""SELECT {lit(dataset)} AS dataset, {lit(label or col)} AS target_column, CAST({col} AS VARCHAR) AS target_value,
 CAST(count(*) AS BIGINT) AS count, round(CAST(count(*) AS DOUBLE)*100/CAST(sum(count(*)) OVER () AS DOUBLE), 3) AS percent
FROM {frame} GROUP BY {col}"""


A_RAW_HEADERS = list(lenses.INTAKE_A_HEADERS.keys())


def oracles() -> dict[str, str]:
    a, b = with_a(), with_b()
    out = {}
    out["clean_a"] = f"{a} SELECT * FROM clean_a"
    out["clean_b"] = f"{b} SELECT * FROM clean_b"
    # read from files: rows are numbered from 0 in file order
    for name, ctes, lens, frame in (("clean_a_from_csv", a, "intake_a", "clean_a"), ("clean_b_from_sheet", b, "intake_b", "clean_b")):
        out[name] = f"""{ctes}, place AS (SELECT row_pos AS at, row_number() OVER (ORDER BY row_pos) - 1 AS i FROM {lens})
SELECT place.i AS row_pos, c.* EXCLUDE (row_pos) FROM {frame} c JOIN place ON place.at = c.row_pos"""
    out["intake_a_parsed"] = f"{a} SELECT * FROM parsed_a"
    out["intake_b_parsed"] = f"{b} SELECT * FROM parsed_b"
    out["header_discovery"] = f"{b} SELECT * FROM body_b"
    out["cleaning_log_a"] = f"""{a} SELECT 'Data1' AS dataset, CAST((SELECT count(*) FROM parsed_a) AS BIGINT) AS raw_rows,
 CAST((SELECT count(*) FROM parsed_a WHERE risk IS NULL) AS BIGINT) AS rows_dropped_missing_target,
 CAST(0 AS BIGINT) AS rows_dropped_missing_features,
 CAST((SELECT count(*) FROM ruled_a WHERE risk IS NOT NULL) - (SELECT count(*) FROM clean_a) AS BIGINT) AS rows_removed_exact_duplicates,
 CAST((SELECT count(*) FROM clean_a) AS BIGINT) AS final_rows, CAST(12 AS BIGINT) AS final_columns"""
    complete_b = " AND ".join(f"{c} IS NOT NULL" for c in D2)
    out["cleaning_log_b"] = f"""{b} SELECT 'Data2' AS dataset, CAST((SELECT count(*) FROM intake_b) AS BIGINT) AS raw_rows_including_metadata,
 CAST((SELECT h FROM hdr) AS BIGINT) AS header_row_zero_based,
 CAST((SELECT count(*) FROM body_b) AS BIGINT) AS data_rows_after_header,
 CAST((SELECT count(*) FROM ruled_b WHERE high_risk IS NULL) AS BIGINT) AS rows_dropped_missing_target,
 CAST((SELECT count(*) FROM ruled_b WHERE high_risk IS NOT NULL AND NOT ({complete_b})) AS BIGINT) AS rows_dropped_missing_features,
 CAST((SELECT count(*) FROM ruled_b WHERE {complete_b}) - (SELECT count(*) FROM clean_b) AS BIGINT) AS rows_removed_exact_duplicates,
 CAST((SELECT count(*) FROM clean_b) AS BIGINT) AS final_rows, CAST(15 AS BIGINT) AS final_columns"""
    out["rule_report_a"] = a + ", report_in AS (SELECT * FROM parsed_a WHERE risk IS NOT NULL)" + rule_report_sql(
        "report_in", specs.DATA1_RANGE_RULES, "Data1"
    )
    out["rule_report_b"] = b + ", report_in AS (SELECT * FROM parsed_b WHERE high_risk IS NOT NULL)" + rule_report_sql(
        "report_in", specs.DATA2_RANGE_RULES, "Data2"
    )
    cells_b = [f"c{i}" for i in range(13)]
    out["profile_quality"] = f"""{a}, {b[len('WITH '):]}
{quality_sql('raw_a', A_RAW_HEADERS, 'Data1 raw', 'Risk Level')} UNION ALL
{quality_sql('clean_a', D1 + ['risk'], 'Data1 clean', 'risk')} UNION ALL
{quality_sql('intake_b', cells_b, 'Data2 raw including metadata', None)} UNION ALL
{quality_sql('clean_b', D2, 'Data2 clean', 'high_risk')}"""
    out["profile_missing"] = f"""{a}, {b[len('WITH '):]}
{missing_sql('raw_a', A_RAW_HEADERS, 'Data1 raw', list(lenses.INTAKE_A_HEADERS.values()))} UNION ALL
{missing_sql('clean_a', D1 + ['risk'], 'Data1 clean')} UNION ALL
{missing_sql('clean_b', D2, 'Data2 clean')}"""
    out["target_distribution"] = f"""{a}, {b[len('WITH '):]}
{target_sql('raw_a', 'risk_level', 'Data1 raw', 'Risk Level')} UNION ALL
{target_sql('clean_a', 'risk', 'Data1 clean')} UNION ALL
{target_sql('clean_b', 'high_risk', 'Data2 clean')}"""
    out.update(star_oracles())
    out.update(metric_oracles())
    out.update(split_oracles())
    out.update(score_oracles())
    return out


# ------------------------------------------------------------------ star + audit
def with_star() -> str:
    a, b = with_a(), with_b()
    n1 = "CAST(NULL AS DOUBLE)"
    ni = "CAST(NULL AS INTEGER)"
    return f"""{a}, {b[len('WITH '):]},
wide AS (
 SELECT 'Data1' AS source_dataset, 0 AS so, row_pos, CAST(risk AS INTEGER) AS target_risk, CAST(age AS DOUBLE) AS age, {n1} AS pregnancy_weeks,
  systolic_bp, diastolic_bp, heart_rate, body_temp_f, {n1} AS weight_kg, {n1} AS height_cm, {n1} AS height_m, bmi,
  CAST(previous_complications AS INTEGER) AS previous_complications, CAST(preexisting_diabetes AS INTEGER) AS preexisting_diabetes,
  CAST(gestational_diabetes AS INTEGER) AS gestational_diabetes, CAST(mental_health AS INTEGER) AS mental_health,
  {ni} AS gravida_n, {ni} AS tt_injection_n, blood_sugar, {ni} AS urine_sugar_yes, {ni} AS vdrl_positive, {ni} AS hrsag_positive,
  {n1} AS fetal_heartbeat_bpm FROM clean_a
 UNION ALL
 SELECT 'Data2', 1, row_pos, high_risk, CAST(age AS DOUBLE), pregnancy_weeks,
  systolic_bp, diastolic_bp, {n1}, {n1}, weight_kg, height_cm, height_m, bmi_calc,
  {ni}, {ni}, {ni}, {ni}, gravida_n, tt_injection_n, {n1}, urine_sugar_yes, vdrl_positive, hrsag_positive, fetal_heartbeat_bpm FROM clean_b),
numbered AS (SELECT *, CAST(row_number() OVER (ORDER BY so, row_pos) AS BIGINT) AS pregnancy_id FROM wide),
t AS (SELECT *, pregnancy_id - min(pregnancy_id) OVER (PARTITION BY source_dataset) AS source_row_id FROM numbered),
pregnancies AS (SELECT pregnancy_id, source_dataset, source_row_id, target_risk, age, pregnancy_weeks, now() AS created_at FROM t),
vitals AS (SELECT pregnancy_id AS vitals_id, pregnancy_id, systolic_bp, diastolic_bp, heart_rate, body_temp_f, weight_kg, height_cm, height_m, bmi FROM t),
medical_history AS (SELECT pregnancy_id AS history_id, pregnancy_id, previous_complications, preexisting_diabetes, gestational_diabetes, mental_health, gravida_n, tt_injection_n FROM t),
lab_tests AS (SELECT pregnancy_id AS lab_id, pregnancy_id, blood_sugar, urine_sugar_yes, vdrl_positive, hrsag_positive FROM t),
obstetric_observations AS (SELECT pregnancy_id AS obs_id, pregnancy_id, fetal_heartbeat_bpm FROM t),
data_sources AS (SELECT source_dataset, 'x' AS cleaned_file, CAST(count(*) AS INTEGER) AS loaded_row_count, now() AS loaded_at, 'x' AS notes FROM t GROUP BY source_dataset),
vw_data1_modeling AS (SELECT p.pregnancy_id, p.source_row_id, p.age, v.systolic_bp, v.diastolic_bp, l.blood_sugar, v.body_temp_f, v.bmi,
  h.previous_complications, h.preexisting_diabetes, h.gestational_diabetes, h.mental_health, v.heart_rate, p.target_risk AS risk
  FROM pregnancies p JOIN vitals v ON v.pregnancy_id = p.pregnancy_id JOIN medical_history h ON h.pregnancy_id = p.pregnancy_id
  JOIN lab_tests l ON l.pregnancy_id = p.pregnancy_id WHERE p.source_dataset = 'Data1'),
vw_data2_modeling AS (SELECT p.pregnancy_id, p.source_row_id, p.age, h.gravida_n, h.tt_injection_n, p.pregnancy_weeks, v.weight_kg, v.height_cm,
  v.height_m, v.systolic_bp, v.diastolic_bp, o.fetal_heartbeat_bpm, l.urine_sugar_yes, l.vdrl_positive, l.hrsag_positive, v.bmi AS bmi_calc,
  p.target_risk AS high_risk FROM pregnancies p JOIN vitals v ON v.pregnancy_id = p.pregnancy_id JOIN medical_history h ON h.pregnancy_id = p.pregnancy_id
  JOIN lab_tests l ON l.pregnancy_id = p.pregnancy_id JOIN obstetric_observations o ON o.pregnancy_id = p.pregnancy_id WHERE p.source_dataset = 'Data2')"""


STAR_CHECK_SQL = {
    "data_sources": [
        ("source_dataset_in_set", "source_dataset IN ('Data1', 'Data2')"),
        ("loaded_row_count_nonnegative", "loaded_row_count >= 0"),
    ],
    "pregnancies": [
        ("source_row_id_nonnegative", "source_row_id >= 0"),
        ("target_risk_binary", "target_risk IN (0, 1)"),
        ("age_range", "age BETWEEN 10 AND 65"),
        ("pregnancy_weeks_range", "pregnancy_weeks BETWEEN 1 AND 45"),
    ],
    "vitals": [
        ("systolic_bp_range", "systolic_bp BETWEEN 70 AND 220"),
        ("diastolic_bp_range", "diastolic_bp BETWEEN 40 AND 140"),
        ("heart_rate_range", "heart_rate BETWEEN 40 AND 200"),
        ("body_temp_f_range", "body_temp_f BETWEEN 90 AND 110"),
        ("weight_kg_range", "weight_kg BETWEEN 25 AND 200"),
        ("height_cm_range", "height_cm BETWEEN 120 AND 220"),
        ("height_m_range", "height_m BETWEEN 1.2 AND 2.2"),
        ("bmi_range", "bmi BETWEEN 10 AND 70"),
    ],
    "medical_history": [
        ("previous_complications_binary", "previous_complications IN (0, 1)"),
        ("preexisting_diabetes_binary", "preexisting_diabetes IN (0, 1)"),
        ("gestational_diabetes_binary", "gestational_diabetes IN (0, 1)"),
        ("mental_health_binary", "mental_health IN (0, 1)"),
        ("gravida_n_ordinal", "gravida_n IN (1, 2, 3)"),
        ("tt_injection_n_ordinal", "tt_injection_n IN (1, 2, 3)"),
    ],
    "lab_tests": [
        ("blood_sugar_range", "blood_sugar BETWEEN 2 AND 25"),
        ("urine_sugar_yes_binary", "urine_sugar_yes IN (0, 1)"),
        ("vdrl_positive_binary", "vdrl_positive IN (0, 1)"),
        ("hrsag_positive_binary", "hrsag_positive IN (0, 1)"),
    ],
    "obstetric_observations": [("fetal_heartbeat_bpm_range", "fetal_heartbeat_bpm BETWEEN 60 AND 220")],
}
MODEL_CHECK_SQL = {
    "model_runs": [
        ("dataset_name_in_set", "dataset_name IN ('Data1', 'Data2', 'Combined')"),
        *[(f"{c}_range", f"{c} BETWEEN 0 AND 1") for c in ("auc", "accuracy", "precision", "recall", "f1", "threshold")],
    ],
    "predictions": [
        ("predicted_probability_range", "predicted_probability BETWEEN 0 AND 1"),
        ("predicted_class_binary", "predicted_class IN (0, 1)"),
        ("risk_label_in_set", "risk_label IN ('high-risk pregnancy', 'not high-risk pregnancy')"),
    ],
}
MODEL_NOT_NULL_SQL = {
    "model_runs": ["model_run_id", "model_name", "dataset_name", "trained_at"],
    "predictions": ["prediction_id", "created_at", "model_name", "input_json", "predicted_probability", "predicted_class", "risk_label"],
}
STAR_NOT_NULL_SQL = {
    "data_sources": ["source_dataset", "cleaned_file", "loaded_row_count", "loaded_at"],
    "pregnancies": ["pregnancy_id", "source_dataset", "source_row_id", "target_risk", "created_at"],
    "vitals": ["vitals_id", "pregnancy_id"],
    "medical_history": ["history_id", "pregnancy_id"],
    "lab_tests": ["lab_id", "pregnancy_id"],
    "obstetric_observations": ["obs_id", "pregnancy_id"],
}
STAR_KEYS_SQL = {
    "data_sources": [["source_dataset"]],
    "pregnancies": [["pregnancy_id"], ["source_dataset", "source_row_id"]],
    "vitals": [["vitals_id"], ["pregnancy_id"]],
    "medical_history": [["history_id"], ["pregnancy_id"]],
    "lab_tests": [["lab_id"], ["pregnancy_id"]],
    "obstetric_observations": [["obs_id"], ["pregnancy_id"]],
}
SATELLITES = ["vitals", "medical_history", "lab_tests", "obstetric_observations"]


def unique_sql(tbl: str, cols: list[str]) -> str:
    k = ", ".join(cols)
    return (
        f"SELECT {lit(tbl)} AS table_name, {lit('unique(' + ','.join(cols) + ')')} AS check_name, "
        f"CAST(count_if(n > 1) AS BIGINT) AS duplicate_keys, CAST(coalesce(sum(CASE WHEN n > 1 THEN n - 1 END), 0) AS BIGINT) AS violations "
        f"FROM (SELECT {k}, count(*) AS n FROM {tbl} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)} GROUP BY {k}) g"
    )


def orphan_sql(name: str, child: str, fk: str, parent: str, pk: str) -> str:
    return (
        f"SELECT {lit(name)} AS check_name, CAST(count(*) AS BIGINT) AS issue_count FROM {child} c "
        f"WHERE c.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pk} = c.{fk})"
    )


def childless_sql(name: str, parent: str, pk: str, child: str, fk: str) -> str:
    return (
        f"SELECT {lit(name)} AS check_name, CAST(count(*) AS BIGINT) AS issue_count FROM {parent} p "
        f"LEFT JOIN (SELECT DISTINCT {fk} FROM {child}) c ON c.{fk} = p.{pk} WHERE c.{fk} IS NULL"
    )


TPCH_FKS_SQL = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
]


def star_oracles() -> dict[str, str]:
    s = with_star()
    out = {}
    out["star_view_1"] = f"{s} SELECT * FROM vw_data1_modeling"
    out["star_view_2"] = f"{s} SELECT * FROM vw_data2_modeling"
    out["star_view_2_stored"] = out["star_view_2"]
    out["star_view_1_stored"] = out["star_view_1"]
    out["surrogate_ids"] = f"{s} SELECT pregnancy_id, source_dataset, source_row_id, target_risk, age, pregnancy_weeks FROM pregnancies"
    out["star_count_reconciliation"] = f"""{s} SELECT ds.source_dataset, CAST(ds.loaded_row_count AS BIGINT) AS expected_rows,
 CAST(count(p.pregnancy_id) AS BIGINT) AS pregnancy_rows, CAST(count(p.pregnancy_id) - ds.loaded_row_count AS BIGINT) AS row_count_difference
 FROM data_sources ds LEFT JOIN pregnancies p ON p.source_dataset = ds.source_dataset GROUP BY ds.source_dataset, ds.loaded_row_count"""
    out["star_published"] = out["star_count_reconciliation"]
    out["star_target_counts"] = f"{s} SELECT source_dataset, target_risk, CAST(count(*) AS BIGINT) AS rows FROM pregnancies GROUP BY source_dataset, target_risk"
    parts = [f"SELECT '{x}_rows' AS output_name, CAST(count(*) AS BIGINT) AS rows FROM {x}" for x in SATELLITES]
    parts += [
        "SELECT 'Data1 modelling_rows', CAST(count(*) AS BIGINT) FROM vw_data1_modeling",
        "SELECT 'Data2 modelling_rows', CAST(count(*) AS BIGINT) FROM vw_data2_modeling",
        "SELECT 'missing_target_values', CAST(count(*) AS BIGINT) FROM pregnancies WHERE target_risk IS NULL",
    ]
    out["star_table_counts"] = f"{s} " + " UNION ALL ".join(parts)
    out["parents_without_child"] = f"{s} " + " UNION ALL ".join(
        childless_sql(f"pregnancies_without_{x}", "pregnancies", "pregnancy_id", x, "pregnancy_id") for x in SATELLITES
    )
    out["orphans"] = f"{s} " + " UNION ALL ".join(orphan_sql(f"orphan_{x}", x, "pregnancy_id", "pregnancies", "pregnancy_id") for x in SATELLITES)
    checks = [
        f"SELECT {lit(tbl)} AS table_name, {lit(name)} AS check_name, CAST(count_if(NOT ({cond})) AS BIGINT) AS violations FROM {tbl}"
        for tbl, conds in STAR_CHECK_SQL.items()
        for name, cond in conds
    ]
    checks += [
        f"SELECT {lit(tbl)}, {lit(c + '_not_null')}, CAST(count_if({c} IS NULL) AS BIGINT) FROM {tbl}"
        for tbl, cols in STAR_NOT_NULL_SQL.items()
        for c in cols
    ]
    out["check_audit"] = f"{s} " + " UNION ALL ".join(checks)
    keys = STAR_KEYS_SQL
    out["unique_audit"] = f"{s} " + " UNION ALL ".join(unique_sql(t, c) for t, ks in keys.items() for c in ks)
    fks = [("pregnancies", "source_dataset", "data_sources", "source_dataset")] + [(x, "pregnancy_id", "pregnancies", "pregnancy_id") for x in SATELLITES]
    out["fk_audit"] = f"{s} " + " UNION ALL ".join(orphan_sql(f"{c}.{fk}->{p}.{pk}", c, fk, p, pk) for c, fk, p, pk in fks)
    out["tpch_parents_without_child"] = " UNION ALL ".join(
        [
            childless_sql("orders_without_lineitem", "orders", "o_orderkey", "lineitem", "l_orderkey"),
            childless_sql("customers_without_orders", "customer", "c_custkey", "orders", "o_custkey"),
        ]
    )
    out["tpch_fk_audit"] = " UNION ALL ".join(orphan_sql(f"{c}.{fk}->{p}.{pk}", c, fk, p, pk) for c, fk, p, pk in TPCH_FKS_SQL)
    tk = {"orders": [["o_orderkey"]], "lineitem": [["l_orderkey", "l_linenumber"]], "customer": [["c_custkey"]], "part": [["p_partkey"]], "supplier": [["s_suppkey"]]}
    out["tpch_unique_audit"] = " UNION ALL ".join(unique_sql(t, c) for t, ks in tk.items() for c in ks)
    return out


# ------------------------------------------------------------------ metrics on the scored lens
GRID_SQL = "(SELECT CAST(t AS DOUBLE) / 100 AS threshold FROM unnest(range(10, 91, 5)) AS u(t))"


def with_scored() -> str:
    return f"""WITH scored AS ({lenses.duck(lenses.SCORED_ORACLE_SQL)}),
ss AS (SELECT *, CASE WHEN fold = 0 THEN 'holdout_test' ELSE 'train_oof' END AS split FROM scored)"""


def rates_sql(tn="tn", fp="fp", fn="fn", tp="tp") -> str:
    def r(n, d):
        return f"CASE WHEN ({d}) = 0 THEN 0.0 ELSE CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) END"

    return (
        f"{r(f'{tp}+{tn}', f'{tn}+{fp}+{fn}+{tp}')} AS accuracy, {r(tp, f'{tp}+{fp}')} AS precision, "
        f"{r(tp, f'{tp}+{fn}')} AS recall, {r(f'2*{tp}', f'2*{tp}+{fp}+{fn}')} AS f1"
    )


def auc_sql(src: str, group: str | None) -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""(SELECT {g}CASE WHEN sum(np) > 0 AND sum(nn) > 0 THEN CAST(sum(np*below) + sum(np*nn)*0.5 AS DOUBLE)/CAST(sum(np)*sum(nn) AS DOUBLE) END AS roc_auc
 FROM (SELECT {g}p, np, nn, sum(nn) OVER ({part}ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - nn AS below
  FROM (SELECT {g}p, sum(CASE WHEN y=1 THEN 1 ELSE 0 END) AS np, sum(CASE WHEN y=1 THEN 0 ELSE 1 END) AS nn FROM {src} GROUP BY {g}p) a) b {gb})"""


def sweep_sql(src: str, group: str) -> str:
    return f"""(SELECT c.*, {rates_sql()}, a.roc_auc FROM (
 SELECT s.{group}, g.threshold, CAST(count_if(s.p < g.threshold AND s.y <> 1) AS BIGINT) AS tn, CAST(count_if(s.p >= g.threshold AND s.y <> 1) AS BIGINT) AS fp,
  CAST(count_if(s.p < g.threshold AND s.y = 1) AS BIGINT) AS fn, CAST(count_if(s.p >= g.threshold AND s.y = 1) AS BIGINT) AS tp
 FROM {src} s CROSS JOIN {GRID_SQL} g GROUP BY s.{group}, g.threshold) c LEFT JOIN {auc_sql(src, group)} a ON a.{group} = c.{group})"""


def metric_oracles() -> dict[str, str]:
    s = with_scored()
    out = {}
    out["scored_folds"] = f"{s} SELECT id, y, p, fold FROM scored"
    out["confusion"] = f"""{s} SELECT fold, CAST(0.5 AS DOUBLE) AS threshold, {rates_sql()}, tn, fp, fn, tp FROM (
 SELECT fold, CAST(count_if(p < 0.5 AND y <> 1) AS BIGINT) AS tn, CAST(count_if(p >= 0.5 AND y <> 1) AS BIGINT) AS fp,
  CAST(count_if(p < 0.5 AND y = 1) AS BIGINT) AS fn, CAST(count_if(p >= 0.5 AND y = 1) AS BIGINT) AS tp FROM ss GROUP BY fold) c"""
    out["threshold_sweep"] = f"{s} SELECT * FROM {sweep_sql('ss', 'split')} x"
    out["skewed_score_metrics"] = f"""WITH sk AS ({lenses.duck(lenses.SKEWED_SQL)}),
g AS (SELECT g, p, CAST(sum(y) AS BIGINT) AS tp, count(*) AS c FROM sk GROUP BY g, p),
k AS (SELECT g, p, tp, c, sum(tp) OVER w AS ctp, sum(c) OVER w AS cc FROM g WINDOW w AS (PARTITION BY g ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT g, p, CAST(ctp AS DOUBLE)/CAST(cc AS DOUBLE) AS prec, CAST(ctp AS DOUBLE)/(SELECT sum(tp) FROM g AS o WHERE o.g = k.g) AS rec FROM k),
z AS (SELECT g, prec, rec, coalesce(lag(rec) OVER (PARTITION BY g ORDER BY p DESC),0) AS pr, coalesce(lag(prec) OVER (PARTITION BY g ORDER BY p DESC),1) AS pp FROM m),
pr AS (SELECT g, sum((rec-pr)*prec) AS average_precision, sum((rec-pr)*(prec+pp)/2) AS pr_auc FROM z GROUP BY g)
SELECT g, roc_auc, average_precision, pr_auc FROM pr JOIN {auc_sql('sk', 'g')} u USING (g)"""
    out["select_threshold"] = f"""{s} SELECT * EXCLUDE (r) FROM (SELECT *, (recall >= 0.95 AND precision >= 0.7) AS meets_floors,
 row_number() OVER (PARTITION BY split ORDER BY (recall >= 0.95 AND precision >= 0.7) DESC, recall DESC, f1 DESC, precision DESC, threshold DESC) AS r
 FROM {sweep_sql('ss', 'split')} x) z WHERE r = 1"""
    out["roc_auc"] = f"{s} SELECT * FROM {auc_sql('scored', None)} x"
    out["roc_auc_by_fold"] = f"{s} SELECT * FROM {auc_sql('scored', 'fold')} x"
    pts = """g AS (SELECT p, CAST(sum(y) AS BIGINT) AS tp, count(*) AS c FROM scored GROUP BY p),
k AS (SELECT p, tp, c, sum(tp) OVER w AS ctp, sum(c) OVER w AS cc FROM g WINDOW w AS (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tot AS (SELECT CAST(sum(y) AS DOUBLE) AS all_pos, CAST(count(*) - sum(y) AS DOUBLE) AS all_neg FROM scored)"""
    out["pr_summary"] = f"""{s}, {pts},
m AS (SELECT p, CAST(ctp AS DOUBLE)/CAST(cc AS DOUBLE) AS prec, CAST(ctp AS DOUBLE)/(SELECT all_pos FROM tot) AS rec FROM k),
z AS (SELECT prec, rec, coalesce(lag(rec) OVER (ORDER BY p DESC),0) AS prec_rec, coalesce(lag(prec) OVER (ORDER BY p DESC),1) AS pp FROM m)
SELECT sum((rec-prec_rec)*prec) AS average_precision, sum((rec-prec_rec)*(prec+pp)/2) AS pr_auc FROM z"""
    out["roc_points"] = f"""{s}, {pts}
SELECT p AS threshold, CASE WHEN all_neg = 0 THEN 0.0 ELSE (cc - ctp)/all_neg END AS fpr, CASE WHEN all_pos = 0 THEN 0.0 ELSE ctp/all_pos END AS tpr FROM k, tot"""
    out["pr_points"] = f"""{s}, {pts}
SELECT p AS threshold, CAST(ctp AS DOUBLE)/CAST(cc AS DOUBLE) AS precision, CASE WHEN all_pos = 0 THEN 0.0 ELSE ctp/all_pos END AS recall FROM k, tot"""
    ms = ", ".join(
        f"avg({m}) AS mean_test_{m}, stddev_pop({m}) AS std_test_{m}" for m in ("accuracy", "precision", "recall", "f1", "roc_auc")
    )
    out["cv_grid_rank"] = f"""{s}, summ AS (SELECT threshold, {ms}, CAST(count(*) AS BIGINT) AS n_folds FROM {sweep_sql('scored', 'fold')} x GROUP BY threshold)
SELECT *, rank() OVER (ORDER BY mean_test_recall DESC) AS rank_test_recall,
 row_number() OVER (ORDER BY mean_test_recall DESC, threshold ASC) = 1 AS is_best FROM summ"""
    out["threshold_report"] = f"""{s}, sw AS (SELECT * FROM {sweep_sql('ss', 'split')} x),
pick AS (SELECT threshold AS selected_threshold FROM sw WHERE split = 'train_oof'
 ORDER BY (recall >= 0.95 AND precision >= 0.7) DESC, recall DESC, f1 DESC, precision DESC, threshold DESC LIMIT 1)
SELECT sw.*, selected_threshold, threshold = selected_threshold AS is_selected FROM sw, pick"""
    keys = "dataset, model, variant, fold"
    cand = f"""{s}, r AS (SELECT CASE WHEN id % 2 = 0 THEN 'Data1' ELSE 'Data2' END AS dataset, fold, y, p FROM scored),
n AS (SELECT dataset, fold, sum(y) AS pos, count(*) AS n FROM r GROUP BY dataset, fold),
mb AS (SELECT a.dataset, a.fold, CASE WHEN 2 * sum(b.pos) > sum(b.n) THEN 1.0 ELSE 0.0 END AS p
 FROM n a JOIN n b ON a.dataset = b.dataset AND a.fold <> b.fold GROUP BY a.dataset, a.fold),
c AS (SELECT dataset, model, 'tuned' AS variant, fold, y, p * k / (p * k + 1 - p) AS p FROM r,
  (VALUES ('odds_half', CAST(0.5 AS DOUBLE)), ('odds_one', 1.0), ('odds_double', 2.0), ('odds_tenfold', 10.0)) s(model, k)
 UNION ALL SELECT r.dataset, 'MajorityBaseline', 'default', r.fold, r.y, CAST(mb.p AS DOUBLE) FROM r JOIN mb USING (dataset, fold)),
cf AS (SELECT {keys}, CAST(count_if(p < 0.5 AND y <> 1) AS BIGINT) AS tn, CAST(count_if(p >= 0.5 AND y <> 1) AS BIGINT) AS fp,
  CAST(count_if(p < 0.5 AND y = 1) AS BIGINT) AS fn, CAST(count_if(p >= 0.5 AND y = 1) AS BIGINT) AS tp FROM c GROUP BY {keys}),
pf AS (SELECT cf.*, {rates_sql()}, u.roc_auc FROM cf JOIN {auc_sql('c', keys)} u USING ({keys})),
cv AS (SELECT dataset, model, variant, {", ".join(f"avg({m}) AS cv_{m}_mean, stddev_pop({m}) AS cv_{m}_std" for m in ("accuracy", "precision", "recall", "f1", "roc_auc"))},
  CAST(count(*) AS BIGINT) AS n_folds FROM pf GROUP BY dataset, model, variant)"""
    order = "cv_recall_mean DESC, cv_f1_mean DESC, cv_roc_auc_mean DESC, model"
    out["candidate_comparison"] = f"{cand} SELECT * FROM cv"
    out["majority_baseline"] = f"""{cand} SELECT dataset, fold, CAST(0.5 AS DOUBLE) AS threshold, accuracy, precision, recall, f1, tn, fp, fn, tp
FROM pf WHERE model = 'MajorityBaseline'"""
    for name, first in (("select_final", "(cv_precision_mean >= 0.7) DESC, "), ("select_best", "")):
        out[name] = f"""{cand} SELECT * FROM cv WHERE variant = 'tuned' AND model <> 'MajorityBaseline'
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY {first}{order}) = 1"""
    return out


# ------------------------------------------------------------------ split / resample / stats
def rank_sql(tbl: str, label: str, ident: str, seed) -> str:
    key = f"md5(concat('{seed}', ':', CAST({ident} AS VARCHAR)))" if seed is not None else f"md5(CAST({ident} AS VARCHAR))"
    return f"row_number() OVER (PARTITION BY {label} ORDER BY {key}, {ident})"


def alloc_sql(tbl: str, label: str) -> str:
    return f"""cnt AS (SELECT {label} AS lab, count(*) AS n FROM {tbl} GROUP BY {label}),
tot AS (SELECT CAST(sum(n) AS DOUBLE) AS n_all, ceil(CAST(sum(n) AS DOUBLE) * 0.2) AS n_t FROM cnt),
al AS (SELECT lab, n, floor(n * n_t / n_all) AS fl, n * n_t / n_all - floor(n * n_t / n_all) AS rem, n_t FROM cnt, tot),
al2 AS (SELECT lab, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, lab) <= n_t - sum(fl) OVER () THEN 1 ELSE 0 END AS n_test FROM al)"""


def dealt_sql(rows: str, keys: dict[str, str]) -> str:
    """CTEs that end in ``dealt`` (k, i, x): for each permutation k of ``keys`` row i takes what stands at row x.

    ``rows`` has the dense numbers i = 0..n-1. A Feistel network on pairs (l, r) of a
    rectangle of sides a and b, applied until the result is below n.
    """
    prime = 2**31 - 1
    params = []
    for name, key in keys.items():
        fields = []
        for j in range(8):
            digest = hashlib.md5(f"{key}:{j}".encode()).hexdigest()
            fields += [str(int(digest[:8], 16) % (prime - 1) + 1), str(int(digest[8:16], 16) % prime)]
        params.append(f"('{name}', {', '.join(fields)})")
    columns = ", ".join(f"f{j}, o{j}" for j in range(8))
    body = "(SELECT k, i, n, a, b, turns, x % a AS l, x // a AS r FROM walk, size WHERE turns = 0 OR x >= n)"
    for j in range(8):
        source, side = ("r", "a") if j % 2 == 0 else ("l", "b")
        keep = f"(l + h) % a AS l, r" if j % 2 == 0 else "l, (r + h) % b AS r"
        body = f"""(SELECT k, i, n, a, b, turns, {keep} FROM (
 SELECT k, i, n, a, b, turns, l, r, ((h * h + o{j}) % {prime}) % {side} AS h FROM (
 SELECT q.k, i, n, a, b, turns, l, r, o{j}, (h1 * h1 + f{j}) % {prime} AS h FROM (
 SELECT z.k, i, n, a, b, turns, l, r, f{j}, o{j}, (({source} % {prime}) * f{j} + o{j}) % {prime} AS h1 FROM {body} z JOIN params USING (k)) q)))"""
    return f"""params(k, {columns}) AS (VALUES {', '.join(params)}),
rn AS (SELECT count(*) AS n FROM {rows}),
size AS (SELECT n, a, b FROM (SELECT n, a, CAST(greatest(1, ceil(n / a)) AS BIGINT) AS b FROM (
  SELECT n, CAST(floor(sqrt(greatest(n - 1, 0))) AS BIGINT) + 1 + d AS a FROM rn, range(0, 4096) AS t(d)))
 ORDER BY CASE WHEN a * b - n <= 4 THEN 0 ELSE 1 END, CASE WHEN a * b - n <= 4 THEN a ELSE a * b - n END, a LIMIT 1),
walk(k, i, x, turns) AS (SELECT k, i, i, 0 FROM {rows}, params UNION ALL SELECT k, i, r * a + l, turns + 1 FROM {body} w),
dealt AS (SELECT k, i, x FROM walk, size WHERE turns > 0 AND x < n)"""


def split_oracles() -> dict[str, str]:
    out = {}
    out["stratified_split"] = f"""WITH {alloc_sql('orders', 'o_orderstatus')},
r AS (SELECT o_orderkey, o_orderstatus, {rank_sql('orders', 'o_orderstatus', 'o_orderkey', 42)} AS rk FROM orders)
SELECT r.o_orderkey, r.o_orderstatus, r.rk <= al2.n_test AS is_test FROM r JOIN al2 ON al2.lab = r.o_orderstatus"""
    out["stratified_kfold"] = f"""SELECT o_orderkey, o_orderstatus, CAST(({rank_sql('orders', 'o_orderstatus', 'o_orderkey', 42)} - 1) % 5 AS INTEGER) AS fold FROM orders"""
    mm = """cnt AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
mm AS (SELECT (SELECT quality FROM cnt ORDER BY n DESC, quality ASC LIMIT 1) AS major,
              (SELECT quality FROM cnt ORDER BY n ASC, quality DESC LIMIT 1) AS minor,
              (SELECT max(n) FROM cnt) AS n_major, (SELECT min(n) FROM cnt) AS n_minor)"""
    out["undersample"] = f"""WITH {mm},
r AS (SELECT doc_id, quality, {rank_sql('labels', 'quality', 'doc_id', 42)} AS rk FROM labels)
SELECT doc_id, quality FROM r, mm WHERE quality <> major OR rk <= n_minor OR n_major = n_minor"""
    out["oversample"] = f"""WITH {mm},
mi AS (SELECT doc_id, quality, {rank_sql('labels', 'quality', 'doc_id', 42)} - 1 AS idx FROM labels, mm WHERE quality = minor),
dr AS (SELECT d AS draw, CAST(floor(CAST(('0x' || substr(md5(concat('42', ':', CAST(d AS VARCHAR))), 1, 13))::BIGINT AS DOUBLE) / {float(16**13)} * n_minor) AS BIGINT) AS idx
       FROM mm, range(0, (SELECT n_major FROM mm)) AS t(d))
SELECT doc_id, quality, CAST(NULL AS BIGINT) AS draw FROM labels, mm WHERE quality = major
UNION ALL SELECT mi.doc_id, mi.quality, dr.draw FROM dr JOIN mi ON mi.idx = dr.idx"""
    out["column_permutation"] = f"""WITH RECURSIVE scored AS ({lenses.duck(lenses.SCORED_ORACLE_SQL)}),
a AS (SELECT id, p, row_number() OVER (ORDER BY id) - 1 AS i FROM scored),
{dealt_sql('a', {'': '7'})}
SELECT a.id, o.p AS pv FROM a JOIN dealt ON dealt.i = a.i JOIN a AS o ON o.i = dealt.x"""
    a = with_a()
    out["class_weights"] = f"""{a}, c AS (SELECT risk AS label, CAST(count(*) AS BIGINT) AS n_class FROM clean_a GROUP BY risk)
SELECT label, n_class, CAST(sum(n_class) OVER () AS DOUBLE) / (count(*) OVER () * n_class) AS balanced_weight,
 row_number() OVER (ORDER BY n_class DESC, label ASC) = 1 AS is_majority FROM c"""
    feats = list(specs.DATA1.features)
    params = " UNION ALL ".join(
        f"""SELECT {i} AS feature_order, '{f}' AS feature, md AS median, avg(coalesce({f}, md)) AS mean, stddev_pop(coalesce({f}, md)) AS std,
 CASE WHEN stddev_pop(coalesce({f}, md)) > 1e-12 * abs(avg(coalesce({f}, md))) THEN stddev_pop(coalesce({f}, md)) ELSE 1.0 END AS scale
 FROM clean_a, (SELECT median({f}) AS md FROM clean_a) m GROUP BY md"""
        for i, f in enumerate(feats)
    )
    out["impute_scale_params"] = f"{a}, params AS ({params}) SELECT * FROM params"
    scaled = ", ".join(
        f"(coalesce({f}, (SELECT median FROM params WHERE feature = '{f}')) - (SELECT mean FROM params WHERE feature = '{f}')) / (SELECT scale FROM params WHERE feature = '{f}') AS {f}"
        for f in feats
    )
    out["impute_scale"] = f"{a}, params AS ({params}) SELECT row_pos, risk, {scaled} FROM clean_a"

    def corr_sql(frame, features, target, dataset):
        return " UNION ALL ".join(
            f"""SELECT '{dataset}' AS dataset, '{f}' AS feature, r AS target_correlation, abs(r) AS abs_target_correlation,
 CASE WHEN abs(r) >= 0.75 THEN 'review' ELSE '' END AS flag
 FROM (SELECT CASE WHEN var_pop({f}) * var_pop({target}) > 0 THEN corr({f}, {target}) END AS r FROM {frame} WHERE {f} IS NOT NULL AND {target} IS NOT NULL) z"""
            for f in features
        )

    out["leakage"] = f"{with_star()} {corr_sql('vw_data1_modeling', feats, 'risk', 'Data1')} UNION ALL {corr_sql('vw_data2_modeling', list(specs.DATA2.features), 'high_risk', 'Data2')}"
    out["leakage_lineitem"] = f"WITH li AS (SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS returned FROM lineitem) " + corr_sql(
        "li", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "returned", "lineitem"
    )
    return out


# ------------------------------------------------------------------ scoring
def with_requests() -> str:
    from riskloom.operators.score import ALL_FIELDS

    b = with_b()
    a_fields = lenses.REQUEST_A_FIELDS
    lens_col = {v: k for k, v in lenses.INTAKE_A_HEADERS.items()}  # header -> lens column
    a_sel = ", ".join(f"{lens_col[h]} AS {f}" for h, f in a_fields.items())
    b_sel = ", ".join(f"CAST({c} AS VARCHAR) AS b_{c}" for c in lenses.REQUEST_B_FIELDS)
    cols = []
    for f in a_fields.values():
        cols.append(f"coalesce(ia.{f}, ib.b_{f}) AS {f}" if f in lenses.SHARED_FIELDS else f"ia.{f}")
    cols += [f"ib.b_{c} AS {c}" for c in lenses.REQUEST_B_FIELDS if c not in lenses.SHARED_FIELDS]
    present = {f: f"({f} IS NOT NULL AND {strip('CAST(' + f + ' AS VARCHAR)')} <> '')" for f in ALL_FIELDS}
    typed = []
    perr = []
    for f in ALL_FIELDS:
        if f == "bmi_calc":
            typed.append("CAST(NULL AS DOUBLE) AS bmi_calc")
            continue
        t = strip(f"CAST({f} AS VARCHAR)")
        typed.append(f"CASE WHEN {present[f]} THEN {to_number(t)} END AS {f}")
        perr.append(f"CASE WHEN {present[f]} AND {to_number(t)} IS NULL THEN 'invalid value in field: {f}' END")
    bmi = "CASE WHEN weight_kg IS NOT NULL AND weight_kg <> 0 AND height_cm IS NOT NULL AND height_cm > 0 THEN round_even(weight_kg / ((height_cm/100.0)*(height_cm/100.0)), 2) END"
    verr = []
    for f in ALL_FIELDS:
        if f in specs.REQUEST_RANGES:
            lo, hi = specs.REQUEST_RANGES[f]
            verr.append(f"CASE WHEN {f} IS NOT NULL AND NOT ({f} BETWEEN {lo} AND {hi}) THEN '{f}: value must be between {lo:g} and {hi:g}' END")
        elif f in specs.REQUEST_ORDINAL_123:
            verr.append(f"CASE WHEN {f} IS NOT NULL AND {f} NOT IN (1, 2, 3) THEN '{f}: choose a valid value' END")
        elif f in specs.REQUEST_BINARY_01:
            verr.append(f"CASE WHEN {f} IS NOT NULL AND {f} NOT IN (0, 1) THEN '{f}: choose yes or no' END")

    def miss(features):
        return "list_filter([" + ", ".join(f"CASE WHEN {f} IS NULL OR isnan({f}) THEN '{f}' END" for f in features) + "], lambda x: x IS NOT NULL)"

    others = ", ".join(f for f in ALL_FIELDS if f not in ("bmi", "bmi_calc"))
    return f"""{b},
ra AS (SELECT row_pos, {a_sel} FROM ({lenses.duck(lenses.INTAKE_A_SQL)}) q),
ia AS (SELECT row_pos AS request_id, * EXCLUDE (row_pos) FROM ra),
ib AS (SELECT row_pos - 2 AS request_id, {b_sel} FROM parsed_b),
req AS (SELECT coalesce(ia.request_id, ib.request_id) AS request_id, {', '.join(cols)} FROM ia FULL OUTER JOIN ib ON ia.request_id = ib.request_id),
typed AS (SELECT request_id, {', '.join(typed)}, list_filter([{', '.join(perr)}], lambda x: x IS NOT NULL) AS payload_errors FROM req),
bmi AS (SELECT request_id, {others}, coalesce(bmi, {bmi}) AS bmi, coalesce(bmi_calc, {bmi}) AS bmi_calc, payload_errors FROM typed),
prep AS (SELECT request_id, {', '.join(ALL_FIELDS)},
  list_concat(payload_errors, list_filter([{', '.join(verr)}], lambda x: x IS NOT NULL)) AS errors,
  {miss(specs.DATA1.features)} AS missing_data1, {miss(specs.DATA2.features)} AS missing_data2 FROM bmi),
routed AS (SELECT *,
  CASE WHEN len(errors) > 0 THEN 'rejected' WHEN len(missing_data1) = 0 AND len(missing_data2) = 0 THEN 'combined'
   WHEN len(missing_data1) = 0 THEN 'data1_only' WHEN len(missing_data2) = 0 THEN 'data2_only' ELSE 'incomplete' END AS prediction_mode FROM prep)"""


def txt(col: str) -> str:
    return f"array_to_string({col}, '; ') AS {col}"


def sigmoid_sql(card) -> str:
    z = " + ".join([str(float(card.intercept))] + [f"CAST({f} AS DOUBLE) * {float(card.coefficients.get(f, 0.0))}" for f in card.features])
    return f"1.0 / (1.0 + exp(-({z})))"


def importance_sql() -> str:
    """Permutation importance of the intake-2 card: F1 at 0.5 of every (feature, repeat) copy against the plain rows."""
    from riskloom.plans import model_cards as mc

    card, seed = mc.DATA2_CARD, specs.RANDOM_STATE
    keys = {f"{f}:{r}": f"{seed}:{f}:{r}" for f in card.features for r in range(specs.IMPORTANCE_REPEATS)}
    swapped = ", ".join(f"CASE WHEN d.k LIKE '{f}:%' THEN o.{f} ELSE a.{f} END AS {f}" for f in card.features)
    f1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END"
    counts = "count_if(p >= 0.5 AND y = 1) AS tp, count_if(p >= 0.5 AND y <> 1) AS fp, count_if(p < 0.5 AND y = 1) AS fn"
    return f"""{with_b().replace('WITH ', 'WITH RECURSIVE ', 1)},
a AS MATERIALIZED (SELECT row_number() OVER (ORDER BY row_pos) - 1 AS i, high_risk AS y, {', '.join(card.features)} FROM clean_b),
{dealt_sql('a', keys)},
s AS (SELECT k, y, {sigmoid_sql(card)} AS p FROM (SELECT d.k, a.y, {swapped} FROM a JOIN dealt d ON d.i = a.i JOIN a AS o ON o.i = d.x)),
c AS (SELECT k, {f1} AS f1 FROM (SELECT k, {counts} FROM s GROUP BY k)),
base AS (SELECT {f1} AS f1 FROM (SELECT {counts} FROM (SELECT y, {sigmoid_sql(card)} AS p FROM a)))
SELECT split_part(k, ':', 1) AS feature, avg((SELECT f1 FROM base) - f1) AS importance_mean, stddev_pop((SELECT f1 FROM base) - f1) AS importance_std
FROM c GROUP BY 1"""


def single_sql(ctes: str, card, mode: str, records: str) -> str:
    """One model's results for raw records: numbers or errors, missing features, no range rules."""
    fields = card.features
    text = {f: strip(f"CAST({f} AS VARCHAR)") for f in fields}
    present = {f: f"({f} IS NOT NULL AND {text[f]} <> '')" for f in fields}
    typed = ", ".join(f"CASE WHEN {present[f]} THEN {to_number(text[f])} END AS {f}" for f in fields)
    errors = ", ".join(f"CASE WHEN {present[f]} AND {to_number(text[f])} IS NULL THEN 'invalid value in field: {f}' END" for f in fields_in_order(fields))
    missing = ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in fields)
    some = lambda items: f"list_filter([{items}], lambda x: x IS NOT NULL)"
    ok = f"m = '{mode}'"
    return f"""{ctes},
rec AS ({records}),
ty AS (SELECT request_id, {typed}, {some(errors)} AS errors FROM rec),
mi AS (SELECT *, {some(missing)} AS missing FROM ty),
md AS (SELECT *, CASE WHEN len(errors) > 0 THEN 'rejected' WHEN len(missing) = 0 THEN '{mode}' ELSE 'incomplete' END AS m FROM mi),
sc AS (SELECT *, CASE WHEN {ok} THEN {sigmoid_sql(card)} END AS p FROM md)
SELECT request_id, m AS prediction_mode, CASE m WHEN 'rejected' THEN array_to_string(errors, '; ') WHEN 'incomplete' THEN 'Missing {card.dataset}: ' || array_to_string(missing, ', ') END AS reason,
 CASE WHEN {ok} THEN '{card.model_name}' END AS model_name, p AS probability, CASE WHEN {ok} THEN CAST({card.threshold} AS DOUBLE) END AS threshold,
 CASE WHEN {ok} THEN CAST(p >= CAST({card.threshold} AS DOUBLE) AS INTEGER) END AS predicted_class,
 CASE WHEN {ok} THEN CASE WHEN p >= CAST({card.threshold} AS DOUBLE) THEN '{specs.RISK_LABELS[1]}' ELSE '{specs.RISK_LABELS[0]}' END END AS risk_label,
 CASE WHEN {ok} THEN {len(fields)} END AS feature_count, CASE WHEN {ok} THEN '{'; '.join(fields)}' END AS features_used,
 CASE WHEN {ok} THEN '' END AS limitations FROM sc"""


def fields_in_order(fields) -> list[str]:
    from riskloom.operators.score import ALL_FIELDS

    return [f for f in ALL_FIELDS if f in fields]


def bad_values_sql(ctes: str) -> str:
    from riskloom.operators.score import ALL_FIELDS

    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS field, request_id AS id, CAST({f} AS VARCHAR) AS value FROM req WHERE {f} IS NOT NULL AND "
        f"{strip(f'CAST({f} AS VARCHAR)')} <> '' AND {to_number(strip(f'CAST({f} AS VARCHAR)'))} IS NULL"
        for f in ALL_FIELDS
        if f != "bmi_calc"
    )
    return f"""{ctes}, bv AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY id, value) AS r FROM ({rows}) u)
SELECT field, CAST(count(*) AS BIGINT) AS n_bad, string_agg(value, '; ' ORDER BY r) FILTER (r <= 3) AS first_values FROM bv GROUP BY field"""


def model_runs_ctes() -> str:
    """model_runs: both cards on the complete rows of their clean intakes."""
    from riskloom.plans import model_cards as mc

    ctes, rows = [], []
    for i, (card, frame, label) in enumerate(((mc.DATA1_CARD, "clean_a", "risk"), (mc.DATA2_CARD, "clean_b", "high_risk")), 1):
        whole = " AND ".join(f"{f} IS NOT NULL" for f in card.features)
        t = f"CAST({card.threshold} AS DOUBLE)"
        ctes.append(f"run{i} AS (SELECT {label} AS y, {sigmoid_sql(card)} AS p FROM {frame} WHERE {whole})")
        ctes.append(
            f"cnt{i} AS (SELECT count_if(p < {t} AND y <> 1) AS tn, count_if(p >= {t} AND y <> 1) AS fp, count_if(p < {t} AND y = 1) AS fn, count_if(p >= {t} AND y = 1) AS tp FROM run{i})"
        )
        rows.append(
            f"SELECT CAST({i} AS BIGINT) AS model_run_id, '{card.model_name}' AS model_name, '{card.dataset}' AS dataset_name, now() AS trained_at, "
            f"(SELECT roc_auc FROM {auc_sql(f'run{i}', None)} u) AS auc, {rates_sql()}, {t} AS threshold, '' AS notes FROM cnt{i}"
        )
    return ",\n".join(ctes) + ",\nmodel_runs AS (" + " UNION ALL ".join(rows) + ")"


def score_oracles() -> dict[str, str]:
    from riskloom.operators.score import ALL_FIELDS
    from riskloom.plans import model_cards as mc

    r = with_requests()
    out = {}
    out["request_validate"] = f"{r} SELECT request_id, {', '.join(ALL_FIELDS)}, {txt('errors')}, {txt('missing_data1')}, {txt('missing_data2')} FROM prep"
    reason = f"""CASE prediction_mode WHEN 'data1_only' THEN '{specs.ROUTE_REASONS['data1_only']}' WHEN 'data2_only' THEN '{specs.ROUTE_REASONS['data2_only']}'
 WHEN 'rejected' THEN array_to_string(errors, '; ')
 WHEN 'incomplete' THEN 'No complete feature group was supplied. Missing Data1: ' || array_to_string(missing_data1, ', ') || '; missing Data2: ' || array_to_string(missing_data2, ', ') END"""
    near = "CASE WHEN prediction_mode = 'incomplete' THEN CASE WHEN len(missing_data2) <= len(missing_data1) THEN 'Data2' ELSE 'Data1' END END"
    near_m = "CASE WHEN prediction_mode = 'incomplete' THEN CASE WHEN len(missing_data2) <= len(missing_data1) THEN missing_data2 ELSE missing_data1 END END"
    out["route_mode"] = f"{r} SELECT request_id, prediction_mode, {reason} AS reason, {near} AS nearest_group, array_to_string({near_m}, '; ') AS nearest_missing FROM routed"
    use1 = "prediction_mode IN ('combined', 'data1_only')"
    use2 = "prediction_mode IN ('combined', 'data2_only')"
    w1 = w2 = "CAST(0.5 AS DOUBLE)"
    thr = f"CAST({mc.DUAL.combined_threshold} AS DOUBLE)"
    lab = lambda c: f"CASE WHEN {c} = 1 THEN '{specs.RISK_LABELS[1]}' WHEN {c} = 0 THEN '{specs.RISK_LABELS[0]}' END"
    scored = f"""{r},
sc AS (SELECT *, CASE WHEN {use1} THEN {sigmoid_sql(mc.DATA1_CARD)} END AS p1, CASE WHEN {use2} THEN {sigmoid_sql(mc.DATA2_CARD)} END AS p2 FROM routed),
sc2 AS (SELECT *, CASE WHEN prediction_mode = 'combined' THEN {w1} * p1 + {w2} * p2 END AS pc,
  CASE WHEN {use1} THEN CAST(p1 >= CAST({mc.DATA1_CARD.threshold} AS DOUBLE) AS INTEGER) END AS c1,
  CASE WHEN {use2} THEN CAST(p2 >= CAST({mc.DATA2_CARD.threshold} AS DOUBLE) AS INTEGER) END AS c2 FROM sc),
flat AS (SELECT request_id, prediction_mode, {reason} AS reason, '{specs.DISCLAIMER}' AS disclaimer,
  CASE WHEN {use1} THEN '{mc.DATA1_CARD.model_name}' END AS data1_model_name, p1 AS data1_probability,
  CASE WHEN {use1} THEN CAST({mc.DATA1_CARD.threshold} AS DOUBLE) END AS data1_threshold, c1 AS data1_predicted_class, {lab('c1')} AS data1_risk_label,
  CASE WHEN {use2} THEN '{mc.DATA2_CARD.model_name}' END AS data2_model_name, p2 AS data2_probability,
  CASE WHEN {use2} THEN CAST({mc.DATA2_CARD.threshold} AS DOUBLE) END AS data2_threshold, c2 AS data2_predicted_class, {lab('c2')} AS data2_risk_label,
  pc AS combined_probability, CASE WHEN prediction_mode = 'combined' THEN {thr} END AS combined_threshold,
  CASE WHEN prediction_mode = 'combined' THEN CAST(pc >= {thr} AS INTEGER) END AS combined_predicted_class,
  {lab("CASE WHEN prediction_mode = 'combined' THEN CAST(pc >= " + thr + " AS INTEGER) END")} AS combined_risk_label,
  CASE WHEN prediction_mode = 'combined' THEN {w1} END AS data1_weight, CASE WHEN prediction_mode = 'combined' THEN {w2} END AS data2_weight,
  {txt('errors')}, {txt('missing_data1')}, {txt('missing_data2')}, {near} AS nearest_group FROM sc2)"""
    out["combined_score"] = f"{scored} SELECT * FROM flat"
    out["importance_card"] = importance_sql()
    out["stream_scores"] = out["combined_score"]
    out["requests_json_roundtrip"] = out["combined_score"]
    req_both = f"""{r},
rb AS (SELECT *, CASE WHEN len(errors) > 0 THEN 'rejected' WHEN len(missing_data1) = 0 AND len(missing_data2) = 0 THEN 'combined' ELSE 'incomplete' END AS mode2 FROM prep),
rs AS (SELECT *, CASE WHEN mode2 = 'combined' THEN {w1} * ({sigmoid_sql(mc.DATA1_CARD)}) + {w2} * ({sigmoid_sql(mc.DATA2_CARD)}) END AS pc FROM rb)
SELECT request_id, mode2 AS prediction_mode, pc AS combined_probability,
 CASE WHEN mode2 = 'combined' THEN CAST(pc >= {thr} AS INTEGER) END AS combined_predicted_class,
 {lab("CASE WHEN mode2 = 'combined' THEN CAST(pc >= " + thr + " AS INTEGER) END")} AS combined_risk_label,
 CASE mode2 WHEN 'rejected' THEN array_to_string(errors, '; ') WHEN 'incomplete' THEN '{specs.INCOMPLETE_REASONS['combined']} Missing Data1: '
  || array_to_string(missing_data1, ', ') || '; missing Data2: ' || array_to_string(missing_data2, ', ') END AS reason,
 {txt('missing_data1')}, {txt('missing_data2')},
 CASE WHEN mode2 = 'incomplete' THEN CASE WHEN len(missing_data2) <= len(missing_data1) THEN 'Data2' ELSE 'Data1' END END AS nearest_group FROM rs"""
    out["combined_required_score"] = req_both
    out["bad_values"] = bad_values_sql(r)
    out["combined_score_no_metadata"] = out["combined_score"].replace(thr, "CAST(0.5 AS DOUBLE)")
    pick = lambda what: f"CASE WHEN prediction_mode = 'combined' THEN combined_{what} WHEN prediction_mode = 'data1_only' THEN data1_{what} ELSE data2_{what} END"
    name = "CASE WHEN prediction_mode = 'combined' THEN data1_model_name || '+' || data2_model_name WHEN prediction_mode = 'data1_only' THEN data1_model_name ELSE data2_model_name END"
    accepted = "prediction_mode IN ('combined', 'data1_only', 'data2_only')"
    out["stream_predictions"] = f"""{scored}
SELECT request_id AS prediction_id, CAST(NULL AS BIGINT) AS model_run_id, {name} AS model_name, {pick('probability')} AS predicted_probability,
 {pick('predicted_class')} AS predicted_class, {pick('risk_label')} AS risk_label FROM flat WHERE {accepted}"""
    out["stream_quarantine"] = f"""{scored}
SELECT request_id, prediction_mode, reason, errors, missing_data1, missing_data2, nearest_group, CAST(NULL AS VARCHAR) AS malformed_text
FROM flat WHERE NOT ({accepted})
UNION ALL SELECT NULL, 'rejected', 'malformed record', 'malformed record', NULL, NULL, NULL, '{{"request_id": ' || request_id || ', "age": '
FROM req WHERE request_id % 97 = 0"""
    out["score_data1"] = single_sql(with_a(), mc.DATA1_CARD, "data1",
        f"SELECT row_pos AS request_id, {', '.join(f'{src} AS {dst}' for dst, src in A_SRC.items())} FROM ({lenses.duck(lenses.INTAKE_A_SQL)}) q")
    out["score_data2"] = single_sql(with_b(), mc.DATA2_CARD, "data2",
        f"SELECT row_pos AS request_id, {', '.join(f'CAST({f} AS VARCHAR) AS {f}' for f in mc.DATA2_CARD.features)} FROM parsed_b")
    runs = model_runs_ctes()
    out["model_runs"] = f"{with_star()}, {runs} SELECT * EXCLUDE (trained_at) FROM model_runs"
    star, log = with_star(), scored.removeprefix("WITH ")
    own = r.removeprefix("WITH ")
    tables = [*STAR_CHECK_SQL, *MODEL_CHECK_SQL]
    log = log.replace(with_b().removeprefix("WITH ") + ",", "", 1)  # with_star has intake 2 already
    parts = [
        f"SELECT {lit(t)} AS table_name, {lit(n)} AS check_name, CAST(count_if(NOT ({c})) AS BIGINT) AS violations FROM b_{t}"
        for t, conds in (STAR_CHECK_SQL | MODEL_CHECK_SQL).items() for n, c in conds
    ]
    parts += [
        f"SELECT {lit(t)}, {lit(c + '_not_null')}, CAST(count_if({c} IS NULL) AS BIGINT) FROM b_{t}"
        for t, cols in (STAR_NOT_NULL_SQL | MODEL_NOT_NULL_SQL).items() for c in cols
    ]
    keys = STAR_KEYS_SQL | {"model_runs": [["model_run_id"]], "predictions": [["prediction_id"]]}
    parts += [
        f"SELECT {lit(t)}, check_name, violations FROM ({unique_sql('b_' + t, c)})" for t, ks in keys.items() for c in ks
    ]
    fks = [("pregnancies", "source_dataset", "data_sources", "source_dataset")] + [(x, "pregnancy_id", "pregnancies", "pregnancy_id") for x in SATELLITES]
    fks.append(("predictions", "model_run_id", "model_runs", "model_run_id"))
    parts += [
        f"SELECT {lit(c)}, check_name, issue_count FROM ({orphan_sql(f'{c}.{fk}->{p}.{pk}', 'b_' + c, fk, 'b_' + p, pk)})" for c, fk, p, pk in fks
    ]
    broken = ",\n".join(
        f"b_{t} AS (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in lenses.FAULTS[t].items())}) FROM {t})" for t in tables
    )
    out["constraint_audit"] = f"""{star}, {log}, {runs},
predictions AS (SELECT request_id AS prediction_id, now() AS created_at, CAST(2 AS BIGINT) AS model_run_id, {name} AS model_name, 'json' AS input_json,
 {pick('probability')} AS predicted_probability, {pick('predicted_class')} AS predicted_class, {pick('risk_label')} AS risk_label FROM flat WHERE {accepted}),
{broken}
""" + " UNION ALL ".join(parts)
    part = lambda g, n: (
        f"CASE WHEN {g}_probability IS NOT NULL THEN '{n} ' || CAST(round_even({g}_probability * 100, 0) AS BIGINT) || ' % (threshold ' || "
        f"printf('%.3f', round_even({g}_threshold, 3)) || CASE WHEN {g}_weight IS NOT NULL THEN ', weight ' || printf('%.2f', {g}_weight) ELSE '' END || ')' END"
    )
    out["presentation"] = f"""{scored},
pres AS (SELECT *,
  CASE WHEN prediction_mode = 'combined' THEN combined_probability WHEN prediction_mode = 'data1_only' THEN data1_probability ELSE data2_probability END AS p,
  CASE WHEN prediction_mode = 'combined' THEN combined_threshold WHEN prediction_mode = 'data1_only' THEN data1_threshold ELSE data2_threshold END AS t,
  CASE WHEN prediction_mode = 'combined' THEN combined_predicted_class WHEN prediction_mode = 'data1_only' THEN data1_predicted_class ELSE data2_predicted_class END AS c
 FROM flat WHERE prediction_mode IN ('combined', 'data1_only', 'data2_only'))
SELECT request_id, prediction_mode, CASE prediction_mode WHEN 'combined' THEN 'Both models' WHEN 'data1_only' THEN 'Data1 model' ELSE 'Data2 model' END AS mode_label,
 CAST(round_even(p * 100, 0) AS BIGINT) AS probability_pct, c AS predicted_class, {lab('c')} AS risk_label,
 CAST(round_even(t, 3) AS DOUBLE) AS threshold, concat_ws('; ', {part('data1', 'Data1')}, {part('data2', 'Data2')}) AS details, reason FROM pres"""
    return out
