"""Dirty-intake lenses over the driver tables.

The reference ships no raw tables, so its two intake shapes are derived from the
driver's parquet tables by row-wise SQL (no filters on ids, whole tables). The
same SQL text runs on Spark (``spark.sql(text, orders=df, ...)``, which binds
DataFrames as uniquely named views) and on DuckDB (``text.format(orders="orders")``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import specs
from riskloom.sources.tables import table

# Raw intake 1: headered table read as strings (bad ages, blanks, 'n/a', out-of-set
# flags, missing targets, injected exact duplicates).
INTAKE_A_SQL = """
SELECT row_pos, age, systolic_bp, diastolic, bs, body_temp, bmi, prev_comp, pre_diab, gest_diab, mental, heart_rate, risk_level FROM (
SELECT k+d*1000000000 AS row_pos,
 CASE WHEN k%97=5 THEN '325' WHEN k%89=3 THEN '' ELSE CAST(15+c%35 AS VARCHAR(20)) END AS age,
 CASE WHEN k%101=7 THEN 'n/a' ELSE CAST(90+p%80 AS VARCHAR(20)) END AS systolic_bp,
 CAST(50+p%60 AS VARCHAR(20)) AS diastolic,
 concat(CAST(3+p%15 AS VARCHAR(20)),'.',CAST(k%10 AS VARCHAR(20))) AS bs,
 CAST(97+c%7 AS VARCHAR(20)) AS body_temp,
 CASE WHEN k%83=2 THEN '0' WHEN k%71=1 THEN NULL ELSE concat(CAST(18+c%25 AS VARCHAR(20)),'.',CAST(p%10 AS VARCHAR(20))) END AS bmi,
 CASE WHEN k%103=9 THEN '2' ELSE CAST(p%2 AS VARCHAR(20)) END AS prev_comp,
 CAST(c%2 AS VARCHAR(20)) AS pre_diab, CAST((c+p)%2 AS VARCHAR(20)) AS gest_diab, CAST(k%2 AS VARCHAR(20)) AS mental,
 CASE WHEN k%107=11 THEN ' 250 ' ELSE CAST(58+p%45 AS VARCHAR(20)) END AS heart_rate,
 CASE WHEN k%61=4 THEN NULL WHEN st='F' THEN 'High' WHEN st='O' THEN ' low ' ELSE 'LOW' END AS risk_level
FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS p, o_orderstatus AS st, 0 AS d FROM {orders}
 UNION ALL SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT), o_orderstatus, 1 FROM {orders} WHERE o_orderkey%50=0) b) x
"""

# Raw intake 2: headerless cells; a title row at row_pos 0, the header at 1, column c7 unnamed.
INTAKE_B_SQL = """
SELECT k+2 AS row_pos, CAST(16+u%30 AS VARCHAR(20)) AS c0,
 CASE WHEN k%7<3 THEN '1st' WHEN k%7<5 THEN '2nd' WHEN k%7=5 THEN ' 3RD ' ELSE '4th' END AS c1,
 CASE k%3 WHEN 0 THEN '1st' WHEN 1 THEN '2nd' ELSE '3rd' END AS c2,
 concat(CAST(5+k%37 AS VARCHAR(20)),' week') AS c3,
 concat(CAST(40+u%60 AS VARCHAR(20)), CASE WHEN k%2=0 THEN ' kg' ELSE '.5kg' END) AS c4,
 CASE k%8 WHEN 0 THEN concat('5',chr(39),'3',chr(34)) WHEN 1 THEN concat('5.2',chr(39),chr(39)) WHEN 2 THEN '160 cm' WHEN 3 THEN '1.65'
  WHEN 4 THEN concat('5',chr(39),' 10') WHEN 5 THEN '95' WHEN 6 THEN concat('5',chr(39),chr(39),'4') ELSE CAST(140+u%50 AS VARCHAR(20)) END AS c5,
 CASE WHEN k%67=1 THEN '1200/80' WHEN k%59=2 THEN 'unknown' ELSE concat(CAST(90+k%80 AS VARCHAR(20)),' / ',CAST(50+u%60 AS VARCHAR(20)),' mmHg') END AS c6,
 CAST(NULL AS VARCHAR(20)) AS c7,
 concat(CAST(100+k%90 AS VARCHAR(20)),'b/m') AS c8,
 CASE WHEN k%40=3 THEN 'None' WHEN k%4=0 THEN 'Yes' WHEN k%4=1 THEN 'no' WHEN k%4=2 THEN ' Y ' ELSE '0' END AS c9,
 CASE WHEN k%11=0 THEN 'Positive' ELSE 'negative' END AS c10,
 CASE WHEN k%13=0 THEN 'positive' ELSE 'Negative' END AS c11,
 CASE WHEN k%73=0 THEN 'maybe' WHEN et IN ('error','purchase') THEN 'Yes' ELSE 'No' END AS c12
FROM (SELECT event_id AS k, user_id AS u, event_type AS et FROM {events}) e
UNION ALL SELECT 0,'Registry export',NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL,NULL
UNION ALL SELECT 1,'Age ','Gravida','TT injection','pregnancy duration','weight','hight','blood pressure',NULL,'fetal heartbeat','urine test - sugar','VDRL','HRsAG test','high risk pregnancy'
"""

# Scored lens: (id, y, p) from labelled documents; folds come from the stratified
# k-fold operator (Spark) / a per-class row_number (oracle).
SCORED_BASE_SQL = """
SELECT l.doc_id AS id, l.quality AS y, CAST(d.n_chars%100 AS DOUBLE)/100 AS p
FROM {labels} l JOIN {documents} d ON d.doc_id=l.doc_id
"""
SCORED_ORACLE_SQL = """
SELECT l.doc_id AS id, l.quality AS y, CAST(d.n_chars%100 AS DOUBLE)/100 AS p,
 (row_number() OVER (PARTITION BY l.quality ORDER BY md5(CAST(l.doc_id AS VARCHAR(20))), l.doc_id)-1)%5 AS fold
FROM {labels} l JOIN {documents} d ON d.doc_id=l.doc_id
"""

INTAKE_B_CELLS = tuple(f"c{i}" for i in range(13))

# Lens column -> raw intake 1 header.
INTAKE_A_HEADERS = {
    "age": "Age",
    "systolic_bp": "Systolic BP",
    "diastolic": "Diastolic",
    "bs": "BS",
    "body_temp": "Body Temp",
    "bmi": "BMI",
    "prev_comp": "Previous Complications",
    "pre_diab": "Preexisting Diabetes",
    "gest_diab": "Gestational Diabetes",
    "mental": "Mental Health",
    "heart_rate": "Heart Rate",
    "risk_level": "Risk Level",
}


def duck(sql: str) -> str:
    """Lens text for DuckDB, where the driver tables are plain views."""
    return sql.format(orders="orders", events="events", labels="labels", documents="documents", lineitem="lineitem")


TASK_ROWS = 250_000  # rows of a table that a parsing task gets


def spread(df: DataFrame) -> DataFrame:
    """Hash-spread a table's rows over at least as many tasks as cores, TASK_ROWS to a task.

    The text parsers are CPU-bound, and a scan's splits follow bytes and row groups: a
    table of few large row groups is read by few tasks, whatever its number of splits.
    All columns are hashed, so that a repeated or missing key does not gather its rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // TASK_ROWS)), *df.columns)


def intake_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lens A as it comes off disk: one string column per raw header, plus row_pos."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"))
    lens = spark.sql(INTAKE_A_SQL, orders=orders)
    return lens.select("row_pos", *[F.col(k).alias(v) for k, v in INTAKE_A_HEADERS.items()])


def intake_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lens B as a headerless sheet: (row_pos, c0..c12) string cells."""
    return spark.sql(INTAKE_B_SQL, events=spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")))


def scored(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Scored lens (id, y, p, fold) with seeded stratified folds."""
    from riskloom.operators.split import stratified_kfold

    base = spark.sql(
        SCORED_BASE_SQL, labels=table(spark, sf_dir, "labels"), documents=table(spark, sf_dir, "documents")
    )
    return stratified_kfold(base, label_col="y", id_col="id", k=k, seed=None, fold_col="fold")


# Scores of order lines by line status: nine in ten within 1e-9, the rest spread over
# (0, 5e-4], one line of each status at 1; labels from the return flag.
SKEWED_SQL = """
SELECT l_linestatus AS g, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
 CASE WHEN (l_orderkey * 7 + l_linenumber) % 10 < 9 THEN CAST((l_orderkey * 13 + l_partkey * 31 + l_linenumber) % 100003 AS DOUBLE) * 1e-14
  WHEN l_orderkey = (SELECT min(l_orderkey) FROM {lineitem}) THEN 1.0
  ELSE CAST((l_partkey * 17 + l_suppkey) % 9973 + 1 AS DOUBLE) / 9973 * 5e-4 END AS p
FROM {lineitem}
"""


def skewed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SKEWED_SQL, lineitem=table(spark, sf_dir, "lineitem"))


# Request records: raw intake-1 strings paired with parsed intake-2 values on their
# source ids (order key k <-> event id k, one full outer equi-join; either side may
# be alone). Intake-2 rows carry no bmi_calc, so serve-time BMI derivation fills it.
REQUEST_A_FIELDS = {raw: name for raw, name in specs.DATA1_COLUMN_MAP.items() if name in specs.DATA1.features}
REQUEST_B_FIELDS = (
    "age",
    "gravida_n",
    "tt_injection_n",
    "pregnancy_weeks",
    "weight_kg",
    "height_cm",
    "systolic_bp",
    "diastolic_bp",
    "fetal_heartbeat_bpm",
    "urine_sugar_yes",
    "vdrl_positive",
    "hrsag_positive",
)
SHARED_FIELDS = ("age", "systolic_bp", "diastolic_bp")


def requests(spark: SparkSession, sf_dir: str, parsed_b: DataFrame | None = None) -> DataFrame:
    """(request_id, 20 string fields) — any subset may be absent, blank or non-numeric.

    ``parsed_b``: the rows of intake 2 as ``parse_data2`` gives them, if they are landed already.
    """
    from riskloom.plans.clean import parse_data2

    a = intake_a(spark, sf_dir).select(
        F.col("row_pos").alias("request_id"), *[F.col(k).alias(v) for k, v in REQUEST_A_FIELDS.items()]
    )
    b = (parse_data2(intake_b(spark, sf_dir)) if parsed_b is None else parsed_b).select(
        (F.col("row_pos") - 2).alias("request_id"), *[F.col(c).cast("string").alias(f"b_{c}") for c in REQUEST_B_FIELDS]
    )
    j = a.join(b, "request_id", "full_outer")
    cols = []
    for f in REQUEST_A_FIELDS.values():
        cols.append(F.coalesce(F.col(f), F.col(f"b_{f}")).alias(f) if f in SHARED_FIELDS else F.col(f))
    cols += [F.col(f"b_{c}").alias(c) for c in REQUEST_B_FIELDS if c not in SHARED_FIELDS]
    return j.select("request_id", *cols)


def learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lens C: clean intake 1 rows (missing features stay missing) and a learnable label
    ((preexisting_diabetes = 1 AND blood_sugar >= 10) OR systolic_bp >= 150)."""
    from riskloom.plans.clean import clean_data1
    from riskloom.sources.ingest import na_tokens_to_null

    c = clean_data1(na_tokens_to_null(intake_a(spark, sf_dir)))
    label = ((F.col("preexisting_diabetes") == 1) & (F.col("blood_sugar") >= 10)) | (F.col("systolic_bp") >= 150)
    return c.withColumn("risk", F.coalesce(label, F.lit(False)).cast("int"))


# A star with faults: per table the columns whose values are replaced in some rows, so
# that every constraint of the audit is violated. The same SQL text runs on both engines.
def _fault(column: str, *cases: tuple[int, str], key: str = "pregnancy_id") -> str:
    return "CASE " + " ".join(f"WHEN {key} % {n} = 0 THEN {value}" for n, value in cases) + f" ELSE {column} END"


_CHILD = {"pregnancy_id": _fault("pregnancy_id", (137, "pregnancy_id + 1"), (139, "-pregnancy_id"), (149, "NULL"))}
FAULTS = {
    "data_sources": {
        "loaded_row_count": "CASE WHEN source_dataset = 'Data2' THEN -1 ELSE loaded_row_count END",
        "cleaned_file": "CASE WHEN source_dataset = 'Data1' THEN NULL ELSE cleaned_file END",
        "source_dataset": "CASE WHEN source_dataset = 'Data2' THEN 'Data4' ELSE source_dataset END",
    },
    "pregnancies": {
        "age": _fault("age", (101, "9")),
        "target_risk": _fault("target_risk", (103, "2"), (107, "NULL")),
        "pregnancy_weeks": _fault("pregnancy_weeks", (109, "46")),
        "source_row_id": _fault("source_row_id", (113, "-1")),
        "source_dataset": _fault("source_dataset", (127, "'Data3'"), (131, "NULL")),
    },
    "vitals": _CHILD | {
        c: _fault(c, (n, v)) for c, n, v in [
            ("systolic_bp", 61, "69"), ("diastolic_bp", 67, "141"), ("heart_rate", 71, "201"), ("body_temp_f", 73, "89.5"),
            ("weight_kg", 79, "201"), ("height_cm", 83, "119"), ("height_m", 89, "2.3"), ("bmi", 97, "9.5"),
        ]
    },
    "medical_history": _CHILD | {
        c: _fault(c, (n, v)) for c, n, v in [
            ("previous_complications", 41, "2"), ("preexisting_diabetes", 43, "-1"), ("gestational_diabetes", 47, "3"),
            ("mental_health", 53, "2"), ("gravida_n", 59, "4"), ("tt_injection_n", 61, "0"),
        ]
    },
    "lab_tests": _CHILD | {
        c: _fault(c, (n, v)) for c, n, v in [("blood_sugar", 31, "26"), ("urine_sugar_yes", 37, "2"), ("vdrl_positive", 41, "2"), ("hrsag_positive", 43, "2")]
    },
    "obstetric_observations": _CHILD | {"fetal_heartbeat_bpm": _fault("fetal_heartbeat_bpm", (29, "59"))},
    "model_runs": {
        "dataset_name": "CASE WHEN model_run_id = 2 THEN 'Other' ELSE dataset_name END",
        "auc": "CASE WHEN model_run_id = 1 THEN 1.5 ELSE auc END",
        "threshold": "CASE WHEN model_run_id = 1 THEN -0.1 ELSE threshold END",
        "recall": "CASE WHEN model_run_id = 2 THEN 2 ELSE recall END",
    },
    "predictions": {
        "predicted_probability": _fault("predicted_probability", (151, "-0.5"), key="prediction_id"),
        "predicted_class": _fault("predicted_class", (157, "2"), key="prediction_id"),
        "risk_label": _fault("risk_label", (163, "'unknown'"), (167, "NULL"), key="prediction_id"),
        "model_run_id": _fault("model_run_id", (173, "99"), (179, "NULL"), key="prediction_id"),
        "prediction_id": _fault("prediction_id", (181, "prediction_id + 1"), key="prediction_id"),
    },
}


def with_faults(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with the faults of FAULTS, column types kept."""
    out = {}
    for name, df in tables.items():
        faults = FAULTS.get(name, {})
        out[name] = df.select(*[F.expr(faults[c]).cast(df.schema[c].dataType).alias(c) if c in faults else F.col(c) for c in df.columns])
    return out


# Records of one model each, as a batch of files would bring them: texts, typed by the scorer.
def records_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, intake-1 features as raw strings)."""
    return intake_a(spark, sf_dir).select(F.col("row_pos").alias("request_id"), *[F.col(k).alias(v) for k, v in REQUEST_A_FIELDS.items()])


def records_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, parsed intake-2 features as strings, bmi_calc among them; no range rules applied)."""
    from riskloom.plans.clean import parse_data2

    features = [*REQUEST_B_FIELDS, "bmi_calc"]
    return parse_data2(intake_b(spark, sf_dir)).select(F.col("row_pos").alias("request_id"), *[F.col(c).cast("string").alias(c) for c in features])
