"""Normalised 1:1 star (S10-S12), surrogate ids (W1-W2) and modelling views.

Both clean intakes are unioned with a source tag and numbered 1..N (intake 1
rows first, each in file order) without a single-task window; the ordered frame
is cut into the shared checkpoint folder. Every star table is a projection of
that one frame.

The modelling views are 1:1 inner joins on ``pregnancy_id``. On a star that was
just split from one frame, that join is an identity (the audit's unique / FK /
childless checks prove the 1:1 shape), so the views read the split's source
frame in a single scan with no exchange. On stored tables (:func:`read_star`)
the views run the joins; written with ``bucketBy`` they need no shuffle either.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import specs
from riskloom.operators.ranking import dense_ids

SOURCE_ORDER = {"Data1": 0, "Data2": 1}

PREGNANCY_COLS = ["pregnancy_id", "source_dataset", "source_row_id", "target_risk", "age", "pregnancy_weeks"]
VITALS_COLS = ["systolic_bp", "diastolic_bp", "heart_rate", "body_temp_f", "weight_kg", "height_cm", "height_m", "bmi"]
HISTORY_COLS = [
    "previous_complications",
    "preexisting_diabetes",
    "gestational_diabetes",
    "mental_health",
    "gravida_n",
    "tt_injection_n",
]
LAB_COLS = ["blood_sugar", "urine_sugar_yes", "vdrl_positive", "hrsag_positive"]
OBS_COLS = ["fetal_heartbeat_bpm"]

DOUBLE_COLS = {"age", "pregnancy_weeks", "blood_sugar", "fetal_heartbeat_bpm", *VITALS_COLS}
INT_COLS = {"target_risk", *HISTORY_COLS, "urine_sugar_yes", "vdrl_positive", "hrsag_positive"}


def _typed(name: str, value=None):
    c = F.lit(None) if value is None else value
    if name in DOUBLE_COLS:
        return c.cast("double").alias(name)
    if name in INT_COLS:
        return c.cast("int").alias(name)
    return c.alias(name)


def _wide(clean: DataFrame, source: str, target: str, mapping: dict[str, str]) -> DataFrame:
    """Vertical-split input: one row per clean row, every star column (absent ones NULL)."""
    all_cols = [c for c in PREGNANCY_COLS if c not in ("pregnancy_id", "source_dataset", "source_row_id")]
    all_cols += VITALS_COLS + HISTORY_COLS + LAB_COLS + OBS_COLS
    src = {"target_risk": target, **mapping}
    return clean.select(
        F.lit(source).alias("source_dataset"),
        F.lit(SOURCE_ORDER[source]).alias("_src_order"),
        F.col("row_pos"),
        *[_typed(c, F.col(src[c]) if c in src else None) for c in all_cols],
    )


DATA1_MAP = {c: c for c in specs.DATA1.features}
DATA2_MAP = {c: c for c in specs.DATA2.features if c != "bmi_calc"}
DATA2_MAP.update({"bmi": "bmi_calc", "height_m": "height_m"})


def tagged_rows(clean1: DataFrame, clean2: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """All clean rows with pregnancy_id (1..N) and 0-based source_row_id, co-partitioned by id."""
    wide = _wide(clean1, "Data1", "risk", DATA1_MAP).unionByName(_wide(clean2, "Data2", "high_risk", DATA2_MAP))
    numbered = dense_ids(wide, [F.col("_src_order"), F.col("row_pos")], out="pregnancy_id", num_partitions=num_partitions)
    # per-source offsets (two rows), read once: as a join, every table of the star would count them again
    firsts = numbered.groupBy("source_dataset").agg(F.min("pregnancy_id").alias("first")).collect()
    first = F.lit(None).cast("long")
    for r in firsts:
        first = F.when(F.col("source_dataset") == r["source_dataset"], F.lit(r["first"])).otherwise(first)
    return numbered.withColumn("source_row_id", (F.col("pregnancy_id") - first).cast("long"))


def load_star(clean1: DataFrame, clean2: DataFrame, num_partitions: int | None = None) -> dict[str, DataFrame]:
    """S10 + S12: the five entity tables and the lineage table."""
    t = tagged_rows(clean1, clean2, num_partitions)
    pid = F.col("pregnancy_id")
    star = {
        "pregnancies": t.select(*PREGNANCY_COLS, F.current_timestamp().alias("created_at")),
        "vitals": t.select(pid.alias("vitals_id"), "pregnancy_id", *VITALS_COLS),
        "medical_history": t.select(pid.alias("history_id"), "pregnancy_id", *HISTORY_COLS),
        "lab_tests": t.select(pid.alias("lab_id"), "pregnancy_id", *LAB_COLS),
        "obstetric_observations": t.select(pid.alias("obs_id"), "pregnancy_id", *OBS_COLS),
    }
    star["data_sources"] = data_sources(t)
    star[SPLIT_SOURCE] = t
    return star


SPLIT_SOURCE = "_split_source"  # not a table: the frame the star was split from


def data_sources(tagged: DataFrame, files: dict[str, str] | None = None) -> DataFrame:
    """One lineage row per source: dataset, file, row count, load time, notes."""
    files = files or {"Data1": "data/processed/data1_clean.parquet", "Data2": "data/processed/data2_clean.parquet"}
    counts = tagged.groupBy("source_dataset").agg(F.count(F.lit(1)).cast("int").alias("loaded_row_count"))
    file_col = F.create_map(*[x for k, v in files.items() for x in (F.lit(k), F.lit(v))])
    note_col = F.create_map(*[x for k, v in specs.DATA_SOURCE_NOTES.items() for x in (F.lit(k), F.lit(v))])
    return counts.select(
        "source_dataset",
        F.element_at(file_col, F.col("source_dataset")).alias("cleaned_file"),
        "loaded_row_count",
        F.current_timestamp().alias("loaded_at"),
        F.element_at(note_col, F.col("source_dataset")).alias("notes"),
    )


def view_data1(star: dict[str, DataFrame]) -> DataFrame:
    """4-way 1:1 join, intake-1 rows (source filter pushed to the pregnancies scan)."""
    if SPLIT_SOURCE in star:
        j = star[SPLIT_SOURCE].filter(F.col("source_dataset") == "Data1")
    else:
        p = star["pregnancies"].filter(F.col("source_dataset") == "Data1")
        j = p.join(star["vitals"], "pregnancy_id").join(star["medical_history"], "pregnancy_id").join(star["lab_tests"], "pregnancy_id")
    return j.select(
        "pregnancy_id",
        "source_row_id",
        "age",
        "systolic_bp",
        "diastolic_bp",
        "blood_sugar",
        "body_temp_f",
        "bmi",
        "previous_complications",
        "preexisting_diabetes",
        "gestational_diabetes",
        "mental_health",
        "heart_rate",
        F.col("target_risk").alias("risk"),
    )


def view_data2(star: dict[str, DataFrame]) -> DataFrame:
    """5-way 1:1 join, intake-2 rows; bmi -> bmi_calc, target_risk -> high_risk."""
    if SPLIT_SOURCE in star:
        j = star[SPLIT_SOURCE].filter(F.col("source_dataset") == "Data2")
    else:
        p = star["pregnancies"].filter(F.col("source_dataset") == "Data2")
        j = (
            p.join(star["vitals"], "pregnancy_id")
            .join(star["medical_history"], "pregnancy_id")
            .join(star["lab_tests"], "pregnancy_id")
            .join(star["obstetric_observations"], "pregnancy_id")
        )
    return j.select(
        "pregnancy_id",
        "source_row_id",
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
        F.col("bmi").alias("bmi_calc"),
        F.col("target_risk").alias("high_risk"),
    )


def modelling_view(star: dict[str, DataFrame], dataset: str) -> DataFrame:
    """The dataset's modelling view."""
    return view_data1(star) if dataset == "Data1" else view_data2(star)


TABLES = ("data_sources", "pregnancies", "vitals", "medical_history", "lab_tests", "obstetric_observations")


def write_star(star: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Every table written whole to its own folder.

    ``pregnancies`` is partitioned by source so the views' source filter prunes files.
    """
    for name in TABLES:
        writer = star[name].write.mode(mode)
        if name == "pregnancies":
            writer = writer.partitionBy("source_dataset")
        writer.parquet(f"{path.rstrip('/')}/{name}")


def write_star_bucketed(star: dict[str, DataFrame], path: str, prefix: str, buckets: int) -> None:
    """Stored star for repeated view reads: every table in ``buckets`` buckets of pregnancy_id, one
    sorted file each, in the session's catalog (external tables under ``path``)."""
    for name in TABLES:
        df = star[name]
        if name != "data_sources":
            df = df.repartition(buckets, "pregnancy_id")
        w = df.write.mode("overwrite").option("path", f"{path.rstrip('/')}/{name}")
        if name != "data_sources":
            w = w.bucketBy(buckets, "pregnancy_id").sortBy("pregnancy_id")
        w.saveAsTable(f"{prefix}_{name}")


def read_star_bucketed(spark, prefix: str) -> dict[str, DataFrame]:
    """The catalog's bucketed tables: joins on pregnancy_id need no exchange."""
    return {name: spark.table(f"{prefix}_{name}") for name in TABLES}


def read_star(spark, path: str) -> dict[str, DataFrame]:
    """Stored star tables (views on these run the joins)."""
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in TABLES}


# ----------------------------------------------------------------------------- published versions
POINTER = "_published"  # append-only table: one row per published version


def publish_star(star: dict[str, DataFrame], path: str, expected: dict[str, int]) -> str:
    """Full refresh that readers never see half done.

    The tables go to a new version folder, are read back and validated (R8); only then
    a row is appended to the pointer table, which readers resolve. A load that fails,
    at whatever point, leaves the version before it in place. Returns the version.
    """
    from riskloom.operators import audit

    spark = star["pregnancies"].sparkSession
    version = f"version-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{version}"
    write_star(star, folder)
    audit.require_complete(read_star(spark, folder), expected)
    last = published(spark, path)
    row = [((last["number"] if last else 0) + 1, version)]
    spark.createDataFrame(row, "number LONG, version STRING").withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode(
        "append"
    ).parquet(f"{path.rstrip('/')}/{POINTER}")
    return version


def published(spark, path: str):
    """The newest row of the pointer table, or None."""
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{POINTER}")
    if not pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer):
        return None
    return spark.read.parquet(f"{path.rstrip('/')}/{POINTER}").orderBy(F.desc("number"), F.desc("published_at")).first()


def read_published(spark, path: str) -> dict[str, DataFrame]:
    """The star that was published last."""
    last = published(spark, path)
    if last is None:
        raise ValueError(f"{path}: no star has been published")
    return read_star(spark, f"{path.rstrip('/')}/{last['version']}")


def load_and_validate(clean1: DataFrame, clean2: DataFrame, path: str) -> dict[str, DataFrame]:
    """E2 load step: split, publish a validated version (full refresh), read it back."""
    expected = {"Data1": clean1.count(), "Data2": clean2.count()}
    publish_star(load_star(clean1, clean2), path, expected)
    return read_published(clean1.sparkSession, path)
