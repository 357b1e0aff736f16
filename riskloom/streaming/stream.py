"""Structured Streaming scoring.

Request files (JSON lines) are read as a stream with a fixed schema and go
through the same column functions as batch scoring. One query serves three
sinks: each micro-batch is scored once and written, then its accepted and its
refused rows are read back from that file and written in turn:

* ``scored``      - every request with its routing and scores (T1),
* ``predictions`` - accepted requests in the predictions-table layout (T2),
* ``quarantine``  - rejected, incomplete and malformed requests with reasons (T3).

Every write replaces the folder ``batch_id=<n>`` of its sink. A batch that is run
again after a failure has the same id and the same files, so that it leaves the
same rows: each sink holds every request exactly once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import score as score_ops

CORRUPT = "_corrupt_record"
MALFORMED = "malformed record"
SINKS = ("scored", "predictions", "quarantine")


def request_schema(fields=score_ops.ALL_FIELDS) -> T.StructType:
    return T.StructType([T.StructField("request_id", T.LongType())] + [T.StructField(f, T.StringType()) for f in fields])


def write_request_files(requests: DataFrame, path: str) -> None:
    """Land request records as JSON-lines files (the stream's source folder)."""
    requests.write.mode("overwrite").json(path)


@dataclass
class StreamPaths:
    source: str
    output: str
    checkpoint: str

    def sink(self, name: str) -> str:
        return f"{self.output.rstrip('/')}/{name}"


def request_stream(spark: SparkSession, paths: StreamPaths, max_files_per_trigger: int | None = None) -> DataFrame:
    """The source folder as a stream; a line that is no JSON object keeps its text in ``_corrupt_record``."""
    reader = spark.readStream.schema(T.StructType([*request_schema().fields, T.StructField(CORRUPT, T.StringType())]))
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(paths.source)


def scored_rows(requests: DataFrame, model1, model2, dual) -> DataFrame:
    """Requests scored; malformed ones rejected with their text as input."""
    fields = [c for c in requests.columns if c not in ("request_id", CORRUPT)]
    src = requests.withColumn("input_json", F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*fields))))
    flat = score_ops.score_records(src, model1, model2, dual, mode="auto", keep=("request_id", "input_json", CORRUPT))
    bad = F.col(CORRUPT).isNotNull()
    instead = {"prediction_mode": F.lit("rejected"), "reason": F.lit(MALFORMED), "errors": F.array(F.lit(MALFORMED))}
    instead |= {c: F.lit(None) for c in ("missing_data1", "missing_data2", "nearest_group")}
    return flat.withColumns({c: F.when(bad, value).otherwise(F.col(c)) for c, value in instead.items()}).drop(CORRUPT)


def prediction_rows(flat: DataFrame, model_run_id=None) -> DataFrame:
    """Predictions-table layout for accepted requests."""
    p, _, cls = score_ops.main_block()
    return flat.filter(score_ops.is_accepted()).select(
        F.col("request_id").alias("prediction_id"),
        F.current_timestamp().alias("created_at"),
        F.lit(model_run_id).cast("long").alias("model_run_id"),
        score_ops.main_model_name().alias("model_name"),
        "input_json",
        p.alias("predicted_probability"),
        cls.alias("predicted_class"),
        score_ops.risk_label(cls).alias("risk_label"),
    )


def quarantine_rows(flat: DataFrame) -> DataFrame:
    """Refused requests with their reasons, the nearest group and their text."""
    return flat.filter(~score_ops.is_accepted()).select(
        "request_id", "prediction_mode", "reason", "errors", "missing_data1", "missing_data2", "nearest_group", "input_json"
    )


def write_batch(requests: DataFrame, batch_id: int, paths: StreamPaths, model1, model2, dual, model_run_id=None) -> None:
    """Score one micro-batch once and replace its folder in each sink."""
    own = {name: f"{paths.sink(name)}/batch_id={batch_id}" for name in SINKS}
    scored = scored_rows(requests, model1, model2, dual)
    scored.write.mode("overwrite").parquet(own["scored"])
    flat = requests.sparkSession.read.schema(scored.schema).parquet(own["scored"])
    prediction_rows(flat, model_run_id).write.mode("overwrite").parquet(own["predictions"])
    quarantine_rows(flat).write.mode("overwrite").parquet(own["quarantine"])


def run_scoring_streams(spark: SparkSession, paths: StreamPaths, model1, model2, dual, model_run_id=None, max_files_per_trigger: int | None = None) -> dict:
    """Drain the source folder with ``trigger(availableNow=True)``; returns the sinks' paths."""
    query = (
        request_stream(spark, paths, max_files_per_trigger)
        .writeStream.foreachBatch(lambda df, n: write_batch(df, n, paths, model1, model2, dual, model_run_id))
        .option("checkpointLocation", paths.checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return {name: paths.sink(name) for name in SINKS}


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a sink."""
    return spark.read.parquet(path).drop("batch_id")
