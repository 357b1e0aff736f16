"""Steps that must grow no faster than their input."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from riskloom import session, specs
from riskloom.operators import audit, score, star
from riskloom.operators.permute import Permutation
from riskloom.operators.ranking import dense_ids
from riskloom.plans import catalog, clean, train
from riskloom.sources import ingest, lenses


def plan_text(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_planning_settings_are_set_unless_the_user_did(spark):
    kept = {k: spark.conf.get(k) for k in session.PLANNING}
    try:
        spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
        spark.conf.set("spark.sql.constraintPropagation.enabled", "true")
        session.tuned(spark)
        assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
        assert spark.conf.get("spark.sql.constraintPropagation.enabled") == "true"
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_routing_runs_no_lambda_per_record(spark):
    fields = ", ".join(f"{f} string" for f in score.ALL_FIELDS)
    rows = [(1, *[" 1 "] * len(score.ALL_FIELDS)), (2, *["x"] * len(score.ALL_FIELDS)), (3, *[" \t"] * len(score.ALL_FIELDS))]
    routed = score.route(score.prepare_requests(spark.createDataFrame(rows, f"request_id long, {fields}")))
    assert "lambda" not in plan_text(routed)
    got = {r["request_id"]: r for r in routed.collect()}
    assert got[2]["errors"] == [f"invalid value in field: {f}" for f in score.ALL_FIELDS]
    assert got[3]["errors"] == [] and got[3]["missing_data1"] == list(specs.DATA1.features)


def test_spread_gives_rows_of_a_missing_key_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(lenses, "TASK_ROWS", 100)
    df = spark.range(5000).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("v"))
    out = lenses.spread(df).groupBy(F.spark_partition_id()).count().collect()
    assert len(out) > 40 and max(r["count"] for r in out) < 400


def test_late_header_is_found(spark):
    late = ingest.HEADER_ROWS + 5
    cells = spark.range(late + 3).select(F.col("id").alias("row_pos"), *[
        F.when(F.col("id") == late, F.lit(m.upper())).otherwise("1").alias(f"c{i}") for i, m in enumerate(specs.DATA2_HEADER_MARKERS)
    ])
    assert ingest.find_header(cells)[0] == late


def test_dealt_equals_the_numbers(spark):
    for n in (1, 7, 101, 1009):
        p = Permutation(n, "3:f")
        for inverse in (False, True):
            rounds = [(F.lit(f).cast("long"), F.lit(o).cast("long")) for f, o in (reversed(p.rounds()) if inverse else p.rounds())]
            rows = p.dealt(spark.range(n), "id", "to", rounds, inverse).collect()
            assert all(r["to"] == p.of_number(r["id"], inverse) for r in rows)


def test_dense_ids_land_in_columns(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("a"), F.lit("x").alias("b"))
    ids = dense_ids(df, [F.col("a")], num_partitions=5)
    assert [r["row_id"] for r in ids.orderBy("a").collect()] == list(range(1, 1001))
    assert "b:string" not in plan_text(ids.select("row_id"))


def test_frame_is_landed_once(spark):
    tf = train.TrainFrame(spark.range(10).select("id", F.col("id").alias("x"), F.lit(1).alias("y")), ["x"], "y", "id")
    assert tf.rows() is tf.rows() and tf.rows().count() == 10


def test_refused_requests_are_left_out_after_scoring(spark):
    fields = ", ".join(f"{f} string" for f in score.ALL_FIELDS)
    rows = [(1, *["1"] * len(score.ALL_FIELDS)), (2, *["x"] * len(score.ALL_FIELDS)), (3, "30", *[None] * (len(score.ALL_FIELDS) - 1))]
    requests = spark.createDataFrame(rows, f"request_id long, {fields}")
    kept = catalog.prediction_table(requests, 2)
    assert "translate(" not in plan_text(kept)  # no parser is left under the filter
    scored = score.score_records(requests, catalog.model_cards.DATA1_CARD, catalog.model_cards.DATA2_CARD, catalog.model_cards.DUAL)
    accepted = {r["request_id"] for r in scored.filter(score.is_accepted()).collect()}
    assert {r["prediction_id"] for r in kept.collect()} == accepted


def test_keys_cross_the_network_once_for_both_audits(spark, tmp_path):
    def landed(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    parent = landed("p", [(1,), (1,), (2,), (None,)], "id long")
    child = landed("c", [(1,), (1,), (3,), (3,), (3,), (None,)], "fk long")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = audit.full_audit(
            {"p": parent, "c": child}, {"p": {"positive": F.col("id") > 1}}, {"c": ["fk"]}, {"p": [["id"]], "c": [["fk"]]}, [("c", "fk", "p", "id")]
        )
        assert plan_text(report).count("ReusedExchange") == 2
        found = {(r["table_name"], r["check_name"]): r["violations"] for r in report.collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert found == {("p", "positive"): 2, ("c", "fk_not_null"): 1, ("p", "unique(id)"): 1, ("c", "unique(fk)"): 3, ("c", "c.fk->p.id"): 3}


def test_nan_is_no_duplicate_key(spark):
    df = spark.sql("SELECT * FROM VALUES (double('NaN')), (double('NaN')), (1D), (1D), (NULL) AS t(k)")
    assert audit.unique_audit({"t": df}, {"t": [["k"]]}).first()["violations"] == 1


def test_star_tables_do_not_count_their_sources_again(spark):
    d1 = [f"{c} double" for c in clean.DATA1_COLUMNS[:-1]]
    d2 = [f"{c} double" for c in clean.DATA2_COLUMNS[:-1]]
    clean1 = spark.createDataFrame([(n, *[1.0] * len(d1), 0) for n in (5, 3)], ", ".join(["row_pos long", *d1, "risk int"]))
    clean2 = spark.createDataFrame([(n, *[1.0] * len(d2), 1) for n in (4, 9, 2)], ", ".join(["row_pos long", *d2, "high_risk int"]))
    loaded = star.load_star(clean1, clean2)
    assert "HashAggregate" not in plan_text(loaded["pregnancies"])
    ids = [(r["pregnancy_id"], r["source_dataset"], r["source_row_id"]) for r in loaded["pregnancies"].orderBy("pregnancy_id").collect()]
    assert ids == [(1, "Data1", 0), (2, "Data1", 1), (3, "Data2", 0), (4, "Data2", 1), (5, "Data2", 2)]
    nothing = star.load_star(clean1.filter("false"), clean2.filter("false"))
    assert nothing["pregnancies"].count() == 0
