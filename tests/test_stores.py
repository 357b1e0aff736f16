"""Published stars, bucketed joins, file order, stream replay, constraint faults."""

import json

import pytest
from pyspark.sql import functions as F

from riskloom.operators import audit, star
from riskloom.plans import catalog, clean, model_cards
from riskloom.sources import ingest, lenses
from riskloom.streaming import stream
from support import SF_SMALL


@pytest.fixture(scope="module")
def intakes(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("clean")
    catalog.clean_a_df(spark, SF_SMALL).write.parquet(f"{top}/a")
    catalog.clean_b_df(spark, SF_SMALL).write.parquet(f"{top}/b")
    return spark.read.parquet(f"{top}/a"), spark.read.parquet(f"{top}/b")


def test_failing_load_leaves_the_published_star(spark, intakes, tmp_path):
    path = str(tmp_path / "star")
    with pytest.raises(ValueError, match="no star"):
        star.read_published(spark, path)
    star.load_and_validate(*intakes, path)
    first = star.published(spark, path)["version"]
    before = star.read_published(spark, path)["pregnancies"].count()
    loaded = star.load_star(*intakes)
    with pytest.raises(ValueError, match="not complete"):  # a count that does not come out
        star.publish_star(loaded, path, {"Data1": 1, "Data2": 2})
    loaded["vitals"] = loaded["vitals"].withColumn("bmi", F.raise_error(F.lit("disk on fire")).cast("double"))
    with pytest.raises(Exception, match="disk on fire"):  # a write that dies half way
        star.publish_star(loaded, path, {"Data1": 1, "Data2": 2})
    assert star.published(spark, path)["version"] == first
    assert star.read_published(spark, path)["pregnancies"].count() == before
    star.load_and_validate(*intakes, path)
    last = star.published(spark, path)
    assert last["version"] != first and last["number"] == 2


def test_bucketed_views_join_without_exchange(spark, intakes, tmp_path):
    star.write_star_bucketed(star.load_star(*intakes), str(tmp_path / "star"), "bucketed_test", 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        tables = star.read_star_bucketed(spark, "bucketed_test")
        for view in (star.view_data1(tables), star.view_data2(tables)):
            plan = view._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            assert view.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_view_drops_a_pregnancy_without_satellite(spark, intakes, tmp_path):
    star.write_star(star.load_star(*intakes), str(tmp_path / "star"))
    tables = star.read_star(spark, str(tmp_path / "star"))
    whole = star.view_data1(tables).count()
    tables["lab_tests"] = tables["lab_tests"].filter("pregnancy_id <> 1")
    assert star.view_data1(tables).count() == whole - 1


def test_rows_keep_file_order_over_files_and_blocks(spark, tmp_path):
    rows, n = [], 0
    for name, size in (("a.csv", 3), ("b.csv", 5000), ("c.csv", 1), ("d.csv", 700)):
        lines = [f"{n + i},x{n + i}" for i in range(size)]
        (tmp_path / name).write_text("id,text\n" + "\n".join(lines) + "\n")
        rows += range(n, n + size)
        n += size
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many blocks a file
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = ingest.read_raw_csv(spark, str(tmp_path)).orderBy("row_pos").collect()
        sheet = ingest.read_headerless(spark, str(tmp_path), 2).orderBy("row_pos").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert [(r["row_pos"], int(r["id"])) for r in got] == list(enumerate(rows))
    assert [r["row_pos"] for r in sheet] == list(range(len(rows) + 4)) and sheet[0]["c0"] == "id" and sheet[1]["c0"] == "0"


def test_replayed_batches_leave_the_same_rows(spark, tmp_path):
    paths = stream.StreamPaths(str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    lenses.requests(spark, SF_SMALL).limit(300).repartition(5).write.json(paths.source)
    (tmp_path / "in" / "bad.json").write_text('{"request_id": 5, "age": \nnot json at all\n')
    cards = model_cards.DATA1_CARD, model_cards.DATA2_CARD, model_cards.DUAL
    sinks = stream.run_scoring_streams(spark, paths, *cards, max_files_per_trigger=2)
    read = lambda: {n: sorted(map(str, stream.read_sink(spark, p).drop("created_at").collect())) for n, p in sinks.items()}
    first = read()
    assert len(first["scored"]) == 302 and len(first["predictions"]) + len(first["quarantine"]) == 302
    bad = stream.read_sink(spark, sinks["quarantine"]).filter("request_id IS NULL").collect()
    assert sorted(r["input_json"] for r in bad) == ['not json at all', '{"request_id": 5, "age": ']
    assert {r["reason"] for r in bad} == {stream.MALFORMED}
    # a batch that is run again, as after a crash before its commit
    log = sorted((tmp_path / "ckpt" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for name in (log[-1].name, f".{log[-1].name}.crc"):
        (tmp_path / "ckpt" / "commits" / name).unlink(missing_ok=True)
    assert stream.run_scoring_streams(spark, paths, *cards, max_files_per_trigger=2) == sinks
    assert read() == first


def test_every_constraint_is_violated_by_the_faults(spark):
    rows = catalog.QUERIES["constraint_audit"](spark, SF_SMALL).collect()
    checks = [r for r in rows if not r["check_name"].endswith("_not_null") and "unique(" not in r["check_name"] and "->" not in r["check_name"]]
    assert len(checks) == 35
    assert sum(r["violations"] > 0 for r in checks) >= 28
    assert sum(r["violations"] > 0 for r in rows if "->" in r["check_name"]) >= 5
    assert audit.star_checks().keys() | audit.model_checks().keys() == {r["table_name"] for r in checks}


def test_clean_from_files_equals_clean_from_tables(spark):
    for name, table in (("clean_a_from_csv", "clean_a"), ("clean_b_from_sheet", "clean_b")):
        a = catalog.QUERIES[name](spark, SF_SMALL).drop("row_pos")
        b = catalog.QUERIES[table](spark, SF_SMALL).drop("row_pos")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_malformed_rows_in_records(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"request_id": 1, "age": "30"}) + "\n{broken\n")
    got = ingest.read_records_json(spark, str(tmp_path), stream.request_schema(), layout="lines").collect()
    assert sorted((r["request_id"], r["_corrupt_record"]) for r in got if r["request_id"]) == [(1, None)]
    assert [r["_corrupt_record"] for r in got if not r["request_id"]] == ["{broken"]
    assert clean.DATA1_COLUMNS
