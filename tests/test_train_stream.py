"""Model training (rows-only) and streaming checks."""

import pytest
from pyspark.sql import functions as F

from support import SF_SMALL
from riskloom.plans import catalog
from riskloom.plans import train as T


def test_gbt_separates_learnable_lens(spark):
    tf = catalog.lens_c(spark, SF_SMALL)
    tr, te = T.split_frame(tf)
    model = T.fit(tf, tr, "HistGradientBoosting", {**T.DEFAULTS["HistGradientBoosting"], "max_iter": 10})
    r = T.metric_table(T.predict(model, te, tf.tag), tf.label).first()
    assert r["roc_auc"] > 0.9


def test_holdout_recheck_equals_direct_evaluation(spark, tmp_path):
    tf = catalog.lens_c(spark, SF_SMALL)
    tr, te = T.split_frame(tf)
    model = T.fit(tf, tr, "LogisticRegression", T.DEFAULTS["LogisticRegression"])
    direct = T.metric_table(T.predict(model, te, tf.tag), tf.label).first()
    path = str(tmp_path / "m")
    T.save_model(model, path)
    again = T.holdout_recheck(path, tf, te.select(tf.id_col), threshold=0.5).first()
    for k in ("tn", "fp", "fn", "tp"):
        assert direct[k] == again[k]
    assert direct["roc_auc"] == pytest.approx(again["roc_auc"])


def test_grid_order_and_rank(spark):
    cands = T.grid_candidates(T.FULL_GRIDS["LogisticRegression"])
    assert cands[0] == {"C": 0.1, "class_weight": None} and cands[1] == {"C": 0.1, "class_weight": "balanced"} and len(cands) == 6
    boosted = T.grid_candidates(T.FULL_GRIDS["HistGradientBoosting"])
    assert len(boosted) == 48 and sum(map(T.supported, boosted)) == 24
    assert len(T.grid_candidates(T.FULL_GRIDS["RandomForest"])) == 24


def test_boosting_stops_early_above_the_row_limit(spark, monkeypatch):
    noise = spark.range(3000).select(
        F.col("id"), F.rand(1).alias("a"), F.rand(2).alias("b"), (F.rand(3) < 0.5).cast("int").alias("y")
    ).checkpoint()
    tf = T.TrainFrame(noise, ["a", "b"], "y", "id")
    params = {"learning_rate": 0.1, "max_iter": 12, "max_leaf_nodes": 15, "min_samples_leaf": 10}
    assert T.rounds_used(T.fit(tf, tf.select(), "HistGradientBoosting", params)) == 12
    monkeypatch.setattr(T, "EARLY_STOPPING_ROWS", 2999)
    stopped = T.fit(tf, tf.select(), "HistGradientBoosting", params)
    assert T.rounds_used(stopped) < 12
    assert T.predict(stopped, tf.select(), tf.tag).columns == ["id", "a", "b", "y", "p"]


@pytest.mark.parametrize("family", ["RandomForest", "HistGradientBoosting"])
def test_tree_fits_deal_rows_over_tasks(spark, monkeypatch, family):
    rows = spark.range(1200).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, F.lit(7)).alias("id"), F.rand(1).alias("a"), F.rand(2).alias("b")
    ).withColumn("y", (F.col("a") + F.col("b") > 1).cast("int")).checkpoint()  # a third of the ids null, a third equal
    small = {"RandomForest": {"n_estimators": 5}, "HistGradientBoosting": {"max_iter": 2}}[family]
    kind = {"RandomForest": T.RandomForestClassifier, "HistGradientBoosting": T.GBTClassifier}[family]
    parts, plain = [], kind.fit

    def seen(est, data, *more):
        parts.append(data.rdd.glom().map(len).collect())
        return plain(est, data, *more)

    monkeypatch.setattr(kind, "fit", seen)

    def trees(df):
        tf = T.TrainFrame(df, ["a", "b"], "y", "id")
        return T.fit(tf, df, family, {**T.DEFAULTS[family], **small}).stages[-1].toDebugString.split("\n", 1)[1]

    in_one = rows.coalesce(1)
    trees(in_one)
    monkeypatch.setattr(T, "TREE_TASK_ROWS", (100_000, 200))
    assert trees(in_one) == trees(rows.orderBy(F.rand(3)).coalesce(1))  # whatever the order in which they come
    trees(rows.repartition(9))
    assert [len(p) for p in parts] == [1, 6, 6, 9] and {sum(p) for p in parts} == {1200}
    assert max(parts[1]) < 300


def test_holdout_rows_are_scored_once(spark, monkeypatch):
    rows = spark.range(900).select(F.when(F.col("id") > 300, F.col("id")).alias("id"), F.rand(1).alias("a"))
    tf = T.TrainFrame(rows.withColumn("y", (F.col("a") + F.rand(4) > 1).cast("int")).checkpoint(), ["a"], "y", "id")
    model = T.fit(tf, tf.select(), "RandomForest", {"n_estimators": 4, "max_depth": 3})
    monkeypatch.setattr(T, "TREE_TASK_ROWS", (100_000, 200))
    once, direct = T.scored_once(model, tf, tf.select().coalesce(1)), T.predict(model, tf.select(), tf.tag)
    assert "UDF" not in once._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(once.collect()) == sorted(direct.select("y", "p").collect())
    assert T.metric_table(once, "y").collect() == T.metric_table(direct, "y").collect()


def test_large_forests_are_grown_in_blocks_of_trees(spark, monkeypatch, tmp_path):
    rows = spark.range(600).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"))
    tf = T.TrainFrame(rows.withColumn("y", (F.col("a") + F.col("b") > 1).cast("int")).checkpoint(), ["a", "b"], "y", "id")
    seen, plain = [], T.RandomForestClassifier.fit

    def fit(est, data, *more):
        seen.append((est.getNumTrees(), est.getCacheNodeIds(), est.getSeed()))
        return plain(est, data, *more)

    monkeypatch.setattr(T.RandomForestClassifier, "fit", fit)

    def trees(block):
        monkeypatch.setattr(T, "FOREST_BLOCK", block)
        return T.fit(tf, tf.select(), "RandomForest", {"n_estimators": 5})

    assert T.rounds_used(trees((3000, 1))) == 5 and [s[:2] for s in seen] == [(5, True)]
    model = trees((1200, 1))
    forest = model.stages[-1]
    assert [s[:2] for s in seen[1:]] == [(2, True), (2, True), (1, True)] and len({s[2] for s in seen[1:]}) == 3
    assert forest.getNumTrees == 5 and len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) == 5
    T.save_model(model, str(tmp_path / "forest"))
    scores = [sorted(T.predict(m, tf.select(), tf.tag).select("id", "p").collect()) for m in (model, T.load_model(str(tmp_path / "forest")))]
    assert scores[0] == scores[1] and len(scores[0]) == 600
    assert T.rounds_used(trees((1, 3))) == 5 and [s[0] for s in seen[4:]] == [3, 2]


def test_candidates_without_a_counterpart_are_reported_not_fitted(spark):
    rows = spark.range(400).select("id", F.rand(5).alias("a")).withColumn("y", (F.col("a") > 0.6).cast("int"))
    tf = T.TrainFrame(rows.checkpoint(), ["a"], "y", "id")
    grid = T.grid_candidates({"max_iter": [2], "max_leaf_nodes": [4], "min_samples_leaf": [5], "l2_regularization": [0.0, 0.1]})
    with pytest.raises(ValueError):
        T.fit(tf, tf.select(), "HistGradientBoosting", grid[1])
    got = {r.candidate: r for r in T.cv_metrics(tf, T.with_folds(tf, tf.select(), k=2), "HistGradientBoosting", grid, k=2).collect()}
    assert got[0].supported and got[0].is_best and got[0].mean_test_recall > 0.9
    assert not got[1].supported and not got[1].is_best and got[1].mean_test_recall is None and got[1].rank_test_recall is None


def test_comparison_asks_for_every_family_and_its_whole_grid(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(catalog, "lens_c", lambda *_: None)
    monkeypatch.setattr(T, "comparison_rows", lambda tf, families: asked.update(families) or spark.range(1))
    catalog.QUERIES["model_comparison"](spark, SF_SMALL)
    assert list(asked) == list(T.FAMILIES) and asked == {"MajorityBaseline": None, **T.FULL_GRIDS}
    assert [len(T.grid_candidates(asked[f])) for f in T.FAMILIES[1:]] == [6, 48, 24]


def test_importance_has_every_feature(spark):
    df = catalog.QUERIES["importance"](spark, SF_SMALL)
    rows = df.collect()
    assert len(rows) == 11 and all(r["importance_std"] >= 0 for r in rows)


def test_stream_equals_batch(spark):
    s = catalog.QUERIES["stream_scores"](spark, SF_SMALL)
    b = catalog.QUERIES["combined_score"](spark, SF_SMALL)
    cols = ["request_id", "prediction_mode", "data1_probability", "data2_probability", "combined_probability"]
    assert s.select(*cols).exceptAll(b.select(*cols)).count() == 0
    assert b.select(*cols).exceptAll(s.select(*cols)).count() == 0


def test_run_clean_and_load(spark, tmp_path):
    from riskloom.operators import star as star_ops
    from riskloom.plans import clean
    from riskloom.sources import lenses

    raw1 = catalog.raw_a(spark, SF_SMALL)
    cells2 = lenses.intake_b(spark, SF_SMALL)
    log = clean.run_clean(raw1, cells2, str(tmp_path / "clean"))
    assert log["data1"]["final_rows"] > 0 and log["data2"]["final_rows"] > 0
    c1 = spark.read.parquet(str(tmp_path / "clean" / "data1_clean"))
    c2 = spark.read.parquet(str(tmp_path / "clean" / "data2_clean"))
    stored = star_ops.load_and_validate(c1, c2, str(tmp_path / "star"))
    assert star_ops.view_data1(stored).count() == log["data1"]["final_rows"]
    assert star_ops.view_data2(stored).count() == log["data2"]["final_rows"]
