"""Golden micro-fixtures: values published by the reference's own reports."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics, split
from riskloom.operators.score import DualMetadata, LinearModel, score_records

# threshold, precision, recall, f1 of the reference's train_oof threshold tables (17 rows each)
FINAL_MODEL_OOF = [
    (0.1, 0.924956369982548, 0.9962406015037594, 0.9592760180995475),
    (0.15, 0.9363957597173145, 0.9962406015037594, 0.9653916211293261),
    (0.2, 0.9496402877697842, 0.9924812030075187, 0.9705882352941176),
    (0.25, 0.9547920433996383, 0.9924812030075187, 0.9732718894009217),
    (0.3, 0.9581818181818181, 0.9906015037593985, 0.9741219963031423),
    (0.35, 0.9686924493554327, 0.9887218045112782, 0.9786046511627907),
    (0.4, 0.9722735674676525, 0.9887218045112782, 0.9804287045666356),
    (0.45, 0.974025974025974, 0.9868421052631579, 0.9803921568627451),
    (0.5, 0.9757914338919925, 0.9849624060150376, 0.980355472404116),
    (0.55, 0.981203007518797, 0.981203007518797, 0.981203007518797),
    (0.6, 0.9829867674858223, 0.9774436090225563, 0.9802073515551367),
    (0.65, 0.9847908745247148, 0.9736842105263158, 0.9792060491493384),
    (0.7, 0.988527724665392, 0.9718045112781954, 0.9800947867298578),
    (0.75, 0.9885057471264368, 0.9699248120300752, 0.9791271347248577),
    (0.8, 0.9903474903474904, 0.9642857142857143, 0.9771428571428571),
    (0.85, 0.9921568627450981, 0.9511278195488722, 0.9712092130518234),
    (0.9, 0.9939516129032258, 0.9266917293233082, 0.9591439688715954),
]
DATA1_MODEL_OOF = [
    (0.1, 0.9715762273901809, 0.9947089947089947, 0.9830065359477124),
    (0.15, 0.9765625, 0.9920634920634921, 0.984251968503937),
    (0.2, 0.9765625, 0.9920634920634921, 0.984251968503937),
    (0.25, 0.9765013054830287, 0.9894179894179894, 0.9829172141918529),
    (0.3, 0.9765013054830287, 0.9894179894179894, 0.9829172141918529),
    (0.35, 0.9765013054830287, 0.9894179894179894, 0.9829172141918529),
    (0.4, 0.9765013054830287, 0.9894179894179894, 0.9829172141918529),
    (0.45, 0.9790575916230366, 0.9894179894179894, 0.9842105263157894),
    (0.5, 0.9790575916230366, 0.9894179894179894, 0.9842105263157894),
    (0.55, 0.9790575916230366, 0.9894179894179894, 0.9842105263157894),
    (0.6, 0.9790575916230366, 0.9894179894179894, 0.9842105263157894),
    (0.65, 0.9815789473684211, 0.9867724867724867, 0.9841688654353562),
    (0.7, 0.9815789473684211, 0.9867724867724867, 0.9841688654353562),
    (0.75, 0.9814814814814815, 0.9814814814814815, 0.9814814814814815),
    (0.8, 0.9813333333333333, 0.9735449735449735, 0.9774236387782205),
    (0.85, 0.9812332439678284, 0.9682539682539683, 0.9747003994673769),
    (0.9, 0.9838709677419355, 0.9682539682539683, 0.976),
]


@pytest.mark.parametrize("rows,expected", [(FINAL_MODEL_OOF, 0.15), (DATA1_MODEL_OOF, 0.10)])
def test_select_threshold_golden(spark, rows, expected):
    sweep = spark.createDataFrame(rows, "threshold DOUBLE, precision DOUBLE, recall DOUBLE, f1 DOUBLE")
    assert metrics.select_threshold(sweep).first()["threshold"] == pytest.approx(expected)


# dataset, model, variant, cv_precision_mean, cv_recall_mean, cv_f1_mean, cv_roc_auc_mean (reference comparison table)
COMPARISON = [
    ("Data1", "MajorityBaseline", "default", 0.0, 0.0, 0.0, 0.5),
    ("Data1", "LogisticRegression", "default", 0.9573367530209635, 0.9471228070175439, 0.9520935296856049, 0.9926342884237622),
    ("Data1", "LogisticRegression", "tuned", 0.9518914034775607, 0.9708421052631578, 0.9608285917496444, 0.9927291200975411),
    ("Data1", "HistGradientBoosting", "default", 0.9869996578857337, 0.9814385964912281, 0.9840841710049718, 0.9992877463930097),
    ("Data1", "HistGradientBoosting", "tuned", 0.9795692640692641, 0.98940350877193, 0.9843426661206169, 0.9987182483235115),
    ("Data1", "RandomForest", "default", 0.9789013385855491, 0.9788070175438597, 0.9787867050945408, 0.9987183499288761),
    ("Data1", "RandomForest", "tuned", 0.9693606237816764, 0.9841403508771929, 0.9765306937990778, 0.997981575560523),
    ("Data2", "MajorityBaseline", "default", 0.6674999999999999, 1.0, 0.8005992509363296, 0.5),
    ("Data2", "LogisticRegression", "default", 0.8501376813022878, 0.8702697936871804, 0.8598590270289013, 0.8627642124945518),
    ("Data2", "LogisticRegression", "tuned", 0.8425159753051116, 0.8928760359724917, 0.8667705647900554, 0.8604655263621936),
    ("Data2", "HistGradientBoosting", "default", 0.9814727864727864, 0.9831246693704815, 0.9822093270502551, 0.995176718358547),
    ("Data2", "HistGradientBoosting", "tuned", 0.9760871394280342, 0.9849409275260095, 0.9803654002313982, 0.9940321995721364),
    ("Data2", "RandomForest", "default", 0.9538062524210403, 0.96803032974784, 0.9607361117517806, 0.9886103745304645),
    ("Data2", "RandomForest", "tuned", 0.953943230043282, 0.9698994886263446, 0.961728945510387, 0.9878108749247246),
]


def test_model_selection_golden(spark):
    comp = spark.createDataFrame(
        COMPARISON, "dataset STRING, model STRING, variant STRING, cv_precision_mean DOUBLE, cv_recall_mean DOUBLE, cv_f1_mean DOUBLE, cv_roc_auc_mean DOUBLE"
    )
    final = metrics.select_best(comp.filter("dataset = 'Data2'"), precision_floor=0.70).first()
    assert (final["model"], final["variant"]) == ("HistGradientBoosting", "tuned")
    per_ds = {r["dataset"]: (r["model"], r["variant"]) for r in metrics.select_best(comp).collect()}
    assert per_ds == {"Data1": ("HistGradientBoosting", "tuned"), "Data2": ("HistGradientBoosting", "tuned")}


def test_confusion_rates_golden(spark):
    # tn 62, fp 5, fn 1, tp 132 at threshold 0.15
    rows = [(0, 0.0)] * 62 + [(0, 0.9)] * 5 + [(1, 0.0)] * 1 + [(1, 0.9)] * 132
    df = spark.createDataFrame(rows, "y INT, p DOUBLE")
    r = metrics.confusion(df, "y", "p", 0.15).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (62, 5, 1, 132)
    assert r["accuracy"] == pytest.approx(0.97)
    assert r["precision"] == pytest.approx(0.9635036496350365)
    assert r["recall"] == pytest.approx(0.9924812030075187)
    assert r["f1"] == pytest.approx(0.9777777777777777)


def test_combined_score_golden(spark):
    # fixed-probability models reproduce the reference's sample combined prediction
    import math

    p1, p2 = 0.9999947638591437, 0.9457717933633584
    m1 = LinearModel("Data1", "HistGradientBoosting", ("age",), {"age": 0.0}, intercept=math.log(p1 / (1 - p1)), threshold=0.10)
    m2 = LinearModel("Data2", "HistGradientBoosting", ("age",), {"age": 0.0}, intercept=math.log(p2 / (1 - p2)), threshold=0.15)
    fields = {
        "age": "30", "systolic_bp": "140", "diastolic_bp": "90", "blood_sugar": "8.0", "body_temp_f": "98.6", "bmi": "32.0",
        "previous_complications": "1", "preexisting_diabetes": "0", "gestational_diabetes": "1", "mental_health": "0", "heart_rate": "95",
        "gravida_n": "2", "tt_injection_n": "2", "pregnancy_weeks": "34", "weight_kg": "82", "height_cm": "160", "fetal_heartbeat_bpm": "145",
        "urine_sugar_yes": "1", "vdrl_positive": "0", "hrsag_positive": "0", "bmi_calc": "32.03125",
    }
    req = spark.createDataFrame([{"request_id": 1, **fields}])
    out = score_records(req, m1, m2, DualMetadata(combined_threshold=0.125)).first()
    assert out["prediction_mode"] == "combined"
    assert out["data1_probability"] == pytest.approx(p1, abs=1e-12) and out["data2_probability"] == pytest.approx(p2, abs=1e-12)
    assert out["combined_probability"] == pytest.approx(0.972883278611251, abs=1e-12)
    assert out["combined_threshold"] == pytest.approx(0.125) and out["combined_predicted_class"] == 1


def test_test_allocation_matches_reference_counts(spark):
    # 1169 rows (696 / 473) -> 234 test rows: 139 / 95; 997 rows (332 / 665) -> 200: 67 / 133
    for counts, expected in [({0: 696, 1: 473}, {0: 139, 1: 95}), ({0: 332, 1: 665}, {0: 67, 1: 133})]:
        df = spark.createDataFrame(list(counts.items()), "y INT, n_class LONG")
        got = {r["y"]: r["n_test"] for r in split.test_allocation(df, "y").collect()}
        assert got == expected


def test_majority_out_of_fold_and_threshold_report(spark):
    """The constant of a fold comes from the other folds; ties predict class 0; the chosen threshold is marked in both splits."""
    from riskloom.operators import metrics

    rows = [(f, y) for f, ys in enumerate(([1, 1, 1, 1], [0, 0, 0], [1, 0, None])) for y in ys]
    df = spark.createDataFrame(rows, "fold int, y int")
    got = {r.fold: r.p for r in metrics.majority_scores(df, "y").select("fold", "p").distinct().collect()}
    for fold in range(3):
        others = [y for f, y in rows if f != fold]
        assert got[fold] == float(2 * others.count(1) > len(others))
    scored = spark.createDataFrame(
        [(s, int(p > 0.3), p) for s, shift in (("train_oof", 0.0), ("holdout_test", 0.02)) for p in (0.05 + shift, 0.2 + shift, 0.35 + shift, 0.8)],
        "split string, y int, p double",
    )
    report = metrics.threshold_report(scored, "y", "p").collect()
    assert len(report) == 34 and len({r.selected_threshold for r in report}) == 1
    assert sorted(r.split for r in report if r.is_selected) == ["holdout_test", "train_oof"]
    best = next(r for r in report if r.is_selected and r.split == "train_oof")
    assert (best.recall, best.precision) == (1.0, 1.0) and best.threshold == max(
        r.threshold for r in report if r.split == "train_oof" and r.recall == 1.0 and r.precision == 1.0
    )


def test_deployed_model_has_no_precision_floor(spark):
    from riskloom.plans import train

    rows = [("D", "a", "tuned", 0.75, 0.6, 0.6, 0.6), ("D", "b", "tuned", 0.5, 0.9, 0.6, 0.6), ("D", "MajorityBaseline", "tuned", 0.9, 1.0, 1.0, 1.0)]
    table = spark.createDataFrame(
        rows, "dataset string, model string, variant string, cv_precision_mean double, cv_recall_mean double, cv_f1_mean double, cv_roc_auc_mean double"
    )
    assert train.select_final(table, "D")["model"] == "a" and train.select_deployed(table, "D")["model"] == "b"
    assert train.select_deployed(table, "E") == {}
