"""Logistic model cards used to check the scoring operators against SQL.

A card is what a trained logistic model leaves behind (features, weights,
intercept, selected threshold). The training job produces MLlib models for the
same scoring path (``SparkModel``); these fixed cards keep the routing,
combination and flattening logic checkable by an independent SQL oracle.
Thresholds and dual weights follow the reference's selected values
(0.10 for Data1, 0.15 for Data2, weights 0.5/0.5, combined threshold 0.125).
"""

from __future__ import annotations

from riskloom import specs
from riskloom.operators.score import DualMetadata, LinearModel

DATA1_CARD = LinearModel(
    dataset="Data1",
    model_name="LogisticRegression",
    features=specs.DATA1.features,
    coefficients={
        "age": 0.02,
        "systolic_bp": 0.03,
        "diastolic_bp": 0.02,
        "blood_sugar": 0.25,
        "body_temp_f": 0.0,
        "bmi": 0.05,
        "previous_complications": 0.8,
        "preexisting_diabetes": 1.2,
        "gestational_diabetes": 0.6,
        "mental_health": 0.5,
        "heart_rate": 0.01,
    },
    intercept=-12.5,
    threshold=0.10,
)
DATA2_CARD = LinearModel(
    dataset="Data2",
    model_name="LogisticRegression",
    features=specs.DATA2.features,
    coefficients={
        "age": 0.02,
        "gravida_n": 0.3,
        "tt_injection_n": -0.8,
        "pregnancy_weeks": 0.02,
        "weight_kg": 0.01,
        "height_cm": 0.0,
        "systolic_bp": 0.02,
        "diastolic_bp": 0.02,
        "fetal_heartbeat_bpm": 0.005,
        "urine_sugar_yes": 0.5,
        "vdrl_positive": 1.0,
        "hrsag_positive": 1.2,
        "bmi_calc": 0.03,
    },
    intercept=-7.0,
    threshold=0.15,
)
DUAL = DualMetadata(weights={"Data1": 0.5, "Data2": 0.5}, combined_threshold=0.125)
