"""Record scoring (C1-C10) with request cleaning/validation.

All per-record logic is column expressions over a frame of requests: payload
cleaning gives typed fields plus an error array, validation appends rule
errors, feature-group completeness gives two ``missing_*`` arrays, routing is
a CASE, and each model is applied once to all rows. Bad records are not
raised one by one: they get ``prediction_mode = 'rejected'``/``'incomplete'``
with reasons (the quarantine), and ``on_invalid='raise'`` restores the
reference's fail-the-batch behaviour with one count.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import specs
from riskloom.functions import parse

ALL_FIELDS = list(dict.fromkeys([*specs.DATA1.features, *specs.DATA2.features]))


# ----------------------------------------------------------------------------- models
@dataclass(frozen=True)
class LinearModel:
    """A logistic model card: p = 1 / (1 + exp(-(intercept + sum(w * x)))), class = p >= threshold."""

    dataset: str
    model_name: str
    features: tuple[str, ...]
    coefficients: dict[str, float]
    intercept: float
    threshold: float
    limitations: tuple[str, ...] = field(default_factory=tuple)

    def probability(self) -> Column:
        z = F.lit(float(self.intercept))
        for f in self.features:
            z = z + F.col(f).cast("double") * F.lit(float(self.coefficients.get(f, 0.0)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def score(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, self.probability())


@dataclass(frozen=True)
class SparkModel:
    """A fitted MLlib ``PipelineModel`` whose stages read ``features`` and write ``probability_col``."""

    dataset: str
    model_name: str
    features: tuple[str, ...]
    pipeline_model: object
    threshold: float
    probability_col: str = "probability"
    limitations: tuple[str, ...] = field(default_factory=tuple)

    def score(self, df: DataFrame, out: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        before = set(df.columns)
        scored = self.pipeline_model.transform(df)
        scored = scored.withColumn(out, vector_to_array(F.col(self.probability_col))[1])
        return scored.drop(*[c for c in scored.columns if c not in before and c != out])


@dataclass(frozen=True)
class DualMetadata:
    weights: dict = field(default_factory=lambda: dict(specs.FALLBACK_DUAL["weights"]))
    combined_threshold: float | None = None
    weight_rationale: str = specs.DEFAULT_WEIGHT_RATIONALE

    @classmethod
    def absent(cls) -> DualMetadata:
        """What stands for stored metadata that is not there (S15); a document without the threshold has none."""
        return cls(combined_threshold=specs.FALLBACK_DUAL["combined_threshold"])


# ----------------------------------------------------------------------------- request cleaning
def clean_payload(df: DataFrame, fields=ALL_FIELDS, keep=("request_id",)) -> DataFrame:
    """P20: known fields only; NULL/blank -> absent; numeric text -> double; other text -> error."""
    given = [f for f in fields if f in df.columns]
    texts = df.select(*keep, *[F.col(f).cast("string").alias(f"_text_{f}") for f in given])
    typed = texts.withColumns({f: parse.to_number(f"_text_{f}") if f in given else F.lit(None).cast("double") for f in fields})
    # the text is only stripped where it is no number
    errs = [(F.col(f).isNull() & F.col(f"_text_{f}").isNotNull() & (parse.strip(f"_text_{f}") != ""), f"invalid value in field: {f}") for f in given]
    return typed.select(*keep, *fields, texts_where(errs).alias("payload_errors"))


def texts_where(cases: list[tuple[Column, str]]) -> Column:
    """The texts whose condition holds, in order; in generated code, which a lambda filter over them is not."""
    none = F.array().cast("array<string>")
    return F.concat(none, *[F.when(condition, F.array(F.lit(text))).otherwise(none) for condition, text in cases])


def bad_values(requests: DataFrame, fields=ALL_FIELDS, id_col: str = "request_id", shown: int = 3) -> DataFrame:
    """Per field with text that is no number: how many records, and the first ``shown`` values by id."""
    items = []
    for f in [f for f in fields if f in requests.columns]:
        text = parse.strip(F.col(f).cast("string"))
        item = F.struct(F.lit(f).alias("field"), F.col(id_col).alias("id"), F.col(f).cast("string").alias("value"))
        items.append(F.when(F.col(f).isNotNull() & (text != "") & parse.to_number(text).isNull(), item))
    rows = requests.select(F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x")).select("x.*")
    counts = rows.groupBy("field").agg(F.count(F.lit(1)).alias("n_bad"))
    # the limit on the rank reaches the tasks before the exchange
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("field").orderBy("id", "value"))).filter(F.col("_r") <= shown)
    texts = first.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("_r", "value"))).alias("v"))
    return counts.join(texts, "field").select("field", "n_bad", F.array_join(F.transform("v", lambda x: x["value"]), "; ").alias("first_values"))


def derive_bmi(df: DataFrame) -> DataFrame:
    """bmi = round_half_even(w / (h/100)^2, 2) when w and h are non-zero and h > 0; fills bmi, bmi_calc only if absent."""
    w, h = F.col("weight_kg"), F.col("height_cm")
    hm = h / F.lit(100.0)
    bmi = F.when(w.isNotNull() & (w != 0) & h.isNotNull() & (h > 0), F.bround(w / (hm * hm), 2))
    return df.withColumns({"bmi": F.coalesce(F.col("bmi"), bmi), "bmi_calc": F.coalesce(F.col("bmi_calc"), bmi)})


def validation_errors(fields=ALL_FIELDS) -> Column:
    """One message per present field out of its range / ordinal set / binary set."""
    msgs = []
    for f in fields:
        c = F.col(f)
        if f in specs.REQUEST_RANGES:
            lo, hi = specs.REQUEST_RANGES[f]
            msgs.append((c.isNotNull() & ~c.between(lo, hi), f"{f}: value must be between {lo:g} and {hi:g}"))
        elif f in specs.REQUEST_ORDINAL_123:
            msgs.append((c.isNotNull() & ~c.isin(1.0, 2.0, 3.0), f"{f}: choose a valid value"))
        elif f in specs.REQUEST_BINARY_01:
            msgs.append((c.isNotNull() & ~c.isin(0.0, 1.0), f"{f}: choose yes or no"))
    return texts_where(msgs)


def missing_features(features) -> Column:
    """F8: feature names (in model order) that are absent for the record."""
    return texts_where([(F.col(f).isNull() | F.isnan(F.col(f)), f) for f in features])


def prepare_requests(requests: DataFrame, keep=("request_id",), rules: str = "on") -> DataFrame:
    """P20 + P17 + R9 + C4: typed fields, all errors, and both groups' missing lists.

    ``rules="off"`` scores records as they come: no range rules and no derived BMI.
    """
    cleaned = clean_payload(requests, keep=keep)
    if rules == "on":
        cleaned = derive_bmi(cleaned)
    ranges = validation_errors() if rules == "on" else F.array().cast("array<string>")
    return cleaned.withColumns(
        {
            "errors": F.concat(F.col("payload_errors"), ranges),
            "missing_data1": missing_features(specs.DATA1.features),
            "missing_data2": missing_features(specs.DATA2.features),
        }
    ).drop("payload_errors")


def route(prepared: DataFrame, require_both: bool = False) -> DataFrame:
    """C5 + C10: prediction_mode, reason, and the nearest group for incomplete records."""
    has1 = F.size("missing_data1") == 0
    has2 = F.size("missing_data2") == 0
    bad = F.size("errors") > 0
    if require_both:
        ok_combined = has1 & has2
        mode = F.when(bad, "rejected").when(ok_combined, "combined").otherwise("incomplete")
    else:
        mode = (
            F.when(bad, "rejected")
            .when(has1 & has2, "combined")
            .when(has1, "data1_only")
            .when(has2, "data2_only")
            .otherwise("incomplete")
        )
    closer2 = F.size("missing_data2") <= F.size("missing_data1")
    reason = (
        F.when(mode == "data1_only", F.lit(specs.ROUTE_REASONS["data1_only"]))
        .when(mode == "data2_only", F.lit(specs.ROUTE_REASONS["data2_only"]))
        .when(mode == "rejected", F.concat_ws("; ", "errors"))
        .when(
            mode == "incomplete",
            F.concat(
                F.lit(f"{specs.INCOMPLETE_REASONS['combined' if require_both else 'auto']} Missing Data1: "),
                F.concat_ws(", ", "missing_data1"),
                F.lit("; missing Data2: "),
                F.concat_ws(", ", "missing_data2"),
            ),
        )
    )
    return prepared.withColumns(
        {
            "prediction_mode": mode,
            "reason": reason,
            "nearest_group": F.when(mode == "incomplete", F.when(closer2, "Data2").otherwise("Data1")),
            "nearest_missing": F.when(mode == "incomplete", F.when(closer2, F.col("missing_data2")).otherwise(F.col("missing_data1"))),
        }
    )


def risk_label(cls: Column) -> Column:
    """P22."""
    return F.when(cls == 1, F.lit(specs.RISK_LABELS[1])).when(cls == 0, F.lit(specs.RISK_LABELS[0]))


def score_records(
    requests: DataFrame,
    model1,
    model2,
    dual: DualMetadata | None = None,
    mode: str = "auto",
    keep=("request_id",),
    on_invalid: str = "quarantine",
    rules: str = "on",
) -> DataFrame:
    """Route, score each group with its model (once for all rows), combine, flatten.

    mode: 'auto' (either or both groups), 'combined' (both required), 'data1', 'data2';
    rules: 'on' (range rules and derived BMI, as for forms) or 'off' (records as they come).
    """
    dual = DualMetadata.absent() if dual is None else dual
    prepared = prepare_requests(requests, keep=keep, rules=rules)
    routed = route(prepared, require_both=(mode == "combined"))
    if mode in ("data1", "data2"):
        need = "missing_data1" if mode == "data1" else "missing_data2"
        routed = routed.withColumn(
            "prediction_mode",
            F.when(F.size("errors") > 0, "rejected").when(F.size(need) == 0, F.lit(mode)).otherwise("incomplete"),
        )
        # only the group asked for decides, so only it is named
        group, apart = ("Data1" if mode == "data1" else "Data2"), F.col("prediction_mode") == "incomplete"
        routed = routed.withColumns(
            {
                "reason": F.when(F.col("prediction_mode") == "rejected", F.concat_ws("; ", "errors")).when(
                    apart, F.concat(F.lit(f"Missing {group}: "), F.concat_ws(", ", need))
                ),
                "nearest_group": F.when(apart, F.lit(group)),
                "nearest_missing": F.when(apart, F.col(need)),
            }
        )
    if on_invalid == "raise":
        n_bad = routed.filter(F.col("prediction_mode").isin("rejected", "incomplete")).count()
        if n_bad:
            raise ValueError(f"{n_bad} record(s) are missing features or have invalid values")

    use1 = F.col("prediction_mode").isin("combined", "data1_only", "data1")
    use2 = F.col("prediction_mode").isin("combined", "data2_only", "data2")
    scored = model2.score(model1.score(routed, "_p1"), "_p2")
    p1 = F.when(use1, F.col("_p1"))
    p2 = F.when(use2, F.col("_p2"))

    w1 = float(dual.weights.get("Data1", 0.5))
    w2 = float(dual.weights.get("Data2", 0.5))
    if w1 + w2 <= 0:
        w1 = w2 = 0.5
    w1, w2 = w1 / (w1 + w2), w2 / (w1 + w2)
    comb_thr = dual.combined_threshold if dual.combined_threshold is not None else w1 * model1.threshold + w2 * model2.threshold
    is_comb = F.col("prediction_mode") == "combined"
    comb_p = F.when(is_comb, F.lit(w1) * p1 + F.lit(w2) * p2)
    cls1 = F.when(use1, (p1 >= model1.threshold).cast("int"))
    cls2 = F.when(use2, (p2 >= model2.threshold).cast("int"))
    comb_cls = F.when(is_comb, (comb_p >= F.lit(comb_thr)).cast("int"))
    return scored.select(
        *keep,
        "prediction_mode",
        "reason",
        F.lit(specs.DISCLAIMER).alias("disclaimer"),
        F.when(use1, F.lit(model1.model_name)).alias("data1_model_name"),
        p1.alias("data1_probability"),
        F.when(use1, F.lit(float(model1.threshold))).alias("data1_threshold"),
        cls1.alias("data1_predicted_class"),
        risk_label(cls1).alias("data1_risk_label"),
        F.when(use2, F.lit(model2.model_name)).alias("data2_model_name"),
        p2.alias("data2_probability"),
        F.when(use2, F.lit(float(model2.threshold))).alias("data2_threshold"),
        cls2.alias("data2_predicted_class"),
        risk_label(cls2).alias("data2_risk_label"),
        comb_p.alias("combined_probability"),
        F.when(is_comb, F.lit(float(comb_thr))).alias("combined_threshold"),
        comb_cls.alias("combined_predicted_class"),
        risk_label(comb_cls).alias("combined_risk_label"),
        F.when(is_comb, F.lit(w1)).alias("data1_weight"),
        F.when(is_comb, F.lit(w2)).alias("data2_weight"),
        "errors",
        "missing_data1",
        "missing_data2",
        "nearest_group",
    )


ACCEPTED = ("combined", "data1_only", "data2_only", "data1", "data2")


def is_accepted() -> Column:
    return F.col("prediction_mode").isin(*ACCEPTED)


def _main(combined: Column, data1: Column, data2: Column) -> Column:
    mode = F.col("prediction_mode")
    return F.when(mode == "combined", combined).when(mode.isin("data1_only", "data1"), data1).otherwise(data2)


def main_block() -> tuple[Column, Column, Column]:
    """Probability, threshold and class of the block that decides: combined, else the only model."""
    return tuple(_main(*[F.col(f"{group}_{what}") for group in ("combined", "data1", "data2")]) for what in ("probability", "threshold", "predicted_class"))


def main_model_name() -> Column:
    return _main(F.concat_ws("+", "data1_model_name", "data2_model_name"), F.col("data1_model_name"), F.col("data2_model_name"))


MODE_LABELS = {"combined": "Both models", "data1_only": "Data1 model", "data1": "Data1 model", "data2_only": "Data2 model", "data2": "Data2 model"}


def presentation(flat: DataFrame, keep=("request_id",)) -> DataFrame:
    """The deciding block in whole percent (half to even) with a mode label, and a details
    block: each model's own percentage and threshold (3 dp, half to even), weighted if combined."""
    p, t, c = main_block()
    percent = lambda x: F.bround(x * 100, 0).cast("long")
    labels = F.create_map(*[F.lit(x) for pair in MODE_LABELS.items() for x in pair])

    def part(group: str, name: str) -> Column:
        weight = F.when(F.col(f"{group}_weight").isNotNull(), F.concat(F.lit(", weight "), F.format_string("%.2f", f"{group}_weight"))).otherwise("")
        text = F.concat(
            F.lit(f"{name} "), percent(F.col(f"{group}_probability")).cast("string"), F.lit(" % (threshold "),
            F.format_string("%.3f", F.bround(f"{group}_threshold", 3)), weight, F.lit(")"),
        )
        return F.when(F.col(f"{group}_probability").isNotNull(), text)

    return flat.filter(is_accepted()).select(
        *keep,
        "prediction_mode",
        labels[F.col("prediction_mode")].alias("mode_label"),
        percent(p).alias("probability_pct"),
        c.alias("predicted_class"),
        risk_label(c).alias("risk_label"),
        F.bround(t, 3).alias("threshold"),
        F.concat_ws("; ", part("data1", "Data1"), part("data2", "Data2")).alias("details"),
        "reason",
    )


def model_result(flat: DataFrame, model, group: str, keep=("request_id",)) -> DataFrame:
    """One model's result as a nested row: probability, threshold, class, label, the
    features used and their number, limitations; NULL where the model was not used."""
    p = F.col(f"{group}_probability")
    used = F.array(*[F.lit(f) for f in model.features])
    result = F.struct(
        F.lit(model.model_name).alias("model_name"), p.alias("probability"), F.col(f"{group}_threshold").alias("threshold"),
        F.col(f"{group}_predicted_class").alias("predicted_class"), F.col(f"{group}_risk_label").alias("risk_label"),
        F.lit(len(model.features)).alias("feature_count"), used.alias("features_used"),
        F.array(*[F.lit(x) for x in model.limitations]).cast("array<string>").alias("limitations"),
    )
    return flat.select(*keep, "prediction_mode", "reason", F.when(p.isNotNull(), result).alias("result"))
