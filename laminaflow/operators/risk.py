"""Defect risk: feature row, heuristic, logistic regression and boosted trees."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laminaflow.functions.scalars import clamp, first_match
from laminaflow.model import DEFECT_RESULTS, GOOD_RESULTS, RISK_FEATURES

MIN_LABELS = 8
MIN_LABELS_TREES = 20
MIN_MINORITY_TREES = 5


def feature_row(overview: DataFrame, health: DataFrame, stats: DataFrame, quality: DataFrame) -> DataFrame:
    """The eight raw features per session; oxygen comes from SO1, else SO2."""
    rank = F.when(F.col("signal") == "SO1", 0).otherwise(1)
    o2 = stats.where(F.col("signal").isin("SO1", "SO2")).groupBy("session_id").agg(
        F.min_by(F.struct("mean", "std"), rank).alias("_o2"))
    df = (overview.select("session_id", "duration_min", "layers")
          .join(health.select("session_id", "readiness", "anomaly_count", "slope_sec_per_layer"), "session_id", "left")
          .join(quality.select("session_id", F.col("score").alias("data_quality")), "session_id", "left")
          .join(o2, "session_id", "left"))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.select("session_id", F.col("readiness").cast("double"), zero("anomaly_count").alias("anomaly_count"),
                     zero("slope_sec_per_layer").alias("burn_slope"), F.col("data_quality").cast("double"),
                     F.col("_o2.mean").alias("o2_mean"), F.col("_o2.std").alias("o2_std"),
                     zero("duration_min").alias("duration_min"), zero("layers").alias("layers"))


def outcome_label(result: Column) -> Column:
    """1 defect, 0 good, null otherwise."""
    r = F.lower(F.trim(result))
    return F.when(r.isin(*DEFECT_RESULTS), 1).when(r.isin(*GOOD_RESULTS), 0)


def latest_labels(outcomes: DataFrame) -> DataFrame:
    """Newest usable label per session."""
    rows = outcomes.where("session_id is not null").withColumn("label", outcome_label(F.col("result")))
    return rows.where("label is not null").groupBy("session_id").agg(
        F.max_by("label", F.struct("timestamp", "outcome_id")).alias("label"))


def risk_grade(risk: Column) -> Column:
    return first_match([(risk >= 0.6, "high"), (risk >= 0.3, "medium")], "low")


def _top(pairs: list[tuple[str, Column]], key, keep) -> Column:
    """The four strongest (factor, contribution) pairs."""
    items = F.array(*[F.struct(F.lit(n).alias("factor"), c.alias("contribution"), F.lit(-i).alias("_i"))
                      for i, (n, c) in enumerate(pairs)])
    ranked = F.reverse(F.array_sort(F.transform(F.filter(items, lambda x: keep(x["contribution"])), lambda x: F.struct(
        key(x["contribution"]).alias("k"), x["_i"].alias("i"), x["factor"].alias("factor"), x["contribution"].alias("contribution")))))
    return F.transform(F.slice(ranked, 1, 4), lambda x: F.struct(x["factor"].alias("factor"), x["contribution"].alias("contribution")))


def heuristic_risk(features: DataFrame) -> DataFrame:
    """Weighted blend of the known drivers, renormalised over the drivers a session has."""
    c = F.col
    # Driver name, driver in 0..1, weight.
    drivers = [
        ("Низкая готовность атмосферы", F.greatest(F.lit(0.0), (100 - c("readiness")) / 100), 0.35, c("readiness").isNotNull()),
        ("Низкое качество данных", F.greatest(F.lit(0.0), (100 - c("data_quality")) / 100), 0.15, c("data_quality").isNotNull()),
        ("Аномалии процесса", F.least(F.lit(1.0), F.coalesce("anomaly_count", F.lit(0.0)) / 5.0), 0.25, F.lit(True)),
        ("Рост времени прожига", clamp(F.coalesce("burn_slope", F.lit(0.0)) / 0.5, 0.0, 1.0), 0.25, F.lit(True)),
    ]
    weight = sum((F.when(present, w).otherwise(0.0) for _, _, w, present in drivers), F.lit(0.0))
    shares = [(name, F.when(present, value * w).otherwise(0.0) / weight) for name, value, w, present in drivers]
    risk = sum((s for _, s in shares), F.lit(0.0))
    return features.select("*", risk.alias("risk"), risk_grade(F.round(risk, 9)).alias("grade"), F.lit("heuristic").alias("method"),
                           _top(shares, lambda x: x, lambda x: x > 0).alias("top_factors"))


@dataclass
class RiskModel:
    kind: str
    features: list[str]
    n_train: int
    n_defects: int
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    coef: list[float] = field(default_factory=list)
    intercept: float = 0.0
    importance: list[float] = field(default_factory=list)
    trees: Any = None


def train(labelled: DataFrame, allow_trees: bool = True) -> RiskModel | None:
    """Boosted trees with enough labels, else logistic regression, else None. ``labelled``: features + label.

    Only features that every labelled row has are used. The sizes and moments come from one aggregate row.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    names = list(RISK_FEATURES)
    facts = labelled.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("d"),
        *[F.count(f).alias(f"c_{f}") for f in names], *[F.avg(f).alias(f"m_{f}") for f in names],
        *[F.stddev_pop(f).alias(f"s_{f}") for f in names]).first()
    n, defects = facts.n, int(facts.d)
    used = [f for f in names if facts[f"c_{f}"] == n]
    if n < MIN_LABELS or defects in (0, n) or not used:
        return None
    if allow_trees and n >= MIN_LABELS_TREES and min(defects, n - defects) >= MIN_MINORITY_TREES:
        data = VectorAssembler(inputCols=used, outputCol="_x").transform(
            labelled.select(*used, F.col("label").cast("double").alias("label")))
        fit = GBTClassifier(featuresCol="_x", labelCol="label", maxDepth=3, maxIter=60, stepSize=0.1,
                            minInstancesPerNode=3, seed=7).fit(data)
        return RiskModel("trees", used, n, defects, importance=[float(x) for x in fit.featureImportances.toArray()], trees=fit)
    mean = [facts[f"m_{f}"] for f in used]
    scale = [facts[f"s_{f}"] or 1.0 for f in used]
    scaled = labelled.select(*[((F.col(f) - m) / s).alias(f) for f, m, s in zip(used, mean, scale)],
                             F.col("label").cast("double").alias("label"))
    data = VectorAssembler(inputCols=used, outputCol="_x").transform(scaled)
    fit = LogisticRegression(featuresCol="_x", labelCol="label", regParam=1.0 / n, elasticNetParam=0.0,
                             standardization=False, maxIter=1000, tol=1e-8).fit(data)
    return RiskModel("model", used, n, defects, mean, scale, [float(x) for x in fit.coefficients], float(fit.intercept))


def score(features: DataFrame, model: RiskModel | None) -> DataFrame:
    """Risk of every session: the model where its features are all present, else the heuristic."""
    base = heuristic_risk(features)
    if model is None:
        return base
    whole = F.lit(True)
    for f in model.features:
        whole = whole & F.col(f).isNotNull()
    if model.kind == "model":
        parts = [(RISK_FEATURES[f], F.lit(b) * (F.col(f) - m) / s)
                 for f, m, s, b in zip(model.features, model.mean, model.scale, model.coef)]
        z = sum((p for _, p in parts), F.lit(model.intercept))
        risk = 1 / (1 + F.exp(-clamp(z, -60.0, 60.0)))
        top = _top(parts, F.abs, lambda x: x.isNotNull())
        df = base
    else:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array
        filled = base.select("*", *[F.coalesce(F.col(f), F.lit(0.0)).alias(f"_f_{f}") for f in model.features])
        inputs = [f"_f_{f}" for f in model.features]
        df = model.trees.transform(VectorAssembler(inputCols=inputs, outputCol="_x").transform(filled))
        risk = vector_to_array(F.col("probability"))[1]
        total = sum(model.importance) or 1.0
        top = _top([(RISK_FEATURES[f], F.lit(g / total)) for f, g in zip(model.features, model.importance)],
                   lambda x: x, lambda x: x > 0)
    new = {"risk": risk, "grade": risk_grade(risk), "method": F.lit(model.kind), "top_factors": top}
    return df.select(*features.columns, *[F.when(whole, v).otherwise(F.col(k)).alias(k) for k, v in new.items()])


def defect_risk(features: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Latest labels joined, model trained when possible, every session scored."""
    labels = latest_labels(outcomes)
    model = train(features.join(labels, "session_id"))
    return score(features, model).join(labels, "session_id", "left")
