"""Registered model jobs."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiprisk.ml import certify, evaluate, features, split, train
from shiprisk.session import app_id, apply_defaults, work_dir
from shiprisk.sources import silver

# (application, source folder, balanced) -> fitted model, its encoder and the encoded test rows.
_FITTED: dict[tuple, tuple] = {}
# (application, source folder) -> the split rows (lazy; only the classes' limits are known).
_SPLIT: dict[tuple, DataFrame] = {}


def _features(s: SparkSession, d: str) -> DataFrame:
    apply_defaults(s)
    return features.delivery_features(silver.testbed_silver(s, d).flat)


def _split(s: SparkSession, d: str) -> DataFrame:
    key = (app_id(s), d)
    if key not in _SPLIT:
        _SPLIT[key] = split.stratified_split(_features(s, d))
    return _SPLIT[key]


def delivery_features(s, d):
    return _features(s, d)


def one_hot_drop_first(s, d):
    f = _features(s, d)
    return features.one_hot_long(f, features.fit_encoder(f))


def stratified_split(s, d):
    return _split(s, d).select(features.ID, "label", "split")


def split_balance(s, d):
    return split.split_balance(_split(s, d))


def class_weights(s, d):
    return split.class_weights(_split(s, d).where(F.col("split") == "train"))


def classification_report(s, d):
    return evaluate.classification_report(train.rule_scores(_split(s, d)))


def roc_auc(s, d):
    return evaluate.roc_auc(train.rule_scores(_split(s, d)))


def _forest(s: SparkSession, d: str, balanced: bool = False) -> tuple:
    """The forest at full size (200 trees of depth 12), fitted once an application."""
    key = (app_id(s), d, balanced)
    if key not in _FITTED:
        prep = train.prepare(_split(s, d))
        model = train.train_forest(prep, balanced=balanced)
        prep.release()
        _FITTED[key] = (model, prep.encoder, prep.test)
    return _FITTED[key]


def _logreg(s: SparkSession, d: str) -> tuple:
    """The logistic regression, fitted once an application."""
    key = (app_id(s), d, "logreg")
    if key not in _FITTED:
        prep = train.prepare(_split(s, d))
        model = train.train_logreg(prep)
        prep.release()
        _FITTED[key] = (model, prep.encoder, prep.test)
    return _FITTED[key]


def logreg_gradient(s, d):
    """Whether the fit is the optimum: its mean penalised gradient and Newton step vanish."""
    model, encoder, _ = _logreg(s, d)
    encoded = encoder.transform(_split(s, d)).where(F.col("split") == "train")
    final = model.stages[-1]
    n, gradient, step = certify.logreg_certificate(
        encoded, final.coefficients.toArray(), final.intercept, final.getRegParam())
    return s.createDataFrame([(n, len(final.coefficients), gradient < 1e-6, step < 1e-3)],
                             "n_rows bigint, n_features int, gradient_vanishes boolean, step_vanishes boolean")


def forest_rescored(s, d):
    """Every test row's score through the forest's node table, against the model's own."""
    model, encoder, test = _forest(s, d)
    nodes = certify.node_table(model, encoder, s)
    own = train.score_encoded(model, test).select(features.ID, "label", F.col("score").alias("own"))
    routed = certify.rescored(model, nodes, _split(s, d).where(F.col("split") == "test"))
    return own.join(routed, features.ID, "left").select(
        features.ID, "label", F.coalesce(F.abs(F.col("own") - F.col("score")) < 1e-9, F.lit(False)).alias("agrees"))


def importance_from_gains(s, d):
    """Every feature's importance from the nodes' impurity gains, against the model's own."""
    model, encoder, _ = _forest(s, d)
    gained = certify.importance_from_nodes(certify.node_table(model, encoder, s))
    values = model.stages[-1].featureImportances.toArray().tolist()
    own = s.createDataFrame([(i, n, v) for i, (n, v) in enumerate(zip(features.feature_names(encoder), values))],
                            "slot int, feature string, own double")  # a row a feature
    return own.join(gained, "slot", "left").select(
        "feature", (F.abs(F.col("own") - F.coalesce("importance", F.lit(0.0))) < 1e-9).alias("agrees"))


def _metrics(kind: str):
    def run(s, d):
        model, _, test = _logreg(s, d) if kind == "logreg" else _forest(s, d, kind == "rf_weighted")
        return train.metrics_row(kind, train.score_encoded(model, test))
    return run


def score_delivery_risk(s, d):
    model, _, test = _forest(s, d)
    return train.score_encoded(model, test)


def scored_rows(s, d):
    """What of the scoring doesn't depend on the trees: ids, labels, class and score in range."""
    model, _, test = _forest(s, d)
    out = train.score_encoded(model, test)
    fine = F.col("score").between(0, 1) & (F.col("prediction") == (F.col("score") > 0.5).cast("int"))
    return out.select(features.ID, "label", (fine | (F.col("score") == 0.5)).alias("consistent"))


def feature_importance(s, d):
    model, encoder, _ = _forest(s, d)
    return train.feature_importance(model, encoder, s)


def importance_by_source(s, d):
    model, encoder, _ = _forest(s, d)
    return train.importance_by_source(model, encoder, s)


def importance_total(s, d):
    """Features of the model, and that their importances sum to 1."""
    model, encoder, _ = _forest(s, d)
    every = train.all_importances(model, encoder, s)
    return every.agg(F.count(F.lit(1)).alias("n_features"), F.round(F.sum("importance"), 6).alias("total"))


def model_comparison(s, d):
    rows = [train.metrics_row("rule_by_mode", train.rule_scores(_split(s, d)))]
    return train.compare_models(rows + [_metrics(kind)(s, d) for kind in ("logreg", "rf", "rf_weighted")])


def model_roundtrip(s, d):
    """Save the fitted pipeline to shared storage, load it, score raw rows."""
    model, _, _ = _forest(s, d)
    path = work_dir(s, "model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    return train.score(loaded, _split(s, d).where(F.col("split") == "test"))


def queries() -> dict:
    return {
        "delivery_features": delivery_features,
        "one_hot_drop_first": one_hot_drop_first,
        "stratified_split": stratified_split,
        "split_balance": split_balance,
        "class_weights": class_weights,
        "classification_report": classification_report,
        "roc_auc": roc_auc,
        "logreg_metrics": _metrics("logreg"),
        "rf_metrics": _metrics("rf"),
        "rf_weighted_metrics": _metrics("rf_weighted"),
        "score_delivery_risk": score_delivery_risk,
        "scored_rows": scored_rows,
        "feature_importance": feature_importance,
        "importance_by_source": importance_by_source,
        "importance_total": importance_total,
        "model_comparison": model_comparison,
        "model_roundtrip": model_roundtrip,
        "logreg_gradient": logreg_gradient,
        "forest_rescored": forest_rescored,
        "importance_from_gains": importance_from_gains,
    }
