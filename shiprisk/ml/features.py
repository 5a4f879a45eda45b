"""Feature frame, one-hot encoding, leakage guard."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiprisk.functions.calendar import weekday_index
from shiprisk.schemas import CATEGORICAL_FEATURES, LABEL, NUMERIC_FEATURES, POST_DISPATCH_COLUMNS

ID = "order_item_id"


class LeakageError(ValueError):
    """A feature is only known after the order is dispatched."""


def check_no_leakage(columns: list[str]) -> None:
    """Refuse post-dispatch columns as model inputs."""
    bad = [c for c in columns if c in POST_DISPATCH_COLUMNS]
    if bad:
        raise LeakageError(f"post-dispatch columns cannot be features: {bad}")


def delivery_features(flat: DataFrame) -> DataFrame:
    """M1: the eight inputs and the label, one row per order item (flat names)."""
    out = flat.select(
        F.col(ID),
        F.col("shipping_mode"), F.col("order_region"), F.col("market"), F.col("category_name"),
        F.col("order_item_discount_rate").cast("double").alias("discount_rate"),
        F.col("order_item_quantity").alias("quantity"),
        F.month("order_date").alias("order_month"),
        weekday_index("order_date").alias("order_weekday"),
        F.col(LABEL).alias("label"),
    )
    check_no_leakage(CATEGORICAL_FEATURES + NUMERIC_FEATURES)
    return out


def encoder_pipeline(categorical=CATEGORICAL_FEATURES, numeric=NUMERIC_FEATURES) -> Pipeline:
    """M2: index each category (alphabet descending), one-hot with the last
    index dropped -- i.e. the alphabetically first level is the base -- then
    assemble with the numeric inputs."""
    check_no_leakage(list(categorical) + list(numeric))
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType="alphabetDesc")
                for c in categorical]
    onehot = OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical],
                           outputCols=[f"{c}__ohe" for c in categorical], dropLast=True)
    assembler = VectorAssembler(inputCols=list(numeric) + [f"{c}__ohe" for c in categorical],
                                outputCol="features")
    return Pipeline(stages=[*indexers, onehot, assembler])


def fit_encoder(features: DataFrame) -> PipelineModel:
    """Levels are learnt on the whole feature frame (no target involved)."""
    return encoder_pipeline().fit(features)


def feature_names(encoder: PipelineModel) -> list[str]:
    """Names of the assembled vector slots: numeric inputs, then
    ``<column>_<level>`` for every kept level."""
    names = list(NUMERIC_FEATURES)
    for model, col in zip(encoder.stages[: len(CATEGORICAL_FEATURES)], CATEGORICAL_FEATURES):
        labels = list(model.labels)
        names += [f"{col}_{lvl}" for lvl in labels[:-1]]  # last index dropped
    return names


def base_levels(encoder: PipelineModel) -> dict[str, str]:
    """The dropped (alphabetically first) level of each categorical input."""
    return {c: m.labels[-1] for c, m in zip(CATEGORICAL_FEATURES, encoder.stages)}


def with_known_levels(features: DataFrame, encoder: PipelineModel) -> DataFrame:
    """Replace levels that the encoder never saw (and nulls) by the base level."""
    cols = {c: F.when(F.col(c).isin(list(m.labels)), F.col(c)).otherwise(F.lit(m.labels[-1]))
            for c, m in zip(CATEGORICAL_FEATURES, encoder.stages)}
    return features.withColumns(cols)


def one_hot_long(features: DataFrame, encoder: PipelineModel) -> DataFrame:
    """The active one-hot slots of every row, long form (row id, feature):
    at most one per categorical input, none for its base level."""
    base = base_levels(encoder)
    known = with_known_levels(features, encoder)
    slots = F.array(*[F.when(F.col(c) != base[c], F.concat(F.lit(f"{c}_"), F.col(c))) for c in CATEGORICAL_FEATURES])
    return known.select(ID, F.explode(F.filter(slots, lambda x: x.isNotNull())).alias("feature"))


def one_hot_wide(features: DataFrame, encoder: PipelineModel) -> DataFrame:
    """M2: one 0/1 column ``<column>_<level>`` per kept level beside the row id and the numeric inputs."""
    known = with_known_levels(features, encoder)
    flags = [(F.col(c) == level).cast("int").alias(f"{c}_{level}")
             for c, m in zip(CATEGORICAL_FEATURES, encoder.stages) for level in list(m.labels)[:-1]]
    return known.select(ID, *NUMERIC_FEATURES, *flags)
