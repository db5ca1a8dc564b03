"""CPI models: fitting with Spark ML and batch scoring of an exported network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.metrics import gram, least_squares
from tracemill.session import compiled_methods, cut_lineage

HIDDEN = (256, 128)  # fixed values: hidden layer widths


def fit_regressor(train: DataFrame, features: list[str], label: str = "cpi", kind: str = "linear", seed: int = 0) -> PipelineModel | LinearModel:
    """CPI regressor on prepared columns: least squares, a plane of least absolute deviations, or boosted trees with absolute loss."""
    if kind == "absolute":
        return fit_absolute(train, features, label)
    assemble = VectorAssembler(inputCols=features, outputCol="features_vec")
    common = {"featuresCol": "features_vec", "labelCol": label, "predictionCol": "predicted_cpi"}
    if kind == "linear":
        model = LinearRegression(solver="normal", **common)
    elif kind == "gbt":
        model = GBTRegressor(lossType="absolute", seed=seed, **common)
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    return Pipeline(stages=[assemble, model]).fit(train)


@dataclass(frozen=True)
class LinearModel:
    """A plane: predictions are a native expression. `loss` is the mean absolute error on the fitted rows, by round."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    loss: tuple[float, ...]

    def predicted(self) -> Column:
        return sum((F.col(c).cast("double") * F.lit(k) for c, k in zip(self.features, self.coefficients, strict=True)), F.lit(self.intercept))


def fit_absolute(train: DataFrame, features: list[str], label: str = "cpi", rounds: int = 40, tolerance: float = 1e-6) -> LinearModel:
    """Plane of least absolute deviations, by re-weighted least squares.

    Each round weighs rows with 1 / |residual| of the round before and is one scan that sums a Gram matrix in Spark; the
    driver solves a system of the number of features. Stops when the loss no longer falls. Residuals are not taken below a
    floor, which falls from round to round. Rows with a null are left out, dependent features are allowed, no rows fail.
    """
    columns = [*features, label]
    rows = cut_lineage(train.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna())
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not stats["n"]:
        raise ValueError("no complete row to fit")
    middle, spread = ([stats[f"{n}{i}"] or d for i in range(len(columns))] for n, d in (("m", 0.0), ("s", 1.0)))
    scaled = cut_lineage(rows.select(*[((F.col(c) - F.lit(m)) / F.lit(s)).alias(c) for c, m, s in zip(columns, middle, spread, strict=True)]))
    residual = lambda beta, start: F.abs(F.col(label) - sum((F.col(c) * F.lit(float(k)) for c, k in zip(features, beta, strict=True)), F.lit(start)))
    beta, start, losses, floor, best = None, 0.0, [], 1e-1, None
    for _ in range(rounds):
        weight = None if beta is None else F.lit(1.0) / F.greatest(residual(beta, start), F.lit(floor))
        with compiled_methods(train.sparkSession):
            row = gram(scaled, columns, weight=weight).first()
        beta, start, _r2 = least_squares(row["gram"], len(features))
        loss = scaled.agg(F.avg(residual(beta, start))).first()[0]
        if best is None or loss < best[0]:
            best = (loss, beta, start)
        losses.append(loss * spread[-1])
        if len(losses) > 2 and floor <= 1e-6 and losses[-2] - losses[-1] <= tolerance * losses[-2]:
            break
        floor = max(floor / 4, 1e-7)
    _, beta, start = best
    slopes = [float(k) * spread[-1] / s for k, s in zip(beta, spread[:-1], strict=True)]
    intercept = middle[-1] + start * spread[-1] - sum(k * m for k, m in zip(slopes, middle[:-1], strict=True))
    return LinearModel(tuple(features), tuple(slopes), float(intercept), tuple(losses))


def predict(model: PipelineModel | LinearModel, df: DataFrame) -> DataFrame:
    if isinstance(model, LinearModel):
        return df.withColumn("predicted_cpi", model.predicted())
    return model.transform(df).drop("features_vec")


def score_mlp(df: DataFrame, features: list[str], weights: list[tuple[np.ndarray, np.ndarray]], out: str = "predicted_cpi") -> DataFrame:
    """Forward pass of a ReLU network given as (matrix, bias) per layer, matrices input x output.

    The weights (about 40k numbers) are a broadcast variable; only the features travel to
    Python, and every Arrow batch is one matrix product per layer in single precision.
    """
    shapes = [(w.shape, b.shape) for w, b in weights]
    if weights[0][0].shape[0] != len(features):
        raise ValueError(f"the first layer takes {weights[0][0].shape[0]} features, got {len(features)}")
    if any(w[1] != b[0] for w, b in shapes) or any(a[0][1] != b[0][0] for a, b in zip(shapes, shapes[1:])):
        raise ValueError(f"layer shapes do not fit: {shapes}")
    shared = df.sparkSession.sparkContext.broadcast([(w.astype(np.float32), b.astype(np.float32)) for w, b in weights])

    @F.pandas_udf("double")
    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        layers = shared.value
        for pdf in batches:
            x = pdf.to_numpy(dtype=np.float32)
            for i, (w, b) in enumerate(layers):
                x = x @ w + b
                if i + 1 < len(layers):
                    x = np.maximum(x, 0.0)
            yield pd.Series(x[:, 0].astype(np.float64))

    return df.withColumn(out, forward(F.struct(*features)))
