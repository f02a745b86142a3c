"""Direction classifiers (X4, X5, A13), re-aimed as Spark ML jobs.

The reference trains LSTM encoders on one GPU. Here each sample window is pooled into native
columns (last, mean, population std, min, max per feature) with higher-order array functions,
the price and text vectors are concatenated (late fusion) and a distributed Spark ML classifier
is fitted: ``LogisticRegression`` or a ``MultilayerPerceptronClassifier`` with hidden layers
128, 64, 32 (the fusion head's sizes). Results are not numerically equal to the LSTM.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATS = ("last", "mean", "std", "min", "max")


def pool_window(df: DataFrame, x_col: str, n_features: int, prefix: str) -> DataFrame:
    """Per-feature summary columns of an ``array<array<double>>`` window (time x feature)."""
    def pick(i):
        return lambda r: r[i]

    cols = {}
    for i in range(n_features):
        series = F.transform(F.col(x_col), pick(i))
        n = F.size(series)
        mean = F.aggregate(series, F.lit(0.0), lambda a, v: a + v) / n
        apart = F.aggregate(F.transform(series, lambda v, m=mean: (v - m) * (v - m)), F.lit(0.0), lambda a, v: a + v)
        cols[f"{prefix}{i}_last"] = F.element_at(series, -1)
        cols[f"{prefix}{i}_mean"] = mean
        cols[f"{prefix}{i}_std"] = F.sqrt(apart / n)
        cols[f"{prefix}{i}_min"] = F.array_min(series)
        cols[f"{prefix}{i}_max"] = F.array_max(series)
    return df.withColumns(cols)


def pool_rows(rows: DataFrame, features, length: int, prefix: str, ticker: str = "ticker",
              date: str = "date") -> DataFrame:
    """Window pooling straight from the feature rows: the ``length``-row sliding frame that
    forms a sequence (W11) summarised with built-in window aggregates -- no arrays."""
    w = Window.partitionBy(ticker).orderBy(date).rowsBetween(-(length - 1), 0)
    cols = {}
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        cols[f"{prefix}{i}_last"] = x
        cols[f"{prefix}{i}_mean"] = F.avg(x).over(w)
        cols[f"{prefix}{i}_std"] = F.stddev_pop(x).over(w)
        cols[f"{prefix}{i}_min"] = F.min(x).over(w)
        cols[f"{prefix}{i}_max"] = F.max(x).over(w)
    return rows.withColumns(cols)


def pool_hours(window_rows: DataFrame, features, prefix: str, keys=("ticker", "date", "label"),
               pos: str = "pos") -> DataFrame:
    """Window pooling of the long-form text window (one row per sample hour) with grouped
    built-in aggregates; ``last`` is the value at the highest position."""
    aggs = []
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        aggs += [F.max_by(x, F.col(pos)).alias(f"{prefix}{i}_last"),
                 F.avg(x).alias(f"{prefix}{i}_mean"),
                 F.stddev_pop(x).alias(f"{prefix}{i}_std"),
                 F.min(x).alias(f"{prefix}{i}_min"),
                 F.max(x).alias(f"{prefix}{i}_max")]
    return window_rows.groupBy(*keys).agg(*aggs)


def pooled_names(n_features: int, prefix: str) -> list[str]:
    return [f"{prefix}{i}_{s}" for i in range(n_features) for s in STATS]


def fit_direction_model(train: DataFrame, feature_cols, label: str = "label",
                        kind: str = "logistic", max_iter: int = 100, seed: int = 42,
                        reg: float = 0.0):
    """Assemble, standardise (train statistics only) and fit the classifier."""
    assembler = VectorAssembler(inputCols=list(feature_cols), outputCol="_raw",
                                handleInvalid="keep")
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)
    if kind == "mlp":
        clf = MultilayerPerceptronClassifier(layers=[len(feature_cols), 128, 64, 32, 2],
                                             labelCol=label, featuresCol="features",
                                             maxIter=max_iter, seed=seed)
    else:
        clf = LogisticRegression(labelCol=label, featuresCol="features", maxIter=max_iter,
                                 regParam=reg)
    return Pipeline(stages=[assembler, scaler, clf]).fit(train.withColumn(
        label, F.col(label).cast("double")))


def predict_direction(model, df: DataFrame, label: str = "label",
                      threshold: float = 0.5) -> DataFrame:
    """Prediction table (date, ticker, actual, predicted, probability); Up when p > t."""
    out = model.transform(df.withColumn(label, F.col(label).cast("double")))
    p = vector_to_array("probability")[1]
    return out.select("date", "ticker", F.col(label).cast("int").alias("actual"),
                      (p > threshold).cast("int").alias("predicted"), p.alias("probability"))


def select_direction_model(train: DataFrame, feature_cols, candidates=(("logistic", 0.0),
                                                                      ("logistic", 0.01),
                                                                      ("mlp", 0.0)),
                           tail_frac: float = 0.1, label: str = "label", pos: str = "pos"):
    """Model choice without looking at the test set (the reference picks its best epoch on the
    test split): the chronologically last ``tail_frac`` of the train rows (by ``pos`` from
    ``chrono_split``) validates each candidate fitted on the rest; the winner is refitted on
    the whole train split. Returns (model, validation accuracies)."""
    n = train.count()
    cut = int(n * (1.0 - tail_frac))
    head, tail = train.where(F.col(pos) <= cut), train.where(F.col(pos) > cut)
    scores = {}
    for kind, reg in candidates:
        m = fit_direction_model(head, feature_cols, label, kind=kind, reg=reg)
        pred = predict_direction(m, tail, label)
        acc = pred.agg(F.avg((F.col("predicted") == F.col("actual")).cast("double"))).first()[0]
        scores[(kind, reg)] = acc if acc is not None else -1.0
    best_kind, best_reg = max(scores, key=scores.get)
    return fit_direction_model(train, feature_cols, label, kind=best_kind, reg=best_reg), scores
