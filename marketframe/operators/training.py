"""Direction classifiers trained in rounds, the best kept.

A small network (hidden layers 64 and 32, one logit, as the reference's prediction heads) is fitted by
full-batch Adam. The samples are scaled and packed into matrices once; a round is one Spark job over
the packed blocks, in which every partition sums its gradient and its validation counts and the sums
are added in a tree, so the driver gets a bounded number of vectors of the model's size. After every
round the parameters are judged on validation rows, the chronologically last part of the train
split (the test split stays unseen); the best are written to the shared folder, and training stops
when ``patience`` rounds brought nothing better.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.session import checkpoint_dir, cut_lineage

HIDDEN = (64, 32)
FAN = 64                   # vectors that are added by one task, and sent to the driver at most
BLOCK_ROWS = 4096          # samples of a packed block


@dataclass
class Model:
    """Parameters of a fitted classifier; ``features`` are scaled with the train rows' mean and std."""
    features: list[str]
    mean: list[float]
    scale: list[float]
    hidden: tuple[int, ...]
    weights: np.ndarray
    best_round: int = 0
    valid_accuracy: float = 0.0
    valid_loss: float = float("inf")
    history: list[tuple] = field(default_factory=list)      # (round, train loss, valid loss, valid accuracy)


def layer_sizes(width: int, hidden) -> list[tuple[int, int]]:
    sizes = [width, *hidden, 1]
    return list(zip(sizes[:-1], sizes[1:]))


def initial(width: int, hidden, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([np.concatenate([rng.normal(0, np.sqrt(2 / a), a * b), np.zeros(b)])
                           for a, b in layer_sizes(width, hidden)])


def unpacked(weights: np.ndarray, width: int, hidden):
    out, at = [], 0
    for a, b in layer_sizes(width, hidden):
        out.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def logits(weights: np.ndarray, x: np.ndarray, hidden) -> tuple[np.ndarray, list[np.ndarray]]:
    """(logit of every row, inputs of every layer)."""
    inputs, layers = [x], unpacked(weights, x.shape[1], hidden)
    for k, (w, b) in enumerate(layers):
        z = inputs[-1] @ w + b
        if k + 1 < len(layers):
            inputs.append(np.maximum(z, 0))
    return z[:, 0], inputs


def loss_and_gradient(weights: np.ndarray, x: np.ndarray, y: np.ndarray, hidden) -> tuple[float, np.ndarray]:
    """Summed logistic loss of the rows and its gradient."""
    z, inputs = logits(weights, x, hidden)
    loss = float(np.sum(np.logaddexp(0, z) - y * z))
    back = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)[:, None]
    parts = []
    for (w, _), a in zip(reversed(unpacked(weights, x.shape[1], hidden)), reversed(inputs)):
        parts.append(np.concatenate([(a.T @ back).ravel(), back.sum(axis=0)]))
        back = (back @ w.T) * (a > 0)
    return loss, np.concatenate(parts[::-1])


# ------------------------------------------------------------------ the data
def _scaling(train: DataFrame, features) -> tuple[list[float], list[float]]:
    r = train.agg(*[F.avg(F.col(f).cast("double")) for f in features],
                  *[F.stddev_pop(F.col(f).cast("double")) for f in features]).head()
    n = len(features)
    return [float(v or 0) for v in r[:n]], [float(v) if v else 1.0 for v in r[n:]]


def _scaled(batch, features, mean, scale) -> np.ndarray:
    x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in features]) \
        if features else np.zeros((batch.num_rows, 0))
    return np.nan_to_num((x - np.array(mean)) / np.array(scale))          # missing values: the mean


def _packed(rows: DataFrame, features, label: str, mean, scale) -> DataFrame:
    """(valid, x, y): matrices of at most ``BLOCK_ROWS`` samples."""
    def pack(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = _scaled(part, features, mean, scale)
                y = part.column(label).to_numpy(zero_copy_only=False).astype(np.float64)
                flag = part.column("_valid").to_numpy(zero_copy_only=False)
                for v in (False, True):
                    if (flag == v).any():
                        yield pa.RecordBatch.from_pydict({"valid": pa.array([v]), "x": pa.array([x[flag == v].tobytes()], pa.binary()),
                                                          "y": pa.array([y[flag == v].tobytes()], pa.binary())})

    return rows.select("_valid", label, *features).mapInArrow(pack, "valid boolean, x binary, y binary")


def _summed(parts: DataFrame, n: int, fan: int) -> np.ndarray | None:
    """Sum of the vectors of all ``n`` partitions, in a tree with ``fan`` branches."""
    def add(batches):
        import pyarrow as pa
        total = None
        for batch in batches:
            for raw in batch.column("v").to_pylist():
                v = np.frombuffer(raw)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    while n > fan:
        n = -(-n // fan)
        parts = parts.repartition(n).mapInArrow(add, "v binary")
    rows = [np.frombuffer(r.v) for r in parts.collect()]
    return np.sum(rows, axis=0) if rows else None


def _round(blocks: DataFrame, n: int, weights: np.ndarray, width: int, hidden, fan: int):
    """(train loss, train rows, valid loss, valid rows, valid hits, gradient) at ``weights``."""
    def run(batches):
        import pyarrow as pa
        total = np.zeros(5 + len(weights))
        for batch in batches:
            for valid, x, y in zip(*(batch.column(c).to_pylist() for c in ("valid", "x", "y"))):
                y = np.frombuffer(y)
                x = np.frombuffer(x).reshape(len(y), width)
                if valid:
                    z, _ = logits(weights, x, hidden)
                    total[2:5] += np.sum(np.logaddexp(0, z) - y * z), len(y), np.sum((z > 0) == (y > 0.5))
                else:
                    loss, grad = loss_and_gradient(weights, x, y, hidden)
                    total[:2] += loss, len(y)
                    total[5:] += grad
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    return _summed(blocks.mapInArrow(run, "v binary"), n, fan)


# ------------------------------------------------------------------ training
def fit_best(spark: SparkSession, train: DataFrame, features, label: str = "label", pos: str = "pos",
             hidden=HIDDEN, rounds: int = 40, patience: int = 10, rate: float = 0.01, tail_frac: float = 0.1,
             seed: int = 42, folder: str | None = None, fan: int = FAN) -> Model | None:
    """The model of the round that did best on the last ``tail_frac`` of the train rows in ``pos``
    order: most hits, then least loss. The parameters of each new best are written under ``folder``
    (one of its own in the shared folder, if none is given), so that they outlive the driver. Rows
    without a label are left out, missing features count as the mean; None without train rows."""
    features = list(features)
    train = train.where(F.col(label).isNotNull())
    n, first, last = train.agg(F.count(F.lit(1)), F.min(pos), F.max(pos)).head()
    if not n:
        return None
    cut = last - int(tail_frac * (last - first + 1))                     # positions are numbered in order
    mean, scale = _scaling(train.where(F.col(pos) <= cut), features)
    flagged = train.withColumn("_valid", F.col(pos) > cut)
    blocks = cut_lineage(_packed(flagged, features, label, mean, scale))
    partitions = blocks.rdd.getNumPartitions()
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    weights = initial(len(features), hidden, seed)
    first_moment, second = np.zeros_like(weights), np.zeros_like(weights)
    best, waited, history = None, 0, []
    for k in range(rounds + 1):
        t_loss, t_n, v_loss, v_n, hits, *gradient = _round(blocks, partitions, weights, len(features), hidden, fan)
        judged = (float(hits / v_n), float(-v_loss / v_n)) if v_n else (0.0, float(-t_loss / max(t_n, 1)))
        history.append((k, float(t_loss / max(t_n, 1)), -judged[1], judged[0]))
        if best is None or judged > (best.valid_accuracy, -best.valid_loss):
            best, waited = Model(features, mean, scale, tuple(hidden), weights.copy(), k, judged[0], -judged[1]), 0
            save_model(spark, best, folder)
        else:
            waited += 1
        if waited >= patience or k == rounds:
            break
        g = np.array(gradient) / max(t_n, 1)
        first_moment, second = 0.9 * first_moment + 0.1 * g, 0.999 * second + 0.001 * g * g
        weights = weights - rate * (first_moment / (1 - 0.9 ** (k + 1))) / (np.sqrt(second / (1 - 0.999 ** (k + 1))) + 1e-8)
    best.history = history
    return best


def save_model(spark: SparkSession, model: Model, folder: str) -> None:
    """One row under ``folder/round=<best round>``: a new best never touches the one before."""
    row = [(model.features, model.mean, model.scale, list(model.hidden), model.weights.tolist(), model.valid_accuracy,
            model.valid_loss)]
    spark.createDataFrame(row, "features array<string>, mean array<double>, scale array<double>, hidden array<int>, "
                               "weights array<double>, valid_accuracy double, valid_loss double").coalesce(1).write.mode(
        "overwrite").parquet(f"{folder}/round={model.best_round}")


def load_best(spark: SparkSession, folder: str) -> Model:
    """The best model written under ``folder``."""
    r = spark.read.parquet(folder).orderBy(F.desc("round")).head()
    return Model(list(r.features), list(r.mean), list(r.scale), tuple(r.hidden), np.array(r.weights), r.round,
                 r.valid_accuracy, r.valid_loss)


def predict(model: Model, df: DataFrame, label: str = "label", threshold: float = 0.5,
            keys=("date", "ticker")) -> DataFrame:
    """(keys, actual, predicted, probability) of every row."""
    keys = list(keys)
    head = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            z, _ = logits(model.weights, _scaled(batch, model.features, model.mean, model.scale), model.hidden)
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), batch.column("actual"), pa.array((p > threshold).astype(np.int32)),
                 pa.array(p)], [*keys, "actual", "predicted", "probability"])

    rows = df.select(*keys, F.col(label).cast("int").alias("actual"), *model.features)
    return rows.mapInArrow(run, f"{head}, actual int, predicted int, probability double")


def compare_models(spark: SparkSession, samples: DataFrame, sides: dict[str, list[str]], label: str = "label",
                   **fit) -> tuple[DataFrame, dict[str, Model]]:
    """One model per entry of ``sides`` (name -> feature columns), fitted on the same train rows: a row
    each with its rounds, validation figures and test accuracy, ``selected`` for the best on
    validation (ties: the first)."""
    train, test = (samples.where(F.col("split") == s) for s in ("train", "test"))
    models = {name: fit_best(spark, train, cols, label, **fit) for name, cols in sides.items()}
    models = {k: m for k, m in models.items() if m}
    best = max(models, key=lambda k: (models[k].valid_accuracy, -models[k].valid_loss), default=None)
    out = None
    for name, m in models.items():
        hits = predict(m, test, label).agg(F.avg((F.col("predicted") == F.col("actual")).cast("double")).alias("test_accuracy"))
        row = hits.select(F.lit(name).alias("model"), F.lit(len(m.history) - 1).alias("rounds"),
                          F.lit(m.best_round).alias("best_round"), F.lit(float(m.valid_accuracy)).alias("valid_accuracy"),
                          F.lit(float(m.valid_loss)).alias("valid_loss"), "test_accuracy", F.lit(name == best).alias("selected"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        out = spark.createDataFrame([], "model string, rounds int, best_round int, valid_accuracy double, valid_loss double, "
                                        "test_accuracy double, selected boolean")
    return out, models
