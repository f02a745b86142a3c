"""Text scoring (X1, X2, F20, F21) and batch sequence inference.

``score_text`` returns (sentiment_score, p_negative, p_neutral, p_positive). The default scorer
is a small native lexicon (array functions in the JVM), so the pipeline runs without a model.
A real classifier plugs in through ``make_scorer`` (or ``model``): an iterator pandas UDF over the
text column feeds it Arrow batches; the other columns stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketframe.functions.numeric import softmax3
from marketframe.functions.text import ascii_tokens, keyword_hits, not_blank

# Stand-in lexicon of the default scorer (replaceable through ``make_scorer``).
POSITIVE_WORDS = ["gain", "gains", "up", "rally", "surge", "profit", "beat", "bull", "bullish",
                  "buy", "growth", "strong", "upgrade", "boom", "green", "breakout", "record",
                  "good", "great", "rise"]
NEGATIVE_WORDS = ["loss", "losses", "down", "drop", "crash", "plunge", "bear", "bearish", "sell",
                  "weak", "downgrade", "recession", "debt", "red", "miss", "fall", "bad", "risk",
                  "decline", "fear"]
NEUTRAL_LOGIT = 1.0

SCORE_COLS = ["sentiment_score", "p_negative", "p_neutral", "p_positive"]


def lexicon_scores(text_col: str = "cleaned_text") -> dict:
    """Native lexicon scorer: logits (negative hits, 1, positive hits) -> softmax (F21);
    polarity = p_positive - p_negative (F20)."""
    toks = ascii_tokens(F.col(text_col))
    neg = keyword_hits(toks, NEGATIVE_WORDS).cast("double")
    pos = keyword_hits(toks, POSITIVE_WORDS).cast("double")
    pn, pu, pp = softmax3(neg, F.lit(NEUTRAL_LOGIT), pos)
    return {"p_negative": pn, "p_neutral": pu, "p_positive": pp}


def check_label_order(labels) -> None:
    """The scorer's class 0 must be 'negative' (then neutral, positive)."""
    if not labels or str(labels[0]).lower() != "negative":
        raise ValueError(f"scorer label order must start with 'negative', got {labels!r}")


def score_text(df: DataFrame, text_col: str = "cleaned_text",
               make_scorer: Callable | None = None, batch_size: int = 32, model=None) -> DataFrame:
    """Score non-blank texts (P5); blank texts are dropped as in the reference.

    ``make_scorer()`` must return an object with ``labels`` (X2) and ``__call__(list[str]) ->
    array[n, 3]`` of class probabilities (negative, neutral, positive); ``model`` is such an object
    itself and is broadcast once. Only the text column goes to Python.
    """
    d = df.where(not_blank(text_col))
    if make_scorer is None and model is None:
        probs = lexicon_scores(text_col)
        d = d.withColumns(probs)
        return d.withColumn("sentiment_score", F.col("p_positive") - F.col("p_negative"))

    if model is not None:
        shared = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
        make_scorer = lambda: cloudpickle.loads(shared.value)
    scored = d.withColumn("_p", _probabilities(make_scorer, batch_size)(F.col(text_col)))
    p = {c: F.col(f"_p.{c}") for c in SCORE_COLS[1:]}
    return scored.withColumns({"sentiment_score": p["p_positive"] - p["p_negative"], **p}).drop("_p")


def _probabilities(make_scorer: Callable, batch_size: int):
    """Pandas UDF text -> struct of class probabilities; the scorer is made once per task."""
    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        check_label_order(getattr(scorer, "labels", None))
        for texts in batches:
            texts = texts.astype(str).tolist()
            parts = [np.asarray(scorer(texts[i:i + batch_size]), dtype="float64").reshape(-1, 3)
                     for i in range(0, len(texts), batch_size)]
            yield pd.DataFrame(np.vstack([np.zeros((0, 3)), *parts]), columns=SCORE_COLS[1:])

    return F.pandas_udf(probabilities, ", ".join(f"{c} double" for c in SCORE_COLS[1:]))


def score_sequences(df: DataFrame, make_predict_fn: Callable, input_cols, shapes,
                    out: str = "probability", batch_size: int = 256) -> DataFrame:
    """Batch inference over sample tensors with ``predict_batch_udf``; the model built by
    ``make_predict_fn`` is loaded once per worker and gets numpy batches of the given shapes.
    Nested ``array<array<double>>`` columns are flattened first (the UDF takes 1-D tensors)."""
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_predict_fn, return_type=T.DoubleType(), batch_size=batch_size,
                            input_tensor_shapes=[list(s) for s in shapes])
    cols = []
    for c in input_cols:
        dt = df.schema[c].dataType
        nested = isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.ArrayType)
        cols.append(F.flatten(c) if nested else F.col(c))
    return df.withColumn(out, udf(*cols))


def score_fused(text: DataFrame, price: DataFrame, make_predict_fn: Callable, hours: int, text_features: int,
                days: int, price_features: int, keys=("ticker", "date"), x: str = "X", out: str = "probability",
                batch_size: int = 256) -> DataFrame:
    """X3 on both sides: every text sample with the price sample of its key, zeros where there is none
    (F25). ``make_predict_fn()`` returns a function of two arrays, prices (n, days, price features) and
    texts (n, hours, text features). ``has_price`` tells the zeros apart."""
    from pyspark.ml.functions import predict_batch_udf

    keys = list(keys)
    side = price.select(*keys, F.flatten(x).alias("_price"))
    zeros = F.array_repeat(F.lit(0.0), days * price_features)
    udf = predict_batch_udf(make_predict_fn, return_type=T.DoubleType(), batch_size=batch_size,
                            input_tensor_shapes=[[days, price_features], [hours, text_features]])
    both = text.withColumn("_text", F.flatten(x)).drop(x).join(side, keys, "left")
    return both.withColumns({"has_price": F.col("_price").isNotNull(),
                             out: udf(F.coalesce("_price", zeros), "_text")}).drop("_price", "_text")


def late_fusion(price_weights, text_weights, bias: float = 0.0) -> Callable:
    """Model for :func:`score_fused`: both windows are encoded by their feature means over time, the
    encodings are concatenated and a logistic head weighs them."""
    head = [float(v) for v in [*price_weights, *text_weights]]

    def make():
        import numpy as np
        w = np.array(head)

        def predict(price, text):
            encoded = np.concatenate([price.mean(axis=1), text.mean(axis=1)], axis=1)
            return 1.0 / (1.0 + np.exp(-(encoded @ w + bias)))
        return predict
    return make


def pandas_probs_from_logits(logits: np.ndarray) -> np.ndarray:
    """Softmax over the last axis (helper for user scorers)."""
    z = logits - logits.max(axis=-1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=-1, keepdims=True)


__all__ = ["score_text", "score_sequences", "score_fused", "late_fusion", "lexicon_scores", "check_label_order",
           "pandas_probs_from_logits"]
