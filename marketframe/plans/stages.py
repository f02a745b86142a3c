"""End-to-end stages: the reference's three stage scripts as compositions of the operators.

Each stage reads DataFrames, writes its tables with the library's sinks (Parquet, partitioned
where a later read prunes) and returns what it wrote as DataFrames read back from storage, so a
later stage starts from materialised data instead of a long lineage.

- :func:`text_stage`: raw posts -> English filter, cleaning (F1-F9) -> scoring (X1) ->
  hourly sentiment on a gap-free grid (A4, A5, J2).
- :func:`price_stage`: raw bars + scored posts -> date bounds (A3, J8, P3), gap fill (W15),
  indicators (W1-W9), samples (W10, W11), split (W16), scaler (A9, F24).
- :func:`text_sample_stage`: hourly sentiment + raw bars -> 72-hour windows (J5, W14, P10), split.
- :func:`fusion_stage`: both sample sets -> alignment (J3, P7), split, classifier (X4), metrics
  (A10-A12) and the predictions export (S11).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.functions.text import clean_keep, html_decode_rows, with_english
from marketframe.operators import classifier as C
from marketframe.operators import fusion as FU
from marketframe.operators import hourly as H
from marketframe.operators import metrics as M
from marketframe.operators import prices as PR
from marketframe.operators import samples as S
from marketframe.operators.scoring import score_text
from marketframe.schemas import PRICE_FEATURES, TEXT_DELTA_FEATURES, TEXT_FEATURES
from marketframe.sources import files as FS


def _p(root: str, name: str) -> str:
    return os.path.join(root, name) if "://" not in root else f"{root.rstrip('/')}/{name}"


def text_stage(raw_posts: DataFrame, out: str, make_scorer=None) -> dict[str, DataFrame]:
    """Raw posts (ticker, post_id, text, created_at, likes_count, retweet_count, ...) ->
    cleaned, scored and hourly tables under ``out``."""
    spark = raw_posts.sparkSession
    eng = with_english(html_decode_rows(raw_posts, "text", "_decoded"), "text")
    cleaned = clean_keep(eng, "_decoded", "cleaned_text", keep="is_english", decode_html=False)
    cleaned = cleaned.drop("_decoded", "n_tokens", "n_hits", "is_english")
    FS.write_table(cleaned, _p(out, "cleaned_posts"), "ticker")
    cleaned = spark.read.parquet(_p(out, "cleaned_posts"))
    scored = score_text(cleaned, "cleaned_text", make_scorer)
    FS.write_table(scored, _p(out, "scored_posts"), "ticker")
    scored = spark.read.parquet(_p(out, "scored_posts"))
    hourly = H.hourly_sentiment(scored)
    FS.write_table(hourly, _p(out, "hourly_sentiment"), "ticker")
    return {"cleaned": cleaned, "scored": scored,
            "hourly": spark.read.parquet(_p(out, "hourly_sentiment"))}


def price_stage(bars: DataFrame, scored_posts: DataFrame, out: str,
                length: int = 60) -> dict[str, DataFrame]:
    """Raw bars -> cleaned bars, price samples (split, scaled) and scaler parameters."""
    spark = bars.sparkSession
    cleaned = PR.fill_gaps(PR.restrict_bars(bars, scored_posts))
    FS.write_table(cleaned, _p(out, "cleaned_bars"), "ticker")
    cleaned = spark.read.parquet(_p(out, "cleaned_bars"))
    rows = S.price_rows(cleaned)
    FS.write_table(rows, _p(out, "price_rows"))
    rows = spark.read.parquet(_p(out, "price_rows"))
    split = S.chrono_split(S.price_sample_keys(rows, length))
    stats = S.scaler_fit(S.train_row_weights(rows, split, length))
    FS.write_scaler(stats, _p(out, "price_scaler"))
    stats = spark.read.parquet(_p(out, "price_scaler"))
    keys = split.select("ticker", "date", "label", "split")
    FS.write_sequence_store(S.apply_scaler(rows, stats), keys, _p(out, "price_samples"), length=length)
    return {"cleaned": cleaned, "scaler": stats,
            "samples": FS.read_sequence_store(spark, _p(out, "price_samples"))}


def text_sample_stage(hourly: DataFrame, raw_bars: DataFrame, out: str) -> dict[str, DataFrame]:
    """Hourly sentiment grid + raw bars -> 72-hour text samples with their own split."""
    spark = hourly.sparkSession
    gd = H.hourly_deltas(hourly)
    keys = S.text_sample_keys(raw_bars, S.text_first_hours(hourly))
    windows = S.text_windows(keys, gd)
    split = S.chrono_split(keys.select("ticker", "date"))
    samples = windows.select("ticker", "date", "label", "X").join(
        split.select("ticker", "date", "split"), ["ticker", "date"])
    FS.write_samples(samples, _p(out, "text_samples"))
    return {"samples": FS.read_samples(spark, _p(out, "text_samples"))}


def fusion_stage(price_samples: DataFrame, text_samples: DataFrame, out: str,
                 kind: str = "select") -> dict[str, DataFrame]:
    """Align both sample sets (union of their splits), keep agreeing labels, re-split, pool,
    fit (``kind='select'`` chooses the model on a tail slice of train, never on test),
    predict the test rows, evaluate and export the predictions."""
    spark = price_samples.sparkSession
    p = price_samples.drop("split")
    t = text_samples.drop("split")
    al = FU.keep_agreeing(FU.align(p, t))
    n_p, n_t = len(PRICE_FEATURES), len(TEXT_FEATURES) + len(TEXT_DELTA_FEATURES)
    al = C.pool_window(C.pool_window(al, "X_price", n_p, "p"), "X_text", n_t, "t")
    feats = C.pooled_names(n_p, "p") + C.pooled_names(n_t, "t")
    sp = S.chrono_split(al.select("date", "ticker", "label", *feats))
    FS.write_table(sp, _p(out, "fusion_features"), "split")
    sp = spark.read.parquet(_p(out, "fusion_features"))
    train = sp.where(F.col("split") == "train")
    if kind == "select":
        model, _ = C.select_direction_model(train, feats)
    else:
        model = C.fit_direction_model(train, feats, kind=kind)
    pred = C.predict_direction(model, sp.where(F.col("split") == "test"))
    FS.write_predictions_csv(pred, _p(out, "predictions_csv"))
    pred = (spark.read.option("header", True).schema(pred.schema)
            .csv(_p(out, "predictions_csv")))
    return {"predictions": pred, "metrics": M.confusion(pred),
            "roc_auc": M.roc_auc(pred), "per_ticker": M.ticker_accuracy(pred)}
