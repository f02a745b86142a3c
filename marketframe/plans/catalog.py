"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver's tables through the adapters and composes library operators; the
matching DuckDB SQL lives in :mod:`marketframe.plans.oracle`. Doubles are rounded to 6 decimals
in the projection that leaves the query (both sides), nothing else is changed for the check.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketframe.functions.numeric import rnd, sigmoid
from marketframe.operators import hourly as H
from marketframe.functions.text import clean_keep, clean_or_null, html_decode_rows, with_english
from marketframe.functions.timefn import add_hours, floor_hour, format_date, parse_date, roll_weekend
from marketframe.operators import fusion as FU
from marketframe.operators import indicators as I
from marketframe.operators import metrics as M
from marketframe.operators import prices as PR
from marketframe.operators import samples as S
from marketframe.operators import scoring as SC
from marketframe.operators import serving as SV
from marketframe.sources import ingest as IN
from marketframe.session import checkpoint_dir, cut_lineage, ensure_session_defaults
from marketframe.sources import commits as CM
from marketframe.sources import files as FS
from marketframe.sources import fixtures as FX


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating-point column (comparison projection)."""
    return df.select(*[
        rnd(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def _hourly_posts(spark, sf):
    return H.hourly_weighted(FX.posts(spark, sf))


def q_hourly_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_hourly_posts(spark, sf).select(
        "hour", "ticker", "p_negative", "p_neutral", "p_positive", "mean_sentiment",
        "tweet_count", "sentiment_std", "max_sentiment", "min_sentiment", "total_engagement",
        "avg_engagement"))


def q_hourly_grid(spark, sf):
    return rounded(H.fill_hour_grid(_hourly_posts(spark, sf)))


def q_hourly_delta(spark, sf):
    d = H.hourly_deltas(H.fill_hour_grid(_hourly_posts(spark, sf)))
    return rounded(d.select("hour", "ticker", "delta_mean_sentiment", "delta_tweet_count"))




# ----------------------------------------------------------------------------- shared builders
def _bars(spark, sf):
    return FX.bars(spark, sf)


def _price_rows(spark, sf):
    """The post-warm-up feature rows (bar-sized) feed several branches (keys, split, weights,
    sequences); a reliable checkpoint cuts the ~15-window lineage once instead of recomputing
    it per branch."""
    return cut_lineage(S.price_rows(_bars(spark, sf)))


def _price_keys(spark, sf):
    return S.price_sample_keys(_price_rows(spark, sf))


def _first_hours(spark, sf):
    p = FX.posts(spark, sf)
    return p.groupBy("ticker").agg(F.min(floor_hour(roll_weekend("created_at"))).alias("first_hour"))


def _text_keys(spark, sf):
    return S.text_sample_keys(_bars(spark, sf), _first_hours(spark, sf))


def _aligned(spark, sf):
    a = FU.align(_price_keys(spark, sf), _text_keys(spark, sf).select("ticker", "date", "label"))
    return FU.keep_agreeing(a)


def predictions(spark, sf):
    """Adapter: agreeing aligned samples with a deterministic score per date."""
    a = _aligned(spark, sf)
    prob = (F.dayofyear("date") * 37 % 101) / F.lit(101.0)
    return a.select("date", "ticker", F.col("label").alias("actual"), prob.alias("probability"))


def _dedup_posts(spark, sf):
    return IN.dedup_first(FX.posts(spark, sf), "post_id", FX.POST_ORDER)


def _english(spark, sf):
    return with_english(FX.raw_text(spark, sf))


def _cleaned(spark, sf):
    e = _english(spark, sf)
    return e.withColumn("cleaned_text", F.when(F.col("is_english"),
                                               clean_or_null("text", decode_html=False)))


def _long(c):
    return F.col(c).cast("long").alias(c)


# ----------------------------------------------------------------------------- indicators
def q_returns(spark, sf):
    d = I.returns(_bars(spark, sf))
    return rounded(d.select("ticker", "date", "return_1d", "log_return_1d"))


def q_momentum(spark, sf):
    return rounded(I.momentum(_bars(spark, sf), 10).select("ticker", "date", "momentum_10d"), 4)


def q_sma(spark, sf):
    return rounded(I.sma(_bars(spark, sf)).select("ticker", "date", "SMA_10", "SMA_20"), 4)


def q_ema(spark, sf):
    d = I.emas(_bars(spark, sf), (10, 12, 20, 26))
    return rounded(d.select("ticker", "date", "EMA_10", "EMA_12", "EMA_20", "EMA_26"), 4)


def q_volatility(spark, sf):
    d = I.volatility(I.returns(_bars(spark, sf)))
    return rounded(d.select("ticker", "date", "volatility_10", "volatility_20"))


def q_rsi(spark, sf):
    return rounded(I.rsi(_bars(spark, sf)).select("ticker", "date", "RSI_14"))


def q_macd(spark, sf):
    d = I.macd(_bars(spark, sf))
    return rounded(d.select("ticker", "date", "MACD", "MACD_signal", "MACD_hist"), 4)


def q_bollinger(spark, sf):
    d = I.bollinger(_bars(spark, sf))
    return rounded(d.select("ticker", "date", "BB_mid", "BB_upper", "BB_lower", "BB_width"), 4)


def q_direction_label(spark, sf):
    d = S.direction_label(_bars(spark, sf))
    return rounded(d.select("ticker", "date", "close", "next_close", "label"), 4)


# ----------------------------------------------------------------------------- samples
def _row_sum(r):
    return F.aggregate(r, F.lit(0.0), lambda a, v: a + v)


def _checksum(x):
    """Every value weighted by its position (day or hour) and feature: swapped rows or columns
    change it, which the plain sum would not show."""
    row = F.transform(x, lambda r, i: (i + 1) * F.aggregate(
        F.transform(r, lambda v, f: (f + 1) * v), F.lit(0.0), lambda a, v: a + v))
    return F.aggregate(row, F.lit(0.0), lambda a, v: a + v)


def q_price_sequences(spark, sf):
    s = S.price_sequences(_price_rows(spark, sf))
    x_sum = F.aggregate("X", F.lit(0.0), lambda acc, r: acc + _row_sum(r))
    out = s.select("ticker", "date", "label", F.size("X").cast("long").alias("seq_len"),
                   F.round(x_sum, 1).alias("x_sum"), F.round(_checksum("X"), 1).alias("checksum"),
                   F.col("X")[0][3].alias("first_close"), F.col("X")[59][3].alias("last_close"))
    return rounded(out, 4)


def _text_windows(spark, sf):
    hourly = cut_lineage(H.hourly_weighted(FX.posts(spark, sf)))  # grid, bounds, coverage
    gd = H.hourly_deltas(H.fill_hour_grid(hourly))
    keys = S.text_sample_keys(_bars(spark, sf), S.text_first_hours(hourly))
    return S.text_windows(keys, gd)


def q_text_windows(spark, sf):
    w = _text_windows(spark, sf)
    x_sum = F.aggregate("X", F.lit(0.0), lambda acc, r: acc + _row_sum(r))
    d_sum = F.aggregate("X", F.lit(0.0), lambda acc, r: acc + (r[8] + r[9]))
    out = w.select("ticker", "date", "label", F.col("present_hours").cast("long").alias("present_hours"),
                   F.size("X").cast("long").alias("n_hours"), x_sum.alias("x_sum"),
                   _checksum("X").alias("checksum"), d_sum.alias("delta_sum"), F.col("X")[71][3].alias("last_mean_sentiment"))
    return rounded(out)


def q_chrono_split(spark, sf):
    d = S.chrono_split(_aligned(spark, sf))
    return d.select("ticker", "date", "split", _long("pos"))


def q_class_balance(spark, sf):
    d = M.class_balance(S.chrono_split(_aligned(spark, sf)))
    return rounded(d)


def _price_split_weights(spark, sf):
    rows = _price_rows(spark, sf)  # checkpointed: used by the split and by the weights
    split = S.chrono_split(S.price_sample_keys(rows))
    return rows, S.train_row_weights(rows, split)


def q_scaler_fit(spark, sf):
    _, wr = _price_split_weights(spark, sf)
    return rounded(S.scaler_fit(wr), 4)


def q_scaler_apply(spark, sf):
    rows, wr = _price_split_weights(spark, sf)
    stats = S.scaler_fit(wr)
    return rounded(S.scale_long(rows, stats))


def q_align(spark, sf):
    return _aligned(spark, sf).select("date", "ticker", "label_price", "label_text")


# ----------------------------------------------------------------------------- prices
def q_ffill_bfill(spark, sf):
    d = PR.fill_gaps(FX.gappy_bars(spark, sf))
    return rounded(d.select("ticker", "date", "close"), 4)


def q_date_bounds(spark, sf):
    d = PR.restrict_bars(_bars(spark, sf), FX.posts(spark, sf))
    return rounded(d.select("ticker", "date", "close"), 4)


# ----------------------------------------------------------------------------- ingest
def q_dedup_posts(spark, sf):
    d = _dedup_posts(spark, sf)
    return rounded(d.select("post_id", "ticker", "created_at", "likes_count", "retweet_count",
                            "p_negative", "p_positive", "sentiment_score"))


ALLOW = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


def q_post_ticker_join(spark, sf):
    posts = _dedup_posts(spark, sf).drop("ticker")
    d = IN.attach_ticker(posts, FX.mapping(spark, sf), tickers=ALLOW)
    return d.select("post_id", "ticker", "created_at")


# ----------------------------------------------------------------------------- text
def q_english_filter(spark, sf):
    return _english(spark, sf).select("post_id", "ticker", "is_english", "n_tokens", "n_hits")


def _kept(spark, sf):
    return clean_keep(_english(spark, sf), keep="is_english", decode_html=False)


def q_clean_text(spark, sf):
    return _kept(spark, sf).select("post_id", "ticker", "cleaned_text")


def q_clean_summary(spark, sf):
    c = _cleaned(spark, sf).withColumn("kept", F.col("cleaned_text").isNotNull())
    return rounded(M.run_summary(c, "kept", by="ticker"))


def q_sentiment_lexicon(spark, sf):
    s = SC.score_text(_kept(spark, sf), "cleaned_text")
    return rounded(s.select("post_id", "p_negative", "p_neutral", "p_positive", "sentiment_score"))


def q_sentiment_buckets(spark, sf):
    return rounded(M.sentiment_buckets(FX.posts(spark, sf)))


def q_html_decode(spark, sf):
    """entity decoding of texts carrying ``&amp;``."""
    r = FX.raw_text(spark, sf)
    r = r.withColumn("text", F.when(F.col("post_id") % 2 == 0, F.concat("text", F.lit(" &amp; co")))
                     .otherwise(F.col("text")))
    return html_decode_rows(r, "text", "decoded").select("post_id", "decoded")


# ----------------------------------------------------------------------------- metrics
def q_confusion_metrics(spark, sf):
    return rounded(M.confusion(predictions(spark, sf)))


def q_roc_auc(spark, sf):
    return rounded(M.roc_auc(predictions(spark, sf)))


def q_ticker_accuracy(spark, sf):
    return rounded(M.ticker_accuracy(predictions(spark, sf)))


# ----------------------------------------------------------------------------- serving
def q_asof_lookup(spark, sf):
    pts = FX.posts(spark, sf).select("ticker", F.to_date("created_at").alias("query_date")).distinct()
    d = SV.asof_lookup(pts, _bars(spark, sf))
    return rounded(d, 4)


LAST_N_END = "2000-06-30"


def q_last_n(spark, sf):
    b = _bars(spark, sf).where(F.col("date") <= F.lit(LAST_N_END).cast("date"))
    d = SV.last_n(b, 30)
    return rounded(d.select("ticker", "date", "close", _long("rank_from_end")), 4)


def q_sample_k(spark, sf):
    d = SV.first_k(_dedup_posts(spark, sf), 200, "ticker", "post_id")
    return d.select("ticker", "post_id", "created_at", _long("rank"))


def _pred_prices(spark, sf):
    return SV.price_join(predictions(spark, sf), _bars(spark, sf))


def q_price_join(spark, sf):
    d = _pred_prices(spark, sf).select("date", "ticker", "actual", "probability", "close")
    return rounded(d, 4)


def q_projection(spark, sf):
    d = SV.project_prices(SV.projection_history(predictions(spark, sf), _bars(spark, sf)))
    return rounded(d.select("ticker", "date", "close", "predicted_close", "avg_move"), 4)


def q_day_change(spark, sf):
    d = SV.day_change(_bars(spark, sf))
    return rounded(d.select("ticker", "date", "day_change_pct"))


def q_signal(spark, sf):
    d = SV.signal(predictions(spark, sf))
    return rounded(d.select("ticker", "date", "probability", "trend", "confidence"))


def q_table_stats(spark, sf):
    return SV.first_last(FX.posts(spark, sf))


def _fusion_samples(spark, sf):
    """(samples, price feature names, text feature names): pooled scaled-price windows and pooled text
    windows of the agreeing aligned samples, split chronologically. The table is checkpointed, so that
    training passes do not recompute the lineage."""
    from marketframe.operators import classifier as C
    from marketframe.schemas import PRICE_FEATURES, TEXT_DELTA_FEATURES, TEXT_FEATURES
    rows, wr = _price_split_weights(spark, sf)
    scaled = S.apply_scaler(rows, S.scaler_fit(wr))
    pp = C.pool_rows(scaled.withColumn("_n", F.row_number().over(
        Window.partitionBy("ticker").orderBy("date"))), PRICE_FEATURES, 60, "p")
    price, text = C.pooled_names(len(PRICE_FEATURES), "p"), C.pooled_names(len(TEXT_FEATURES + TEXT_DELTA_FEATURES), "t")
    pp = pp.where((F.col("_n") >= 60) & F.col("next_close").isNotNull()).select("ticker", "date", "label", *price)
    tp = C.pool_window(_text_windows(spark, sf), "X", len(TEXT_FEATURES + TEXT_DELTA_FEATURES), "t").select(
        "ticker", "date", "label", *text)
    al = FU.keep_agreeing(pp.withColumnRenamed("label", "label_price").join(
        tp.withColumnRenamed("label", "label_text"), ["date", "ticker"]))
    return cut_lineage(S.chrono_split(al.select("date", "ticker", "label", *price, *text))), price, text


def q_fusion_predictions(spark, sf):
    """X4 + X5 (rows-only): a logistic regression on both sides' pooled windows, fitted on train,
    predicts the test rows."""
    from marketframe.operators import classifier as C
    sp, price, text = _fusion_samples(spark, sf)
    model = C.fit_direction_model(sp.where(F.col("split") == "train"), price + text)
    return C.predict_direction(model, sp.where(F.col("split") == "test"))


def _side_predictions(spark, sf, side):
    from marketframe.operators import training as TR
    sp, price, text = _fusion_samples(spark, sf)
    model = TR.fit_best(spark, sp.where(F.col("split") == "train"), {"price": price, "text": text}[side])
    return TR.predict(model, sp.where(F.col("split") == "test"))


def q_price_classifier(spark, sf):
    """X4 (rows-only): the price-only network, trained in rounds, the best on validation kept."""
    return _side_predictions(spark, sf, "price")


def q_text_classifier(spark, sf):
    """X4 (rows-only): the text-only network, trained in rounds, the best on validation kept."""
    return _side_predictions(spark, sf, "text")


def q_classifier_selection(spark, sf):
    """X4 (rows-only): price-only, text-only and fused networks on the same samples, the best selected."""
    from marketframe.operators import training as TR
    sp, price, text = _fusion_samples(spark, sf)
    return TR.compare_models(spark, sp, {"price": price, "text": text, "fused": price + text})[0]


def fusion_weight(i: int) -> float:
    """Weight of the i-th feature of a side in the stand-in fusion head."""
    return (-1.0) ** i / (i + 1)


def _momentum_predictor(idx, nf):
    """Stand-in model for X3: p(up) = sigmoid(mean over the window's last day of the scaled
    return and momentum features). Real weights plug in the same way. Everything the worker
    needs is captured here, on the driver."""
    def make():
        import numpy as np

        def predict(x):
            last = x.reshape(len(x), -1, nf)[:, -1, :]
            return 1.0 / (1.0 + np.exp(-last[:, idx].mean(axis=1)))
        return predict
    return make


def q_sequence_inference(spark, sf):
    """Batch inference over the scaled 60 x 23 price windows with
    ``predict_batch_udf`` (Arrow batches, model built once per worker)."""
    rows, wr = _price_split_weights(spark, sf)
    seqs = S.price_sequences(S.apply_scaler(rows, S.scaler_fit(wr)))
    n = 60 * len(S.PRICE_FEATURES)
    from marketframe.schemas import PRICE_FEATURES as PF
    model = _momentum_predictor([PF.index("return_1d"), PF.index("momentum_10d")], len(PF))
    out = SC.score_sequences(seqs.select("ticker", "date", "label", "X"), model, ["X"], [[n]])
    return out.select("ticker", "date", "label", F.round("probability", 4).alias("probability"))


def q_fused_inference(spark, sf):
    """X3 on both inputs, F25: every text sample's 72 x 10 window with the scaled 60 x 23 price window
    of its day, zeros where there is none, through one batch model of two tensors."""
    from marketframe.schemas import PRICE_FEATURES as PF, TEXT_DELTA_FEATURES as TD, TEXT_FEATURES as TF
    rows, wr = _price_split_weights(spark, sf)
    price = S.price_sequences(S.apply_scaler(rows, S.scaler_fit(wr)))
    model = SC.late_fusion([fusion_weight(i) for i in range(len(PF))], [fusion_weight(i) for i in range(len(TF + TD))])
    out = SC.score_fused(_text_windows(spark, sf), price, model, 72, len(TF + TD), 60, len(PF))
    return out.select("ticker", "date", "label", "has_price", F.round("probability", 4).alias("probability"))


def q_sequence_store(spark, sf):
    """The price samples written as segments and places, both splits read back (their
    windows built while reading) and checked."""
    rows = _price_rows(spark, sf)
    keys = S.chrono_split(S.price_sample_keys(rows)).select("ticker", "date", "label", "split")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/sequences-{uuid.uuid4().hex}"
    FS.write_sequence_store(rows, keys, folder)
    both = FU.union_splits(*(FS.read_sequence_store(spark, folder, s) for s in ("train", "test")))
    x = F.col("X").cast("array<array<double>>")
    good = F.forall(x, lambda r: (F.size(r) == len(S.PRICE_FEATURES)) & F.forall(r, lambda v: ~F.isnan(v)))
    out = both.select("ticker", "date", "label", "split", F.size("X").cast("long").alias("seq_len"), good.alias("good"),
                      F.round(_checksum(x), 0).alias("checksum"), x[0][3].alias("first_close"), x[59][3].alias("last_close"))
    return rounded(out, 3)


def _disagreeing(spark, sf):
    """Price labels over bars with days missing, text labels over all bars: some differ."""
    thin = _bars(spark, sf).where(F.dayofmonth("date") % 11 != 0)
    price = S.direction_label(thin).select("ticker", "date", "label")
    return FU.align(price, _text_keys(spark, sf).select("ticker", "date", "label"))


def q_agreement_report(spark, sf):
    return rounded(FU.agreement(_disagreeing(spark, sf)))


def q_keep_agreeing(spark, sf):
    return FU.keep_agreeing(_disagreeing(spark, sf))


def q_hour_reindex(spark, sf):
    """The hourly table on given hours, from a day before to ten days after each first hour."""
    hourly = cut_lineage(_hourly_posts(spark, sf))
    first = F.min("hour")
    bounds = hourly.groupBy("ticker").agg(add_hours(first, -24).alias("first_hour"), add_hours(first, 240).alias("last_hour"))
    return rounded(H.fill_hour_grid(hourly, bounds))


def q_null_report(spark, sf):
    """Missing values before and after the gap fill."""
    gappy = FX.gappy_bars(spark, sf)
    counted = [PR.null_count(d).select(F.lit(n).alias("stage"), "nulls") for n, d in (("before", gappy), ("after", PR.fill_gaps(gappy)))]
    return FU.union_splits(*counted)


def q_preview(spark, sf):
    return rounded(SV.preview(_bars(spark, sf)).select("ticker", "date", "close"), 4)


def q_extra_indicator(spark, sf):
    """A caller's indicator beside the built-in ones."""
    def spread(w):
        frame = w.rowsBetween(-4, 0)
        return F.max("close").over(frame) - F.min("close").over(frame)
    d = I.technical_indicators(_bars(spark, sf), extra={"range_5": spread})
    return rounded(d.select("ticker", "date", "range_5"), 4)


def _own_folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_scaler_store(spark, sf):
    """Scaler parameters written and read back, two of their columns."""
    folder = _own_folder(spark, "scaler")
    FS.write_scaler(S.scaler_fit(_price_split_weights(spark, sf)[1]), folder)
    return rounded(FS.read_table(spark, folder, ["feature", "mean", "scale"]), 4)


def q_predictions_export(spark, sf):
    """Predictions written as CSV and read back."""
    folder = _own_folder(spark, "predictions")
    p = predictions(spark, sf)
    p = p.select("date", "ticker", "actual", (F.col("probability") > 0.5).cast("int").alias("predicted"), "probability")
    FS.write_predictions_csv(p, folder)
    return rounded(spark.read.option("header", True).schema(p.schema).csv(folder))


def q_date_text(spark, sf):
    """dates as text and back; text that is no date becomes NULL."""
    b = _bars(spark, sf).withColumn("text", format_date("date", "dd/MM/yyyy"))
    return b.select("ticker", "text", parse_date("text", "dd/MM/yyyy").alias("parsed"),
                    parse_date(F.concat(F.lit("on "), "text"), "dd/MM/yyyy").alias("unreadable"))


def q_logit_probabilities(spark, sf):
    """sigmoid of a bar's relative move."""
    logit = 10 * (F.col("close") - F.col("open")) / F.col("open")
    return rounded(_bars(spark, sf).select("ticker", "date", sigmoid(logit).alias("probability")))


class LexiconModel:
    """The default scorer's formula as a pluggable Python model."""
    labels = ["negative", "neutral", "positive"]

    def __init__(self):
        self.words = [set(SC.NEGATIVE_WORDS), set(SC.POSITIVE_WORDS)]

    def __call__(self, texts):
        import re

        import numpy as np
        out = np.full((len(texts), 3), SC.NEUTRAL_LOGIT)
        for i, t in enumerate(texts):
            tokens = re.split(r"\W+", t.lower())
            out[i, 0], out[i, 2] = (sum(w in words for w in tokens) for words in self.words)
        return SC.pandas_probs_from_logits(out)


def q_sentiment_model(spark, sf):
    """A Python model scores the cleaned texts, batch by batch."""
    s = SC.score_text(_kept(spark, sf), "cleaned_text", make_scorer=LexiconModel)
    return rounded(s.select("post_id", "p_negative", "p_neutral", "p_positive", "sentiment_score"))


def q_append_posts(spark, sf):
    """A batch of posts committed, then all posts, of which the stored ids are ignored."""
    path, posts = _own_folder(spark, "posts"), FX.posts(spark, sf)
    for batch in (posts.where("l_partkey % 2 = 0"), posts):
        CM.append_committed(batch.withColumn("odd", F.col("l_partkey") % 2), path, order=["odd", *FX.POST_ORDER])
    d = CM.read_committed(spark, path)
    return rounded(d.select("post_id", "ticker", "created_at", "likes_count", "p_positive"))


def q_replace_tickers(spark, sf):
    """One ticker's bars replaced by others, one listed without new rows, in one commit."""
    path, b = _own_folder(spark, "bars"), _bars(spark, sf)
    CM.replace_committed(b, path)
    new = b.where((F.col("ticker") == "1-URGENT") & (F.dayofmonth("date") % 2 == 0)).withColumn("close", F.col("close") * 2)
    CM.replace_committed(new, path, tickers=["2-HIGH"])
    return rounded(CM.read_committed(spark, path).select("ticker", "date", "close"), 4)


def q_ingest_posts(spark, sf):
    """A noisy post CSV and a mapping CSV (several files each, counts written
    ``3.0``, rows without a number, repeated ids) are written to the shared folder and read back."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    posts, mapping = FX.noisy_posts(spark, sf), FX.noisy_mapping(spark, sf)
    options = {"header": True, "quoteAll": True, "escape": '"'}
    posts.write.options(**options).csv(f"{folder}/posts")
    mapping.write.options(**options).csv(f"{folder}/mapping")
    d = FS.ingest_posts(spark, f"{folder}/posts", f"{folder}/mapping")
    return d.select("post_id", "ticker", "text", "author", "created_at", "likes_count", "retweet_count", "comment_count")


def q_read_bars(spark, sf):
    """S3: a bar CSV with ``n/a`` values and unreadable dates, written and read back."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/bars-{uuid.uuid4().hex}"
    FX.noisy_bars(spark, sf).write.option("header", True).csv(folder)
    return rounded(FS.read_bars(spark, folder, fmt="csv"), 4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "hourly_weighted": q_hourly_weighted,
    "hourly_grid": q_hourly_grid,
    "hourly_delta": q_hourly_delta,
    "returns": q_returns,
    "momentum": q_momentum,
    "sma": q_sma,
    "ema": q_ema,
    "volatility": q_volatility,
    "rsi": q_rsi,
    "macd": q_macd,
    "bollinger": q_bollinger,
    "direction_label": q_direction_label,
    "price_sequences": q_price_sequences,
    "text_windows": q_text_windows,
    "chrono_split": q_chrono_split,
    "class_balance": q_class_balance,
    "scaler_fit": q_scaler_fit,
    "scaler_apply": q_scaler_apply,
    "align": q_align,
    "ffill_bfill": q_ffill_bfill,
    "date_bounds": q_date_bounds,
    "dedup_posts": q_dedup_posts,
    "post_ticker_join": q_post_ticker_join,
    "english_filter": q_english_filter,
    "clean_text": q_clean_text,
    "clean_summary": q_clean_summary,
    "sentiment_lexicon": q_sentiment_lexicon,
    "sentiment_buckets": q_sentiment_buckets,
    "confusion_metrics": q_confusion_metrics,
    "roc_auc": q_roc_auc,
    "ticker_accuracy": q_ticker_accuracy,
    "asof_lookup": q_asof_lookup,
    "last_n": q_last_n,
    "sample_k": q_sample_k,
    "price_join": q_price_join,
    "projection": q_projection,
    "day_change": q_day_change,
    "signal": q_signal,
    "table_stats": q_table_stats,
    "ingest_posts": q_ingest_posts,
    "read_bars": q_read_bars,
    "html_decode": q_html_decode,
    "fusion_predictions": q_fusion_predictions,
    "sequence_inference": q_sequence_inference,
    "fused_inference": q_fused_inference,
    "sequence_store": q_sequence_store,
    "agreement_report": q_agreement_report,
    "keep_agreeing": q_keep_agreeing,
    "hour_reindex": q_hour_reindex,
    "null_report": q_null_report,
    "preview": q_preview,
    "extra_indicator": q_extra_indicator,
    "scaler_store": q_scaler_store,
    "predictions_export": q_predictions_export,
    "date_text": q_date_text,
    "logit_probabilities": q_logit_probabilities,
    "sentiment_model": q_sentiment_model,
    "append_posts": q_append_posts,
    "replace_tickers": q_replace_tickers,
    "price_classifier": q_price_classifier,
    "text_classifier": q_text_classifier,
    "classifier_selection": q_classifier_selection,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_session_defaults(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        return run
    return {k: wrap(v) for k, v in QUERIES.items()}
