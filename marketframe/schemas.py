"""Schemas, feature layouts and fixed word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# Input schemas (explicit: no schema inference on the read path)
# ---------------------------------------------------------------------------------------------

POSTS_CSV_SCHEMA = T.StructType([
    T.StructField("tweet_id", T.StringType()),
    T.StructField("writer", T.StringType()),
    T.StructField("post_date", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("comment_num", T.StringType()),
    T.StructField("retweet_num", T.StringType()),
    T.StructField("like_num", T.StringType()),
])

MAPPING_CSV_SCHEMA = T.StructType([
    T.StructField("tweet_id", T.StringType()),
    T.StructField("ticker_symbol", T.StringType()),
])

RAW_POST_COLUMNS = [
    "ticker", "platform", "post_id", "text", "author", "created_at",
    "likes_count", "retweet_count", "comment_count",
]

BAR_COLUMNS = ["ticker", "date", "open", "high", "low", "close", "volume", "adj_close"]
BAR_VALUE_COLUMNS = ["open", "high", "low", "close", "volume", "adj_close"]

HOURLY_COLUMNS = [
    "hour", "ticker", "p_negative", "p_neutral", "p_positive", "mean_sentiment", "tweet_count",
    "sentiment_std", "max_sentiment", "min_sentiment", "total_engagement", "avg_engagement",
]

# ---------------------------------------------------------------------------------------------
# These must equal the reference's for identical results.
# ---------------------------------------------------------------------------------------------

# Per-day price features in their positional order (close at index 3).
PRICE_FEATURES = [
    "open", "high", "low", "close", "adj_close",
    "log_volume",
    "return_1d", "log_return_1d", "momentum_10d",
    "SMA_10", "SMA_20", "EMA_10", "EMA_20",
    "volatility_10", "volatility_20",
    "RSI_14",
    "MACD", "MACD_signal", "MACD_hist",
    "BB_mid", "BB_upper", "BB_lower", "BB_width",
]

# Per-hour text features, then the two deltas appended per window hour.
TEXT_FEATURES = [
    "p_negative", "p_neutral", "p_positive",
    "mean_sentiment", "tweet_count", "sentiment_std",
    "max_sentiment", "min_sentiment",
]
TEXT_DELTA_FEATURES = ["delta_mean_sentiment", "delta_tweet_count"]

# Keyword list of the English detector, in the reference's order.
ENGLISH_KEYWORDS = [
    "the", "be", "to", "of", "and", "a", "in", "that", "have", "i",
    "it", "for", "not", "on", "with", "he", "as", "you", "do", "at",
    "this", "but", "his", "by", "from", "they", "we", "say", "her", "she",
    "or", "an", "will", "my", "one", "all", "would", "there", "their", "what",
    "is", "are", "was", "were", "been", "has", "had", "does", "did", "can",
    "could", "should", "about", "after", "over", "under", "up", "down",
    "stock", "market", "price", "buy", "sell", "trading", "trade",
    "shares", "earnings", "revenue", "profit", "loss", "quarter", "reports",
    "hold", "long", "short", "call", "put", "bull", "bear", "rally",
    "surge", "plunge", "dip", "gap", "eps", "guidance", "forecast",
    "inflation", "rate", "rates", "fed", "federal", "bank", "economy",
    "recession", "gdp", "cpi", "debt", "bond", "yield", "crypto", "bitcoin",
    "dividend", "split", "merger", "acquisition", "deal", "ipo", "ceo", "cfo",
    "board", "investor", "shareholder", "analyst", "target", "rating", "upgrade", "downgrade",
    "record", "high", "low", "gain", "drop", "crash", "boom", "correction",
    "volatility", "volume", "green", "red", "support", "resistance", "breakout",
]


def require_columns(df: DataFrame, cols) -> DataFrame:
    """Raise ``ValueError`` naming the missing columns (case-sensitive)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}; have {df.columns}")
    return df
