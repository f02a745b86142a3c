"""Ingest operators: post-ticker mapping join (J1), allow-list (P2), unique-key dedup.

Dedup and mapping reduction are ``groupBy`` + ``min_by``/``max_by``: declarative aggregates
that Spark combines map-side, so a post id copied a million times costs one partial row per
task instead of one giant window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_first(df: DataFrame, key: str = "post_id", order=None, keep_order: bool = True) -> DataFrame:
    """Keep one row per ``key``: the first by ``order`` (columns defining ingest order). Without
    ``keep_order`` these columns go, and are not sorted and shuffled a second time with the others."""
    order = list(order or [])
    payload = [c for c in df.columns if c != key and (keep_order or c not in order)]
    ordkey = F.struct(*[F.col(c) for c in order]) if order else F.struct(*[F.col(c)
                                                                         for c in payload])
    kept = df.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in payload]), ordkey)
                               .alias("_r"))
    return kept.select(key, *[F.col(f"_r.{c}").alias(c) for c in payload])


def append_new(existing: DataFrame, incoming: DataFrame, key: str = "post_id",
               order=None) -> DataFrame:
    """S8 when appending: rows whose key is already stored are ignored (anti-join)."""
    fresh = dedup_first(incoming, key, order)
    return fresh.join(existing.select(key), key, "left_anti")


def reduce_mapping(mapping: DataFrame, key: str = "post_id", ticker: str = "ticker",
                   order: str = "map_order", multi: str = "last") -> DataFrame:
    """J1 mapping: 'last' keeps the last ticker per id in ``order`` (later rows overwrite earlier
    ones in a dict); 'all' keeps every (id, ticker) pair."""
    if multi == "all":
        return mapping.select(key, ticker).distinct()
    return mapping.groupBy(key).agg(
        F.max_by(F.col(ticker), F.struct(F.col(order), F.col(ticker))).alias(ticker))


def allow_tickers(df: DataFrame, tickers=None, ticker: str = "ticker") -> DataFrame:
    """Optional ticker allow-list (``isin`` becomes a hash-set test)."""
    if not tickers:
        return df
    return df.where(F.col(ticker).isin(list(tickers)))


def attach_ticker(posts: DataFrame, mapping: DataFrame, key: str = "post_id",
                  tickers=None, multi: str = "last", order: str = "map_order") -> DataFrame:
    """J1 + P2: the allow-list filters the mapping first, then the mapping is reduced and inner
    joined with the posts; posts without a mapping are dropped. Spark picks broadcast or sort-merge from the measured mapping size."""
    m = reduce_mapping(allow_tickers(mapping, tickers), key, "ticker", order, multi)
    return posts.join(m, key)
