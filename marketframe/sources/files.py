"""File sources and sinks.

Readers declare their schema (no inference pass over the data); sinks are Parquet/CSV writes
that Spark runs in parallel, one file per task. The reference's document store is replaced by
partitioned Parquet: ``partitionBy('ticker')`` gives partition pruning where the store used a
ticker index, and dynamic partition overwrite replaces only the tickers written (S7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions.timefn import epoch_to_ts
from marketframe.operators.samples import sequence_places, sequence_segments, sequence_windows
from marketframe.schemas import BAR_COLUMNS, MAPPING_CSV_SCHEMA, POSTS_CSV_SCHEMA, require_columns
from marketframe.sources.ingest import append_new, attach_ticker, dedup_first
from marketframe.sources.quoted_csv import read_quoted_csv


def file_order():
    """Position of a row in its source: file, block, row. ``monotonically_increasing_id`` alone is
    not enough, because Spark packs files into partitions by size."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def whole_number(c: str):
    """A count as written by pandas (``3`` or ``3.0``), truncated; NULL where it is no number."""
    return F.expr(f"coalesce(try_cast({c} AS BIGINT), try_cast(try_cast({c} AS DOUBLE) AS BIGINT))")


def read_mapping_csv(spark: SparkSession, path: str) -> DataFrame:
    """Post -> ticker mapping CSV; the id stays a string (64-bit ids are not floats).
    ``map_order`` records the file order so 'last mapping wins' is defined (J1)."""
    df = spark.read.schema(MAPPING_CSV_SCHEMA).option("header", True).csv(path)
    return df.select(F.col("tweet_id").alias("post_id"), F.col("ticker_symbol").alias("ticker"),
                     file_order().alias("map_order"))


def read_posts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Posts CSV (bodies may hold newlines). Rows whose epoch or counts are no numbers are
    skipped, as the reference skips malformed rows; counts written ``3.0`` are kept. Large files
    are split into blocks although their fields hold newlines (:mod:`marketframe.sources.quoted_csv`)."""
    raw = read_quoted_csv(spark, path, POSTS_CSV_SCHEMA).withColumnRenamed("file_order", "ingest_order")
    ints = {c: whole_number(c) for c in
            ["post_date", "comment_num", "retweet_num", "like_num"]}
    d = raw.withColumns(ints)
    ok = F.lit(True)
    for c in ints:
        ok = ok & F.col(c).isNotNull()
    return d.where(ok & F.col("tweet_id").isNotNull()).select(
        F.lit("Twitter").alias("platform"),
        F.col("tweet_id").alias("post_id"),
        F.col("body").alias("text"),
        F.col("writer").alias("author"),
        epoch_to_ts("post_date").alias("created_at"),
        F.col("like_num").alias("likes_count"),
        F.col("retweet_num").alias("retweet_count"),
        F.col("comment_num").alias("comment_count"),
        F.lit(None).cast("double").alias("sentiment_score"),
        "ingest_order",
    )


def ingest_posts(spark: SparkSession, posts_csv: str, mapping_csv: str, tickers=None,
                 multi: str = "last") -> DataFrame:
    """S1 + S2 + J1 + P2 + S8: the raw post table, one row per post id (first in file order).

    Dedup runs before the mapping join (the ticker depends only on the id, so the result is the
    same): copies of a hot id collapse in the partial aggregate instead of skewing the join."""
    posts = dedup_first(read_posts_csv(spark, posts_csv), "post_id", ["ingest_order"], keep_order=False)
    mapping = read_mapping_csv(spark, mapping_csv)
    return attach_ticker(posts, mapping, tickers=tickers, multi=multi)


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S3: daily bars from a file source. Column names are normalised case-insensitively,
    ``date`` parsed, prices cast to double (bad values -> NULL, W15 fills them) and ``adj_close``
    taken from the file when present, else the close. Missing columns raise."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    df = reader.format(fmt).load(path)
    names = {c: c.strip().lower().replace(" ", "_") for c in df.columns}
    df = require_columns(df.withColumnsRenamed(names), ["ticker", "date", "open", "high", "low", "close", "volume"])
    cols = {"date": F.coalesce(F.expr("try_cast(date AS DATE)"),
                               F.try_to_timestamp(F.col("date").cast("string")).cast("date"))}
    for c in ["open", "high", "low", "close", "volume"]:
        cols[c] = F.expr(f"try_cast({c} AS DOUBLE)")
    adj = F.expr("try_cast(adj_close AS DOUBLE)") if "adj_close" in df.columns else F.lit(None)
    cols["adj_close"] = F.coalesce(adj, cols["close"])
    return df.withColumns(cols).select(*BAR_COLUMNS)


def read_table(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """Table scan; a column list becomes the Parquet ``ReadSchema`` (pruning)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def _rebalanced(df: DataFrame, cols) -> DataFrame:
    """Before a partitioned write: the REBALANCE hint lets AQE split a hot partition value
    (a ticker with a third of the rows) over several tasks and merge small ones, so the write
    neither funnels a hot key through one task nor leaves tasks x values small files."""
    return df.hint("rebalance", *cols)


def write_table(df: DataFrame, path: str, partition_by=None) -> None:
    """Overwrite the whole table (static overwrite: partitions absent from ``df`` go too)."""
    if partition_by:
        cols = [partition_by] if isinstance(partition_by, str) else list(partition_by)
        (_rebalanced(df, cols).write.mode("overwrite")
         .option("partitionOverwriteMode", "static").partitionBy(*cols).parquet(path))
    else:
        df.write.mode("overwrite").parquet(path)


def append_posts(incoming: DataFrame, path: str, key: str = "post_id", order=None) -> None:
    """S8 sink for a plain folder with one writer: appends the rows whose key the Parquet table at
    ``path`` does not hold yet, the first of each key in ``order``. The table is created by the first
    call. Where calls may fail, be repeated or run side by side, use ``commits.append_committed``."""
    spark = incoming.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        fresh = append_new(spark.read.parquet(path), incoming, key, order)
    else:
        fresh = dedup_first(incoming, key, order)
    fresh.drop(*(order or [])).write.mode("append").parquet(path)


def replace_tickers(df: DataFrame, path: str, ticker: str = "ticker", tickers=None) -> None:
    """S7 for a plain folder: replace only the tickers present in ``df`` (dynamic partition overwrite).
    Tickers given in ``tickers`` lose their stored rows even if ``df`` has no new ones for them, once
    the new rows stand. For one commit over all tickers use ``commits.replace_committed``."""
    spark, stale = df.sparkSession, set()
    if tickers:
        fresh = {r[0] for r in df.select(ticker).where(F.col(ticker).isin(list(tickers))).distinct().collect()}
        stale = set(tickers) - fresh
    (_rebalanced(df, [ticker]).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(ticker).parquet(path))
    for t in stale:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{ticker}={t}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_samples(samples: DataFrame, path: str) -> None:
    """Sample archive as Parquet partitioned by split; dates stay dates, windows are float32."""
    if "X" in samples.columns:
        samples = samples.withColumn("X", F.col("X").cast("array<array<float>>"))
    _rebalanced(samples, ["split"]).write.mode("overwrite").partitionBy("split").parquet(path)


def write_sequence_store(rows: DataFrame, keys: DataFrame, path: str, **layout) -> None:
    """S9, compact: the feature rows once, in segments, and the samples as places in them
    (``samples.sequence_segments``, ``samples.sequence_places``). ``keys``: ticker, date, label, split."""
    sequence_places(rows, keys, **layout).write.mode("overwrite").parquet(f"{path}/places")
    sequence_segments(rows, **layout).write.mode("overwrite").parquet(f"{path}/segments")


def read_sequence_store(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """S9 source of the compact store: the samples with their windows, built while reading."""
    places = spark.read.parquet(f"{path}/places")
    places = places.where(F.col("split") == split) if split else places
    return sequence_windows(places, spark.read.parquet(f"{path}/segments"))


def read_samples(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """S9 source; reading one split prunes the other partition (U2 is reading both)."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


def write_scaler(stats: DataFrame, path: str) -> None:
    """Scaler parameters (feature, mean, scale), one small file."""
    stats.coalesce(1).write.mode("overwrite").parquet(path)


def write_predictions_csv(pred: DataFrame, path: str) -> None:
    """Predictions export (date, ticker, actual, predicted, probability) with header."""
    pred.write.mode("overwrite").option("header", True).csv(path)
