"""Adapters from the driver's TPC-H-style tables to the library's inputs (FIXTURES.md §3).

The same definitions are written in SQL in ``marketframe.plans.oracle`` so both engines read the
same inputs. Every adapter is a lazy projection/aggregation of the given tables; nothing is
materialised on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions.timefn import add_hours
from marketframe.session import text_partitions

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per ticker from orders (weekdays only).

    open/close are the totals of the smallest/largest order key of the day; the aggregate is
    algebraic (``min_by``/``max_by``), so it is combined map-side before the shuffle.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate",
                                              "o_orderpriority")
    return (
        o.where(F.weekday("o_orderdate") < 5)
        .groupBy(F.col("o_orderpriority").alias("ticker"),
                 F.to_date("o_orderdate").alias("date"))
        .agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.sum("o_totalprice").alias("volume"),
        )
        .withColumn("adj_close", F.col("close"))
    )


def gappy_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with close missing on every day-of-month divisible by 7 and on each ticker's first
    row (input for the forward/backward fill)."""
    b = bars(spark, sf_dir)
    first = b.groupBy("ticker").agg(F.min("date").alias("_first"))
    return (
        b.join(first, "ticker")
        .withColumn("close", F.when((F.dayofmonth("date") % 7 == 0)
                                    | (F.col("date") == F.col("_first")),
                                    F.lit(None).cast("double")).otherwise(F.col("close")))
        .drop("_first")
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored posts from lineitem joined with orders.

    ``post_id`` is not unique (input for dedup); the source columns that order duplicates are kept
    and pruned by Catalyst when a query does not use them.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    p_neg = F.col("l_tax") * 5
    p_pos = F.col("l_discount") * 5
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .select(
            F.col("o_orderpriority").alias("ticker"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("post_id"),
            add_hours(F.col("l_shipdate"), (F.col("l_partkey") % 24).cast("int")).alias("created_at"),
            (F.col("l_quantity").cast("int") % 3).cast("long").alias("likes_count"),
            (F.col("l_linenumber") % 2).cast("long").alias("retweet_count"),
            F.lit(0).cast("long").alias("comment_count"),
            p_neg.alias("p_negative"),
            (F.lit(1.0) - p_neg - p_pos).alias("p_neutral"),
            p_pos.alias("p_positive"),
            (p_pos - p_neg).alias("sentiment_score"),
            "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        )
    )


POST_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw posts from documents, with the noise the cleaner removes added by doc_id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    sid = i.cast("string")
    t = F.col("text")
    t = F.when(i % 5 == 0, F.concat(F.lit("RT "), t)).otherwise(t)
    t = F.when(i % 3 == 0, F.concat(t, F.lit(" @user"), sid)).otherwise(t)
    t = F.when(i % 4 == 0, F.concat(t, F.lit(" http://ex.am/"), sid)).otherwise(t)
    t = F.when(i % 6 == 0, F.concat(t, F.lit(" #tag"), sid)).otherwise(t)
    t = F.when(i % 7 == 0, F.concat(t, F.lit(" 0x"), F.lpad(F.hex(i), 40, "f"))).otherwise(t)
    t = F.when(i % 8 == 0, F.concat(t, F.lit(" \U0001F600"))).otherwise(t)
    t = F.when(i % 9 == 0, F.concat(t, F.lit(" 1BoatSLRHtKNngkdXEeobR76b53LETtpyT"))).otherwise(t)     # base58
    t = F.when(i % 10 == 0, F.concat(t, F.lit(" www.ex.am/"), sid, F.lit("?a=b"))).otherwise(t)
    t = F.when(i % 11 == 0, F.concat(t, F.lit(" \u6f22\u5b57\u304b\u306a word"))).otherwise(t)      # CJK
    out = d.select(
        F.col("source").alias("ticker"),
        i.alias("post_id"),
        t.alias("text"),
        "lang",
    )
    return text_partitions(out)


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post -> ticker mapping rows (one per lineitem; ``map_order`` is the file order)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("post_id"),
        F.col("o_orderpriority").alias("ticker"),
        F.col("l_partkey").alias("map_order"),
    )


def noisy_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the post CSV from lineitem. The id is the order, so ids repeat; files follow the
    line number, so the first row of an id is that of the smallest line number. Likes of every
    fifth part are no number, other counts are written as pandas writes floats. The order is total,
    so that ranges, and with them tasks and files, are as small as the session's partitions say."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("day"))
    order = ["l_linenumber", "l_orderkey", "l_partkey", "l_suppkey", "day"]
    rows = li.orderBy(*order)
    days = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("long")
    return rows.select(
        F.col("l_orderkey").cast("string").alias("tweet_id"),
        F.concat(F.lit("writer"), (F.col("l_suppkey") % 50).cast("string")).alias("writer"),
        (days * 86400 + F.col("l_linenumber") * 61).cast("string").alias("post_date"),
        F.concat(F.lit('say "'), F.col("l_partkey").cast("string"), F.lit('"\nline, '),
                 F.col("l_suppkey").cast("string")).alias("body"),
        F.concat((F.col("l_partkey") % 4).cast("string"), F.lit(".0")).alias("comment_num"),
        (F.col("l_partkey") % 3).cast("string").alias("retweet_num"),
        F.when(F.col("l_partkey") % 5 == 0, F.lit("n/a")).otherwise(
            F.concat((F.col("l_suppkey") % 7).cast("string"), F.lit(".0"))).alias("like_num"))


def noisy_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the mapping CSV: an id repeats with other tickers; the last row wins. Every ninth
    order is not mapped. Ordered like the posts."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").where("l_orderkey % 9 <> 0")
    rows = li.orderBy("l_linenumber", "l_orderkey")
    names = F.array(F.lit("AAPL"), F.lit("GOOG"), F.lit("TSLA"))
    return rows.select(F.col("l_orderkey").cast("string").alias("tweet_id"),
                       F.get(names, (F.col("l_linenumber") % 3).cast("int")).alias("ticker_symbol"))


def noisy_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a bar CSV, a row an order: volumes and dates that do not parse."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey",
                                              F.to_date("o_orderdate").alias("day"))
    price = F.col("o_totalprice").cast("string")
    return o.select(
        F.concat(F.col("o_orderpriority"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("Ticker"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit("unknown")).otherwise(F.col("day").cast("string")).alias("Date"),
        price.alias("Open"), price.alias("High"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(price).alias("Low"), price.alias("Close"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string")).alias("Volume"))
