"""Keyed sinks with one commit step.

A table is a folder of Parquet parts, ``data/<part>``, and of numbered manifests, ``commits/<version>``, that
list the parts of a version and the tickers that each has lost. A writer stages its rows as a new part,
then creates the next manifest by renaming a finished file to its number, which fails if another writer
took the number; it then looks at the new version and tries again. Until the manifest stands,
readers see the version before, whole; a job that dies in between leaves a part that nobody reads.

The rename must be atomic and refuse an existing target, as HDFS does.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketframe.sources.ingest import dedup_first

ATTEMPTS = 20


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


def manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(version, content) of the last commit; version 0 has no parts."""
    folder = _path(spark, path, "commits")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    versions = [int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
    if not versions:
        return 0, {"schema": None, "parts": []}
    last = max(versions)
    text = spark.read.text(f"{path.rstrip('/')}/commits/{last:012d}.json", wholetext=True).head()[0]
    return last, json.loads(text)


def _commit(spark: SparkSession, path: str, version: int, content: dict) -> bool:
    """Whether ``content`` became the given version; False if that version is taken."""
    from py4j.protocol import Py4JJavaError
    conf = spark._jsc.hadoopConfiguration()
    draft, final = (_path(spark, path, "commits", n) for n in (f"_{uuid.uuid4().hex}", f"{version:012d}.json"))
    fs = draft.getFileSystem(conf)
    out = fs.create(draft)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    plain = spark._sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(draft, final, plain)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
            raise
        fs.delete(draft, False)
        return False
    return True


def _stage(df: DataFrame, path: str, partition_by: str | None) -> str:
    part = uuid.uuid4().hex
    rows = df.hint("rebalance", partition_by) if partition_by else df
    writer = rows.write.partitionBy(partition_by) if partition_by else rows.write
    writer.parquet(f"{path.rstrip('/')}/data/{part}")
    return part


def _rows(spark: SparkSession, path: str, content: dict) -> DataFrame | None:
    if not content["parts"]:
        return None
    schema = T.StructType.fromJson(content["schema"])
    alike: dict[tuple, list[str]] = {}
    for p in content["parts"]:
        alike.setdefault(tuple(p["without"]), []).append(f"{path.rstrip('/')}/data/{p['part']}")
    out = None
    for without, folders in alike.items():                     # one scan for all parts that lost the same tickers
        d = spark.read.schema(schema).parquet(*folders).select(*schema.names)
        if without:
            col, named = F.col(content["ticker"]), [t for t in without if t is not None]
            gone = F.coalesce(col.isin(named), F.lit(False)) | (col.isNull() if None in without else F.lit(False))
            d = d.where(~gone)
        out = d if out is None else out.unionByName(d)
    return out


def read_committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the last version; None before the first commit."""
    return _rows(spark, path, manifest(spark, path)[1])


def append_committed(incoming: DataFrame, path: str, key: str = "post_id", order=None) -> int:
    """Adds the rows whose key the table does not hold, the first of each key in ``order``, and
    returns the table's version. A call that is repeated, or runs beside another writer, adds nothing
    twice; a call that brings nothing new makes no version. Rows without a key are one key."""
    spark = incoming.sparkSession
    for _ in range(ATTEMPTS):
        version, content = manifest(spark, path)
        stored = _rows(spark, path, content)
        fresh = dedup_first(incoming, key, order)
        if stored is not None:
            known = stored.select(F.col(key).alias("_known")).distinct()
            fresh = fresh.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")
        fresh = fresh.drop(*(order or []))
        part = _stage(fresh, path, None)
        staged = spark.read.schema(fresh.schema).parquet(f"{path.rstrip('/')}/data/{part}")
        if staged.isEmpty():
            return version
        new = {"part": part, "without": []}
        if _commit(spark, path, version + 1, {**content, "schema": fresh.schema.jsonValue(), "parts": [*content["parts"], new]}):
            return version + 1
    raise RuntimeError(f"{path}: another writer took {ATTEMPTS} versions in a row")


def replace_committed(df: DataFrame, path: str, ticker: str = "ticker", tickers=None) -> int:
    """The tickers in ``df``, and those listed in ``tickers``, have just the rows of ``df`` from the
    new version on, which is returned; all other rows stay. Old parts are not touched."""
    spark = df.sparkSession
    part = _stage(df.withColumn("_ticker", F.col(ticker)), path, "_ticker")
    staged = spark.read.schema(df.schema).parquet(f"{path.rstrip('/')}/data/{part}")
    replaced = {r[0] for r in staged.select(ticker).distinct().collect()} | set(tickers or [])    # a manifest entry each
    for _ in range(ATTEMPTS):
        version, content = manifest(spark, path)
        kept = [{**p, "without": sorted({*p["without"], *replaced}, key=lambda t: (t is not None, t))}
                for p in content["parts"]]
        new = {"ticker": ticker, "schema": df.schema.jsonValue(), "parts": [*kept, {"part": part, "without": []}]}
        if _commit(spark, path, version + 1, new):
            return version + 1
    raise RuntimeError(f"{path}: another writer took {ATTEMPTS} versions in a row")


def compact(spark: SparkSession, path: str) -> int:
    """Rewrites the table as one part, so that replaced rows are no longer scanned; a write that came
    between wins, and the table stays as it is. Returns the version."""
    version, content = manifest(spark, path)
    rows = _rows(spark, path, content)
    if rows is None:
        return version
    part = _stage(rows, path, None)
    done = _commit(spark, path, version + 1, {**content, "parts": [{"part": part, "without": []}]})
    return version + 1 if done else manifest(spark, path)[0]
