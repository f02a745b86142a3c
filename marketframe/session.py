"""Session configuration.

Timestamps are kept as ``timestamp_ntz`` end to end and the session zone is pinned to UTC, so
results do not depend on the machine's zone. AQE is on (runtime coalescing, skew-join splitting,
broadcast switching from measured sizes). Partition-overwrite semantics are set per write by the
sinks (full overwrite vs. replace only the written tickers), not session-wide.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "marketframe",
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench. On a cluster, use the cluster's session and call
    :func:`ensure_session_defaults` on it instead."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        # checkpoint files of DataFrames that went out of scope are removed by the cleaner
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_session_defaults(spark)
    return spark


def ensure_session_defaults(spark: SparkSession) -> SparkSession:
    """Pin the SQL settings the library relies on (runtime-settable ones only)."""
    for k, v in SESSION_DEFAULTS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)    # raises where a setting is locked: results depend on the zone
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a session whose executors run inside the driver (``local[...]``) gets a
    fresh folder; any other session raises, since a folder of one machine is not shared.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="mf-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df):
    """Reliable checkpoint (never ``localCheckpoint``): survives executor loss because the data
    is written to the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_released(df):
    """:func:`cut_lineage`, after which Spark removes the shuffle files that ``df`` was made from. Else
    they stay until the driver happens to collect its garbage, beside those of the steps that follow."""
    conf = df.sparkSession.conf
    before = conf.get(_RELEASE, None)
    conf.set(_RELEASE, "true")
    try:
        return cut_lineage(df.select("*"))      # a frame takes the setting when it is made
    finally:
        if before is None:
            conf.unset(_RELEASE)
        else:
            conf.set(_RELEASE, before)


#: Session setting: partitions that CPU-bound text work is dealt out over. Unset: as scanned.
TEXT_PARTITIONS = "marketframe.text.partitions"


def text_partitions(df):
    """Deals rows out over the stated number of partitions, for tables in a few unsplittable files.
    Without the setting the scan's own splits (``spark.sql.files.maxPartitionBytes``) stand and
    nothing is shuffled."""
    n = df.sparkSession.conf.get(TEXT_PARTITIONS, None)
    return df.repartition(int(n)) if n else df
