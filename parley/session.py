"""Session settings and the shared scratch location.

Everything in the library is lazy DataFrame code; only this module touches session configuration.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC session clock (timestamps are compared with naive values as UTC),
# adaptive execution (runtime broadcast choice, partition coalescing, skew-join splitting), Arrow for the
# few Python stages.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(master: str = "local[8]", app: str = "parley", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """Session for tests, the bench and scripts. On a cluster, pass the cluster's own settings in ``extra``."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location (``spark.checkpoint.dir``).

    The setting is read from the session. Where it is unset a local master gets a folder under the system temp
    directory; on a cluster that folder would be another one on each machine, so an unset setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on a cluster (master {master})")
        base = tempfile.mkdtemp(prefix="parley-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return os.path.join(base, *parts, uuid.uuid4().hex) if parts else os.path.join(base, uuid.uuid4().hex)


def cut_lineage(df):
    """Reliable checkpoint (never ``localCheckpoint``): survives executor loss."""
    shared_dir(df.sparkSession)  # makes sure a checkpoint dir is registered
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Make the ``parley`` package importable in Python workers (``addPyFile`` of a zip), as
    ``--py-files`` would on a cluster. Done once per SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_parley_shipped", False):
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="parley-pkg-"), "parley.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(target)
    sc._parley_shipped = True


def bound_arrow_batches(spark: SparkSession, limit: str = "8MB") -> None:
    """Arrow batches by bytes, unless the session says otherwise: a Python worker and the JVM's side of it hold a few of
    them at a time, and rows may be texts of any length."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, limit)


def prepare(spark: SparkSession) -> SparkSession:
    """Session-level requirements of every query: UTC clock, bounded Arrow batches, a checkpoint folder, the package on
    workers."""
    ensure_utc(spark)
    bound_arrow_batches(spark)
    shared_dir(spark)
    ship_package(spark)
    return spark
