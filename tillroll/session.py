"""Session construction and the shared scratch location.

On a cluster the session is built by the platform; ``get_session`` only fills
settings that are still unset so that tests and local runs behave like the
cluster (UTC, AQE on, no UI).  ``scratch_dir`` resolves the shared folder
named by ``spark.checkpoint.dir``; a local temporary folder is used only when
that setting is absent and the master is local (tests, laptops).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tillroll") -> SparkSession:
    """Return the active session, creating a local one when none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, name: str = "") -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables.

    Reads ``spark.checkpoint.dir`` from the session.  Only when it is unset
    and everything runs in one local process (tests, local runs) a temporary
    folder is created and registered as the checkpoint dir, so
    ``DataFrame.checkpoint()`` works too.  On a cluster every node would write
    to its own disk, so a missing setting raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all nodes of {master or 'the cluster'} share")
        base = tempfile.mkdtemp(prefix="tillroll-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
        try:
            spark.sparkContext.setCheckpointDir(base)
        except Exception:  # noqa: BLE001 - no SparkContext (e.g. Spark Connect)
            pass
    sub = f"{name or 'table'}-{uuid.uuid4().hex[:12]}"
    return os.path.join(base.rstrip("/"), sub)
