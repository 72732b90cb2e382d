"""Session settings that the engine's semantics rest on."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def get_session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS, then the given ones (dots written as two underscores)."""
    builder = SparkSession.builder.appName("gridloom")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()


_made: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, spark.checkpoint.dir. Where that is unset, a local folder will do for a local
    master; on a cluster it is an error, as executors would not see each other's files. What is written there is deleted when the
    driver's process ends while its session is up, unless discard() has deleted it before."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/gridloom-checkpoints"
    if not _made:
        atexit.register(_clean)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete what was written to a path of scratch()."""
    if path in _made:
        _made.discard(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    with contextlib.suppress(Exception):  # the session may be gone: then the folder's owner cleans it
        for path in list(_made) if spark is not None else ():
            discard(spark, path)
