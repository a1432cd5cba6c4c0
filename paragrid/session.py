"""Session helpers: safe defaults and the shared checkpoint folder."""

from __future__ import annotations

import pickle
import re
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "paragrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors share.

    It is the session's ``spark.checkpoint.dir``; only a session on one machine
    without that setting (tests) gets a temporary folder of its own.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="paragrid-checkpoint-")
        context.setCheckpointDir(folder)
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sent_packed(spark: SparkSession, value: tuple) -> Callable[[], tuple]:
    """A function that gives ``value`` to tasks; it is sent compressed, as the driver and each executor keep it on their disks."""
    raw = pickle.dumps(value, pickle.HIGHEST_PROTOCOL)
    sent, size = spark.sparkContext.broadcast(pa.compress(raw, "zstd", asbytes=True)), len(raw)
    return lambda: pickle.loads(pa.decompress(sent.value, size, "zstd", asbytes=True))
