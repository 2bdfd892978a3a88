"""Session construction and the shared scratch location.

Everything that must be written (CSV round trips, checkpoints) goes under the
folder named by ``spark.checkpoint.dir``: on a cluster that is a shared file
system chosen by the operator.  Only when the setting is absent (unit tests,
a laptop) do we pick a folder ourselves.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def get_spark(master: str | None = None, app: str = "cohortlens",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    ``shuffle_partitions`` is set only when given; otherwise the submitted or
    default value stands.  On a cluster it should be sized so one shuffle
    partition holds ~128-256 MB (AQE coalesces the rest).  ANSI mode stays on; operators use ``try_divide`` where a zero
    denominator is a legitimate outcome.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master:
        builder = builder.master(master)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # Spark Connect
        pass
    scratch_dir(spark)
    return spark


def scratch_dir(spark: SparkSession, *parts: str) -> str:
    """Return a fresh sub-folder of the session's checkpoint directory.

    Reads ``spark.checkpoint.dir`` from the session; sets a local one only
    when the session has none and its master is local (tests); on a cluster a
    missing setting is an error.  The SparkContext checkpoint dir is
    aligned with it so ``DataFrame.checkpoint()`` writes to the same place.
    """
    base = spark.conf.get(_CKPT_KEY, None)
    if not base:
        master = spark.conf.get("spark.master", None) or ""
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"{_CKPT_KEY} is not set: name a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/cohortlens-ckpt-{uuid.uuid4().hex[:8]}"
        spark.conf.set(_CKPT_KEY, base)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client; paths suffice
        sc = None
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    if not parts:
        return base
    return "/".join([base.rstrip("/"), *parts, uuid.uuid4().hex])
