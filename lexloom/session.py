"""A session with the settings that the plans here count on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once an application, so that they need no copy of it."""
    if spark.sparkContext.applicationId not in _shipped:
        top = Path(__file__).parent
        path = Path(tempfile.mkdtemp(prefix="lexloom-")) / "lexloom.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, str(Path(top.name) / f.relative_to(top)))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(spark.sparkContext.applicationId)
    return spark


def session(name: str = "lexloom", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, UTC, and Arrow; master and partitions stay the cluster's unless given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or a temporary one where all run on this machine."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="lexloom-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/lexloom-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path
