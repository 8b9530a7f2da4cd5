"""Tables written in the folder that spark.checkpoint.dir names, which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder; where the setting is empty, a local master uses a temporary folder and a cluster, where that would not be shared, is refused."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-marquee-")
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below it."""
    return f"{shared_root(spark)}/catalog/{name}-{uuid.uuid4().hex}"
