"""Sessions with the settings that the plans count on, and the folder for what they write down."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

from ..functions import sqlfunctions


def session(name: str = "cladeframe", threads: int | None = None, **settings: str) -> SparkSession:
    """A session with adaptive plans, split skewed joins, UTC and the library's SQL functions; settings of the caller
    and of the cluster win. threads count where no master is set, as on one machine."""
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    if threads:
        SparkContext._ensure_initialized()
        if not SparkConf().get("spark.master"):
            conf["spark.master"] = f"local[{threads}]"
    builder = SparkSession.builder.appName(name)
    for key, value in (conf | settings).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    sqlfunctions.register(spark)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder that spark.checkpoint.dir names; on one machine without it, in a temporary one."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="cladeframe-")
    return f"{top}/{name}-{uuid.uuid4().hex}"
