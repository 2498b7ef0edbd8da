"""Spark sessions with the settings that the plans expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "graphloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC.  Under ``local[n]`` there are
    as many shuffle partitions as threads; a cluster's own setting is kept."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local["):
            builder = builder.config("spark.sql.shuffle.partitions", str(int(master[6:-1]) if master[6:-1].isdigit() else os.cpu_count()))
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
