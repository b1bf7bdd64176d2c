"""Session factory with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tessera", master: str | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    b = b.master(master) if master else b
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    for k, v in (base | {k.replace("__", "."): str(v) for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
