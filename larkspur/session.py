"""A session with the settings the library's results assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "larkspur", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
