"""Session settings that suit these jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings. Wide feature rows generate large methods; above 8000 bytes the JVM would
# only interpret them, so Spark falls back to split-up projections there.
TUNING = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark
