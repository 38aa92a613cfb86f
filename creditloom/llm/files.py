"""Binary files written and read by Spark's own sources, so that any store Spark reaches will do.

Spark has a reader for whole binary files but no writer. Its text writer writes the bytes of a
string as they are and ends each row with a separator, so a file goes out as one row (one record
per file) whose last bytes are the separator. Writers name the last bytes of their format for it.
Task attempts, lost executors and renames are left to Spark's commit protocol.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators.sizing import checkpoint_dir


def run_folder(spark: SparkSession, what: str) -> str:
    """A new folder in the shared place that the cluster names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/creditloom/{what}-{uuid.uuid4().hex}"


def write_files(rows: DataFrame, column: str, folder: str, closing: bytes) -> None:
    """One file per row of the binary ``column``; ``closing`` is appended to each."""
    (rows.select(F.col(column).cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
     .option("encoding", "ISO-8859-1").option("lineSep", closing.decode("latin-1")).text(folder))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content`` of every file that is not empty."""
    return spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "content")
