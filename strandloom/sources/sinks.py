"""Writers of delimited text, FASTA and result tables, and a cache of derived tables."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.sources.tables import six_digits


def write_table(df: DataFrame, path: str, header: bool = True, sep: str = "\t", null: str = "") -> None:
    """A delimited text without quoting; nulls as the given word."""
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(null)).alias(c) for c in df.columns])
    line = text.select(F.concat_ws(sep, *[F.col(c) for c in df.columns]).alias("value"))
    if header:
        line = df.sparkSession.createDataFrame([(sep.join(df.columns),)], "value string").coalesce(1).union(line)
    line.write.mode("overwrite").option("compression", "gzip" if path.endswith(".gz") else "none").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Statistic and value with six significant digits, in the metrics' order."""
    write_table(metrics.orderBy("no").select(F.col("statistic").alias("Statistic"), six_digits("value").alias("Value")), path)


def cached(spark: SparkSession, source: str, folder: str, build) -> DataFrame:
    """build() as a Parquet table kept by the source's path, size and time; a changed source is built anew and its old tables are removed."""
    st = os.stat(source)
    stem = hashlib.md5(os.path.abspath(source).encode()).hexdigest()[:16]
    path = os.path.join(folder, f"{stem}-{st.st_size}-{st.st_mtime_ns}")
    if not os.path.exists(os.path.join(path, "_SUCCESS")):
        import shutil

        for old in os.listdir(folder) if os.path.isdir(folder) else ():
            if old.startswith(f"{stem}-"):
                shutil.rmtree(os.path.join(folder, old), ignore_errors=True)
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
