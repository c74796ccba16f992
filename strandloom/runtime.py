"""Session helpers shared by all operators: table access, key normalisation, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only after a count shows that it has no more rows and bytes than these.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm(c: Column | str) -> Column:
    """A key as it compares and prints: without blanks at both ends, in upper case. Null stays null."""
    return F.upper(F.trim(F.col(c) if isinstance(c, str) else c))


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables that cut lineage: the session's spark.checkpoint.dir.

    Only a session without that setting (a local test session) gets a folder of its own, removed at exit.
    """
    sc = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not got:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        got = tempfile.mkdtemp(prefix="strandloom-")
        atexit.register(shutil.rmtree, got, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", got)
    return got


def session_dir(spark: SparkSession) -> str:
    """This session's own folder in shared_dir; the JVM removes it with all tables when it ends."""
    root = shared_dir(spark)
    got = spark.conf.get("strandloom.session.dir", None)
    if not got or not got.startswith(root):
        got = f"{root}/strandloom-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(got)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        spark.conf.set("strandloom.session.dir", got)
    return got


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and go on from the written table.

    Used where a result is read more than once: the plan before it runs a single time, and a lost executor
    costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(df: DataFrame) -> Column:
    """About how many bytes a row of `df` takes."""
    out = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            c = F.octet_length(c)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.length(F.to_json(F.struct(c)))
        else:
            c = F.lit(8)
        out = out + F.coalesce(c, F.lit(0))
    return out


def observed(seen: Observation) -> dict | None:
    """What an observation saw, after its job; None when the optimizer left the observed part out, as it does with empty tables."""
    try:
        return seen.get or None
    except Py4JJavaError:
        return None


def measured(df: DataFrame, **more: Column) -> tuple[DataFrame, dict]:
    """cut(df), with its rows, its bytes and the aggregates `more`, all taken in the job that writes it."""
    seen = Observation()
    facts = [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width(df)), F.lit(0)).alias("bytes"), *[c.alias(k) for k, c in more.items()]]
    written = cut(df.observe(seen, *facts))
    return written, observed(seen) or written.agg(*facts).first().asDict()


def fits(facts: dict) -> bool:
    """Whether a measured table may be broadcast."""
    return facts["rows"] <= BROADCAST_ROWS and facts["bytes"] <= BROADCAST_BYTES


def small(df: DataFrame, rows: int | None = None) -> bool:
    """True when `df` is counted to have at most `rows` rows (it stops counting there), in BROADCAST_BYTES."""
    most = BROADCAST_ROWS if rows is None else rows
    got = df.limit(most + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width(df)), F.lit(0)).alias("bytes")).first()
    return got["rows"] <= most and got["bytes"] <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint when its counted size allows one, else `df` as it is."""
    return F.broadcast(df) if small(df) else df
