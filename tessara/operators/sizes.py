"""When a side may be broadcast, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def small(df: DataFrame, rows: int, megabytes: int = 32) -> DataFrame:
    """df with a broadcast hint if it has no more than `rows` rows and these, written out, take no more than `megabytes`;
    else Spark shuffles both sides of the join."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).cast("long")
    n, taken = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and taken <= megabytes << 20 else df


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a temporary folder only where it is unset and all runs on one
    machine. On a cluster without it this fails, as executors can't read each other's folders."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessara-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: a lost executor loses none of it."""
    path = f"{shared_dir(df.sparkSession)}/tessara-step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
