"""Pieces that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessara.operators.sizes import shared_dir

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder. It cuts the lineage, and later reads prune its columns; losing an
    executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessara-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text in order; null: none."""
    inner = F.btrim(text, F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, none).otherwise(F.split(inner, SPACE))


def md5_fraction(text: Column, digits: int = 13) -> Column:
    """A number in [0, 1) that depends on the text alone, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("double") / float(16**digits)
