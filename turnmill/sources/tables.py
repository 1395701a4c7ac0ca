"""Typed access to the table files of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table, pruned to ``columns`` if any are named."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def records(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table whose rows may have been delivered twice, each record once.

    A repeated delivery differs from the first in its arrival time only, so a distinct over the
    content columns (combined on the map side, no sort) is enough; ``columns`` must leave the
    arrival time out.
    """
    return table(spark, folder, name, *columns).distinct()


def once(df: DataFrame, key: str, at: str) -> DataFrame:
    """Each key once, with the content of its first arrival (``at``; a null time counts as last).

    For tables whose repeated rows are not known to be equal. Ties in time are settled by the
    row's content, so that the result does not depend on the order of the rows. Rows with a null
    key are one record.
    """
    rest = [c for c in df.columns if c not in (key, at)]
    first = F.min(F.struct(F.col(at).isNull().alias("_late"), F.col(at).alias(at), *[F.col(c).alias(c) for c in rest]))
    return df.groupBy(key).agg(first.alias("_first")).select(key, *[f"_first.{c}" for c in (at, *rest)])
