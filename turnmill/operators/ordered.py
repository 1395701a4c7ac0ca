"""Running values and runs over the ordered rows of a group, in two levels.

Rows are cut into shards that follow the order (stretches of time), worked on shard by shard, and
stitched by one row a shard, so that a group of any size is never one task's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.session import cut

#: Seconds of a transcript in one shard.
SHARD_S = 900


def time_shard(start: str, seconds: int = SHARD_S) -> Column:
    """The shard of a time in seconds; rows without a time come first, in a shard of their own."""
    return F.coalesce(F.floor(F.col(start) / seconds), F.lit(-(2**40)))


def running(df: DataFrame, group: str, order: list[str], shard: Column, **sums: Column) -> DataFrame:
    """Adds for each name in ``sums`` the sum over the earlier rows of the group (0 at first).

    ``order`` must be a total order within a group (nulls first), and ``shard`` must not fall
    along it. Null values count as 0.
    """
    local = Window.partitionBy(group, "_shard").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    x = df.withColumn("_shard", shard)
    x = x.withColumns({f"_v_{n}": F.coalesce(v, F.lit(0)) for n, v in sums.items()})
    totals = x.groupBy(group, "_shard").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(group).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(group).alias("_g"), F.col("_shard").alias("_s"), *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    x = x.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)) for n in sums})
    x = x.join(offsets, x[group].eqNullSafe(offsets["_g"]) & (x["_shard"] == offsets["_s"]))
    x = x.withColumns({n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in sums})
    return x.drop("_shard", "_g", "_s", *[f"_{k}_{n}" for k in "vlo" for n in sums])


def runs(df: DataFrame, group: str, order: list[str], shard: Column, value: str) -> DataFrame:
    """``(group, run_no, value, n, first, last)``: longest stretches of rows with the same value.

    Nulls are a value of their own. ``first`` and ``last`` are structs of the ``order`` columns.
    """
    local = Window.partitionBy(group, "_shard").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    x = df.select(group, *order, F.col(value).alias("_value"), shard.alias("_shard"))
    same = F.lag("_value").over(local).eqNullSafe(F.col("_value")) & (F.row_number().over(local) > 1)
    x = x.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct(*order)
    part = x.groupBy(group, "_shard", "_run").agg(F.first("_value").alias("_value"), F.count("*").alias("_n"), F.min(place).alias("_first"), F.max(place).alias("_last"))
    summary = part.groupBy(group, "_shard").agg(F.max("_run").alias("_runs"), F.min_by(F.struct("_value"), "_run").alias("_head"), F.max_by(F.struct("_value"), "_run").alias("_tail"))
    by = Window.partitionBy(group).orderBy("_shard")
    summary = summary.withColumn("_joined", F.coalesce((F.lag("_tail").over(by).eqNullSafe(F.col("_head"))).cast("int"), F.lit(0)))
    summary = summary.withColumn("_offset", F.coalesce(F.sum(F.col("_runs") - F.col("_joined")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    summary = summary.select(F.col(group).alias("_g"), F.col("_shard").alias("_s"), "_joined", "_offset")
    stitched = part.join(summary, part[group].eqNullSafe(summary["_g"]) & (part["_shard"] == summary["_s"]))
    stitched = stitched.withColumn("run_no", F.col("_offset") + F.col("_run") - F.col("_joined"))
    return stitched.groupBy(group, "run_no").agg(F.first("_value").alias(value), F.sum("_n").alias("n"), F.min("_first").alias("first"), F.max("_last").alias("last"))


def following(df: DataFrame, group: str, order: list[str], shard: Column, n: int, value: Column, name: str, block: int = 1000) -> DataFrame:
    """Adds ``name``: the values of a row and the ``n - 1`` rows after it in its group, joined by
    spaces. Rows near the end of a block of rows are sent to the block before as well."""
    x = running(df, group, order, shard, _row=F.lit(1)).withColumn("_value", value)
    own = (F.col("_row") / block).cast("long")
    seen = F.when((F.col("_row") % block < n - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    x = x.withColumn("_own", own).withColumn("_block", F.explode(seen))
    w = Window.partitionBy(group, "_block").orderBy("_row").rowsBetween(0, n - 1)
    return x.withColumn(name, F.concat_ws(" ", F.collect_list("_value").over(w))).where("_block = _own").drop("_row", "_value", "_own", "_block")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``, the place of each row in the given order, from 1. ``order`` must be total.

    Rows are dealt into ranges of the order and numbered inside them; only the size of each range
    is summed over all."""
    x = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = x.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row a range.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return x.withColumn("_own", own).join(offsets, "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def by_groups(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on the rows of each group of ``keys`` in the given order, as applyInPandas, but many
    groups go to Python in one batch, which pays where groups are small. Keys are not null."""

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def worked(pdf: pd.DataFrame, ends: np.ndarray) -> Iterator[pd.DataFrame]:
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                yield work(pdf.iloc[a:b])

        open_ = None
        for pdf in batches:
            pdf = pdf if open_ is None or open_.empty else pd.concat([open_, pdf], ignore_index=True)
            new = np.zeros(len(pdf), bool)
            for k in keys:
                v = pdf[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            ends = np.flatnonzero(new)
            if len(ends):
                yield pd.concat(worked(pdf, ends), ignore_index=True)
            open_ = pdf.iloc[ends[-1] if len(ends) else 0 :]
        if open_ is not None and len(open_):
            yield work(open_)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(groups, schema)
