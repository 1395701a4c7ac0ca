"""Merging time intervals per entity and listing the gaps between them.

Two levels, so that one huge entity is never one task's group: intervals are clipped into time
shards and merged inside each (entity, shard); what is left to stitch per entity is at most two
pieces a shard, those that come first and last in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ten minutes. A shard has at most this many distinct starts, whatever the number of rows.
SHARD_MS = 600_000


def _islands(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``_island``: counts up wherever a row starts after everything before it has ended."""
    w = Window.partitionBy(*group).orderBy(*order)
    before = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_new", F.when(F.col("_start") <= before, 0).otherwise(1)).withColumn(
        "_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )


def coverage(df: DataFrame, entity: str, start: str, end: str, shard_ms: int = SHARD_MS) -> DataFrame:
    """``(entity, kind, start_ms, end_ms)``: each period covered without break, and each gap
    between one period and the next.

    ``start`` and ``end`` are whole milliseconds (BIGINT). Intervals that overlap, nest or touch
    belong together. Rows with a null entity, start or end, and reversed or empty intervals, do
    not count. Repeated rows change nothing; other columns are ignored; an empty table gives no
    rows. Negative times are allowed.
    """
    raw = df.select(F.col(entity).alias("_entity"), F.col(start).cast("long").alias("_start"), F.col(end).cast("long").alias("_end"))
    raw = raw.where("_entity is not null and _start < _end")
    clipped = raw.select(
        "_entity",
        F.explode(F.expr(f"sequence(floor(_start / {shard_ms}D), floor((_end - 1) / {shard_ms}D))")).alias("_shard"),
        "_start",
        "_end",
    ).select(
        "_entity",
        "_shard",
        F.greatest("_start", F.col("_shard") * shard_ms).alias("_start"),
        F.least("_end", (F.col("_shard") + 1) * shard_ms).alias("_end"),
    )
    # Combined before the shuffle: of intervals with the same start only the longest matters.
    longest = clipped.groupBy("_entity", "_shard", "_start").agg(F.max("_end").alias("_end"))
    merged = (
        _islands(longest, ["_entity", "_shard"], ["_start"])
        .groupBy("_entity", "_shard", "_island")
        .agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"))
    )
    shard = Window.partitionBy("_entity", "_shard").orderBy("_start")
    pieces = merged.select(
        "_entity", "_shard", "_start", "_end", F.lag("_end").over(shard).alias("_before"), F.lead("_start").over(shard).alias("_after")
    )
    def row(kind: str, start: Column, end: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), start.alias("_start"), end.alias("_end"))

    def listed(*rows: Column) -> Column:
        return F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull()))

    # A piece at the edge of its shard goes on to the stitching, as kind 'edge'.
    inner = F.col("_before").isNotNull() & F.col("_after").isNotNull()
    gap_before = F.when(F.col("_before").isNotNull(), row("gap", F.col("_before"), F.col("_start")))
    own = F.when(inner, row("period", F.col("_start"), F.col("_end"))).otherwise(row("edge", F.col("_start"), F.col("_end")))
    found = pieces.select("_entity", "_shard", listed(gap_before, own))
    # One pass: what is final keeps the shard as its key and goes through the same exchange as the
    # edges, which come together by entity, at most two a shard.
    edge = F.col("kind") == "edge"
    by = Window.partitionBy("_entity", "_key").orderBy("_start")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    keyed = found.withColumn("_key", F.when(~edge, F.col("_shard")))
    before = F.max("_end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    stitched = keyed.withColumns({"_until": before, "_covered": F.max("_end").over(upto), "_last_shard": F.lag("_shard").over(by)})
    stitched = stitched.withColumn("_new", F.col("_until").isNull() | (F.col("_start") > F.col("_until")))
    stitched = stitched.withColumns({"_since": F.max(F.when(F.col("_new"), F.col("_start"))).over(upto), "_closed": F.coalesce(F.lead("_new").over(by), F.lit(True))})
    gap = F.when(edge & F.col("_new") & (F.col("_last_shard") < F.col("_shard")), row("gap", F.col("_until"), F.col("_start")))
    period = F.when(edge & F.col("_closed"), row("period", F.col("_since"), F.col("_covered")))
    final = F.when(~edge, F.struct("kind", "_start", "_end"))
    return stitched.select(F.col("_entity").alias(entity), listed(gap, period, final)).toDF(entity, "kind", "start_ms", "end_ms")
