"""Items into containers of fixed capacity: pattern packing by non-negative least squares.

Lengths are taken in 128 steps of the capacity. A pattern is a few lengths that together fill a
container; how often each pattern is used is fitted to the histogram of lengths, rounded down,
and what is left over is packed by best fit in groups. Patterns stay short (four items at most)
because items of a sixteenth to a quarter of the capacity are packed first, by the same method,
into bundles of a quarter. Smaller items are what fills the rest: they are packed by best fit into
the room that is left in containers, and into new ones. Only histograms (128 counts) and three
other numbers come to the driver.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnmill.session import cut

STEPS = 128
RATIO = 4
#: A pattern leaves at most this many steps unused.
SLACK = 6
#: Items or containers of one task where best fit packs what is left, and items of one length
#: numbered by one task.
GROUP = 20_000
NUMBERED = 200_000


def patterns(steps: int = STEPS, ratio: int = RATIO, slack: int = SLACK) -> list[tuple[int, ...]]:
    """All multisets of lengths from ``steps / ratio`` up that fill a container within ``slack``."""
    least = steps // ratio
    found = [(steps - s,) for s in range(slack + 1)]
    for n in range(1, ratio):
        for few in combinations_with_replacement(range(least, steps - least + 1), n):
            rest = steps - sum(few)
            found += [(*few, last) for last in range(max(few[-1], rest - slack), rest + 1) if last >= least]
    return found


def fit(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares by the active set method: the x >= 0 that makes |ax - b| least."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * (np.abs(a).sum() + 1) * (np.abs(b).max(initial=0) + 1)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tolerance:
            break
        active[j] = True
        while True:
            s = np.zeros_like(x)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            bad = active & (s <= 1e-12)
            if not bad.any():
                break
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.min(np.where(bad, x / (x - s), np.inf))
            x = x + (t if np.isfinite(t) else 0.0) * (s - x)
            active &= x > 1e-12
            if not active.any():
                break
        x = s
    return x


def repeats(histogram: np.ndarray, slack: int = SLACK) -> list[tuple[tuple[int, ...], int]]:
    """How often to use which pattern; no length is used more often than it is there."""
    all_ = [p for p in patterns(len(histogram) - 1, slack=slack) if all(histogram[i] for i in p)]
    if not all_:
        return []
    a = np.zeros((len(histogram), len(all_)))
    for j, p in enumerate(all_):
        for i in p:
            a[i, j] += 1
    # Long items left over cost most, so they weigh most in the fit.
    weight = np.sqrt(np.arange(len(histogram)) / len(histogram))[:, None]
    x = fit(a * weight, histogram * weight[:, 0])
    left, used = histogram.astype(int).copy(), []
    for j in np.argsort(-x):
        p = all_[j]
        need = np.bincount(p, minlength=len(left))
        own = need > 0
        n = int(min(np.floor(x[j] + 1e-9), (left[own] // need[own]).min()))
        if n > 0:
            left -= n * need
            used.append((p, n))
    # What rounding left over still goes into full patterns, the fullest first.
    for p in sorted(all_, key=lambda p: -sum(p)):
        need = np.bincount(p, minlength=len(left))
        own = need > 0
        if (n := int((left[own] // need[own]).min())) > 0:
            left -= n * need
            used.append((p, n))
    return used


def best_fit(sizes: list[int], capacity: int, rooms: list[int] | None = None) -> list[int]:
    """Best fit decreasing: the container number of each item. The first containers are those that
    have ``rooms`` left; new ones follow."""
    free = sorted((room, i) for i, room in enumerate(rooms or []))  # room left, container
    out, n = [0] * len(sizes), len(free)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(free, (sizes[i], -1))
        if at == len(free):
            room, box, n = capacity, n, n + 1
        else:
            room, box = free.pop(at)
        out[i] = box
        insort(free, (room - sizes[i], box))
    return out


def _numbered(items: DataFrame, most: int) -> DataFrame:
    """Adds ``rank``, from 0 within each length, without all items of a length in one task."""
    salts = max(1, -(-most // NUMBERED))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("item"))
    return salted.withColumn("own", own).join(offset, ["length", "salt"]).withColumn("rank", F.col("offset") + F.col("own") - 1).drop("salt", "own", "offset")


def _level(items: DataFrame, capacity: int, name: str) -> DataFrame:
    """``(item, size, box)`` of items no larger than ``capacity``."""
    spark = items.sparkSession
    items = items.withColumn("length", F.greatest(F.ceil(F.col("size") * STEPS / capacity), F.lit(1)).cast("int"))
    histogram = np.zeros(STEPS + 1)
    for length, n in items.groupBy("length").agg(F.count("*").alias("n")).collect():
        histogram[length] = n
    used = repeats(histogram)
    slots, left = [], histogram.astype(int).copy()
    taken = np.zeros(STEPS + 1, int)
    for j, (pattern, n) in enumerate(used):
        for length in sorted(set(pattern)):
            each = pattern.count(length)
            slots.append((length, int(taken[length]), int(taken[length] + n * each), j, each))
            taken[length] += n * each
    left -= taken
    slot = spark.createDataFrame(slots, "length int, low long, high long, pattern int, each int")
    numbered = _numbered(items, int(histogram.max()))
    placed = numbered.join(F.broadcast(slot), (numbered["length"] == slot["length"]) & (numbered["rank"] >= slot["low"]) & (numbered["rank"] < slot["high"]), "left")
    placed = placed.select("item", "size", F.when(F.col("pattern").isNotNull(), F.concat_ws("-", F.lit(name), "pattern", F.floor((F.col("rank") - F.col("low")) / F.col("each")))).alias("box"))
    placed = cut(placed)
    groups = max(1, -(-int(left.sum()) // GROUP))

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"])
        boxes = best_fit(pdf["size"].tolist(), capacity)
        return pd.DataFrame({"item": pdf["item"], "size": pdf["size"], "box": [f"{name}-r{g}-{b}" for g, b in zip(pdf["g"], boxes, strict=True)]})

    packed = placed.where("box is null").withColumn("g", F.pmod(F.xxhash64("item"), F.lit(groups))).groupBy("g").applyInPandas(rest, "item string, size long, box string")
    return placed.where("box is not null").unionByName(packed)


def _filled(boxed: DataFrame, small: DataFrame, capacity: int) -> DataFrame:
    """``(item, box)`` of the small items: in boxes of ``(item, size, box)`` that have room, or new."""
    rooms = boxed.groupBy("box").agg((F.lit(capacity) - F.sum("size")).alias("size")).where("size > 0")
    both = rooms.select(F.lit(None).cast("string").alias("item"), "size", "box").unionByName(small.select("item", "size", F.lit(None).cast("string").alias("box")))
    counts = both.agg(F.count("box").alias("boxes"), F.count("item").alias("items")).first()
    groups = max(1, -(-max(counts["boxes"], counts["items"]) // GROUP))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        room = pdf[pdf["item"].isna()].sort_values(["size", "box"])
        items = pdf[pdf["item"].notna()].sort_values(["size", "item"])
        names, g = room["box"].tolist(), int(pdf["g"].iloc[0])
        boxes = best_fit(items["size"].tolist(), capacity, room["size"].tolist())
        return pd.DataFrame({"item": items["item"], "box": [names[b] if b < len(names) else f"s{g}-{b}" for b in boxes]})

    return both.withColumn("g", F.pmod(F.xxhash64(F.coalesce("item", "box")), F.lit(groups))).groupBy("g").applyInPandas(fill, "item string, box string")


def pack(items: DataFrame, item_id: str, size: str, capacity: int = 8192) -> DataFrame:
    """``(item_id, piece, from_unit, to_unit, size, container)``: every item in one container.

    No container holds more than ``capacity``. Only an item that is larger than that is cut, into
    pieces that fill containers of their own and a last piece that is packed with other items. An
    empty item (or a null size) takes no room, but has its container. ``item_id`` must be unique;
    extra columns are ignored; an empty table gives no rows. The same table gives the same
    containers.
    """
    sized = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("all"))
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("all") / capacity) - 1, F.lit(0)).cast("int")))).select(
        "item_id",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("from_unit"),
        F.least("all", (F.col("piece").cast("long") + 1) * capacity).alias("to_unit"),
    )
    pieces = pieces.withColumn("size", F.col("to_unit") - F.col("from_unit")).withColumn("item", F.concat_ws("-", F.lit("i"), "item_id", "piece"))
    pieces = cut(pieces)
    quarter = capacity // RATIO
    own = pieces.select("item", "size")
    full = own.where(F.col("size") == capacity).select("item", F.col("item").alias("box"))
    small = own.where(F.col("size") <= quarter // RATIO)
    bundled = cut(_level(own.where((F.col("size") > quarter // RATIO) & (F.col("size") <= quarter)), quarter, "b"))
    bundles = bundled.groupBy(F.col("box").alias("item")).agg(F.sum("size").alias("size"))
    boxed = cut(_level(own.where((F.col("size") > quarter) & (F.col("size") < capacity)).unionByName(bundles), capacity, "c"))
    inside = bundled.select("item", F.col("box").alias("bundle")).join(boxed.select(F.col("item").alias("bundle"), "box"), "bundle").select("item", "box")
    alone = boxed.join(bundles.select("item"), "item", "left_anti").select("item", "box")
    placed = full.unionByName(inside).unionByName(alone).unionByName(_filled(boxed, small, capacity))
    return pieces.join(placed, "item").select("item_id", "piece", "from_unit", "to_unit", "size", F.col("box").alias("container"))
