"""Long exact spans shared between records, by prefix-partitioned sparse suffix trees.

Every run of ``min_len`` characters holds an anchor that depends on the run alone: the place
where the fingerprint of the next ``prefix`` characters is least. So two records that share a run
have the suffixes at its anchor in the same subtree, that of the suffixes opening with those
characters, and only anchored suffixes, one in some dozens, go into trees. Subtrees are the groups
of a shuffle in which the suffixes are sorted; longest common prefixes of neighbours give the
inner nodes. As an anchor may lie anywhere in a run, the letters before it form a second tree, of
reversed prefixes. A node of string depth ``min_len - l`` in the one and a node of depth ``l`` in
the other, with suffixes of two records in both, are a shared run that begins ``l`` letters before
the anchor. Equality is that of letters everywhere; fingerprints only bring suffixes together.

Prefixes are of variable length: where more than ``max_group`` suffixes open alike, the subtree
is split by everything it takes to fill ``min_len`` characters (the run itself), and those groups
only count whether a second text holds them, which combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnmill.session import cut

MIN_LEN = 120
PREFIX = 48
MAX_GROUP = 20_000
#: Characters of text whose anchors are found together.
LETTERS = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of a fingerprint (a 64-bit finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit fingerprints of all runs of ``n`` codes: a polynomial, by doubling of the length."""
    letters = _mix(codes.astype(np.uint64) + np.uint64(1))
    power, at = _BASE, {1: letters}
    powers, size = {1: power}, 1
    while size * 2 <= n:
        half = at[size]
        at[size * 2] = half[: len(half) - size] * powers[size] + half[size:]
        powers[size * 2] = (powers[size].reshape(1) * powers[size])[0]
        size *= 2
    out, done = None, 0
    for size in sorted(at, reverse=True):
        if n & size:
            part = at[size]
            out = part if out is None else out[: len(codes) - done - size + 1] * powers[size] + part[done : done + len(codes) - done - size + 1]
            done += size
    return _mix(out)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchors(codes: np.ndarray, min_len: int, prefix: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of a text, or of texts one after the other that end at ``ends``, and
    the fingerprints of the prefixes there."""
    if len(codes) < min_len:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _rolling(codes, prefix)
    width = min_len - prefix + 1
    # The least of each window of ``width`` places: prefix and suffix minima of blocks that wide.
    n = len(h) - width + 1
    pad = -len(h) % width
    blocks = np.append(h, np.full(pad, np.iinfo(np.uint64).max)).reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(right[:n], left[width - 1 : width - 1 + n])
    for end in [] if ends is None else ends:  # windows over the end of a text do not count
        least[max(end - min_len + 1, 0) : end] = 0
    # All places that are the least of some window that holds them.
    reach = np.concatenate([np.full(width - 1, 0, np.uint64), least, np.full(width - 1, 0, np.uint64)])
    pad = -len(reach) % width
    blocks = np.append(reach, np.zeros(pad, np.uint64)).reshape(-1, width)
    left = np.maximum.accumulate(blocks, 1).ravel()
    right = np.maximum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    most = np.maximum(right[: len(h)], left[width - 1 : width - 1 + len(h)])
    at = np.flatnonzero(h == most)
    return at, h[at]


def _anchored(pdf: pd.DataFrame, min_len: int, prefix: int) -> Iterator[pd.DataFrame]:
    """``(subtree, text_id, at)`` of the anchors of texts, some at a time."""
    sizes = pdf["text"].str.len().to_numpy()
    part = np.cumsum(sizes) // LETTERS
    for _, own in pdf.groupby(part, sort=False):
        ends = np.cumsum(own["text"].str.len().to_numpy())
        at, h = anchors(_codes("".join(own["text"])), min_len, prefix, ends)
        text = np.searchsorted(ends, at, "right")
        yield pd.DataFrame({"subtree": h.view(np.int64), "text_id": own["text_id"].to_numpy()[text], "at": (at - np.append(0, ends)[text]).astype(np.int32)})


def _letters(strings: list[str], width: int) -> np.ndarray:
    """Letters as a matrix, a string a row, filled up with noughts."""
    return _codes("".join([x.ljust(width, "\0") for x in strings])).reshape(len(strings), width)


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many letters the rows of two matrices have in common at the start, ``most`` at most."""
    differ = a != b
    return np.minimum(np.where(differ.any(1), differ.argmax(1), a.shape[1]), most)


def _shared(pdf: pd.DataFrame, min_len: int, prefix: int) -> pd.DataFrame:
    """Of whole subtrees, sorted by ``subtree``, ``ahead``, ``back``: what each suffix shares with
    other texts, as stretches around its anchor."""
    none = pd.DataFrame({"text_id": [], "start": [], "end": []}, dtype="int64")
    if pdf.empty:
        return none
    width = min_len - prefix
    sub, text, at = (pdf[c].to_numpy() for c in ("subtree", "text_id", "at"))
    ahead, back = pdf["ahead"].tolist(), pdf["back"].tolist()
    n_ahead, n_back = np.array([len(x) for x in ahead]), np.array([len(x) for x in back])
    f, b = _letters(ahead, min_len), _letters(back, width)
    lcp = np.where(sub[1:] == sub[:-1], _common(f[1:], f[:-1], np.minimum(n_ahead[1:], n_ahead[:-1])), -1)
    alike = (lcp == n_ahead[1:]) & (n_ahead[1:] == n_ahead[:-1]) & (n_back[1:] == n_back[:-1]) & (b[1:] == b[:-1]).all(1)
    # Leaves: suffixes with the same surroundings. One that two texts hold shares all of it.
    leaf = np.append(0, np.cumsum(~alike))
    first = np.flatnonzero(np.append(True, ~alike))
    lo, hi = np.minimum.reduceat(text, first), np.maximum.reduceat(text, first)
    least, most = np.full(len(first), min_len), np.full(len(first), -1)  # letters before the anchor
    whole = lo != hi
    least[whole], most[whole] = np.maximum(min_len - n_ahead[first], 0)[whole], n_back[first][whole]
    # The others need a node below which there is another text; only subtrees with such leaves.
    group = np.append(0, np.cumsum(np.diff(sub[first]) != 0))
    sizes, open_ = np.bincount(group), np.bincount(group, ~whole)
    keep = np.flatnonzero(((sizes > 1) & (open_ > 0))[group])
    if len(keep):
        g, own = group[keep], first[keep]
        lcp = np.append(-1, lcp)[own]  # of neighbouring leaves
        backward = np.array(sorted(range(len(keep)), key=lambda i: (g[i], back[own[i]])))
        rows = own[backward]
        lcs = np.append(-1, np.where(g[backward][1:] == g[backward][:-1], _common(b[rows[1:]], b[rows[:-1]], np.minimum(n_back[rows[1:]], n_back[rows[:-1]])), -1))
        behind = np.empty(len(keep), np.int64)
        for before in range(width + 1):
            behind[backward] = np.cumsum(lcs < before)
            node = np.cumsum(lcp < min_len - before) * (len(keep) + 1) + behind
            fits = np.flatnonzero((n_ahead[own] >= min_len - before) & (n_back[own] >= before))
            if not len(fits):
                continue
            order = fits[np.argsort(node[fits], kind="stable")]
            starts = np.flatnonzero(np.append(True, np.diff(node[order]) != 0))
            several = np.minimum.reduceat(lo[keep[order]], starts) != np.maximum.reduceat(hi[keep[order]], starts)
            found = keep[order[np.repeat(several, np.diff(np.append(starts, len(order))))]]
            least[found], most[found] = np.minimum(least[found], before), np.maximum(most[found], before)
    rows = np.flatnonzero((most >= least)[leaf])
    if not len(rows):
        return none
    # All runs of a suffix hold its anchor, so they are one stretch.
    return pd.DataFrame({"text_id": text[rows], "start": at[rows] - most[leaf[rows]], "end": at[rows] - least[leaf[rows]] + min_len})


def _crowded(suffixes: DataFrame, min_len: int, prefix: int) -> DataFrame:
    """:func:`_shared` for subtrees of any size, as joins and groupings that combine early.

    Suffixes with the same surroundings are one leaf; the runs around the anchor are nodes.
    """
    leaf_key = ["subtree", "ahead", "back"]
    leaves = suffixes.groupBy(*leaf_key).agg(F.min("text_id").alias("one"), F.max("text_id").alias("other"))
    latest = F.length("back")
    earliest = F.greatest(min_len - F.length("ahead"), F.lit(0))
    runs = (
        leaves.withColumn("around", F.concat(F.reverse("back"), F.col("ahead")))
        .where(earliest <= latest)
        .withColumn("before", F.explode(F.sequence(earliest, latest)))
        .withColumn("run", F.substr("around", F.length("back") - F.col("before") + 1, F.lit(min_len)))
    )
    nodes = runs.groupBy("subtree", "run").agg(F.min("one").alias("lo"), F.max("other").alias("hi")).where("lo <> hi")
    held = runs.join(nodes.select("subtree", "run"), ["subtree", "run"]).groupBy(*leaf_key).agg(F.min("before").alias("least"), F.max("before").alias("most"))
    return suffixes.join(held, leaf_key).select("text_id", (F.col("at") - F.col("most")).cast("long").alias("start"), (F.col("at") - F.col("least") + min_len).cast("long").alias("end"))


def shared_spans(df: DataFrame, record: list[str], text: str, min_len: int = MIN_LEN, prefix: int = PREFIX, max_group: int = MAX_GROUP) -> DataFrame:
    """``(*record, text_length, span_start, span_end)``: each longest stretch of a record's text in
    which every position lies in a run of at least ``min_len`` characters that also occurs in a
    different record. Positions count code points from 0; ``span_end`` is exclusive.

    Records are told apart by the ``record`` columns, which should be unique but for repeated
    deliveries of the same content; those are one record. Texts are compared as stored. Null and
    shorter texts share nothing; a text held by two records is shared whole; a run repeated
    inside one record only is not shared. Other columns are ignored; an empty table gives no rows.
    """
    # Two columns of the same text in every record: the record's key and the text's id.
    keys = [f"_r{i}" for i in range(len(record))]  # record columns may be named like ours
    given = df.select(*[F.col(c).alias(k) for c, k in zip(record, keys, strict=True)], F.col(text).alias("text")).where(F.length("text") >= min_len).withColumn("text_id", F.xxhash64("text"))
    rows = given.select(*keys, "text_id", F.length("text").alias("text_length")).distinct()
    # Copies of a text are compared once.
    texts = given.groupBy("text_id").agg(F.first("text").alias("text"))

    def anchored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _anchored(pdf, min_len, prefix)

    def surroundings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach = min_len - prefix
        for pdf in batches:
            n = pdf["at"].str.len().to_numpy()
            ids, at, sub = np.repeat(pdf["text_id"].to_numpy(), n), np.concatenate([*pdf["at"], np.empty(0, np.int32)]), np.concatenate([*pdf["subtree"], np.empty(0, np.int64)])
            bodies = [(x, a) for x, places in zip(pdf["text"], pdf["at"], strict=True) for a in places.tolist()]
            yield pd.DataFrame({"subtree": sub, "text_id": ids, "at": at, "ahead": [x[a : a + min_len] for x, a in bodies], "back": [x[max(a - reach, 0) : a][::-1] for x, a in bodies]})

    def subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches come sorted by subtree; the last one of a batch may go on in the next."""
        open_ = None
        for pdf in batches:
            pdf = pdf if open_ is None else pd.concat([open_, pdf], ignore_index=True)
            going_on = pdf["subtree"] == pdf["subtree"].iloc[-1] if len(pdf) else []
            open_ = pdf[going_on] if len(pdf) else None
            yield _shared(pdf[~going_on] if len(pdf) else pdf, min_len, prefix)
        if open_ is not None:
            yield _shared(open_, min_len, prefix)

    # Three numbers an anchor; which prefixes two texts have is known before any letters travel.
    places = cut(texts.mapInPandas(anchored, "subtree long, text_id long, at int"))
    prefixes = places.groupBy("subtree").agg(F.count("*").alias("n"), F.min("text_id").alias("lo"), F.max("text_id").alias("hi")).where("lo <> hi")
    prefixes = cut(prefixes.select("subtree", (F.col("n") > max_group).alias("crowded")))

    def suffixes(kind: DataFrame) -> DataFrame:
        wanted = places.join(kind, "subtree", "left_semi").groupBy("text_id").agg(F.collect_list("at").alias("at"), F.collect_list("subtree").alias("subtree"))
        return texts.join(wanted, "text_id").mapInPandas(surroundings, "subtree long, text_id long, at int, ahead string, back string")

    small = suffixes(prefixes.where("not crowded")).repartition("subtree").sortWithinPartitions("subtree", "ahead", "back")
    found = small.mapInPandas(subtrees, "text_id long, start long, end long")
    if not (crowded := prefixes.where("crowded")).isEmpty():
        found = found.unionByName(_crowded(suffixes(crowded), min_len, prefix))
    copied = rows.groupBy("text_id").agg(F.count("*").alias("n"), F.max("text_length").alias("end")).where("n > 1")
    found = found.unionByName(copied.select("text_id", F.lit(0).cast("long").alias("start"), F.col("end").cast("long").alias("end")))

    w = Window.partitionBy("text_id").orderBy("start")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    longest = found.groupBy("text_id", "start").agg(F.max("end").alias("end"))
    island = longest.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = island.groupBy("text_id", "island").agg(F.min("start").cast("int").alias("span_start"), F.max("end").cast("int").alias("span_end"))
    named = [F.col(k).alias(c) for c, k in zip(record, keys, strict=True)]
    return rows.join(spans, "text_id").select(*named, "text_length", "span_start", "span_end")


def shared_parts(spans: DataFrame, record: list[str]) -> DataFrame:
    """``(*record, text_length, shared_length, shared_part)`` of :func:`shared_spans`."""
    return spans.groupBy(*record, "text_length").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_length")).withColumn(
        "shared_part", F.round(F.col("shared_length") / F.col("text_length"), 6)
    )
