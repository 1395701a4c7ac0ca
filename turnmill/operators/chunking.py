"""Transcripts into overlapping chunks of sentences with times.

Where the next chunk begins depends only on where this one began, so a video is cut into blocks
of letters: each block works out, from every place at which it may be entered, where its chain of
chunks leaves it; one short walk a video over these links picks the real entries; and the blocks
list their chunks. No video's text or cues come together in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions.text import identifier, trimmed
from turnmill.operators.ordered import by_groups, running
from turnmill.operators.transcripts import with_offsets
from turnmill.session import cut

BLOCK = 100_000
SEPARATOR = r"[.!?]\s"
# Fixed value: white space, as expressions take it.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def separator_places(text: Column, separator: str = SEPARATOR) -> Column:
    """Where separators begin in a cue's text and the space after it; a separator never reaches
    beyond that space, so every cue finds its own."""
    text = F.concat(F.coalesce(text, F.lit("")), F.lit(" "))
    parts = F.split(text, f"(?={separator})")
    ends = F.aggregate(parts, F.array().cast("array<int>"), lambda at, p: F.concat(at, F.array(F.coalesce(F.try_element_at(at, F.lit(-1)), F.lit(0)) + F.length(p))))
    none = F.array().cast("array<int>")
    return F.concat(F.when(text.rlike(f"^{separator}"), F.array(F.lit(0))).otherwise(none), F.when(F.size(parts) > 1, F.slice(ends, 1, F.size(parts) - 1)).otherwise(none))


def sentence_starts(cues: DataFrame) -> DataFrame:
    """``(video_id, b, end)`` of the pieces of each video's text; a separator begins its piece.

    ``cues`` are ``(video_id, start_char, row_no, letters, places)``, numbers only.
    """
    at = F.when(F.col("row_no") == 1, F.array_union("places", F.array(F.lit(0)))).otherwise(F.col("places"))
    b = cues.select("video_id", "start_char", F.explode(at).alias("i")).select("video_id", (F.col("start_char") + F.col("i")).alias("b"))
    shard = F.floor(F.col("b") / BLOCK)
    local = Window.partitionBy("video_id", "s").orderBy("b")
    b = b.withColumn("s", shard).withColumn("end", F.lead("b").over(local))
    heads = b.groupBy("video_id", "s").agg(F.min("b").alias("head"))
    total = cues.groupBy("video_id").agg(F.max(F.col("start_char") + F.col("letters") + 1).alias("total"))
    heads = heads.join(total, "video_id").select("video_id", "s", F.coalesce(F.lead("head").over(Window.partitionBy("video_id").orderBy("s")), F.col("total")).alias("head"))
    return b.join(heads, ["video_id", "s"]).select("video_id", "b", F.coalesce("end", "head").alias("end"))


def _links(b: np.ndarray, end: np.ndarray, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk that begins at each piece: where it ends, and where the next one begins.

    A piece of at least ``size`` letters is a chunk of its own. Other chunks take pieces while
    they stay within ``size`` and end before such a piece; the next chunk begins at the first
    piece from which at most ``overlap`` letters are repeated and the piece that did not fit fits.
    """
    n = len(b)
    here = np.arange(n)
    long = end - b >= size
    stop = np.where(long, here, n)
    stop = np.minimum.accumulate(stop[::-1])[::-1]  # next piece that is a chunk of its own
    over = np.searchsorted(end, b + size, "right")  # first piece that does not fit
    last = np.minimum(over, stop)
    ends = np.where(long, end, np.where(last < n, b[np.minimum(last, n - 1)], end[-1]))
    fit = np.minimum(over, n - 1)
    back = np.maximum(np.searchsorted(b, b[fit] - overlap, "left"), np.searchsorted(b, end[fit] - size, "left"))
    back = np.minimum(np.maximum(back, here), fit)
    nexts = np.where(long, end, np.where(last == stop, ends, b[back]))
    return ends, np.where((last >= n) & ~long, -1, nexts)


def chunk_ranges(pieces: DataFrame, size: int, overlap: int, block: int = BLOCK) -> DataFrame:
    """``(video_id, b, e)`` of the chunks of :func:`sentence_starts`."""
    if not 0 <= overlap < size <= block:
        raise ValueError("overlap must be below size, and size within a block")
    pieces = cut(pieces)  # three numbers a sentence, read again and again below
    own = F.floor(F.col("b") / block)
    seen = F.when((F.col("b") - own * block <= size) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    in_block = pieces.select("video_id", "b", "end", F.explode(seen).alias("k"))
    total = pieces.groupBy("video_id").agg(F.max("end").alias("total"))
    in_block = in_block.join(total, "video_id")

    def worked(pdf: pd.DataFrame) -> tuple[pd.DataFrame, int, np.ndarray, np.ndarray, np.ndarray, int]:
        b, end, total, k = pdf["b"].to_numpy(), pdf["end"].to_numpy(), int(pdf["total"].iloc[0]), int(pdf["k"].iloc[0])
        ends, nexts = _links(b, end, size, overlap)
        nexts = np.where((nexts >= total) | ((ends >= total) & (nexts < 0)), -1, nexts)
        return pdf, k, b, ends, nexts, int((b < (k + 1) * block).sum())

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, k, b, _, nexts, own = worked(pdf)
        if not own or not (b >= k * block).any():
            return pd.DataFrame({"video_id": [], "k": [], "b": [], "leaves": []})
        place = {x: i for i, x in enumerate(b[:own].tolist())}
        out = nexts[:own].copy()
        for i in range(own - 1, -1, -1):
            if nexts[i] in place:
                out[i] = out[place[nexts[i]]]
        entry = b[:own] <= k * block + size
        entry[0] = True
        return pd.DataFrame({"video_id": pdf["video_id"].iloc[0], "k": k, "b": b[:own][entry], "leaves": out[entry]})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        leaves = dict(zip(pdf["b"].tolist(), pdf["leaves"].tolist(), strict=True))
        at, entries = 0, []
        while at >= 0 and at in leaves:
            entries.append(at)
            at = leaves[at]
        return pd.DataFrame({"video_id": pdf["video_id"].iloc[0], "entry": entries})

    def listed(pdf: pd.DataFrame) -> pd.DataFrame:
        entry = int(pdf["entry"].iloc[0])
        pdf, _, b, ends, nexts, own = worked(pdf)
        place, out, at = {x: i for i, x in enumerate(b[:own].tolist())}, [], entry
        while at in place:
            i = place[at]
            out.append((pdf["video_id"].iloc[0], at, int(ends[i])))
            at = int(nexts[i])
        return pd.DataFrame(out, columns=["video_id", "b", "e"])

    kind = pieces.schema["video_id"].dataType.simpleString()
    links = by_groups(in_block, ["video_id", "k"], ["b"], exits, f"video_id {kind}, k long, b long, leaves long")
    entries = by_groups(links, ["video_id"], ["b"], walk, f"video_id {kind}, entry long").withColumn("k", F.floor(F.col("entry") / block))
    return by_groups(in_block.join(entries, ["video_id", "k"]), ["video_id", "k"], ["b"], listed, f"video_id {kind}, b long, e long")


def _in_blocks(numbers: DataFrame, ranges: DataFrame, block: int) -> DataFrame:
    """``(video_id, segment_id, start_char, k_needed)``: the cues that chunks beginning in a block need."""
    extent = ranges.groupBy("video_id", "k").agg(F.min("b").alias("from"), F.max("e").alias("to"))
    extent = extent.withColumn("j", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    last = F.col("start_char") + F.col("letters")
    cues = numbers.select("video_id", "segment_id", "start_char", last.alias("last")).withColumn("j", F.explode(F.sequence(F.floor(F.col("start_char") / block), F.floor(F.col("last") / block))))
    # A cue and a block's extent may meet in several places; the first one counts.
    met = cues.join(extent, ["video_id", "j"]).where((F.col("start_char") < F.col("to")) & (F.col("last") >= F.col("from")) & (F.col("j") == F.floor(F.greatest("from", "start_char") / block)))
    return met.select("video_id", "segment_id", "start_char", F.col("k").alias("k_needed"))


def fixed_size_chunks(cues: DataFrame, size: int = 3000, overlap: int = 1500, separator: str = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """``(chunk_id, video_id, title, text, cue_start, cue_end, chunk_index, total_chunks)``.

    The text of a video is its trimmed cue texts, in order, each followed by a space. It is cut
    before every separator (which must not begin with white space); chunks take whole pieces up to
    ``size`` letters and repeat at most ``overlap``; a piece as long as that is a chunk of its own.
    Times are interpolated over the letters of the cue at either end and rounded to the millisecond.
    Null texts count as empty; videos without any letters give nothing, nor do chunks of white
    space only. A cue delivered twice is one cue.
    """
    cues = cues.select("video_id", "segment_id", "title", trimmed(F.coalesce("text", F.lit(""))).alias("text"), "cue_start", "cue_end")
    # Only numbers are sorted and summed; the texts travel at the end, each to the blocks of the
    # chunks that hold it.
    own = F.struct("cue_start", F.length("text").alias("letters"), separator_places(F.col("text"), separator).alias("places"))
    numbers = cues.groupBy("video_id", "segment_id").agg(F.min(own).alias("own")).select("video_id", "segment_id", "own.*")
    numbers = cut(with_offsets(numbers, F.col("letters")))
    opening = numbers.where("letters > 0").groupBy("video_id").agg(F.min("start_char").alias("opening"))
    ranges = chunk_ranges(sentence_starts(numbers), size, overlap, block).join(opening, "video_id").where((F.col("b") > 0) | (F.col("e") > F.col("opening")))
    ranges = cut(ranges)  # read twice to number them
    ranges = running(ranges.select("video_id", "b", "e"), "video_id", ["b"], F.floor(F.col("b") / block), chunk_index=F.lit(1))
    ranges = cut(ranges.select("video_id", "b", "e", F.floor(F.col("b") / block).alias("k"), (F.col("chunk_index") + 1).cast("int").alias("chunk_index")))
    totals = ranges.groupBy("video_id").agg(F.count("*").cast("int").alias("total_chunks"))
    held = cues.join(_in_blocks(numbers, ranges, block), ["video_id", "segment_id"])

    def written(both: pd.DataFrame) -> pd.DataFrame:
        asked, told = both[both["chunk_index"].notna()], both[both["chunk_index"].isna()]
        told = told[~told["place"].duplicated()]
        start, texts, title = told["place"].to_numpy(), told["text"].tolist(), told["title"].tolist()
        begins, ends = told["cue_start"].to_numpy(float), told["cue_end"].to_numpy(float)
        letters = np.array([len(x) for x in texts])
        whole, base, out = " ".join(texts) + " ", int(start[0]) if len(start) else 0, []

        def at(position: int) -> float:
            i = int(np.searchsorted(start, position, "right")) - 1
            return begins[i] + (position - start[i]) / max(letters[i], 1) * (ends[i] - begins[i])

        for b, e, index in zip(asked["place"].tolist(), asked["e"].astype(int).tolist(), asked["chunk_index"].astype(int).tolist(), strict=True):
            text = whole[b - base : e - base]
            head = text.lstrip(WHITE)
            first, text = b + len(text) - len(head), head.rstrip(WHITE)
            i, j = (int(np.searchsorted(start, x, side)) for x, side in ((first, "right"), (e, "left")))
            names = [x for x in title[max(i - 1, 0) : j] if x is not None]
            out.append((both["video_id"].iloc[0], max(names, default=None), text, at(first), at(first + len(text) - 1), index))
        return pd.DataFrame(out, columns=["video_id", "title", "text", "cue_start", "cue_end", "chunk_index"])

    kind = cues.schema["video_id"].dataType.simpleString()
    asked = ranges.select("video_id", "k", F.col("b").alias("place"), "e", "chunk_index")
    told = held.select("video_id", F.col("k_needed").alias("k"), F.col("start_char").alias("place"), "text", "title", "cue_start", "cue_end")
    both = asked.unionByName(told, allowMissingColumns=True)
    x = by_groups(both, ["video_id", "k"], ["place"], written, f"video_id {kind}, title string, text string, cue_start double, cue_end double, chunk_index int")
    name = F.concat(identifier(F.coalesce("title", F.lit(""))), F.lit("_"), "video_id", F.lit("_chunk_"), "chunk_index")
    return x.join(totals, "video_id").select(name.alias("chunk_id"), "video_id", "title", "text", F.round("cue_start", 3).alias("cue_start"), F.round("cue_end", 3).alias("cue_end"), "chunk_index", "total_chunks")


def sliding_windows(docs: DataFrame, doc_id: str, text: str, size: int, step: int) -> DataFrame:
    """``(doc_id, window_no, start_char, text)``: windows of ``size`` letters every ``step``, until
    one reaches the end. An empty text has one empty window, a null text none."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step).cast("int"), F.lit(0)))
    x = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.explode(starts).alias("window_no"))
    start = F.col("window_no") * step
    return x.select("doc_id", "window_no", start.alias("start_char"), F.substr("text", start + 1, F.lit(size)).alias("text"))


def sentence_windows(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """``(doc_id, window_no, sentences, letters)``: sentences by the stretch of ``size`` letters in
    which they begin. Not the splitter above: the stretches are fixed, and nothing overlaps."""
    x = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), rf"(?={SEPARATOR})")).alias("i", "s"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("window_no", F.floor(F.coalesce(F.sum(F.length("s")).over(w), F.lit(0)) / size))
    return x.groupBy("doc_id", "window_no").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("letters"))
