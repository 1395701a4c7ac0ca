"""Quotes located in chunks, and what follows: match grades, expected chunks, statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.text import first_words, matchable, normalized, normalized_title, one_spaced, words
from turnmill.session import cut

KEY = 5  # words of a search key, at most
FILTER = 27  # binary logarithm of the bits that tell which runs are asked for: 16 MB
GRAM = 8  # letters by which a single word is looked up in others, at most


def _runs(ws: Column, k: int) -> Column:
    """All runs of ``k`` words of an array that is a column of its own, with fields ``w0`` ..."""
    n = F.size(ws) - k + 1
    return F.arrays_zip(*[F.slice(ws, i + 1, F.greatest(n, F.lit(0))).alias(f"w{i}") for i in range(k)])


@lru_cache(1 << 18)
def _number(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _numbers(text: str) -> np.ndarray:
    """The words of a one-spaced text as fingerprints."""
    ws = [w for w in text.split(" ") if w]
    return np.fromiter(map(_number, ws), np.uint64, len(ws))


def _keys(numbers: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of ``k`` words."""
    n = max(len(numbers) - k + 1, 0)
    x = np.full(n, k, np.uint64)
    for j in range(k if n else 0):
        x = (x ^ numbers[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x


def _bits_of(keys: DataFrame) -> np.ndarray:
    """A filter of the keys, of 2 ** :data:`FILTER` bits whatever their number."""
    place = F.shiftrightunsigned("_key", 64 - FILTER) + 1  # bitmaps count from 1
    parts = keys.groupBy(F.bitmap_bucket_number(place).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = np.zeros((1 << FILTER) // 8, np.uint8)
    for n, own in parts:
        at = (n - 1) * len(own)
        bits[at : at + len(own)] = np.frombuffer(bytes(own), np.uint8)
    return bits


def _around_space(a: Column, i: int, b: Column, j: int) -> Column:
    """The last ``i`` letters of a word and the first ``j`` of the next."""
    return F.concat(F.substring(a, F.greatest(F.length(a) - i + 1, F.lit(1)), F.lit(i)), F.lit(" "), F.substring(b, 1, j))


def _units_with(short: DataFrame, texts: DataFrame, sizes: list[int]) -> DataFrame:
    """``(_phrase, _unit)``: for phrases of one or two words the words, or pairs of neighbours, of
    the texts that contain them, by letters in common."""
    half, found = GRAM // 2, []
    for k in sizes:
        unit = texts.select(F.explode(F.array_distinct(F.transform(_runs(F.col("_i"), k), lambda x: F.concat_ws(" ", *[x[f"w{i}"] for i in range(k)])))).alias("_unit")).distinct()  # noqa: B023
        ws = [F.element_at(F.split("_unit", " "), i + 1) for i in range(k)]
        if k == 1:
            grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length("_unit")), lambda i: F.array(*[F.substring(F.col("_unit"), i, F.lit(n)) for n in range(1, GRAM + 1)])))
            gram = F.substring("_phrase", 1, GRAM)
        else:
            grams = F.array(*[_around_space(ws[0], i, ws[1], j) for i in range(1, half + 1) for j in range(1, half + 1)])
            gram = _around_space(F.try_element_at("_w", F.lit(1)), half, F.try_element_at("_w", F.lit(2)), half)
        asked = short.where(F.size("_w") == k).select("_phrase", gram.alias("_gram"))
        unit = unit.select("_unit", F.explode(F.array_distinct(grams)).alias("_gram"))
        found.append(unit.join(asked, "_gram").where(F.contains("_unit", "_phrase")).select("_phrase", "_unit"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def located(phrases: DataFrame, phrase_id: str, phrase: str, texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """``(phrase_id, text_id)`` where the text contains the phrase; both in normal form already.

    A text that contains a phrase contains all its inner words in a row, so the phrase looks
    itself up by an inner run of five words, the rarest of the three with the least fingerprints,
    or by all inner words if they are fewer, and is then compared exactly. Phrases of one or two
    words have none inside and are looked up in the texts' words and pairs of words. Of the runs of
    the texts only those go on that some phrase may have asked for, by a filter of fixed size.
    Empty and null phrases match nothing. Copies of a phrase or a text are compared once; only
    numbers are shuffled but for one pass of the phrases and one of the texts.
    """
    p = phrases.select(F.col(phrase_id).alias("_pid"), F.col(phrase).alias("_phrase")).where(F.col("_phrase").isNotNull()).withColumn("_p", F.xxhash64("_phrase"))
    t = texts.select(F.col(text_id).alias("_tid"), F.col(text).alias("_text")).where(F.col("_text").isNotNull()).withColumn("_t", F.xxhash64("_text"))
    own = p.select("_p", "_phrase").distinct().withColumn("_w", words(F.col("_phrase"))).where(F.size("_w") > 0)
    once = t.groupBy("_t").agg(F.first("_text").alias("_text"))
    # Texts are cut into runs of those lengths only that some phrase needs; at most seven numbers.
    sizes = sorted(r[0] for r in own.select(F.least(F.size("_w"), F.lit(KEY + 2))).distinct().collect())
    inner, units = [n - 2 for n in sizes if n > 2], [n for n in sizes if n <= 2]
    lengths = sorted({*inner, *units})

    def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [np.sort(_keys(x, min(len(x), KEY)))[:3] for x in (_numbers(y)[1:-1] for y in pdf["_phrase"])]
            yield pd.DataFrame({"_p": np.repeat(pdf["_p"].to_numpy(), [len(k) for k in keys]), "_key": np.concatenate([np.empty(0, np.uint64), *keys]).view(np.int64)})

    def unit_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_p": pdf["_p"], "_key": np.array([_keys(x, len(x))[0] for x in map(_numbers, pdf["_unit"])], np.uint64).view(np.int64)})

    asked = own.where(F.size("_w") > 2).select("_p", "_phrase").mapInPandas(asking, "_p long, _key long")
    if units:
        short = _units_with(own, once.select(words(F.col("_text")).alias("_i")), units).join(own.select("_phrase", "_p"), "_phrase")
        asked = asked.unionByName(short.select("_p", "_unit").mapInPandas(unit_keys, "_p long, _key long"))
    asked = cut(asked)
    sent = t.sparkSession.sparkContext.broadcast(_bits_of(asked))

    def telling(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = sent.value
        for pdf in batches:
            told = []
            for text in pdf["_text"]:
                x = _numbers(text)
                keys = np.unique(np.concatenate([np.empty(0, np.uint64), *[_keys(x, k) for k in lengths]]))
                place = (keys >> np.uint64(64 - FILTER)).astype(np.int64)
                told.append(keys[(bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0])
            yield pd.DataFrame({"_t": np.repeat(pdf["_t"].to_numpy(), [len(k) for k in told]), "_key": np.concatenate([np.empty(0, np.uint64), *told]).view(np.int64)})

    told = cut(once.mapInPandas(telling, "_t long, _key long"))
    frequency = told.groupBy("_key").agg(F.count("*").alias("_df"))
    # Of a short phrase every unit counts, of a long one the rarest run.
    many = own.select("_p", (F.size("_w") <= 2).alias("_all"))
    rarest = asked.join(frequency, "_key").join(many, "_p")
    keep = rarest.where("not _all").groupBy("_p").agg(F.min(F.struct("_df", "_key")).alias("_m")).select("_p", F.col("_m._key").alias("_key"))
    keep = keep.unionByName(rarest.where("_all").select("_p", "_key")) if units else keep
    hits = keep.join(own.select("_p", "_phrase"), "_p").join(told, "_key").join(once, "_t").where(F.contains("_text", "_phrase")).select("_p", "_t")
    return p.select("_pid", "_p").join(hits, "_p").join(t.select("_tid", "_t"), "_t").select(F.col("_pid").alias("phrase_id"), F.col("_tid").alias("text_id")).distinct()


def word_overlaps(phrases: DataFrame, phrase_id: str, phrase: str, texts: DataFrame, text_id: str, text: str, least: int = 80, letters: int = 2_000_000) -> DataFrame:
    """``(phrase_id, text_id, overlap)``: the share of a phrase's different words that the text has
    too, in hundredths to one place, where it is at least ``least``.

    Exact. Sets of words meet in blocks of about ``letters``, each set once. In a pair of blocks
    a phrase of n words that has to share m of them asks for its n - m + 1 rarest only, words
    that the block lacks first: a text without any of these cannot share m. The words of the
    texts left are then counted.
    """
    sets = lambda c: F.array_join(F.array_sort(F.array_distinct(words(normalized(F.col(c))))), " ")
    p, t = phrases.select(F.col(phrase_id).alias("phrase_id"), sets(phrase).alias("_p")).where("_p <> ''"), texts.select(F.col(text_id).alias("text_id"), sets(text).alias("_t")).where("_t <> ''")

    def packed(df: DataFrame, c: str) -> DataFrame:
        once = df.select(c).distinct()
        n = max(1, -(-(once.agg(F.sum(F.length(c))).first()[0] or 0) // letters))
        return once.groupBy(F.pmod(F.xxhash64(c), F.lit(n)).alias(f"{c}_block")).agg(F.collect_list(c).alias(c))

    def shared(pair: pd.DataFrame) -> pd.DataFrame:
        ps, ts = pair["_p"].iloc[0], pair["_t"].iloc[0]
        has: dict[str, list[int]] = {}
        for i, x in enumerate(ts):
            for w in x.split(" "):
                has.setdefault(w, []).append(i)
        holders, none, found = {w: np.asarray(i, np.int32) for w, i in has.items()}, np.zeros(0, np.int32), []
        for x in ps:
            own = sorted((holders.get(w, none) for w in x.split(" ")), key=len)
            need = -(-len(own) * (20 * least - 1) // 2000)  # the share is rounded to one place
            rare = np.bincount(np.concatenate(own[: len(own) - need + 1]), minlength=len(ts))
            if rare.any():
                all_ = rare + np.bincount(np.concatenate([none, *own[len(own) - need + 1 :]]), minlength=len(ts))
                found += [(x, ts[i]) for i in np.flatnonzero((rare > 0) & (all_ >= need))]
        return pd.DataFrame(found, columns=["_p", "_t"])

    # A pair of blocks is a group of one row.
    x = packed(p, "_p").crossJoin(packed(t, "_t")).groupBy("_p_block", "_t_block").applyInPandas(shared, "_p string, _t string")
    share = F.size(F.array_intersect(F.split("_p", " "), F.split("_t", " "))) / F.size(F.split("_p", " "))
    x = x.withColumn("overlap", F.round(100 * share, 1)).where(F.col("overlap") >= least)
    return x.join(p, "_p").join(t, "_t").select("phrase_id", "text_id", "overlap").distinct()


def same_title(a: Column, b: Column) -> Column:
    """Either normalized title contains the other; never for null or blank ones."""
    a, b = normalized_title(a), normalized_title(b)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def chunks_of_quotes(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(quote_id, id)``: the chunks of a quote's title that hold its first ten words.

    ``quotes`` has ``quote_id, quoted_text, transcript_title``, ``chunks`` has ``id, text,
    title``. Texts are compared one-spaced and in lower case.
    """
    starts = quotes.select("quote_id", first_words(normalized(F.col("quoted_text"))).alias("start"))
    found = located(starts, "quote_id", "start", chunks.select("id", normalized(F.col("text")).alias("t")), "id", "t").toDF("quote_id", "id")
    titled = found.join(quotes.select("quote_id", "transcript_title"), "quote_id").join(chunks.select("id", "title"), "id")
    return titled.where(same_title(F.col("transcript_title"), F.col("title"))).select("quote_id", "id")


def resolved_titles(typed: DataFrame, value: str, listed: DataFrame, key: str, title: str, most: int = 10_000) -> DataFrame:
    """``(value, title_id, how)`` of each different typed title: ``exact`` (but for case), else
    ``partial`` (one holds the other; the first of the list), else ``transcript_not_found``.

    A list of up to ``most`` entries goes to every task, since containment has no key to join by;
    titles of a longer one are located in the typed ones, and these in them. Blank titles of either
    side match nothing. A leading ``TRANSCRIPT n:`` does not count.
    """
    v = typed.select(F.col(value).alias("value")).where(F.trim(F.col(value)) != "").distinct()
    v = v.withColumn("_v", F.lower(F.regexp_replace(one_spaced(F.col("value")), r"^TRANSCRIPT \d+: ", "")))
    entries = listed.select(F.col(key).alias("title_id"), F.lower(F.col(title)).alias("_t")).where(F.trim("_t") != "")
    if listed.limit(most + 1).count() <= most:
        hit = v.join(F.broadcast(entries), F.contains("_v", "_t") | F.contains("_t", "_v"), "left")
    else:
        inside = located(v, "value", "_v", entries, "title_id", "_t").toDF("value", "title_id")
        around = located(entries, "title_id", "_t", v, "value", "_v").toDF("title_id", "value")
        both = inside.unionByName(around).distinct().join(entries, "title_id")
        hit = v.join(both, "value", "left")
    best = hit.groupBy("value").agg(F.min(F.when(F.col("title_id").isNotNull(), F.struct((F.col("_t") != F.col("_v")).alias("_other"), "title_id"))).alias("_best"))
    how = F.when(F.col("_best").isNull(), "transcript_not_found").when(F.col("_best._other"), "partial").otherwise("exact")
    return best.select("value", "_best.title_id", how.alias("how"))


def quote_parts(quote: Column) -> Column:
    """The parts of a quote between dots that leave something out, of five words or more, each as
    ``(p, w)``: lower-case text and words."""
    text = matchable(quote)
    text = F.when(F.startswith(text, F.lit("…")) | F.startswith(text, F.lit("...")), one_spaced(F.regexp_replace(text, r"^(?:…|\.\.\.)", ""))).otherwise(text)
    parts = F.transform(F.split(F.lower(text), r"\.{3,}|…"), one_spaced)
    return F.filter(F.transform(parts, lambda p: F.struct(p.alias("p"), words(p).alias("w"))), lambda x: F.size(x["w"]) >= 5)


def search_phrases(parts: Column) -> Column:
    """What to look for of :func:`quote_parts`, in order: ``(grade, phrase)`` with the grade of a find.

    Of each part its opening ten, fifteen and twenty words, then whole parts of 20 to 200
    letters, then fifteen words from the middle of long parts. A find of up to twenty letters
    does not count. Give a column of its own, since it is read three times.
    """
    grade = lambda p, name: F.struct(F.when((F.length(p) > 50) & F.lit(name in ("first_20_words", "clean_chunk")), F.lit("high")).otherwise(F.lit("medium")).alias("grade"), p.alias("phrase"))
    first = lambda x, n: F.when(F.size(x["w"]) >= n, grade(F.array_join(F.slice(x["w"], 1, n), " "), f"first_{n}_words"))
    middle = lambda x: F.when(F.size(x["w"]) >= 20, grade(F.array_join(F.slice(x["w"], F.floor(F.size(x["w"]) / 4).cast("int") + 1, 15), " "), "middle_portion"))
    whole = lambda x: F.when(F.length(x["p"]).between(20, 200), grade(x["p"], "clean_chunk"))
    all_ = F.concat(F.flatten(F.transform(parts, lambda x: F.array(first(x, 10), first(x, 15), first(x, 20)))), F.transform(parts, whole), F.transform(parts, middle))
    return F.filter(all_, lambda x: x.isNotNull() & (F.length(x["phrase"]) > 20))


def graded_quotes(quotes: DataFrame, quote_id: str, quote: str, texts: DataFrame, text: str) -> DataFrame:
    """``(quote_id, found, match_type, confidence)``: how well each quote is found in any text.

    In this order: the whole quote (exact, high); without its dots (partial, high); the search
    phrases in their order; for long quotes, at least seven tenths of the sentences in one and
    the same text (medium); for short ones, any five words in a row (medium); a literal in
    quotation marks (low). Null and blank quotes are ``not_found``.
    """
    q = quotes.select(F.col(quote_id).alias("quote_id"), F.lower(matchable(F.col(quote))).alias("_q"), quote_parts(F.col(quote)).alias("_parts"))
    t = texts.select(F.lower(matchable(F.col(text))).alias("t")).where("t is not null").distinct().withColumn("tid", F.xxhash64("t"))
    plain = one_spaced(F.regexp_replace("_q", r"\.{3,}|…", ""))
    n = F.length("_q")
    item = lambda tier, p, g, of=1: F.struct(F.lit(tier).alias("tier"), p.alias("phrase"), g.alias("grade"), F.lit(of).cast("int").alias("of") if isinstance(of, int) else of.cast("int").alias("of"))
    many = lambda tier, ps, g: F.transform(ps, lambda p: item(tier, p, F.lit(g)))
    # Columns of their own: what is used in several tiers is worked out once.
    wide = q.where("_q is not null and _q <> ''").withColumn("_w", words(F.col("_q"))).withColumn(
        "_sentences", F.transform(F.filter(F.transform(F.split("_q", r"\."), one_spaced), lambda s: F.length(s) > 10), lambda s: one_spaced(F.regexp_replace(s, r"…", "")))
    )
    sentences = F.col("_sentences")
    in_rows = F.arrays_zip(*[F.slice("_w", i + 1, F.greatest(F.size("_w") - 4, F.lit(0))).alias(f"w{i}") for i in range(5)])
    fives = F.transform(in_rows, lambda x: F.concat_ws(" ", *[x[f"w{i}"] for i in range(5)]))
    none = F.array().cast("array<struct<tier:int,phrase:string,grade:string,of:int>>")
    tiers = F.concat(
        F.array(item(1, F.col("_q"), F.lit("high"))),
        F.when(F.length(plain) > 20, F.array(item(2, plain, F.lit("high")))).otherwise(none),
        F.transform(search_phrases(F.col("_parts")), lambda x, i: F.struct(F.lit(3).alias("tier"), x["phrase"].alias("phrase"), x["grade"].alias("grade"), (i + 1).cast("int").alias("of"))),
        F.when(n > 100, F.filter(F.transform(sentences, lambda s: item(4, s, F.lit("medium"), F.size(sentences))), lambda x: F.length(x["phrase"]) > 10)).otherwise(none),
        F.when(n.between(20, 100) & (F.size("_w") >= 5), F.filter(many(5, fives, "medium"), lambda x: ~x["phrase"].contains("..."))).otherwise(none),
        many(6, F.regexp_extract_all("_q", F.lit(r'("[^"]{10,}")'), 1), "low"),
    )
    wanted = cut(wide.select("quote_id", F.posexplode(tiers).alias("at", "p")).select("quote_id", "at", "p.*"))
    phrases = wanted.select("phrase").distinct()
    hits = located(phrases, "phrase", "phrase", t, "tid", "t").toDF("phrase", "tid")
    whole = wanted.where("tier <> 4").join(hits.select("phrase").distinct(), "phrase").select("quote_id", "tier", "at", "grade")
    most = wanted.where("tier = 4").join(hits, "phrase").groupBy("quote_id", "tid").agg(F.count("*").alias("n"), F.max("of").alias("of"), F.min("at").alias("at"))
    most = most.where(F.col("n") >= 0.7 * F.col("of")).select("quote_id", F.lit(4).alias("tier"), "at", F.lit("medium").alias("grade"))
    best = whole.unionByName(most).groupBy("quote_id").agg(F.min(F.struct("tier", "at", "grade")).alias("b"))
    kind = F.when(F.col("b").isNull(), "not_found").when(F.col("b.tier") == 1, "exact").otherwise("partial")
    return q.select("quote_id").join(best, "quote_id", "left").select("quote_id", F.col("b").isNotNull().alias("found"), kind.alias("match_type"), F.coalesce("b.grade", F.lit("low")).alias("confidence"))
