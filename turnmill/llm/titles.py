"""Typed values onto a canonical list: a prefix-filtered set-similarity join.

Both sides become sets of letter triples: the typed values, and of every entry its usual forms.
Triples are ordered by rarity in the list. A value and a form are alike if their Jaccard similarity
is at least ``ALIKE`` and the form holds at least ``LOOK`` of the value's triples; such a pair has a
triple in common among the rarest of either side (the prefixes), so only those are joined. Lengths,
and the places of the last common triple in both orders, bound the overlap of the pairs found;
the overlap and the Jaccard similarity of what is left are computed exactly, and the best is kept.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.session import cut

# Letters of other scripts and figures that stand for a Latin letter.
LOOKALIKE = str.maketrans("аеорсухіјѕԁһկոԛԝ", "aeopcyxijsdhknqw")
FIGURES_AS_LETTERS = ("01", "ol")

# What typing and exporting put around a title.
AFFIXES = [
    r"^(?:re|fwd?)\s*[:–—-]\s*",
    r"^(?:transcript[ _-]+)+of[ _-]+",
    r"^transcript[ _-]+\d+[ _:–—-]+\s*",
    r"(?:\.(?:md|mp4|mp3|txt|csv|json|docx?|pdf)|\s*[-–—_]\s*recording|[ _-]*\(?\breplay\)?|\s*(?:…|\.{2,}))$",
]

#: Share of a typed value's triples that an entry must hold: to be looked at, and to be sure.
LOOK, SURE = 0.45, 0.7
#: Jaccard similarity to one of the entry's forms that is always needed, and share of the letters
#: that stand in words of the entry, needed between the two.
ALIKE, WORDS = 0.2, 0.6
#: Letters that words of a title are cut to in its abbreviated form.
CUT = 4
#: Letters by which a series is looked up, at most.
SERIES_KEY = 4


@F.pandas_udf(T.StringType())
def folded(s: pd.Series) -> pd.Series:
    """Lower case, without accents, lookalikes of other scripts as the letters they stand for."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        x = unicodedata.normalize("NFKD", x.lower().translate(LOOKALIKE))
        return "".join(c for c in x if not unicodedata.combining(c)).translate(LOOKALIKE)

    return s.map(one)


def without_affixes(c: Column) -> Column:
    """Strips :data:`AFFIXES`, quotes and spaces, three layers deep."""
    edges = r"(?U)^[\s\"'“”‘’]+|[\s\"'“”‘’]+$"
    for _ in range(3):
        c = F.regexp_replace(c, edges, "")
        for affix in AFFIXES:
            c = F.regexp_replace(c, affix, "")
    return F.regexp_replace(c, edges, "")


def squeezed(c: Column) -> Column:
    """Letters and figures only."""
    return F.translate(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""), *FIGURES_AS_LETTERS)


def triples(c: Column) -> Column:
    """The set of letter triples; a shorter text is its own triple, an empty one has none."""
    each = F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3)))
    return F.when(F.length(c) >= 3, F.array_distinct(each)).when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))


def word_list(c: Column) -> Column:
    return F.filter(F.split(c, r"[^\p{L}\p{N}.]+"), lambda w: F.length(w) > 0)


def _list_side(listed: DataFrame, key: str, value: str) -> DataFrame:
    """Each entry with its squeezed text with and without the series it belongs to, and the
    triples of its usual short forms (no names in brackets, no subtitle, no series)."""
    entry = listed.select(F.col(key).alias("title_id"), F.col(value).alias("_value")).where(F.col("_value").isNotNull())
    entry = entry.groupBy("_value").agg(F.min("title_id").alias("title_id")).withColumn("_plain", folded("_value"))
    entry = entry.withColumn("_series", F.when(F.col("_plain").contains(" - "), F.split("_plain", " - ", 2)[0]))
    shared = entry.groupBy("_series").agg(F.count("*").alias("_n")).where("_series is not null and _n > 1").select("_series")
    entry = entry.join(shared.withColumn("_in_series", F.lit(True)), "_series", "left")
    rest = F.when(F.col("_in_series"), F.expr("substring(_plain, length(_series) + 4)")).otherwise(F.col("_plain"))
    short = F.regexp_replace("_plain", r"\s*\([^()]*\)\s*$", "")
    cut_words = F.array_join(F.transform(word_list(F.split(short, ": ", 2)[0]), lambda w: F.substring(w, 1, CUT)), " ")
    forms = [F.col("_plain"), short, F.split(short, ": ", 2)[0]]
    forms += [*[F.regexp_replace(f, r"^.*? - ", "") for f in forms], rest, cut_words]
    return entry.select(
        "title_id",
        "_value",
        squeezed(F.when(F.col("_in_series"), F.col("_series"))).alias("_series"),
        triples(squeezed(rest)).alias("_core"),
        triples(squeezed(F.col("_plain"))).alias("_entire"),
        F.filter(F.array_distinct(F.array(*[F.array_sort(triples(squeezed(f))) for f in forms])), lambda f: F.size(f) > 0).alias("_forms"),
        word_list(F.translate(F.col("_plain"), *FIGURES_AS_LETTERS)).alias("_words"),
    )


def _placed(sets: DataFrame, by: list[str], rarity: DataFrame) -> DataFrame:
    """``(*by, _t, _len, _pos)``: the places of the triples of sets ``_set`` in the order of rarity.
    A triple that no form has comes first."""
    each = sets.select(*by, F.size("_set").alias("_len"), F.explode("_set").alias("_t")).join(rarity, "_t", "left")
    return each.withColumn("_pos", F.row_number().over(Window.partitionBy(*by).orderBy(F.coalesce("_df", F.lit(0)), "_t")))


def _alike(values: DataFrame, entries: DataFrame) -> DataFrame:
    """``(_id, title_id)``: the values ``(_id, _core, _without)`` with the entries of which a form may
    be alike. Of a value without its series nothing is known of the similarity with the series, so
    there only the share of its own triples counts."""
    forms = entries.select("title_id", F.posexplode("_forms").alias("_form", "_set"))
    rarity = forms.select(F.explode("_set").alias("_t")).groupBy("_t").agg(F.count("*").alias("_df"))
    # Prefixes end at the last place where an overlap of the needed size can begin.
    x = _placed(values.select(F.struct("_id", "_without").alias("_x"), F.col("_core").alias("_set")), ["_x"], rarity).select("_x.*", "_t", "_len", "_pos", "_df", F.ceil(F.col("_len") * LOOK).alias("_least"))
    x = x.where("_pos <= _len - _least + 1 and _df is not null").drop("_df")
    y = _placed(forms, ["title_id", "_form"], rarity).select("title_id", "_form", "_t", F.col("_len").alias("_size"), F.col("_pos").alias("_place"))
    in_prefix = F.col("_place") <= F.col("_size") - F.ceil(F.col("_size") * ALIKE) + 1
    lengths = (F.col("_size") >= F.ceil(F.col("_len") * ALIKE)) & (F.col("_len") >= F.ceil(F.col("_size") * ALIKE))
    pairs = x.join(y, "_t").where((F.col("_size") >= F.col("_least")) & (F.col("_without") | (in_prefix & lengths)))
    pairs = pairs.groupBy("_id", "title_id", "_form").agg(
        F.count("*").alias("_hits"), F.max("_pos").alias("_pos"), F.max("_place").alias("_place"), *[F.first(c).alias(c) for c in ("_len", "_size", "_least", "_without")]
    )
    # After the last triple in common at most what is left of the shorter rest can be shared.
    jaccard = F.ceil((F.col("_len") + F.col("_size")) * (ALIKE / (1 + ALIKE)))
    need = F.when(F.col("_without"), F.col("_least")).otherwise(F.greatest("_least", jaccard))
    return pairs.where(F.col("_hits") + F.least(F.col("_len") - F.col("_pos"), F.col("_size") - F.col("_place")) >= need).select("_id", "title_id").distinct()


def best_titles(typed: DataFrame, value: str, listed: DataFrame, key: str, title: str) -> DataFrame:
    """``(value, title_id)``: of each different typed value the entry of the list it means, or 0.

    Values that are null or blank, and those equal to an entry, are left out. Two entries with
    the same text count as the one with the lower key. Ties go to the lower key. Everything is
    done once a different value, however many rows hold it; extra columns are ignored.
    """
    # Read several times below.
    entries = cut(_list_side(listed, key, title))
    values = typed.select(F.col(value).alias("value")).where(F.col("value").rlike(r"(?U)\S")).distinct()
    values = values.join(entries.select(F.col("_value").alias("value")), "value", "left_anti")
    values = values.withColumn("_bare", without_affixes(folded("value"))).withColumn("_full", squeezed(F.col("_bare")))

    # A typed value that opens with a series is compared without it: what all entries of a
    # series share says nothing about which of them is meant. A typed value keeps it if nothing
    # else is left. Series are looked up by their first letters.
    opening = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(SERIES_KEY)), lambda n: F.substring(c, F.lit(1), n)))
    series = entries.where("_series <> ''").select("_series", F.substring("_series", 1, SERIES_KEY).alias("_key")).distinct()
    opened = values.where("_full <> ''").select("value", "_full", F.explode(opening(F.col("_full"))).alias("_key")).join(series, "_key")
    opened = opened.where(F.startswith("_full", "_series") & (F.length("_full") > F.length("_series"))).groupBy("value").agg(F.max(F.length("_series")).alias("_opens"))
    values = values.join(opened, "value", "left").select(
        "value",
        F.monotonically_increasing_id().alias("_id"),
        "_bare",
        triples(F.col("_full")).alias("_tokens"),
        F.col("_opens").isNotNull().alias("_without"),
        F.expr("substring(_full, 1, _opens)").alias("_opened"),
        triples(F.expr("substring(_full, coalesce(_opens, 0) + 1)")).alias("_core"),
    )
    values = cut(values)
    near = _alike(values, entries).join(values, "_id").join(entries.withColumnRenamed("_core", "_entry"), "title_id")
    # What was typed with a series means an entry of it, and is held against the rest of that.
    near = near.where(~F.col("_without") | F.col("_opened").eqNullSafe(F.col("_series")))
    held = F.size(F.array_intersect("_core", F.when(F.col("_without"), F.col("_entry")).otherwise(F.col("_entire"))))
    near = near.withColumn("_held", held / F.size("_core")).where(F.col("_held") >= LOOK)
    jaccard = F.transform("_forms", lambda f: F.size(F.array_intersect("_tokens", f)) / F.size(F.array_union("_tokens", f)))
    # Letters of the typed words that are, but for slips, words of the entry or their beginnings.
    typed_words = word_list(F.translate(F.col("_bare"), *FIGURES_AS_LETTERS))
    meant = lambda x, w: F.when(F.endswith(x, F.lit(".")), F.startswith(w, F.rtrim(x, F.lit(".")))).otherwise(
        F.levenshtein(F.replace(x, F.lit("."), F.lit("")), F.replace(w, F.lit("."), F.lit(""))) <= F.least(F.floor(F.length(x) / 3), F.lit(4))
    )
    found = F.filter(F.col("_typed"), lambda x: F.exists("_words", lambda w: meant(x, w)))
    letters = lambda ws: F.aggregate(ws, F.lit(0), lambda n, w: n + F.length(w))
    scored = near.withColumn("_typed", typed_words).withColumn("_score", F.col("_held") + F.array_max(jaccard))
    words_agree = F.try_divide(letters(found), letters(F.col("_typed"))) >= WORDS
    sure = scored.where((F.col("_score") - F.col("_held") >= ALIKE) & ((F.col("_held") >= SURE) | words_agree))
    best = sure.groupBy("value").agg(F.max(F.struct("_score", (-F.col("title_id")).alias("_id"))).alias("_best"))
    return values.select("value").join(best, "value", "left").select("value", F.coalesce(-F.col("_best._id"), F.lit(0).cast("long")).alias("title_id"))
