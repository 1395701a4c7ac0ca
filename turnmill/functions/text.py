"""String expressions: normal forms, time stamps, names of files, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def one_spaced(c: Column) -> Column:
    """Trimmed, with every run of white space as one space."""
    return trimmed(F.regexp_replace(c, r"(?U)\s+", " "))


def normalized(c: Column) -> Column:
    """The form in which texts are searched for each other: one-spaced and lower case."""
    return F.lower(one_spaced(c))


def normalized_title(c: Column) -> Column:
    """Lower case, no colons, double spaces as one (in a single pass), trimmed."""
    return trimmed(F.replace(F.replace(F.lower(c), F.lit(":"), F.lit("")), F.lit("  "), F.lit(" ")))


def matchable(c: Column) -> Column:
    """One-spaced, with long dashes as hyphens."""
    return F.translate(one_spaced(c), "–—", "--")


def words(c: Column) -> Column:
    """The words of a one-spaced text; none of an empty one."""
    return F.filter(F.split(one_spaced(c), " "), lambda w: w != "")


def first_words(c: Column, n: int = 10) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def preview(c: Column, n: int = 100) -> Column:
    """The first ``n`` characters, with dots if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def minutes_seconds(seconds: Column) -> Column:
    """``MM:SS``; minutes go on beyond 59."""
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def hours_minutes_seconds(seconds: Column) -> Column:
    """``HH:MM:SS`` from one hour on, else ``MM:SS``."""
    whole = F.floor(seconds)
    return F.when(whole >= 3600, F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)).otherwise(minutes_seconds(seconds))


def plain_seconds(seconds: Column) -> Column:
    """The shortest decimal form, at most three places: ``12``, ``0.5``, ``1234.567``."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", seconds), r"0+$", ""), r"\.$", "")


def file_name(c: Column) -> Column:
    """A title as the name of a file: what paths cannot hold becomes ``_``, control characters go,
    at most 200 characters, no dots or spaces at the ends, ``untitled`` if nothing is left."""
    x = F.regexp_replace(c, r"\.\.|[/\\<>:\"|?*]", "_")
    x = F.regexp_replace(F.substring(F.regexp_replace(x, r"[\x00-\x1f]", ""), 1, 200), r"^[. ]+|[. ]+$", "")
    return F.when(x == "", F.lit("untitled")).otherwise(x)


def safe_title(c: Column) -> Column:
    """Letters, figures, spaces, ``-`` and ``_`` stay, the rest becomes ``_``."""
    return F.substring(trimmed(F.regexp_replace(c, r"[^\p{L}\p{N} _-]", "_")), 1, 200)


def identifier(c: Column) -> Column:
    """Runs of anything but ASCII letters and figures as one ``_``, none at the ends, cut at 100."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", ""), 1, 100)


def title_of_file(c: Column) -> Column:
    """The title that a file's stem stands for."""
    return F.replace(F.replace(c, F.lit("_"), F.lit(" ")), F.lit("  "), F.lit(" "))


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def lexemes(c: Column) -> Column:
    """Words for full-text search, in order: runs of letters or figures, lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)
