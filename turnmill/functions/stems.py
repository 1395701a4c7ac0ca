"""English word stems for full-text search (the published English algorithm of Snowball)."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that the algorithm treats apart.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Endings and what they become, for the steps of the algorithm.
SECOND = {
    "ational": "ate", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _after(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words with other than a to z and words of two letters stay."""
    if len(word) <= 2 or not re.fullmatch(r"[a-z']+", word) or word in UNCHANGED:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub(r"(?:^y|(?<=[aeiouy])y)", "Y", word.removeprefix("'"))
    special = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(special) if special else _after(w, 0)
    r2 = _after(w, r1)
    w = re.sub(r"(?:'s'|'s|')$", "", w)
    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in AFTER_PLURAL:
        return w
    # Past and continuous forms, adverbs.
    if m := re.search(r"eed(?:ly)?$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(?:ed|ing)(?:ly)?$", w)) and re.search(r"[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT.search(w):
            w += "e"
    w = re.sub(r"(?<=.[^aeiouy])[yY]$", "i", w)
    # Derivations.
    for ending in sorted(SECOND, key=len, reverse=True):
        if w.endswith(ending):
            at = len(w) - len(ending)
            fits = w[at - 1 : at] == "l" if ending == "ogi" else bool(re.fullmatch(r"[cdeghkmnrt]", w[at - 1 : at])) if ending == "li" else True
            if at >= r1 and fits:
                w = w[:at] + SECOND[ending]
            break
    for ending in sorted(THIRD, key=len, reverse=True):
        if w.endswith(ending):
            at = len(w) - len(ending)
            if at >= (r2 if ending == "ative" else r1):
                w = w[:at] + THIRD[ending]
            break
    for ending in FOURTH:
        if w.endswith(ending):
            at = len(w) - len(ending)
            if at >= r2 and (ending != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """The stems of the words of an array; of phrases, word by word. Every word is worked out once
    a task."""
    return words.map(lambda ws: None if ws is None else [" ".join(map(stem, w.split(" "))) for w in ws])
