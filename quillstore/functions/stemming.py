"""Porter's stemmer (1980), for terms once each: a pandas function over distinct terms, whose result is joined back."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms that are stemmed: a search index leaves shorter and longer ones as they are.
SHORTEST, LONGEST = 3, 64

# The algorithm's endings, by step, the longer before the shorter that end them.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(w: str) -> int:
    """How often a vowel is followed by a consonant."""
    kinds = [_vowel(w, i) for i in range(len(w))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:]))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _short(w: str) -> bool:
    """Ends consonant, vowel, consonant, the last none of w, x, y."""
    n = len(w)
    return n > 2 and not _vowel(w, n - 3) and _vowel(w, n - 2) and not _vowel(w, n - 1) and w[-1] not in "wxy"


def _ending(w: str, endings) -> tuple[str, str] | None:
    """(stem, ending) by the longest ending that w has."""
    found = max((e for e in endings if w.endswith(e)), key=len, default=None)
    return (w[: len(w) - len(found)], found) if found is not None else None


@cache
def _tables() -> tuple[dict, dict]:
    return dict(STEP2), dict(STEP3)


def stem(word: str) -> str:
    """The stem of a lower-case word. Letters beyond a to z count as consonants."""
    if not SHORTEST <= len(word) <= LONGEST:
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (cut := _ending(w, ("ed", "ing"))) and _has_vowel(cut[0]):
        w = cut[0]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in _tables():
        if (cut := _ending(w, table)) and _measure(cut[0]) > 0:
            w = cut[0] + table[cut[1]]
    if (cut := _ending(w, STEP4)) and _measure(cut[0]) > 1 and (cut[1] != "ion" or cut[0].endswith(("s", "t"))):
        w = cut[0]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stemmed(term: Column | str) -> Column:
    """Stems of terms; meant for columns of distinct terms."""

    @F.pandas_udf("string")
    def each(terms: pd.Series) -> pd.Series:
        return terms.map(stem, na_action="ignore")

    return each(term)


def stems_of(terms: DataFrame) -> DataFrame:
    """(term, stem) of the distinct terms of a frame (term)."""
    distinct = terms.select("term").distinct()
    return distinct.select("term", stemmed("term").alias("stem"))
