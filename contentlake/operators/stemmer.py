"""English stems for keyword search (R1): the Snowball English stemmer, after its published description.

Stems are computed per distinct word: a worker keeps the stems of the words that it has met (bounded), and
a batch is looked up word by word. Words with a digit or an underscore have no stem but themselves; letters
beyond a-z count as consonants. Tokens hold no apostrophes, so the rules for them are left out.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# --- fixed values: the tables of the published algorithm ----------------------------
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
         "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
         "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
FIRST_REGION = ("gener", "commun", "arsen")
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
         "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
         "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
# ------------------------------------------------------------------------------------

REGION = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]")
VOWEL = re.compile(r"[aeiouy]")
SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
PLAIN = re.compile(r"[\d_]")


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def stem(word: str) -> str:
    """The stem of one lower-case word."""
    if word in WHOLE:
        return WHOLE[word]
    if len(word) <= 2 or PLAIN.search(word):
        return word
    w = re.sub(r"([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))

    def region(start: int) -> int:
        m = REGION.match(w, start)
        return m.end() if m else len(w)

    known = next((p for p in FIRST_REGION if w.startswith(p)), None)
    r1 = len(known) if known else region(0)
    r2 = region(r1)

    # Plurals.
    end = _longest(w, ("sses", "ied", "ies", "s", "us", "ss"))
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w

    # Past forms and participles.
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[:-len(end)] + "ee"
    elif end and VOWEL.search(w[:-len(end)]):
        w = w[:-len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and not VOWEL.match(w[-2]):
        w = w[:-1] + "i"

    end = _longest(w, STEP2)
    if end and len(w) - len(end) >= r1:
        before = w[:-len(end)]
        if (end != "ogi" or before.endswith("l")) and (end != "li" or before[-1:] in tuple(LI_ENDINGS)):
            w = before + STEP2[end]
    end = _longest(w, STEP3)
    if end and len(w) - len(end) >= r1 and (end != "ative" or len(w) - len(end) >= r2):
        w = w[:-len(end)] + STEP3[end]
    end = _longest(w, STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[:-len(end)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not SHORT.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def common_prefix(stem_: str) -> str:
    """What every word with this stem begins with: the stem, but for an ending that a rule has put there
    (e; i for y; le for ility; and the few whole words of the tables)."""
    if stem_ in ("die", "lie", "tie"):
        return stem_[0]
    return stem_[:-2] if stem_.endswith("ble") else stem_[:-1] if stem_.endswith(("e", "i", "y", "bl")) and len(stem_) > 1 else stem_


@lru_cache(maxsize=500_000)
def cached_stem(word: str) -> str:
    return stem(word)


@F.pandas_udf(StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    return words.map(lambda x: None if x is None else cached_stem(x))


@F.pandas_udf(ArrayType(StringType()))
def stems_udf(words: pd.Series) -> pd.Series:
    """Stems of the words of an array, in place."""
    return words.map(lambda xs: None if xs is None else [cached_stem(x) for x in xs])


def vocabulary_stems(doc_terms: DataFrame, term_col: str = "term") -> DataFrame:
    """(term, stem) for the distinct vocabulary of ``doc_terms``."""
    from ..session import ship_package
    ship_package(doc_terms.sparkSession)  # the stemmer UDF runs in executor Python workers
    vocab = doc_terms.select(term_col).distinct()
    return vocab.withColumn("stem", stem_udf(F.col(term_col)))
