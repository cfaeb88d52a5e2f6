"""The published Snowball stemmer for Portuguese, applied to distinct terms."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: suffixes of the published algorithm; ã and õ are written a~ and o~
STANDARD = "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split()
VERB = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam "
    "aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias "
    "arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is "
    "ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos "
    "aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos "
    "eu iu ou ira iras"
).split()
RESIDUAL = "os a i o á í ó".split()
VOWELS = frozenset("aeiouáéíóúâêô")
_BY_LENGTH = {id(x): sorted(x, key=len, reverse=True) for x in (STANDARD, VERB, RESIDUAL)}


def _after_vowel_consonant(word: str, start: int) -> int:
    """Where the region begins after the first consonant that follows a vowel, from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _verb_region(word: str) -> int:
    if len(word) < 2:
        return len(word)
    if word[1] not in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] in VOWELS), len(word))
    if word[0] in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in VOWELS), len(word))
    return min(3, len(word))


def _longest(word: str, suffixes: list[str]) -> str | None:
    return next((s for s in _BY_LENGTH[id(suffixes)] if word.endswith(s)), None)


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    w = word.replace("ã", "a~").replace("õ", "o~")
    rv = _verb_region(w)
    r1 = _after_vowel_consonant(w, 0)
    r2 = _after_vowel_consonant(w, r1)

    def within(suffix: str, region: int, text: str) -> bool:
        return text.endswith(suffix) and len(text) - len(suffix) >= region

    def also(text: str, *befores: str) -> str:
        for b in befores:
            if within(b, r2, text):
                return text[: -len(b)]
        return text

    def standard() -> str | None:
        endings = [*STANDARD, "logia", "logias", "uça~o", "uço~es", "ência", "ências", "amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos", "ira", "iras"]
        s = next((x for x in sorted(endings, key=len, reverse=True) if w.endswith(x)), None)
        if s is None:
            return None
        cut = w[: -len(s)]
        if s == "amente":
            if not within(s, r1, w):
                return None
            if within("iv", r2, cut):
                return also(cut[:-2], "at")
            return also(cut, "os", "ic", "ad")
        if s in ("ira", "iras"):
            return cut + "ir" if within(s, rv, w) and cut.endswith("e") else None
        if not within(s, r2, w):
            return None
        if s in ("logia", "logias"):
            return cut + "log"
        if s in ("uça~o", "uço~es"):
            return cut + "u"
        if s in ("ência", "ências"):
            return cut + "ente"
        if s == "mente":
            return also(cut, "ante", "avel", "ível")
        if s in ("idade", "idades"):
            return also(cut, "abil", "ic", "iv")
        if s in ("iva", "ivo", "ivas", "ivos"):
            return also(cut, "at")
        return cut

    def verb() -> str | None:
        s = next((x for x in _BY_LENGTH[id(VERB)] if within(x, rv, w)), None)
        return None if s is None else w[: -len(s)]

    done = standard()
    if done is None:
        done = verb()
    if done is not None:
        w = done
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    else:
        s = _longest(w, RESIDUAL)
        if s and within(s, rv, w):
            w = w[: -len(s)]
    if w and w[-1] in "eéê" and len(w) - 1 >= rv:
        w = w[:-1]
        if (w.endswith("gu") or w.endswith("ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


@F.pandas_udf(T.StringType())
def stemmed(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))


def stem_terms(terms: DataFrame, term_col: str, protected: list[str] | None = None) -> DataFrame:
    """``terms`` with ``stem``: each distinct term is stemmed once; protected terms stay as they are."""
    distinct = terms.select(term_col).distinct()
    keep = F.col(term_col).isin(protected) if protected else F.lit(False)
    return terms.join(distinct.withColumn("stem", F.when(keep, F.col(term_col)).otherwise(stemmed(term_col))), term_col, "left")
