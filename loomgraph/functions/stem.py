"""English word stems by Porter's rules of 1980, and letters without their accents."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The rules' suffixes and what takes their place.
_STEP2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()
_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def folded(text: Column) -> Column:
    """Lower-case text whose Latin letters have no accents."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def _shape(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[i - 1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def stem(word: str) -> str:
    """The word's stem; words of one or two letters and of other letters than a to z stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    w = re.sub("sses$", "ss", word)
    w = re.sub("ies$", "i", w) if w == word else w
    w = w[:-1] if w == word and w.endswith("s") and not w.endswith("ss") else w
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    elif (m := re.search("(ed|ing)$", w)) and "v" in _shape(w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")) or _measure(w) == 1 and _short_end(w):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (dict(zip(_STEP2[::2], _STEP2[1::2], strict=True)), _STEP3):
        if end := max((s for s in rules if w.endswith(s)), key=len, default=""):
            w = w[: -len(end)] + rules[end] if _measure(w[: -len(end)]) else w
    ends = [s for s in _STEP4 if w.endswith(s)] + (["ion"] if w.endswith(("sion", "tion")) else [])
    if (end := max(ends, key=len, default="")) and _measure(w[: -len(end)]) > 1:
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(T.StringType())
def stemmed(words: pd.Series) -> pd.Series:
    """Stems of a column of words; meant for distinct ones."""
    return words.map(lambda w: None if w is None else stem(w))
