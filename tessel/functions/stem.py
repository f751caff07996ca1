"""The Porter stemmer (M. F. Porter, 1980), and an Arrow function over it."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
MEASURE = re.compile(f"^(?:{C})?{V}{C}")
MANY = re.compile(f"^(?:{C})?{V}{C}{V}{C}")
ONE = re.compile(f"^(?:{C})?{V}{C}(?:{V})?$")
VOWEL = re.compile(f"^(?:{C})?[aeiouy]")
CVC = re.compile(f"^{C}[aeiouy][^aeiouwxy]$")
STEP2 = "ational ate tional tion enci ence anci ance izer ize bli ble alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble logi log".split()
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = re.compile("^(.+?)(al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ou|ism|ate|iti|ous|ive|ize)$")
PAIRS2 = sorted(zip(STEP2[::2], STEP2[1::2]), key=lambda p: -len(p[0]))
PAIRS3 = sorted(STEP3.items(), key=lambda p: -len(p[0]))


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if MEASURE.match(w[:-3]):
            w = w[:-1]
    elif m := re.match("^(.+?)(ed|ing)$", w):
        if VOWEL.match(m[1]):
            w = m[1]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"([^aeiouylsz])\1$", w):
                w = w[:-1]
            elif CVC.match(w):
                w += "e"
    if w.endswith("y") and VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    for pairs in (PAIRS2, PAIRS3):
        for end, new in pairs:
            if w.endswith(end):
                if MEASURE.match(w[: -len(end)]):
                    w = w[: -len(end)] + new
                break
    if m := STEP4.match(w):
        if MANY.match(m[1]):
            w = m[1]
    elif (m := re.match("^(.+?)(s|t)(ion)$", w)) and MANY.match(m[1] + m[2]):
        w = m[1] + m[2]
    if w.endswith("e") and (MANY.match(w[:-1]) or ONE.match(w[:-1]) and not CVC.match(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and MANY.match(w):
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def stems(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else stem(w))
