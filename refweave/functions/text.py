"""Scalar text functions as Column expressions.

All are null in, null (or an empty array) out, and stay inside the JVM.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII spellings of U+0080 to U+00BF and of the signs among the letters after it.
ASCII_SIGNS = {
    "\x80": "EUR", "\x81": " ", "\x82": ",", "\x83": "f", "\x84": ",,", "\x85": "...", "\x86": "+", "\x87": "++", "\x88": "^", "\x89": "%", "\x8a": "S", "\x8b": "<", "\x8c": "OE", "\x8d": "?", "\x8e": "Z", "\x8f": "?",
    "\x90": "?", "\x91": "'", "\x92": "'", "\x93": '"', "\x94": '"', "\x95": "*", "\x96": "-", "\x97": "--", "\x98": "~", "\x99": "(TM)", "\x9a": "s", "\x9b": ">", "\x9c": "oe", "\x9d": "?", "\x9e": "z", "\x9f": "Y",
    "\xa0": " ", "\xa1": "!", "\xa2": "c", "\xa3": "GBP", "\xa4": "$", "\xa5": "YEN", "\xa6": "|", "\xa7": "S", "\xa8": "..", "\xa9": "", "\xaa": "(th)", "\xab": "<<", "\xac": "!", "\xad": " ", "\xae": "(R)", "\xaf": "-",
    "\xb0": "o", "\xb1": "+-", "\xb2": "2", "\xb3": "3", "\xb4": "'", "\xb5": "u", "\xb6": "P", "\xb7": "*", "\xb8": ",", "\xb9": "1", "\xba": "(th)", "\xbb": ">>", "\xbc": "1/4", "\xbd": "1/2", "\xbe": "3/4", "\xbf": "?",
    "\xc6": "AE", "\xd0": "D", "\xd7": "*", "\xd8": "O", "\xde": "b", "\xdf": "ss", "\xe6": "ae", "\xf0": "o", "\xf7": "/", "\xf8": "o", "\xfe": "b",
}
WORD = "[A-Za-zßäöü]{2,}"

# A small list of function words in the languages of the data; a parameter everywhere.
STOPWORDS = (
    "a an and are as at by for from in into is it of on or that the this to under with "
    "aus das dem den der des die ein eine einer im in ist mit nach oder und vom von zu zum zur zwischen "
    "à au aux de des du en est et la le les sur un une "
    "в и из к как на о от по с у"
).split()


def ascii_table(windows_only: bool = False) -> dict[str, str]:
    """Character -> ASCII: accented letters lose the accent, signs are spelt out; or only U+0080 to U+009F."""
    letters = {}
    for code in range(0xC0, 0x100):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2:
            letters[chr(code)] = parts[0]
    table = ASCII_SIGNS | letters
    return {c: a for c, a in sorted(table.items()) if not windows_only or c < "\xa0"}


def ascii_fold(text: Column, windows_only: bool = False) -> Column:
    """U+0080 to U+00FF in ASCII; other characters stay."""
    table = ascii_table(windows_only)
    single = {c: a for c, a in table.items() if len(a) == 1}
    for c, a in table.items():
        if len(a) != 1:
            text = F.replace(text, F.lit(c), F.lit(a))
    return F.translate(text, "".join(single), "".join(single.values()))


def html_fold(text: Column) -> Column:
    """Characters from U+00A0 to U+00FF as numeric-free named entities where a name exists."""
    from html.entities import codepoint2name

    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for code, name in sorted(codepoint2name.items()):
        if 0xA0 <= code <= 0xFF:
            text = F.replace(text, F.lit(chr(code)), F.lit(f"&{name};"))
    return text


def _windows(length: Column, n: int, take) -> Column:
    """``take(i)`` for i = 1 .. length - n + 1; empty where there is none."""
    return F.when(length >= n, F.transform(F.sequence(F.lit(1), length - (n - 1)), take)).otherwise(F.array().cast("array<string>"))


def ngrams(text: Column, n: int) -> Column:
    """Character n-grams of the lower-cased text, padded with n - 1 underscores on both sides; none of an empty text."""
    pad = "_" * (n - 1)
    padded = F.concat(F.lit(pad), F.lower(text), F.lit(pad))
    # As a lambda's variable, the padded text is made once and not again for every gram.
    grams = F.get(F.transform(F.array(padded), lambda p: _windows(F.length(p), n, lambda i: F.substring(p, i, F.lit(n)))), F.lit(0))
    return F.when(F.length(text) > 0, grams).otherwise(F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """Lower-cased words of two letters or more."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def wordgrams(text: Column, n: int) -> Column:
    """Runs of n words joined by underscores; no padding."""
    own = words(text)
    return _windows(F.size(own), n, lambda i: F.array_join(F.slice(own, i, n), "_"))


def tokens(text: Column, stopwords: list[str] | tuple[str, ...] = tuple(STOPWORDS)) -> Column:
    """Lower-cased runs of letters, digits and underscores that are no stopwords."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.coalesce(F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found, F.array().cast("array<string>"))


def char_ngrams(text: Column, n: int, by_word: bool = False) -> Column:
    """Unpadded n-grams of the folded text with underscores for spaces; or of each of its words."""
    folded = ascii_fold(text)
    if by_word:
        own = F.split(folded, " ")
        return F.flatten(F.transform(own, lambda w: _windows(F.length(w), n, lambda i: F.substring(w, i, F.lit(n)))))
    joined = F.replace(folded, F.lit(" "), F.lit("_"))
    return _windows(F.length(joined), n, lambda i: F.substring(joined, i, F.lit(n)))


def year_pairs(year: Column, next_year: int) -> tuple[Column, Column]:
    """Two overlapping tokens of a year, so that years one apart share one; null after ``next_year``."""
    ok = year <= next_year
    pair = lambda a, b: F.when(ok, F.concat(a.cast("string"), b.cast("string")).try_cast("long"))
    return pair(year - 1, year), pair(year, year + 1)


def author_norm(name: Column) -> Column:
    return ascii_fold(F.lower(name))


def bundle(*slots: Column) -> Column:
    """Interchangeable slots as an array: distinct, sorted, nulls last, of the slots' number."""
    own = F.array_sort(F.array_distinct(F.array_compact(F.array(*slots))))
    return F.transform(F.sequence(F.lit(0), F.lit(len(slots) - 1)), lambda i: F.get(own, i))


def representation_id(values: list[Column]) -> Column:
    """SHA-1 over the numbered values of a bundled row."""
    parts = [F.concat(F.lit(f"{i}*+"), F.coalesce(v.cast("string"), F.lit("None"))) for i, v in enumerate(values)]
    return F.sha1(F.concat_ws("#+*", *parts))


def clean_int(value: Column, low: Column | int, high: Column | int) -> Column:
    """An integer within bounds, else null; null where a bound is missing."""
    low, high = (b if isinstance(b, Column) else F.lit(b) for b in (low, high))
    number = value.try_cast("long")
    return F.when((number >= low) & (number <= high), number)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logistic_curve(t: Column, growth: float, k: float, f0: float) -> Column:
    """Logistic growth from f0 to the limit: growth / (1 + e^(-k growth t) (growth / f0 - 1))."""
    return F.lit(growth) / (1 + F.exp(F.lit(-k * growth) * t) * F.lit(growth / f0 - 1))


def root_curve(x: Column, scale: float, n: float, offset: float) -> Column:
    """The n-th root, scaled and lowered: scale x^(1/n) - offset."""
    return F.lit(scale) * F.pow(x, F.lit(1.0 / n)) - offset


def double_logistic_curve(x: Column, height: float, m: float, start: float) -> Column:
    """A steep logistic curve and a slow one of an m-th of its pace, added."""
    return logistic_curve(x, height, height, start) + logistic_curve(x, height, height / m, start / (m * 2000.0))


def serialised(pairs: Column) -> Column:
    """Feature pairs (type, value) as text: sorted, ``type&"value"`` with semicolons between."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["type"], F.lit('&"'), p["value"], F.lit('"'))), ";")


def similarity(kind: str, shared: Column, a: Column, b: Column) -> Column:
    """jaccard, dice, overlap or cosine from the sizes of two sets and of what they share; probability: the part of a."""
    return {
        "jaccard": shared / (a + b - shared),
        "dice": 2 * shared / (a + b),
        "overlap": shared / F.least(a, b),
        "cosine": shared / F.sqrt(a * b),
        "probability": shared / a,
    }[kind]


def strip_last_part(identifier: Column) -> Column:
    """The id without its last underscore-separated part: a cluster id from a duplicate id."""
    return F.regexp_replace(identifier, "_[^_]*$", "")
