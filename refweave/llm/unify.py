"""Visually identical text with different characters (problem 1).

``consistent`` is a pure SQL expression that rewrites one value into the
consistent form: no invisible characters, ordinary spaces, hyphens and widths,
single letters for joined ones, precomposed accents, each word in the letters
of one script. ``canonical_values`` groups the values, with look-alikes mapped,
under the accent-sensitive Unicode collation, for which combining and precomposed
accents are equal and characters without a weight don't count, takes one canonical
member per class and joins it back to every row.

Defined cases: null values give no row; the empty string is its own class;
values with nothing to rewrite come out as they are; words wholly Cyrillic or
Greek are left alone; repeated rows stay repeated; columns of any other name
are ignored and never clash, as only key, field and value are carried.
"""

from __future__ import annotations

import unicodedata
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refweave.sources.tables import cut

# Characters that show nothing, spaces that are not U+0020 and
# hyphens that are not U+002D, as Java character-class bodies.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011\ufe63"

# Joined letters and what they stand for.
JOINED = {
    "\ufb00": "ff",
    "\ufb01": "fi",
    "\ufb02": "fl",
    "\ufb03": "ffi",
    "\ufb04": "ffl",
    "\ufb05": "st",
    "\ufb06": "st",
    "\u0132": "IJ",
    "\u0133": "ij",
}

# Letters of one script that look like letters of another.
CYRILLIC_AS_LATIN = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ё": "ë", "ї": "ï", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ё": "Ë", "Ї": "Ï",
}
GREEK_AS_LATIN = {
    "α": "a", "β": "ß", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}

_SHIFTED = str.maketrans({chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)})
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_LETTER_SIGNS = {"\u212a": "K", "\u212b": "\u00c5", "\u2126": "\u03a9"}
# Letter ranges of the three scripts; a run of letters is mixed where letters of two of them meet.
LATIN, GREEK, CYRILLIC = r"A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ", r"Ͱ-Ͽἀ-῿", r"Ѐ-ԯ"
_MARK = r"[̀-ͯ]"
_MIXED = f"[{LATIN}]{_MARK}*[{GREEK}{CYRILLIC}]|[{GREEK}{CYRILLIC}]{_MARK}*[{LATIN}]|[{GREEK}]{_MARK}*[{CYRILLIC}]|[{CYRILLIC}]{_MARK}*[{GREEK}]"
_ACCENTED = r"[\p{L}\p{N}]" + _MARK
# Below U+0180 only U+00A0 and U+00AD call for a rewrite: most values need no more than this scan.
_UNUSUAL = "[ ­ƀ-￿]"
_REWRITTEN = f"[{INVISIBLE}{SPACES}{HYPHENS}{''.join(JOINED)}{''.join(_LETTER_SIGNS)}" + "！-～]|" + _ACCENTED + "|" + _MIXED


def suspect(value: Column) -> Column:
    """Whether a value may differ from its consistent form."""
    return value.rlike(_UNUSUAL) & value.rlike(_REWRITTEN)


@lru_cache(1)
def _compositions() -> dict[str, str]:
    """Base letter and accent -> the one letter, for every pair that composes."""
    blocks = [*range(0xC0, 0x250), *range(0x386, 0x3CF), *range(0x400, 0x530), *range(0x1E00, 0x1F00)]
    pairs = {}
    for code in blocks:
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == letter:
            pairs[parts] = letter
            first, rest = parts[:-1], parts[-1]
            pairs[unicodedata.normalize("NFC", first) + rest] = letter
    return pairs


def _count(word: Column, pattern: str) -> Column:
    return F.length(word) - F.length(F.regexp_replace(word, pattern, ""))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _one_script(word: Column) -> Column:
    """A word of several scripts in the letters of one.

    A Latin letter that no other script imitates makes it Latin; else a
    Cyrillic letter that Latin has no like of makes it Cyrillic; else the
    script of most letters, Latin on a tie.
    """
    to_latin = CYRILLIC_AS_LATIN | GREEK_AS_LATIN
    latin_like = {v: k for k, v in CYRILLIC_AS_LATIN.items()}
    latin = F.translate(word, "".join(to_latin), "".join(to_latin.values()))
    greek_cyrillic = {g: latin_like[v] for g, v in GREEK_AS_LATIN.items() if v in latin_like}
    source = latin_like | greek_cyrillic
    cyrillic = F.translate(word, "".join(source), "".join(source.values()))
    plainly_latin = word.rlike(rf"[{LATIN}&&[^{''.join(latin_like)}]]")
    plainly_cyrillic = word.rlike(rf"[{CYRILLIC}&&[^{''.join(CYRILLIC_AS_LATIN)}]]")
    more_cyrillic = _count(word, f"[{CYRILLIC}]") > _count(word, f"[{LATIN}]")
    return F.when(plainly_latin, latin).when(plainly_cyrillic | more_cyrillic, cyrillic).otherwise(latin)


def _pieces(text: Column, pattern: str, change) -> Column:
    """The text with ``change`` applied to each of the pieces it consists of."""
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.transform(parts, change), "")


def _composed(text: Column) -> Column:
    """Letters and their combining accents as single letters where there are such."""
    table = F.lit("".join(pair + letter for pair, letter in _compositions().items() if len(pair) == 2))

    def known(pair: Column) -> Column:
        # An accent stands only in second place of a triple, so that a pair is found at its triple or not at all.
        return _let(F.instr(table, pair), lambda at: F.when((at > 0) & (F.length(pair) == 2), F.substring(table, at + 2, F.lit(1))).otherwise(pair))

    def compose(cluster: Column) -> Column:
        two = known(F.substring(cluster, 1, 2))
        three = F.when(F.length(cluster) > 2, _let(F.concat(two, F.substring(cluster, 3, 1)), known)).otherwise(two)
        return F.when(cluster.rlike("^" + _ACCENTED), F.concat(three, F.substring(cluster, F.lit(4), F.length(cluster)))).otherwise(cluster)

    pieces = _pieces(text, rf"(?s)[\p{{L}}\p{{N}}]{_MARK}+|.(?:(?![\p{{L}}\p{{N}}]{_MARK}).)*", compose)
    return F.when(text.rlike(_ACCENTED), pieces).otherwise(text)


def _single_scripts(text: Column) -> Column:
    words = _pieces(text, r"(?s)[\p{L}̀-ͯ]+|[^\p{L}̀-ͯ]+", lambda w: F.when(w.rlike(_MIXED), _one_script(w)).otherwise(w))
    return F.when(text.rlike(_MIXED), words).otherwise(text)


def _visible(raw: Column) -> Column:
    """Without invisible characters, with ordinary spaces, hyphens, widths and single letters."""
    text = F.regexp_replace(raw, f"[{INVISIBLE}]", "")
    text = F.translate(text, SPACES + HYPHENS + _WIDE, " " * len(SPACES) + "-" * len(HYPHENS) + _WIDE.translate(_SHIFTED))
    for sign, plain in (JOINED | _LETTER_SIGNS).items():
        text = F.replace(text, F.lit(sign), F.lit(plain))
    return text


def consistent(value: Column) -> Column:
    """The value in the consistent form; null stays null."""
    # Accents before scripts, so that a letter and its accent count as one; again after, for accents on replaced letters.
    rewritten = _let(_let(_let(_visible(value), _composed), _single_scripts), _composed)
    return F.when(suspect(value), rewritten).otherwise(value)


def mapped(value: Column) -> Column:
    """The value with look-alikes mapped and accents as they stand, which the collation tells equal."""
    return F.when(suspect(value), _let(_visible(value), _single_scripts)).otherwise(value)


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """The kept columns and new ones that are worked out once per row.

    They are made inside a generator, past which no filter is pushed: a filter
    on them doesn't repeat the work.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")
    return df.select(*keep, made).select(*keep, *[F.col(f"_made.{n}").alias(n) for n in columns])


def field_values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row (key, fieldname, value, alike, plain) for every non-null value of the fields.

    alike: the value with look-alikes mapped, null where that is plain; plain:
    its consistent form. They are made inside the generator, past which no
    filter is pushed, so that they are worked out once per value.
    """

    def one(field: str) -> Column:
        value = F.col(field).cast("string")
        made = lambda p: F.struct(F.lit(field).alias("fieldname"), value.alias("value"), F.nullif(mapped(value), p).alias("alike"), p.alias("plain"))
        return _let(consistent(value), made)

    pairs = F.explode(F.array(*[one(f) for f in fields]))
    return df.select(F.col(key).alias("key"), pairs.alias("p")).select("key", "p.fieldname", "p.value", "p.alike", "p.plain").where("value is not null")


def canonical_values(values: DataFrame) -> DataFrame:
    """(key, fieldname, value, canonical) for the rows of ``field_values``.

    Classes are those of ``collate(.., 'UNICODE')``, which minds accents and
    case, over the values with look-alikes mapped. The canonical member is the
    consistent form of a member that occurs in that form, else of any, the
    shortest and then the smallest first.
    """
    spark = values.sparkSession
    # Equal under the collation means equal plain ASCII letters and digits (letters that bear an accent set aside): hashing these first
    # spares all but a few of the costly comparisons.
    skeleton = F.xxhash64(F.regexp_replace(F.coalesce("alike", "plain"), r"[A-Za-z0-9]\p{M}+|[^A-Za-z0-9]+", ""))
    kept = cut(values.withColumn("skeleton", skeleton))
    view = f"refweave_unify_{uuid.uuid4().hex[:12]}"
    kept.createOrReplaceTempView(view)
    return spark.sql(
        f"""
        with classes as (
            select skeleton, collate(coalesce(alike, plain), 'UNICODE') as class, min(struct(value <> plain, length(plain), plain)).plain as canonical
            from {view} group by skeleton, collate(coalesce(alike, plain), 'UNICODE')
        )
        select v.key, v.fieldname, v.value, c.canonical
        from {view} v join classes c on v.skeleton = c.skeleton and collate(coalesce(v.alike, v.plain), 'UNICODE') = c.class
        """
    )


@lru_cache(1)
def _bare_letters() -> dict[str, str]:
    """Lower-case accented letters and the letter under the accent, by decomposition, and a few that don't decompose."""
    bare = {"ø": "o", "ł": "l", "đ": "d", "ı": "i"}
    for code in [*range(0xE0, 0x180), *range(0x430, 0x460), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and chr(code).islower():
            bare[chr(code)] = parts[0]
    return bare


def compared(value: Column, keep: str = "") -> Column:
    """A form for comparison: consistent, lower case, without accents, umlauts and their spellings alike, words parted by one space.

    keep: further characters that stay, as the body of a character class.
    """
    bare = _bare_letters()
    text = F.translate(F.lower(consistent(value)), "".join(bare), "".join(bare.values()))
    text = F.replace(F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    text = F.regexp_replace(text, "([aou])e", "$1")
    return F.trim(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{keep}]+", " "))
