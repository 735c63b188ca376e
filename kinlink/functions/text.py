"""Text scalars for record normalisation, as Column functions.

Everything is a built-in expression but transliteration and accent stripping,
which are Arrow-batched and get null for texts that don't need them.
Patterns use (?U) where words may hold letters beyond ASCII.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinlink.functions import rules

BRAHMIC = "[ऀ-ൿ]"


def _chars(offsets) -> str:
    """Character class body: these offsets in every Brahmic block."""
    return "".join(chr(block + o) for block in range(0x900, 0xD80, 0x80) for o in offsets)


_RRA, _RRA_VIRAMA = "റ", "റ്"
_VOWEL_STOPS = _chars([*rules.VOWEL_SIGNS, rules.VIRAMA, *rules.SILENT_MARKS])
_LETTER = re.compile(f"(?P<geminate>{_RRA}(?=്{_RRA}))|(?P<consonant>[{_chars(rules.CONSONANTS)}])(?P<vowel>(?=[{_chars([rules.NUKTA])}]*[ऀ-ൿ](?<![{_VOWEL_STOPS}{_chars([rules.NUKTA])}])))?|(?P<sign>{BRAHMIC})")
_SIGNS = rules.INDEPENDENT_VOWELS | rules.VOWEL_SIGNS | rules.OTHER_SIGNS | {o: "" for o in (rules.VIRAMA, rules.NUKTA, *rules.SILENT_MARKS)} | {rules.FIRST_DIGIT + d: str(d) for d in range(10)}


def transliterate_text(text: str) -> str:
    """Latin rendering of Brahmic letters: a consonant keeps its inherent vowel unless a vowel
    sign, virama or silent mark follows, or no Brahmic letter does."""
    text = text.replace("‌", "").replace("‍", "")

    def sound(m: re.Match) -> str:
        if m["geminate"]:
            return "t"
        if letter := m["consonant"]:
            doubled = letter == _RRA and text.endswith(_RRA_VIRAMA, 0, m.start())
            return ("t" if doubled else rules.CONSONANTS[ord(letter) & 0x7F]) + ("a" if m["vowel"] is not None else "")
        return _SIGNS.get(ord(m["sign"]) & 0x7F, " ")

    text = re.sub(rules.PRIVATE_LIMITED_SHORT, "private limited", _LETTER.sub(sound, text))
    return " ".join(rules.TRANSLITERATED_WORDS.get(w, w) for w in text.split(" "))


def mapped_text(text: str, words: dict[str, str]) -> str:
    return re.sub(rules.MAP_TOKEN, lambda m: words.get(m[0], m[0]), text)


def transliterate(text: Column, words: dict[str, str] | None = None) -> Column:
    """Learned word map first, then letters; only texts with Brahmic letters reach Python."""
    words = dict(words or {})

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: transliterate_text(mapped_text(t, words) if words else t), na_action="ignore")

    return F.coalesce(run(F.when(text.rlike(BRAHMIC), text)), text)


@F.pandas_udf(StringType())
def _unaccented(s: pd.Series) -> pd.Series:
    return s.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)), na_action="ignore")


def strip_accents(text: Column) -> Column:
    """NFKD without combining marks; only texts beyond ASCII reach Python."""
    return F.coalesce(_unaccented(F.when(text.rlike("[^\\x00-\\x7F]"), text)), text)


def join_apostrophes(text: Column) -> Column:
    return F.regexp_replace(text, "['’`]", "")


def drop_website_parts(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)" + rules.WEBSITE, " ")


def drop_junk_ids(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)" + rules.NAME_JUNK, " ")


def strip_leading_zeros(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)(?<!\\d)0+(?=\\d)", "")


def spell_ampersand(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)\\s*&\\s*", " and ")


def drop_punctuation(text: Column, keep: str = "") -> Column:
    return F.regexp_replace(text, f"(?U)[^\\w\\s{keep}]", " ")


def collapse_spaces(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "(?U)\\s+", " "))


def digits_as_letters(text: Column) -> Column:
    """In words with a digit and two letters or more, ordinals apart, digits become the letters they stand for."""

    def fixed(w: Column) -> Column:
        letters = F.length(F.regexp_replace(w, "[^\\p{L}]", "")) >= 2
        return F.when(w.rlike("(?U)\\d") & letters & ~w.rlike("(?U)" + rules.ORDINAL), F.translate(w, rules.DIGITS, rules.AS_LETTERS)).otherwise(w)

    return F.array_join(F.transform(F.split(collapse_spaces(text), " "), fixed), " ")


def replace_words(text: Column, words: dict[str, str]) -> Column:
    """Whole-word replacements by dictionary. No value is a key with another value, so one look-up a word equals the rules in any order."""
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    spaced = F.regexp_replace(text, "(?U)(\\w+|[^\\w]+)", "$1\u0000")
    parts = F.filter(F.split(spaced, "\u0000"), lambda p: p != "")
    # a map is searched entry by entry, a set of keys by hash
    return F.array_join(F.transform(parts, lambda w: F.when(w.isin(*words), F.element_at(table, w)).otherwise(w)), "")


def strip_legal_forms(text: Column) -> Column:
    return collapse_spaces(F.regexp_replace(text, "(?iU)\\b(?:" + "|".join(rules.LEGAL_FORMS) + ")\\b", " "))


def landmark(text: Column) -> Column:
    return F.btrim(F.regexp_extract(text, rules.LANDMARK, 0))


def house_number(text: Column) -> Column:
    """The number after an explicit marker, after no/#/n°, or of the first component that starts with one."""

    def group(pattern: str, x: Column) -> Column:
        return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))

    of_parts = F.filter(F.transform(F.split(text, ","), lambda c: group(rules.HOUSE_COMPONENT, c)), lambda x: x.isNotNull())
    found = F.coalesce(group(rules.HOUSE_EXPLICIT, text), group(rules.HOUSE_NO, text), F.get(of_parts, 0), F.lit(""))
    return F.regexp_replace(found, "\\s+", "")


def order_free_key(text: Column) -> Column:
    """Sorted distinct tokens, commas as spaces."""
    tokens = F.split(collapse_spaces(F.replace(text, F.lit(","), F.lit(" "))), " ")
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


def name_norm(raw: Column, words: dict[str, str] | None = None) -> Column:
    """A cleaned name: transliterated, without accents, sites and junk ids, words spelled out; null gives ''."""
    text = F.lower(strip_accents(transliterate(F.coalesce(raw, F.lit("")), words)))
    text = strip_leading_zeros(drop_junk_ids(drop_website_parts(join_apostrophes(text))))
    text = digits_as_letters(drop_punctuation(spell_ampersand(text)))
    return collapse_spaces(replace_words(text, rules.NAME_WORDS))


def is_missing_address(raw: Column) -> Column:
    text = F.lower(collapse_spaces(F.coalesce(raw, F.lit(""))))
    return text.isin("", *rules.MISSING_ADDRESSES)


def address_base(raw: Column) -> Column:
    """The lower-cased address from which landmark and house number are read."""
    text = F.lower(strip_accents(transliterate(F.coalesce(raw, F.lit("")))))
    return F.when(is_missing_address(raw), F.lit("")).otherwise(text)


def address_norm(base: Column) -> Column:
    """The cleaned address of a base that :func:`address_base` gave; commas stay."""
    text = drop_punctuation(spell_ampersand(join_apostrophes(strip_leading_zeros(base))), keep=",")
    return collapse_spaces(replace_words(text, rules.ADDRESS_WORDS))
