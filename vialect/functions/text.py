"""Name normalization as Column -> Column builders; everything stays in JVM expressions."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vialect.settings import DEFAULTS, Settings

# Street type words in their normalized form.
STREET_TYPES = ("aleja", "cesta", "chodnik", "dolina", "most", "nabr", "nabrezie", "nam", "namestie", "park", "plac", "rad", "sady", "trieda", "ul", "ulica", "ut", "utca")
# Inflection suffixes of street names, and those of words in entity labels, in the order they are tried.
NAME_SUFFIXES = ("ovska", "ovske", "ovskeho", "ovskej", "ov", "ova", "ovo", "sky", "ska", "ske", "ski", "eho", "ej", "a", "o", "u", "y", "i")
WORD_SUFFIXES = ("oveho", "ovej", "ova", "ovo", "ov", "eho", "ej", "a", "o", "u", "y", "i", "e")
# Letters whose ASCII form isn't their base letter.
LONG_FORMS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij"}
SHORT_FORMS = {"ø": "o", "đ": "d", "ð": "d", "ł": "l", "ħ": "h", "ı": "i", "ŧ": "t", "ſ": "s"}
# Rarer Latin letters, and Greek and Cyrillic ones, by one ASCII letter each.
RARE_SHORT = dict(
    zip(
        "ȷĸŀƀƃƈƌƍƒƙƚƛƞƥƫƭƴƶƿǥȡȥȴȵȶȼȿɀɇɉɋɍɏ" + "αβγδεζηικλμνξοπρσςτυω" + "абвгдезийклмнопрстуфыэґіјѝў",
        "jklbbcddfkllnpttyzwgdzlntcszejqry" + "abgdezeiklmnxoprsstuo" + "abvgdeziiklmnoprstufyegijiu",
        strict=True,
    )
)
RARE_LONG = {
    "ŋ": "ng", "ƕ": "hv", "ƣ": "oi", "ǆ": "dz", "ǉ": "lj", "ǌ": "nj", "ǳ": "dz", "ǣ": "ae", "ǽ": "ae", "ȣ": "ou", "ȝ": "y", "ȸ": "db", "ȹ": "qp", "ŉ": " n", "ǯ": "zh",
    "θ": "th", "φ": "ph", "χ": "kh", "ψ": "ps",
    "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ё": "io", "ѐ": "ie", "ђ": "dj", "ѓ": "gj", "є": "ie", "ѕ": "dz", "ї": "yi", "љ": "lj", "њ": "nj", "ћ": "tsh", "ќ": "kj", "џ": "dzh",
}


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def latin_table() -> tuple[str, str]:
    """Lower-case letters with marks and their ASCII letters: from the canonical decompositions of Unicode, down to a letter
    of the lists above."""
    found = SHORT_FORMS | RARE_SHORT
    for code in (*range(0xDF, 0x250), *range(0x370, 0x3D0), *range(0x430, 0x460), *range(0x1E00, 0x2000)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        base = found.get(base, base)
        if chr(code) not in found and chr(code) not in RARE_LONG and base != chr(code) and base.isascii() and base.islower():
            found[chr(code)] = base
    return "".join(found), "".join(found.values())


def ascii_norm(s: Column) -> Column:
    """Lower-case ASCII letters, digits and single spaces; anything else is a space. Marks are dropped; Latin, Greek and
    Cyrillic letters are transliterated."""

    def rare(t: Column) -> Column:
        spelled = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), RARE_LONG.items(), t)
        return F.when(t.rlike(f"[{''.join(RARE_LONG)}]"), spelled).otherwise(t)

    def spelled(t: Column) -> Column:
        t = F.regexp_replace(t, "[̀-ͯ]", "")
        t = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LONG_FORMS.items(), t)
        return F.translate(once(t, rare), *latin_table())  # few names hold any of the rare letters

    s = once(F.lower(s), lambda t: F.when(t.rlike(r"[^\x00-\x7f]"), spelled(t)).otherwise(t))
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


@F.pandas_udf(T.StringType())
def ascii_norm_unicode(s: pd.Series) -> pd.Series:
    """As ``ascii_norm`` for text in compatibility forms (ligatures, full-width letters), which Spark has no function for."""
    folded = s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t.lower()))
    table = str.maketrans({**LONG_FORMS, **SHORT_FORMS, **RARE_SHORT, **RARE_LONG})
    return folded.map(lambda t: None if t is None else " ".join("".join(c if c.isascii() and c.isalnum() else "" if unicodedata.combining(c) else " " for c in t.translate(table)).split()))


def tokens(s: Column) -> Column:
    """The words of a normalized name; none for the empty name."""
    return F.filter(F.split(s, " "), lambda t: t != "")


def is_street_type(t: Column) -> Column:
    return t.isin(*STREET_TYPES)


def is_initial(t: Column) -> Column:
    return t.rlike("^[a-z]$")


def significant(words: Column) -> Column:
    """Words that are neither street types nor initials."""
    return F.filter(words, lambda t: ~is_street_type(t) & ~is_initial(t))


def preprocess_name(name: Column) -> Column:
    """The significant words of a name, joined by spaces; empty if there are none."""
    return F.array_join(significant(tokens(ascii_norm(name))), " ")


def _letters() -> tuple[np.ndarray, dict[bytes, bytes]]:
    """What ``ascii_norm`` makes of each lower-case letter: a byte by its code, the last for all from there on, and what
    bytes beyond ASCII stand for; 0 goes."""
    table = np.full(0x2001, ord(" "), np.uint8)
    for letter in string.ascii_lowercase + string.digits:
        table[ord(letter)] = ord(letter)
    for letter, value in zip(*latin_table(), strict=True):
        table[ord(letter)] = ord(value)
    table[0x300:0x370] = 0
    long = {**RARE_LONG, **LONG_FORMS}
    for k, letter in enumerate(long):
        table[ord(letter)] = 0x80 + k
    return table, {bytes([0x80 + k]): value.encode() for k, value in enumerate(long.values())}


_LETTERS, _SPELLED = _letters()
_TYPES = re.compile(rf" (?:{'|'.join(STREET_TYPES)}) ".encode())


def without_types(lowered: str) -> bytes:
    """The words of a lower-case name as ``ascii_norm`` writes them, but for street types, between spaces."""
    codes = np.frombuffer(lowered.encode("utf-32-le"), np.uint32)
    words = _LETTERS[np.minimum(codes, len(_LETTERS) - 1)].tobytes()
    if not words.isascii():
        for code, value in _SPELLED.items():
            words = words.replace(code, value)
    return _TYPES.sub(b" ", b" " + words.translate(None, b"\0").replace(b" ", b"  ") + b" ")


@F.pandas_udf(T.StringType())
def _significant_words(lowered: pd.Series) -> pd.Series:
    return lowered.map(lambda t: b" ".join(w for w in without_types(t).split() if len(w) > 1 or w.isdigit()).decode(), na_action="ignore")


def preprocess_text(name: Column) -> Column:
    """As ``preprocess_name``, for whole texts: one pass over the letters instead of one for every rare letter."""
    return _significant_words(F.lower(name))


def strip_longest(word: Column, suffixes: tuple[str, ...]) -> Column:
    """The word without the longest suffix that leaves three characters: the shortest such stem is the one that matches."""
    return F.regexp_replace(word, rf"^(.{{3,}}?)(?:{'|'.join(suffixes)})$", "$1")


def strip_suffix(word: Column) -> Column:
    return strip_longest(word, NAME_SUFFIXES)


def stem_word(word: Column) -> Column:
    return strip_longest(ascii_norm(word), WORD_SUFFIXES)


def ordinal_key(words: Column) -> Column:
    """``1_maja`` for the first number that a proper word follows; null if there is none."""

    def first(w: Column) -> Column:
        pairs = F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda n, w: F.struct(n.alias("n"), w.alias("w")))
        good = F.filter(pairs, lambda p: p["n"].rlike("^[0-9]+$") & ~is_street_type(p["w"]) & ~is_initial(p["w"]) & (F.length(p["w"]) >= 2))
        return F.try_element_at(good, F.lit(1))

    return once(once(words, first), lambda p: F.when(p.isNotNull(), F.concat(p["n"], F.lit("_"), p["w"])))


def suffix_key(name: Column) -> Column:
    """Group key by suffix stripping: the ordinal key, else the stem of the last significant word, else empty."""
    return once(tokens(ascii_norm(name)), lambda words: F.coalesce(ordinal_key(words), strip_suffix(F.try_element_at(significant(words), F.lit(-1))), F.lit("")))


def words_of(label: Column) -> Column:
    return F.filter(F.split(label, r"\s+"), lambda w: w != "")


def name_parts(label: Column) -> Column:
    """Words of at least three characters, as they stand."""
    return F.filter(words_of(label), lambda w: F.length(w) >= 3)


def place_core(label: Column) -> Column:
    return F.coalesce(F.try_element_at(words_of(label), F.lit(1)), F.lit(""))


def match_confidence(street: Column, labels: Column, is_human: Column, settings: Settings = DEFAULTS) -> Column:
    """Confidence that a street is named after an entity: the first test that holds, label by label.

    A label: either name contains the other; for places, its first word; then each longer word: contained, stem
    contained, or first four letters of the stem starting the street's.
    """
    exact, stem, prefix = F.lit(settings.confidence_exact), F.lit(settings.confidence_stem), F.lit(settings.confidence_prefix)

    def confidence(street: Column) -> Column:
        def by_word(word: Column, with_prefix: bool) -> Column:
            def test(w: Column) -> Column:
                found = F.when(F.contains(street["norm"], w["norm"]), exact).when((F.length(w["stem"]) >= 3) & F.contains(street["stem"], w["stem"]), stem)
                if with_prefix:
                    found = found.when((F.length(w["stem"]) >= 4) & F.startswith(street["stem"], F.substring(w["stem"], 1, 4)), prefix)
                return found

            return once(F.struct(ascii_norm(word).alias("norm"), stem_word(word).alias("stem")), test)

        def tests(label: Column) -> Column:
            whole = once(ascii_norm(label), lambda norm: F.when(F.contains(street["norm"], norm) | F.contains(norm, street["norm"]), exact))
            place = once(place_core(label), lambda core: F.when(~is_human & (core != ""), by_word(core, False)))
            return F.concat(F.array(whole, place), F.transform(name_parts(label), lambda w: by_word(w, True)))

        found = F.filter(F.flatten(F.transform(labels, tests)), lambda c: c.isNotNull())
        return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(0.0))

    return once(F.struct(ascii_norm(street).alias("norm"), stem_word(street).alias("stem")), confidence)


def split_names(names: Column) -> Column:
    """Names of a list written with semicolons, without white space around them."""
    return F.transform(F.split(names, ";"), lambda n: F.regexp_replace(n, r"^\s+|\s+$", ""))


def join_names(names: Column) -> Column:
    """Distinct names in code point order."""
    return F.array_join(F.array_sort(F.array_distinct(names)), "; ")


def clean_reply(raw: Column) -> Column:
    """First line of a reply without white space and quotes around it, normalized; empty if nothing is left."""
    s = F.regexp_replace(raw, r"^\s+|\s+$", "")
    s = F.regexp_replace(s, "^[\"']+|[\"']+$", "")
    return ascii_norm(F.regexp_replace(F.substring_index(s, "\n", 1), r"^\s+|\s+$", ""))


def strip_fence(raw: Column) -> Column:
    """A reply without the code fence around it."""
    s = F.regexp_replace(raw, r"^\s+|\s+$", "")
    return F.when(F.startswith(s, F.lit("```")), F.regexp_replace(F.regexp_replace(s, r"^```[^\n]*\n", ""), r"\s*```[^`]*$", "")).otherwise(s)


def cache_name(model: Column) -> Column:
    return F.regexp_replace(model, "[^a-zA-Z0-9_-]", "_")
