from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vialect.functions import similarity, text


def column(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r[0] for r in rows.select("i", f(F.col("s")).alias("r")).orderBy("i").select("r").collect()]


def test_ascii_norm(spark):
    given_ = ["Námestie 1. mája", "Kpt.Nálepku", "  Große   Straße!", "Łódź", "é", "", "Œuvre æther", "İstanbul", None]
    want = ["namestie 1 maja", "kpt nalepku", "grosse strasse", "lodz", "e", "", "oeuvre aether", "istanbul", None]
    assert column(spark, given_, text.ascii_norm) == want
    assert column(spark, want, text.ascii_norm) == want  # idempotent
    assert column(spark, given_, lambda c: text.ascii_norm_unicode(c))[:5] == want[:5]


def test_other_scripts(spark):
    cases = {
        "Улица Жукова": "ulitsa zhukova", "Площадь Революции": "ploshchad revoliutsii", "Ђорђа Њ.": "djordja nj", "Київ, Єва": "kiyiv ieva", "Οδός Ψυχάρη": "odos psukhare", "Θεσσαλονίκη": "thessalonike",
        "Ŋala": "ngala", "ƒǽǿ": "faeo", "Ǆ ǉ ǌ": "dz lj nj", "Ƙano Ɵ": "kano", "ёлка": "iolka", "Šaľa ĸ": "sala k",
    }
    assert column(spark, list(cases), text.ascii_norm) == list(cases.values())


def test_every_lower_case_latin_letter_has_a_form():
    """U+00DF-U+024F without the click and tone letters and those that look like digits."""
    import unicodedata

    known = set(text.latin_table()[0]) | set(text.LONG_FORMS) | set(text.RARE_LONG)
    lacking = {c for c in map(chr, range(0xDF, 0x250)) if unicodedata.category(c) == "Ll"} - known
    assert lacking == set("ƅƨƪƹƺƽƾǝɂ")


def test_keys(spark):
    cases = {"1. mája": "1_maja", "Námestie 1. mája": "1_maja", "Jána Pavla II.": "ii", "Námestie": "", "Štúrova": "stur", "M. R. Štefánika": "stefanik", "Ulica": "", "5 ulica": "5", "A. B.": ""}
    assert column(spark, list(cases), text.suffix_key) == list(cases.values())
    assert column(spark, ["Kpt.Nálepku", "Ulica J. Murgaša", "Hlavná ul."], text.preprocess_name) == ["kpt nalepku", "murgasa", "hlavna"]


def loop_strip(word, suffixes):
    for s in sorted(suffixes, key=len, reverse=True):
        if word.endswith(s) and len(word) - len(s) >= 3:
            return word[: -len(s)]
    return word


def test_suffixes_match_a_loop(spark):
    words = ["".join(p) for a in ("st", "stu", "kolar", "x") for b in text.NAME_SUFFIXES for p in [(a, b), (a, b, "a"), (a, b, b)]]
    assert column(spark, words, text.strip_suffix) == [loop_strip(w, text.NAME_SUFFIXES) for w in words]
    assert column(spark, words, text.stem_word) == [loop_strip(w, text.WORD_SUFFIXES) for w in words]


def test_confidence(spark):
    cases = [
        ("Štúrova", ["Ľudovít Štúr"], True, 1.0), ("Hviezdoslavova", ["Pavol Országh Hviezdoslav"], True, 1.0), ("Košická", ["Košice"], False, 0.9), ("Kosmická", ["Kosmonaut"], True, 0.7),
        ("Fábryho", ["Zoltán Fábry"], True, 1.0), ("Lipová", ["Nikto Iny"], True, 0.0), ("Lipová", [], True, 0.0), ("Lipová", ["", "x"], True, 1.0), ("Banícka", ["Banská Bystrica"], False, 0.0),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s string, l array<string>, h boolean, want double")
    got = rows.select("i", text.match_confidence(F.col("s"), F.col("l"), F.col("h")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [c[3] for c in cases]


def test_replies_and_lists(spark):
    assert column(spark, [' "Milan"\nx', "''", " ", "Ján\n"], text.clean_reply) == ["milan", "", "", "jan"]
    assert column(spark, ['```json\n{"a":1}\n```', '{"a":1}', "```\nx```"], text.strip_fence) == ['{"a":1}', '{"a":1}', "x"]
    assert column(spark, ["a; b ;c", "x"], text.split_names) == [["a", "b", "c"], ["x"]]
    assert column(spark, ["gpt-4o.mini/x"], text.cache_name) == ["gpt-4o_mini_x"]


def test_ngrams_and_jaccard(spark):
    assert column(spark, ["abcd ab", "aaa aaa", ""], similarity.ngrams) == [["abc", "bcd", "ab"], ["aaa"], []]
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(similarity.jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 0.0]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[-1]))
    return row[-1]


@given(st.text("abcd ", max_size=20), st.text("abcd ", max_size=20))
def test_lcs(a, b):
    assert similarity.lcs_length(a, b) == slow_lcs(a, b)


def test_indel_ratio(spark):
    rows = spark.createDataFrame([("abc", "abd"), ("", ""), ("a", None)], "a string, b string")
    assert [r[0] for r in rows.select(similarity.indel_ratio("a", "b")).collect()] == [pytest.approx(4 / 6), 1.0, None]


def test_whole_texts_as_names(spark):
    """Every letter up to U+1FFFF within words, alone and doubled, and words that are dropped, beside and within others."""
    letters = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    rows = [" ".join(f"ab{c}cd {c} {c}{c}" for c in letters[at : at + 512]) for at in range(0, len(letters), 512)]
    rows += ["ulica ulica a most most  b park 5 ut x7 7 rad", "Most-ulicaulica.most", "\u0130STANBUL \u039f\u0394\u039f\u03a3 ulic\u0301a", "ulica a", "", " ", None]
    names = spark.createDataFrame([(r,) for r in rows], "name string")
    got = names.select(text.preprocess_text(F.col("name")).alias("got"), text.preprocess_name(F.col("name")).alias("want")).collect()
    assert [r.got for r in got] == [r.want for r in got] and len(got) == len(rows)
