"""The Column functions: stated examples, random text against DuckDB, and properties."""

import random
import re
import unicodedata

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.functions import grounding, names, nfc, ocrtext, script, typography
from foliant.functions import text as text_functions
from registry import duck


def run(spark, function, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    rows = df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
    return [row.r for row in rows]


CASES = [
    (typography.clean_text, "bir\na\nikki", "bir a ikki"),
    (typography.clean_text, "konver-\ntatsiya", "konvertatsiya"),
    (typography.clean_text, "TO‘RTINChI BOB", "TO‘RTINCHI BOB"),
    (typography.clean_text, "ShAHARShUNOSLIK", "SHAHARSHUNOSLIK"),
    (typography.clean_text, "Shahar va Chegara", "Shahar va Chegara"),
    (typography.clean_text, "a-\nb-\nc", "ab- c"),
    (typography.clean_text, "e\u0301", "é"),
    (typography.clean_text, "", ""),
    (script.to_latin, "ер", "yer"),
    (script.to_latin, "бет", "bet"),
    (script.to_latin, "оеч", "oyech"),
    (script.to_latin, "ШАҲАР ЎЗБЕКИСТОН", "SHAHAR O‘ZBEKISTON"),
    (script.to_latin, "Шаҳар Ш", "Shahar SH"),
    (script.to_latin, "объект", "obʼyekt"),
    (script.to_latin, "ташкилотларии", "tashkilotlariy"),
    (script.expand_e, "ер бет Ер", "yeр бeт Yeр"),
    (ocrtext.fix_mixed_script_words, "Тoшкeнт abcд", "Тошкент abcд"),
    (ocrtext.normalise_apostrophes, "ko'plab koʻplab me'moriy", "ko‘plab ko‘plab meʼmoriy"),
    (ocrtext.normalise_apostrophes, "x'b'c g`o'’", "xʼbʼc g‘o'’"),
    (ocrtext.normalise_apostrophes, "1'a а'b 'a a'", "1'a а'b 'a a'"),
    (ocrtext.normalise_line, "KITOB ASOSLARI 12 €", "kitob asoslari #"),
    (grounding.path_segment, "../../etc", "etc"),
    (grounding.path_segment, "///", "unknown"),
    (grounding.name_slug, "Ўзбекистон.pdf", "document"),
    (grounding.yaml_string, 'a"b\\c\nd', '"a\\"b\\\\c d"'),
    (names.repair_mojibake, "Ўзбек.pdf".encode().decode("latin-1"), "Ўзбек.pdf"),
    (names.repair_mojibake, "café.pdf", "café.pdf"),
    (names.sanitize_path_segment, "../../etc", "etc"),
    (names.sanitize_path_segment, "___", "unnamed"),
    (names.extension, "dir/Book.PDF", ".pdf"),
    (names.extension, ".pdf", ""),
    (text_functions.shorten, "x" * 141, "x" * 140 + "…"),
]


@pytest.mark.parametrize("function,given,expected", CASES)
def test_examples(spark, function, given, expected):
    assert run(spark, function, [given]) == [expected]


ALPHABETS = {
    "clean": list("aAbChShYoNgTs‘'ʼ-\n\n\n\r \t.e") + [
        "\u0301", "\u200b", "\u00ad", "\u00a0", "\u2003", "\u3000", "\x1c", "\u0085", "\u2028",
        "Ch", "SH", "TO", "Ya", "ё", "Ш", "İ", "\u1100", "\u1161", "\U0001f600", "\u0344"],
    "cyrillic": list("аеёЕЕеЁиииИшШЩщЧцЦъьЬЫыЎўҒғҳҚ aZ1.-\n") + ["҂", "҃", "Ӏ"],
    "mixed": list("aceopxyABсеорхуАВДдzZßΩ1 '`ʻ’oOgG\n."),
}


def words(name, count, length, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABETS[name]) for _ in range(rng.randint(0, length)))
            for _ in range(count)]


def in_duckdb(expression, values):
    given = pd.DataFrame({"i": range(len(values)), "v": pd.Series(values, dtype="str")})
    sql = f"SELECT {expression('v')} FROM given ORDER BY i"
    return [row[0] for row in duckdb.connect().register("given", given).execute(sql).fetchall()]


@pytest.mark.parametrize("function,expression,alphabet", [
    (typography.clean_text, duck.clean, "clean"),
    (script.to_latin, duck.latin, "cyrillic"),
    (script.detect_script, duck.script, "cyrillic"),
    (ocrtext.fix_mixed_script_words, duck.mixed_words, "mixed"),
])
def test_random_text(spark, function, expression, alphabet):
    given = words(alphabet, 2500, 60, seed=7)
    got, want = run(spark, function, given), in_duckdb(expression, given)
    wrong = [(g, r, w) for g, r, w in zip(given, got, want) if r != w]
    assert not wrong, wrong[:3]


def test_random_segments(spark):
    rng = random.Random(3)
    given = []
    for _ in range(300):
        gap = rng.choice([8, 60, 120, 200, 900])
        given.append("".join(
            rng.choice(" \n") if rng.random() < 1 / gap else rng.choice("ab\U0001f600")
            for _ in range(rng.choice([0, 10, 599, 600, 601, 1200, 3000]))))
    for text, parts in zip(given, run(spark, grounding.split_for_grounding, given)):
        assert "".join("".join(parts).split()) == "".join(text.split())
        assert all(p and p == p.strip() and len(p) < 750 for p in parts)
        assert len(parts) <= len(text) // 600 + 1


SEGMENTS = [
    ("x" * 600, [600]), ("x" * 601, [600, 1]), ("x" * 650 + "\n" + "y" * 20, [650, 20]),
    ("x" * 690 + " " + "y" * 20, [690, 20]), ("x" * 720 + " " + "y" * 20, [600, 141]),
    ("x" * 720 + "\n" + "y" * 20, [720, 20]), ("x" * 610 + " y\n" + "z" * 20, [612, 20]), (" \n ", []),
]


@pytest.mark.parametrize("text,lengths", SEGMENTS)
def test_segments(spark, text, lengths):
    assert [len(s) for s in run(spark, grounding.split_for_grounding, [text])[0]] == lengths


PEELED = [
    ("BOB 1\nmatn satri\n12", "matn satri"), ("12\nbob 22\nmatn\nso‘z", "matn\nso‘z"),
    ("matn\nBOB 1\nmatn\nso‘z\nmatn", "matn\nBOB 1\nmatn\nso‘z\nmatn"), ("BOB 3", ""),
    ("1\n2\n3\n4\n5", "3"), ("|~|\nmatn\n|~|", "matn"), ("matn 1991\n\n— 7 —", "matn 1991"),
    ("bob 1\nmatn\n[3]\n|~|\nBOB 9", "matn"), ("", ""),
]


def test_peeled_edges(spark):
    lines = F.array(F.lit("bob #"))
    got = run(spark, lambda c: ocrtext.peel_edges(c, lines), [g for g, _ in PEELED])
    assert got == [want for _, want in PEELED]


def test_peeling_takes_edges_only(spark):
    rng = random.Random(5)
    pool = ["BOB 1", "bob 22", "— 7 —", "12", "|~|", "", "  ", "matn satri", "1991", "so‘z", "[3]"]
    given = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    lines = F.array(F.lit("bob #"))
    for text, peeled in zip(given, run(spark, lambda c: ocrtext.peel_edges(c, lines), given)):
        real = [x for x in text.split("\n") if any(ch.isalnum() for ch in x)]
        kept = [x for x in peeled.split("\n") if x.strip()]
        # Two lines at either edge at most, and nothing from in between.
        assert "\n".join(kept) in "\n".join(real) and len(real) - len(kept) <= 4
        assert [x for x in kept if x in ("matn satri", "so‘z")] == [
            x for x in real if x in ("matn satri", "so‘z")]


LONG_WORDS = ["Ch" * 100_000, "ChSh" * 50_000 + "x", "CH" * 100_000]


@pytest.mark.parametrize("function", [typography.fix_caps_digraphs, typography.clean_text])
def test_long_words_of_digraphs(spark, function):
    assert run(spark, function, LONG_WORDS) == ["CH" * 100_000, LONG_WORDS[1], LONG_WORDS[2]]


def test_rounding_matches_python(spark):
    rng = random.Random(1)
    given = [rng.randint(1, 20000) / rng.choice([3, 7, 8, 20, 40, 200]) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in given], "v double")
    rows = df.select("v", text_functions.round_exact(F.col("v"), 1).alias("r")).collect()
    assert all(row.r == round(row.v, 1) for row in rows)


def test_nfc_safe_characters_are_stable():
    import re

    python_class = nfc.MAY_CHANGE.replace(r"\x{10ffff}", r"\U0010ffff")
    may_change = re.compile("[" + python_class.encode().decode("unicode_escape") + "]")
    for code in range(0x110000):
        ch = chr(code)
        if not 0xD800 <= code < 0xE000 and not may_change.match(ch):
            assert unicodedata.normalize("NFC", ch) == ch and not unicodedata.combining(ch)


def test_stored_filename(spark):
    df = spark.createDataFrame([("a/Kitob 1.PDF", ".pdf", "0123456789abcdef")], "n string, e string, h string")
    assert df.select(names.stored_filename(F.col("n"), F.col("e"), F.col("h"))).first()[0] == \
        "0123456789ab__Kitob_1.pdf"


def test_passes_over_the_text():
    """Patterns decode and encode a whole text, so steps that literals can do have none."""
    assert repr(typography.repair_typography(F.col("t"))).count("regexp_replace(") <= 4
    assert "regexp" not in repr(typography.drop_zero_width(F.col("t")))
    assert "regexp" not in repr(typography.normalise_newlines(F.col("t")))


def test_joiners_stay_with_the_jvm():
    assert not re.search("[" + nfc.MAY_CHANGE.replace(r"\x{10ffff}", r"\U0010ffff") + "]", "a​ ﻿b")


def test_capitals_of_a_cyrillic_run_are_marked_where_it_matters(spark):
    marked = run(spark, lambda c: script._mark_caps(c, "ЕШ"), ["ШАҲАР БЕШ Шаҳар Ш"])[0]
    assert marked == "﷐ШАҲАР Б﷐Е﷐Ш Шаҳар ﷐Ш"


def test_replace_matches(spark):
    swap = lambda c: text_functions.replace_matches(c, "b+", lambda m: F.concat(F.lit("<"), m, F.lit(">")))
    assert run(spark, swap, ["", "abba", "b", "bxbb", None]) == ["", "a<bb>a", "<b>", "<b>x<bb>", None]


def test_squeeze_leaves_single_spaces_alone():
    """A match at every space of a text costs more than the rest of the step."""
    assert "(?<! )" in repr(text_functions.squeeze(F.col("t")))


@pytest.mark.parametrize("given,expected", [
    ("", ""), (" a  b\n\nc\t d　", "a b c d"), ("a b \x1cc ", "a b c"), ("a b", "a b"), ("\n \n", ""),
])
def test_squeeze(spark, given, expected):
    assert run(spark, text_functions.squeeze, [given]) == [expected]


def test_latin_letters_are_counted_only_where_they_decide():
    assert "translate(" not in repr(script.detect_script(F.col("t")))
    assert repr(script.detect_script(F.col("t"))).count("(?U)") == 1


def test_sections_are_finished_as_one_text(spark):
    """One pass over a document gives what a pass over each section gives, breaks in the text included."""
    from foliant.plans.text_corpus import finished_texts

    given = [["​\n ер", "ShAHARShUNOSLIK a-", "\nb-\n​c", "­", "ь бет", "ЕР", "a \x1c"], [], [""],
             ["ер﷑бет", "Шаҳар"], ["a﷐", "ер"]]
    df = spark.createDataFrame([(i, texts) for i, texts in enumerate(given)], "i int, v array<string>")
    for kind in ("uz-cyrl", "ru"):
        alone = F.transform(
            "v", lambda text: script.latin_if_uzbek(typography.repair_typography(text), F.lit(kind)))
        rows = df.select(finished_texts(F.col("v"), F.lit(kind)).alias("got"), alone.alias("want")).collect()
        assert [r.got for r in rows] == [r.want for r in rows]


def test_only_words_of_both_scripts_are_taken_out(spark):
    """Words of one script are not handled one by one; signs of a script are no letters of a word."""
    given = ["҂a Tошкент", "aб҂б", "Zаб zßа", "абá bа1аb", "ΩаaΩ"]
    assert run(spark, ocrtext.fix_mixed_script_words, given) == in_duckdb(duck.mixed_words, given)
    assert "[^\\p{L}]+)" not in repr(ocrtext.fix_mixed_script_words(F.col("t")))


def test_plain_texts_are_spared_the_patterns_of_the_clean_up():
    """White space is looked for as literals first, and what takes one byte a letter cannot change under NFC."""
    assert "contains" in repr(typography.squeeze_lines(F.col("t"))).split("regexp_replace")[0].lower()
    assert "octet_length" in repr(nfc.nfc(F.col("t"))).split("nfc_udf")[1].lower()


def test_every_kind_of_space_is_still_squeezed_and_marks_composed(spark):
    spaces = [chr(i) for i in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                               0x202F, 0x205F, 0x3000) if i != 10]
    assert run(spark, typography.squeeze_lines, [f"a{s}b" for s in spaces]) == ["a b"] * len(spaces)
    assert run(spark, typography.squeeze_lines, [f"a {s}b" for s in spaces]) == ["a b"] * len(spaces)
    texts = ["plain", "e\u0301", "\u212b", "caf\u00e9", "\U0001d15e", "\u0439 \u0438\u0306", None]
    assert run(spark, nfc.nfc, texts) == [t and unicodedata.normalize("NFC", t) for t in texts]
    marked = [f"a{z}b" for z in typography.ZERO_WIDTH]
    assert run(spark, typography.drop_zero_width, marked) == ["ab"] * len(marked)


def test_capitals_are_marked_only_where_some_stand_alone(spark):
    letters = "ЕЁЎҒЦЧШЩЮЯ"
    plain = ["Шаҳар Ўзбекистон", "аЕа бЯ яЮ", "АБВ Мен", "бет", ""]
    caps = ["ШАҲАР", "бу Е", "Я", "1Ч2", "АБҒ", "МАЕ-а", "хЁ ЁХ"]
    assert run(spark, lambda c: script._has_caps(c, letters), plain + caps) == [False] * 5 + [True] * 7
    rng = random.Random(20)
    texts = ["".join(rng.choice("еЕаАшШғҒбБѐЀ -e\n") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    marked = run(spark, lambda c: script._mark_caps(c, letters), texts)
    found = run(spark, lambda c: script._has_caps(c, letters), texts)
    assert all(has for text, mark, has in zip(texts, marked, found) if mark != text)
