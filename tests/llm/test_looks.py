import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import looks


def test_one_form_for_what_looks_the_same():
    same = [("Ｋ－２０４", "K-204"), ("é", "é"), ("е́", "é"), ("⼈⽉", "人月"), ("K​o­", "Ko"), ("ｶﾞ", "ガ"), ("が", "が"), ("ミ・ヴ", "ミ·ヴ"), ("a　b", "a b"), ("不", "不"), ("⋯⋯", "……"), ("Ⅱ", "II")]
    for a, b in same:
        assert looks.canonical(a) == looks.canonical(b), (a, b)
    for a, b in [("a", "A"), ("e", "é"), ("a b", "a  b"), ("一", "ー"), ("0", "O"), ("がく", "かく")]:
        assert looks.canonical(a) != looks.canonical(b), (a, b)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_idempotent_and_spans(x):
    form = looks.canonical(x)
    assert looks.canonical(form) == form
    spanned, at = looks.canonical_spans(x)
    assert spanned == form and len(at) == len(form) and at == sorted(at)
    assert looks.letter_codes(x).tobytes() == looks.letters(x).encode("utf-32-le", "surrogatepass")


def test_mapping_is_free_of_conflicts():
    looks.check(looks.mapping())
    for c in map(chr, range(0x20, 0x7F)):
        assert looks.canonical(c) == c


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    forms = ["K-204", "Ｋ-204", "К-204", "né", "né", "ne", "  ", "　", "", None, "一", "⼀"]
    rows = [(f"k{i}", rng.choice(forms)) for i in range(60)] + [("k1", "K-204")]
    want = set()
    for a, x in rows:
        for b, y in rows:
            if a < b and x and y and x != y and looks.canonical(x) == looks.canonical(y) and any(map(str.isalpha, looks.canonical(x))):
                want.add((a, b))
    got = looks.look_alikes(spark.createDataFrame(rows, "id string, text string"), F.col("id"), F.col("text")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_canonical_text_keeps_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Ａ"), (3, "Ａ")], "id int, text string")
    assert [r["canonical"] for r in looks.canonical_text(df, "text").orderBy("id").collect()] == [None, "", "A", "A"]
    assert looks.canonical_text(df.limit(0), "text").count() == 0


def test_what_shows_stays():
    differ = [("؀12", "12"), ("👨‍👩‍👧", "👨👩👧"), ("🏴\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f", "🏴\U000e0067\U000e0062\U000e0073\U000e0063\U000e0074\U000e007f"), ("می‌خواهم", "میخواهم")]
    for a, b in differ:
        assert looks.canonical(a) != looks.canonical(b), (a, b)
    same = [("օ", "o"), ("Ꭺ", "A"), ("Ꮪ", "S"), ("ꓮ", "A"), ("へ", "ヘ"), ("a‍b", "ab"), ("灯‌塔", "灯塔"), ("각", "각"), ("각", "각"), ("e‍́", "é"), ("ợ", "ợ")]
    for a, b in same:
        assert looks.canonical(a) == looks.canonical(b), (a, b)


def test_every_spelling_of_a_character_has_its_form():
    import unicodedata as ud

    for p in (*range(0xC0, 0x3400), *range(0xF900, 0xFFF0), *range(0x1D100, 0x1D200)):
        c = chr(p)
        if ud.category(c) not in ("Cn", "Cs", "Co") and ud.normalize("NFD", c) != c:
            assert looks.canonical(c) == looks.canonical(ud.normalize("NFD", c)), hex(p)


def test_two_rules_for_one_key_conflict():
    import pytest

    with pytest.raises(ValueError, match="conflict"):
        looks._put({"a": "b"}, "a", "c")


def test_a_hot_look(spark):
    rows = [(f"k{i:04d}", "K-204") for i in range(2000)] + [("x", "Ｋ-204"), ("y", None), ("z", "")]
    df = spark.createDataFrame(rows, "id string, text string")
    assert looks.look_alikes(df, F.col("id"), F.col("text")).count() == 2000
    classes = looks.look_classes(df, F.col("id"), F.col("text"))
    assert classes.count() == 2001 and classes.select("look").distinct().count() == 1 and classes.select("raw").distinct().count() == 2
