import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import exprs, fixed


def spec_terms(text):
    """The tokeniser's rule, character by character."""
    out, run, kind = [], "", None

    def flush():
        if kind == "cjk":
            out.extend(run[i : i + k] for k in fixed.GRAMS for i in range(len(run) - k + 1))
        elif kind == "ascii":
            out.append(run.lower())

    for c in text + "\0":
        now = "cjk" if any(a <= ord(c) <= b for a, b in fixed.CJK_RANGES) else "ascii" if re.match("[A-Za-z0-9]", c) else None
        if now != kind:
            flush()
            run, kind = "", now
        run += c
    return sorted(out)


def test_terms_equal_the_rule(spark):
    texts = ["一二三四ABC12", "a 一 b", "\U00020000\U00020001\U00020002", "éauouon", "", "，。!", "第3章x", "你好World世界"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", exprs.terms(F.col("t")).alias("x"), exprs.term_count(F.col("t")).alias("n")).collect()
    for r in rows:
        assert sorted(r["x"]) == spec_terms(r["t"])
        assert r["n"] == len(r["x"])


def test_terms_of_null(spark):
    r = spark.createDataFrame([(None,)], "t string").select(exprs.terms(F.col("t")).alias("x"), exprs.term_count(F.col("t")).alias("n")).first()
    assert r["x"] is None and r["n"] is None


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(F.round(exprs.cosine(F.col("a"), F.col("b")), 9)).collect()] == [0.0, 1.0, None]
    with pytest.raises(Exception, match="different lengths"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(exprs.cosine(F.col("a"), F.col("b"))).collect()


def test_small_expressions(spark):
    df = spark.createDataFrame([("书-一-000012", "a" * 230, "第一话 名", " a　 b ")], "id string, long string, title string, blanks string")
    r = df.select(exprs.book_from_id(F.col("id")), exprs.preview(F.col("long")), exprs.is_chapter_title(F.col("title")), exprs.inline_blanks(F.col("blanks")), exprs.book_from_id(F.lit("x"))).first()
    assert list(r) == ["书-一", "a" * 220 + "...", True, "a b", "unknown"]


def test_chapter_titles(spark):
    yes = ["第一卷 起 第二话 夜", "第12话 名", "终章", "序章", "闲话 一", "外传 二", "第１２话"]
    no = ["他说第一话", "第一次见面", "章", ""]
    got = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in yes + no], "t string").select("t", exprs.is_chapter_title(F.col("t"))).collect()}
    assert got == {x: x in yes for x in yes + no}


def test_natural_key(spark):
    names = ["part10", "Part2", "part1"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(exprs.natural_key(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["part1", "Part2", "part10"]
