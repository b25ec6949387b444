import io
import random
import zipfile

import pytest

from quillspark.operators import text as tx
from quillspark.sources import epub


def chunks(spark, body, **kw):
    df = spark.createDataFrame([("B", body)], "book string, text string")
    return tx.build_chunks(df, "book", "text", **kw).orderBy("chunk_index").collect()


def test_chapter_and_scene_metadata(spark):
    got = chunks(spark, "第一话 名\n\n甲甲甲甲\n\n乙乙乙乙\n\n★★★\n\n丙丙丙丙", target=20, limit=40, overlap=1)
    assert [(r["scene_id"], r["chunk_text"], r["id"]) for r in got] == [("chapter-001-scene-000", "甲甲甲甲\n\n乙乙乙乙", "B-000001"), ("chapter-001-scene-001", "丙丙丙丙", "B-000002")]
    assert all(r["chapter_title"] == "第一话 名" for r in got)


def test_overlap_and_scene_boundary(spark):
    got = chunks(spark, "aaa\n\nbbb\n\nccc\n\nddd\n\neee", target=15, limit=20, overlap=3)
    assert [r["chunk_text"] for r in got] == ["aaa\n\nbbb\n\nccc\n\nddd", "bbb\n\nccc\n\nddd\n\neee"]
    got = chunks(spark, "aaa\n\nbbb\n\nccc\n\nddd\n\n★★★\n\neee", target=15, limit=20, overlap=3)
    assert [r["chunk_text"] for r in got] == ["aaa\n\nbbb\n\nccc\n\nddd", "eee"]


def test_separator_before_any_chapter(spark):
    assert [r["scene_id"] for r in chunks(spark, "a\n\n★★★\n\nb")] == ["scene-000", "chapter-000-scene-001"]


def test_empty_texts_and_wrong_parameters(spark):
    df = spark.createDataFrame([("B", ""), ("C", None), ("D", " \n ")], "book string, text string")
    assert tx.build_chunks(df, "book", "text").count() == 0
    with pytest.raises(ValueError):
        chunks(spark, "a", target=1001, limit=1000)


def test_sentences_are_packed(spark):
    line = "一二三四。五六七八！九十一二？三四五六七八九十一"
    assert all(len(p) <= 10 for p in tx.fit_sentences(line, 10)) and "".join(tx.fit_sentences(line, 10)) == line


def test_packing_covers_every_unit():
    rng = random.Random(1)
    for _ in range(200):
        units = ["x" * rng.randrange(1, 12) for _ in range(rng.randrange(1, 20))]
        got = tx.pack(units, 15, 20, rng.randrange(4))
        assert got[0][0] == 0 and got[-1][1] == len(units) - 1
        assert all(b[0] <= a[1] + 1 and b[1] > a[1] and b[0] > a[0] for a, b in zip(got, got[1:]))


def paras(spark, rows):
    return spark.createDataFrame([("B", i, p) for i, p in enumerate(rows)], "book string, n int, para string")


def test_contents_are_dropped_up_to_the_repeated_title(spark):
    rows = ["简介", "目录", "第一话 甲", "第二话 乙", "第一话 甲", "正文", "第二话 乙"]
    got = tx.drop_contents(paras(spark, rows), "book", "n", "para").orderBy("n").collect()
    assert [r["para"] for r in got] == ["简介", "第一话 甲", "正文", "第二话 乙"]


def test_repeats_and_front_matter(spark):
    got = tx.drop_repeats(paras(spark, ["a", "a", "b", "a"]), "book", "n", "para").orderBy("n").collect()
    assert [r["n"] for r in got] == [0, 2, 3]
    got = tx.trim_front(paras(spark, ["简介", "第一话 甲", "x"]), "book", "n", "para").orderBy("n").collect()
    assert [r["n"] for r in got] == [1, 2]
    assert tx.trim_front(paras(spark, ["a", "b"]), "book", "n", "para").count() == 2


def test_html_blocks():
    page = "<html><head><title>t</title></head><body>foo <b>bar</b><br/>x<script>no</script><p>&amp;y</p></body></html>"
    assert tx.html_blocks(page) == ["foobar", "x", "&y"]


def test_epub_in_spine_order(spark, tmp_path):
    page = lambda *ps: "<html><body>" + "".join(f"<p>{p}</p>" for p in ps) + "</body></html>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", '<package><manifest><item id="a" href="Text/one.xhtml"/><item id="b" href="Text/two.xhtml"/><item id="c" href="Text/title.xhtml"/><item id="d" href="Text/toc.xhtml"/></manifest><spine><itemref idref="c"/><itemref idref="d"/><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("OEBPS/Text/one.xhtml", page("第一话 甲", "一", "★ ★ ★", "作者：某"))
        z.writestr("OEBPS/Text/two.xhtml", page("某某篇", "序章", "零"))
        z.writestr("OEBPS/Text/title.xhtml", page("书名"))
        z.writestr("OEBPS/Text/toc.xhtml", page("目录", "第一话 甲"))
    (tmp_path / "书.epub").write_bytes(data.getvalue())
    got = epub.read_epubs(spark, str(tmp_path)).collect()
    assert [(r["book_name"], r["text"]) for r in got] == [("书", "某某篇 序章\n\n零\n\n第一话 甲\n\n一\n\n★★★\n")]


def test_markup():
    got = tx.html_blocks("<body><!-- a > b --><p title='x > y'>one <b>two</b></p>1 < 2<br/>R&amp;D<script>if (a < b) { '</p>' }</script><svg><p>no</p></svg><style>p{}</style>end")
    assert got == ["onetwo", "1 < 2", "R&D", "end"] or got == ["onetwo", "1 < 2", "R&Dend"]
    assert tx.html_blocks("") == [] and tx.html_blocks("<p></p>\n<p> </p>") == [] and tx.html_blocks("<P>A</P>b") == ["A", "b"]
