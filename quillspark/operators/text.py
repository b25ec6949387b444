"""From raw texts to paragraphs, units and chunks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import fixed
from quillspark.functions.exprs import is_chapter_title, is_toc_heading, paragraph_form


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line, start``: the lines that are not blank, trimmed, with the offset of their first character."""
    each = texts.select(key, F.posexplode(F.split(F.col(text), r"[\r\n]")).alias("line_no", "raw"))
    before = F.coalesce(F.sum(F.length("raw") + 1).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.regexp_replace("raw", r"(?U)^\s+", "")
    each = each.withColumn("start", before + F.length("raw") - F.length(left)).withColumn("line", F.regexp_replace(left, r"(?U)\s+$", ""))
    return each.where("line <> ''").select(key, "line_no", "line", "start")


def text_units(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Paragraph lines with chapter title, chapter index, scene index and scene id; titles and separators are not units.

    A title starts a chapter and its scene 0; a separator line starts the next scene. Before the first of either, the
    scene is the sentinel. Counters are running sums over a text's lines.
    """
    every = lines(texts, key, text).withColumn("is_ch", is_chapter_title(F.col("line"))).withColumn("is_sep", F.col("line") == fixed.SCENE_SEPARATOR)
    run = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("chapter_index", F.sum(F.col("is_ch").cast("int")).over(run)).withColumn("chapter_title", F.last(F.when(F.col("is_ch"), F.col("line")), True).over(run))
    scene = Window.partitionBy(key, "chapter_index").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("scene_index", F.sum(F.col("is_sep").cast("int")).over(scene))
    seen = (F.col("chapter_index") > 0) | (F.col("scene_index") > 0)
    scene_id = F.when(seen, F.format_string("chapter-%03d-scene-%03d", F.col("chapter_index"), F.col("scene_index"))).otherwise(fixed.NO_SCENE)
    return every.where("not is_ch and not is_sep").withColumn("scene_id", scene_id).drop("is_ch", "is_sep")


def fit_sentences(line: str, limit: int) -> list[str]:
    """A long line packed by sentences into pieces of at most ``limit``; a longer sentence is sliced."""
    out, held, at = [], "", 0
    for k, c in enumerate(line):
        if c in fixed.SENTENCE_ENDS or k == len(line) - 1:
            s, at = line[at : k + 1], k + 1
            if held and len(held) + len(s) > limit:
                out.append(held)
                held = ""
            if len(s) <= limit:
                held += s
            else:
                out += [s[i : i + limit] for i in range(0, len(s), limit)]
    return out + [held] * bool(held)


def pack(units: list[str], target: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """``(first, last)`` unit of each chunk; a chunk is closed when the next unit would pass ``limit`` or ``target`` is reached.

    The next chunk starts with up to ``overlap`` of the last units, never with all of them; what is taken over isn't
    measured again, so a chunk may pass the limit.
    """
    out, first, size = [], 0, 0
    for k, u in enumerate(units):
        if k > first and (size + 2 + len(u) > limit or size >= target):
            out.append((first, k - 1))
            first = k - min(overlap, k - first - 1)
            size = sum(map(len, units[first:k])) + 2 * max(0, k - first - 1)
        size += len(u) + (2 if k > first else 0)
    return out + [(first, len(units) - 1)] * bool(units)


def numbered(rows: DataFrame, group: str, at: str, *ties: str, width: int = 4096) -> DataFrame:
    """``rows`` with ``n``, their number in their group in the order of ``at``, then ``ties``, and ``of``, the rows of the group.

    A group is dealt into stretches of ``width`` of ``at``; rows are counted by stretch first, so no task sorts a whole
    group.
    """
    dealt = rows.withColumn("_stretch", F.floor(F.col(at) / width))
    counts = dealt.groupBy(group, "_stretch").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(group, "_stretch", before.alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("of"))
    inside = F.row_number().over(Window.partitionBy(group, "_stretch").orderBy(at, *ties))
    return dealt.withColumn("_inside", inside).join(offsets, [group, "_stretch"]).withColumn("n", F.col("_before") + F.col("_inside")).drop("_stretch", "_before", "_inside")


def build_chunks(texts: DataFrame, key: str, text: str, target: int = fixed.CHUNK_TARGET, limit: int = fixed.CHUNK_MAX, overlap: int = fixed.CHUNK_OVERLAP) -> DataFrame:
    """Chunks of each text with id, index, offsets, chapter and scene; a text's key is its book.

    Units are packed scene by scene, as no chunk passes a title or separator, so each scene is a group of its own and
    the fold is parallel over scenes. Null, empty and blank texts give no chunks; wrong parameters raise.
    """
    if target <= 0 or limit <= 0 or target > limit or overlap < 0:
        raise ValueError("target and limit must be positive, target at most limit, overlap not negative")
    scope = [key, "chapter_index", "scene_index", "chapter_title", "scene_id"]
    units = text_units(texts, key, text).groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "start"))).alias("units"))  # of one scene of one text

    @F.pandas_udf("array<struct<start_pos: bigint, end_pos: bigint, chunk_text: string>>")
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for scenes in batches:
            out = []
            for scene in scenes:
                parts, starts = [], []
                for unit in scene:
                    start = unit["start"]
                    for p in fit_sentences(unit["line"], limit):
                        parts.append(p)
                        starts.append(start)
                        start += len(p)
                out.append([(starts[a], starts[b] + len(parts[b]), "\n\n".join(parts[a : b + 1])) for a, b in pack(parts, target, limit, overlap)])
            yield pd.Series(out)

    packed = units.select(*scope, F.explode(fold("units")).alias("c")).select(*scope, "c.*")
    packed = numbered(packed, key, "start_pos", "end_pos", width=1_000_000)  # chapters and scenes follow one another
    width = F.greatest(F.lit(6), F.length(F.col("of").cast("string")))
    packed = packed.withColumn("id", F.concat(F.col(key).cast("string"), F.lit("-"), F.lpad(F.col("n").cast("string"), width, F.lit("0"))))
    return packed.withColumnRenamed("n", "chunk_index").drop("of")


# A comment or declaration, a tag with its attributes, a stretch of text; a lone < is text.
_MARKUP = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?:[^>"']|"[^"]*"|'[^']*')*>|(?P<text>[^<]+|<)""", re.DOTALL)
_RAW = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style")}


def _stream(page: str) -> Iterator[str | None]:
    """Text that shows, blanks collapsed, and None where a block begins or ends."""
    hidden, at, words = 0, 0, ""
    while at <= len(page):
        m = _MARKUP.match(page, at)
        if words and (m is None or m["text"] is None):  # a stretch of text is over
            if not hidden and (shown := " ".join(html.unescape(words).split())):
                yield shown
            words = ""
        if m is None:
            break
        at = m.end()
        if m["text"] is not None:
            words += m["text"]
        elif m["name"] is not None:
            name = m["name"].lower()
            if name in fixed.IGNORED_TAGS:
                alone = m.group().endswith("/>")
                hidden = max(0, hidden - 1) if m["close"] else hidden + (not alone)
                if name in _RAW and not m["close"] and not alone:  # what stands in it is no markup
                    end = _RAW[name].search(page, at)
                    at = end.start() if end else len(page)
            elif name in fixed.BLOCK_TAGS:
                yield None


def html_blocks(page: str) -> list[str]:
    """The text of each block of a page, inline parts joined without a blank."""
    return ["".join(parts) for ends, parts in groupby(_stream(page), lambda x: x is None) if not ends]


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_blocks_udf(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(lambda x: [] if x is None else html_blocks(x))


def html_paragraphs(pages: DataFrame, key: str, page: str) -> DataFrame:
    """``key, para_no, para``: paragraphs of HTML pages, credit lines dropped, star lines as the separator.

    A short first paragraph that names an arc is joined to a chapter title after it. Null pages give no rows.
    """
    kept = F.filter(F.transform(html_blocks_udf(F.col(page)), paragraph_form), lambda p: p != "")
    rows = pages.select(key, kept.alias("ps"))
    first, second = F.get(F.col("ps"), F.lit(0)), F.get(F.col("ps"), F.lit(1))
    arc = (F.size("ps") >= 2) & (F.length(first) <= 30) & first.rlike("期|篇") & is_chapter_title(second)
    joined = F.when(arc, F.concat(F.array(F.concat(first, F.lit(" "), second)), F.slice(F.col("ps"), F.lit(3), F.greatest(F.size("ps") - 2, F.lit(0))))).otherwise(F.col("ps"))
    return rows.select(key, F.posexplode(joined).alias("para_no", "para"))


def drop_repeats(paragraphs: DataFrame, key: str, order: str, para: str) -> DataFrame:
    """Paragraphs without those equal to the one just before them in their text."""
    before = F.lag(para).over(Window.partitionBy(key).orderBy(order))
    return paragraphs.withColumn("_b", before).where(~F.col(para).eqNullSafe(F.col("_b")) | F.col("_b").isNull()).drop("_b")


def trim_front(paragraphs: DataFrame, key: str, order: str, para: str) -> DataFrame:
    """Paragraphs from the first chapter title on; texts without a title stay whole."""
    first = F.min(F.when(is_chapter_title(F.col(para)), F.col(order))).over(Window.partitionBy(key))
    return paragraphs.withColumn("_f", first).where(F.col("_f").isNull() | (F.col(order) >= F.col("_f"))).drop("_f")


def drop_contents(paragraphs: DataFrame, key: str, order: str, para: str) -> DataFrame:
    """Paragraphs without tables of contents: from a heading up to the first title that comes again, or the first other line.

    A stretch between headings is looked at by itself: its leading run of titles is dropped up to the first repeated one.
    """
    up_to = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    p = paragraphs.withColumn("_h", is_toc_heading(F.col(para))).withColumn("_t", is_chapter_title(F.col(para)))
    p = p.withColumn("_g", F.sum(F.col("_h").cast("int")).over(up_to)).where("not _h")
    inside = Window.partitionBy(key, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    form = F.regexp_replace(F.col(para), r"(?U)\s+", "")
    p = p.withColumn("_again", F.row_number().over(Window.partitionBy(key, "_g", form).orderBy(order)) > 1)
    p = p.withColumn("_closed", F.max((~F.col("_t") | F.col("_again")).cast("int")).over(inside))
    return p.where("_g = 0 or _closed = 1").drop("_h", "_t", "_g", "_again", "_closed")


def joined(paragraphs: DataFrame, key: str, order: str, para: str) -> DataFrame:
    """``key, text``: the paragraphs of each text with empty lines between and a line end after."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(para).alias("p"))))
    return paragraphs.groupBy(key).agg(F.concat(F.array_join(parts["p"], "\n\n"), F.lit("\n")).alias("text"))
