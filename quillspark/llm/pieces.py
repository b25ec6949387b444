"""Problem 4: cutting oversized texts at natural boundaries."""

from __future__ import annotations

import re
import unicodedata as ud
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 1000, 3
SCENE, PARAGRAPH, SENTENCE, CLAUSE = 4, 3, 2, 1
# Line ends, sentence ends with the closers that may follow, clause ends.
LINE = re.compile(r"[^\r\n\v\f\x85  ]+")
SENTENCE_END = re.compile(r"(?:[。！？!?…]+|\.(?=\s))[”’」』）)\"'》〉]*\s*")
CLAUSE_END = re.compile(r"[，、；：,;:]\s*")
NOT_ORNAMENT = set("\"'“”‘’«»‹›„‚「」『』《》〈〉（）()［］[]【】{}｛｝｢｣.,;:!?。．｡，、､；：！？…⋯‥·・･•‧∙⋅¡¿/\\|&%@§")


def is_ornament(line: str) -> bool:
    """Whether a line holds nothing but ornament signs and blanks: no letters, digits, sentence signs, dots, quotes."""
    signs = [c for c in line if not c.isspace() and ud.category(c) not in ("Cf", "Mn")]
    if not signs or any(c in NOT_ORNAMENT or c.isalnum() for c in signs):
        return False
    if all(ud.category(c) == "Pd" for c in signs):  # one or two dashes are punctuation, a row of them is an ornament
        return len(signs) >= 3
    return all(ud.category(c)[0] == "S" or ud.category(c) in ("Po", "Pd", "Pc") for c in signs)


class StrongestCut:
    """Sparse-table range maximum over boundary strengths; of equal strengths the rightmost wins."""

    def __init__(self, at: list[int], strength: list[int]) -> None:
        self.at = at
        rank = np.asarray(strength, np.int64) * (len(at) + 1) + np.arange(len(at))
        self.levels = [rank]
        step = 1
        while 2 * step <= len(at):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-step], last[step:]))
            step *= 2

    def between(self, low: int, high: int) -> int | None:
        """The offset of the strongest boundary with ``low <= offset <= high``, or None."""
        best = self.strongest(low, high)
        return best and best[0]

    def strongest(self, low: int, high: int) -> tuple[int, int] | None:
        """Offset and strength of the strongest boundary with ``low <= offset <= high``, or None."""
        i, j = bisect_left(self.at, low), bisect_right(self.at, high)
        if i >= j:
            return None
        k = (j - i).bit_length() - 1
        strength, place = divmod(int(max(self.levels[k][i], self.levels[k][j - (1 << k)])), len(self.at) + 1)
        return self.at[place], strength


def scenes(text: str) -> list[tuple[int, int, int]]:
    """``(scene start, first offset, end)`` of each scene; the first begins at 0, separators belong to none."""
    out, start, first, end, broken = [], 0, None, 0, False
    for m in LINE.finditer(text):
        line = m.group()
        if not line.strip():
            continue
        begin, stop = m.start() + len(line) - len(line.lstrip()), m.start() + len(line.rstrip())
        if is_ornament(line):
            if first is not None:
                out.append((start, first, end))
            elif not out:  # nothing before the first separator: the scene at 0 keeps its place
                out.append((0, begin, stop))
            first, broken = None, True
            continue
        if first is None:
            first = begin
            start = begin if broken else 0
        end = stop
    if first is not None:
        out.append((start, first, end))
    return out or [(0, 0, len(text))]


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """Pieces ``(scene number, scene start, start, end)`` of at most ``limit`` code points in reading order.

    Every character of a scene but white space around cuts is in a piece; consecutive pieces of a scene share up to
    ``overlap`` paragraphs that fit in half the limit. A stretch without any boundary is cut at the limit, before a
    combining mark where that is possible.
    """
    if limit < 1 or overlap < 0:
        raise ValueError("limit must be positive and overlap not negative")
    bounds = scenes(text)
    strength: dict[int, int] = {}
    for pattern, s in ((CLAUSE_END, CLAUSE), (SENTENCE_END, SENTENCE)):
        for m in pattern.finditer(text):
            strength[m.end()] = s
    paragraphs = []
    for m in LINE.finditer(text):
        if m.group().strip():
            paragraphs.append(m.start() + len(m.group()) - len(m.group().lstrip()))
            strength[paragraphs[-1]] = PARAGRAPH
    held = {scene: (first, end) for scene, first, end in bounds}
    strength |= {scene: SCENE for scene, _, _ in bounds[1:]}
    at = sorted(strength)
    index = StrongestCut(at, [strength[x] for x in at])
    out = []
    todo = [(bounds[0][0], len(text))]
    number = -1
    while todo:  # the strongest boundary of a stretch, as long as that begins a scene, divides it
        low, high = todo.pop()
        best = index.strongest(low + 1, high - 1)
        if best and best[1] == SCENE:
            todo += [(best[0], high), (low, best[0])]
            continue
        number += 1
        first, end = held[low]
        out += [(number, low, a, b) for a, b in _cut_scene(text, first, end, index, paragraphs, limit, overlap)]
    return out


def _cut_scene(text: str, first: int, end: int, index: StrongestCut, paragraphs: list[int], limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    start, done, any_yet = first, first, False
    while end - start > limit:
        stop = index.between(max(done + 1, start + limit // 2), start + limit) or index.between(done + 1, start + limit)
        if not stop:
            stop = start + limit
            while stop > done + 1 and (ud.combining(text[stop]) or ud.category(text[stop]) == "Cf"):
                stop -= 1
            if stop == done + 1:
                stop = start + limit
        any_yet = True
        yield start, start + len(text[start:stop].rstrip())
        done = stop
        i = bisect_left(paragraphs, stop)
        back = [p for p in paragraphs[max(0, i - overlap) : i] if p > start and stop - p <= limit // 2]
        start = back[0] if back and overlap else stop
        while start < end and text[start].isspace():
            start += 1
        done = max(done, start)
    if start < end or not any_yet:
        yield start, end


PIECE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("piece", "scene_no", "scene_start", "start", "end")] + [T.StructField("piece_text", T.StringType())])


def split_oversized(df: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of each text longer than ``limit`` code points, with all other columns of its row and ``part``.

    ``part`` holds piece number, scene number and scene start in the text, start, end and the piece's text. Null, empty
    and shorter texts give no row; equal rows are cut alike, each for itself. No shuffle: a text is cut in its own task.
    """

    @F.pandas_udf(T.ArrayType(PIECE))
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda x: [(k, n, s, a, b, x[a:b]) for k, (n, s, a, b) in enumerate(cut(x, limit, overlap))])

    return df.where(F.length(text) > limit).withColumn("part", F.explode(pieces(text)))


def chunk_pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the chunk relation with their own start, end and scene; a repeated id counts once.

    Later scenes of a text go on counting from its ``scene_index``. Offsets are those in the chunk's text and, shifted by
    ``start_pos``, in the book; the latter are approximate where the stored text is not the raw one. Of a repeated id the
    first row loaded counts; only ids are shuffled to find it.
    """
    large = chunks.where(F.length("text") > limit)
    later = large.select("id", "ord", F.row_number().over(Window.partitionBy("id").orderBy("ord")).alias("_n")).where("_n > 1").select("ord")
    once = large.join(later, "ord", "left_anti")
    one = split_oversized(once.select("id", "book_name", "start_pos", "chapter_index", "scene_index", "scene_id", "text"), "text", limit, overlap)
    p = lambda name: F.col(f"part.{name}")
    index = F.coalesce("scene_index", F.lit(0)) + p("scene_no")
    return one.select(
        "id",
        "book_name",
        p("piece").alias("piece"),
        p("scene_start").alias("scene_start"),
        p("start").alias("start_in_text"),
        p("end").alias("end_in_text"),
        (F.coalesce("start_pos", F.lit(0)) + p("start")).alias("start_pos"),
        (F.coalesce("start_pos", F.lit(0)) + p("end")).alias("end_pos"),
        index.alias("scene_index"),
        F.when(p("scene_no") == 0, F.col("scene_id")).otherwise(F.format_string("chapter-%03d-scene-%03d", F.coalesce("chapter_index", F.lit(0)), index)).alias("scene_id"),
        p("piece_text").alias("text"),
    )
