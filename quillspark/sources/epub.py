"""E-books as a source: members of ZIP files in reading order."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed
from quillspark.functions.exprs import is_toc_heading
from quillspark.operators import text as tx
from quillspark.session import saved
from quillspark.sources.relations import write_texts

HTML = (".xhtml", ".html", ".htm")


def _local(root: ET.Element, name: str) -> Iterator[ET.Element]:
    return (e for e in root.iter() if e.tag.rpartition("}")[2] == name)


def _natural(name: str) -> list:
    return [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.split(r"(\d+)", name)]


def reading_order(book: zipfile.ZipFile) -> list[str]:
    """HTML members by the spine of the package document, else those under a text folder in natural order."""
    names = set(book.namelist())
    try:
        container = ET.fromstring(book.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in _local(container, "rootfile") if e.get("full-path"))
        package = ET.fromstring(book.read(opf))
        at = {e.get("id"): unquote(e.get("href") or "") for e in _local(package, "item")}
        spine = [posixpath.normpath(posixpath.join(posixpath.dirname(opf), at[e.get("idref")])) for e in _local(package, "itemref") if at.get(e.get("idref"))]
        found = [m for m in spine if m in names and m.lower().endswith(HTML)]
    except (KeyError, StopIteration, ET.ParseError):
        found = []
    return found or sorted((m for m in names if "/text/" in f"/{m.lower()}" and m.lower().endswith(HTML)), key=_natural)


def is_body(member: str) -> bool:
    stem = posixpath.splitext(posixpath.basename(member))[0].lower()
    return stem not in fixed.SKIPPED_STEMS and not any(p in stem for p in fixed.SKIPPED_PARTS)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """``book_name, member_no, member, html`` of the body members of each e-book; files that are no ZIP raise."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                stem = posixpath.splitext(posixpath.basename(unquote(name)))[0]
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    rows += [(stem, i, m, book.read(m).decode("utf-8", "ignore")) for i, m in enumerate(m for m in reading_order(book) if is_body(m))]
            yield pd.DataFrame(rows, columns=["book_name", "member_no", "member", "html"])

    return files.mapInPandas(members, "book_name string, member_no int, member string, html string")


def clean_paragraphs(members: DataFrame, prefix: str | None = None) -> DataFrame:
    """``book_name, n, para``: the paragraphs of each book without contents pages, repeats, tables of contents and front matter.

    ``prefix`` keeps only members one of whose first three paragraphs starts with it.
    """
    key = F.struct("book_name", "member_no")
    paras = tx.html_paragraphs(members.withColumn("k", key), "k", "html").select("k.book_name", "k.member_no", "para_no", "para")
    by = Window.partitionBy("book_name", "member_no")
    heading = F.max(F.when(F.col("para_no") == 0, is_toc_heading(F.col("para")).cast("int"))).over(by)
    paras = paras.withColumn("_h", heading).where("_h = 0").drop("_h")
    if prefix and prefix.strip():
        match = F.max(((F.col("para_no") < 3) & F.startswith("para", F.lit(prefix.strip()))).cast("int")).over(by)
        paras = paras.withColumn("_m", match).where("_m = 1").drop("_m")
    paras = paras.withColumn("n", F.row_number().over(Window.partitionBy("book_name").orderBy("member_no", "para_no"))).select("book_name", "n", "para")
    for step in (tx.drop_repeats, tx.drop_contents, tx.trim_front):
        paras = step(paras, "book_name", "n", "para")
    return paras


def read_epubs(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """``book_name, text`` of each e-book."""
    return tx.joined(clean_paragraphs(read_members(spark, path), prefix), "book_name", "n", "para")


def import_epubs(spark: SparkSession, path: str, out: str, prefix: str | None = None) -> DataFrame:
    """Writes the clean text of each e-book under ``out`` and returns ``book_name, paragraphs, chars``; no text at all raises."""
    return write_texts(saved(read_epubs(spark, path, prefix), "epubs"), out)
