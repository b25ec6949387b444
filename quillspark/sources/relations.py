"""Readers and writers of the relations: chunk index, entities, evaluation sets, caches, texts, query log."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import fixed
from quillspark.functions.exprs import paragraph_count
from quillspark.session import delete, saved

CHUNK = "id string, book_name string, chunk_index int, start int, end int, text string, chapter_title string, chapter_index int, scene_index int, scene_id string, embedding array<double>"
ENTITY = "id string, type string, canonical string, aliases array<string>"
EVAL_ITEM = "question string, gold_chunk_id string, reference_answer string, gold_text_preview string, gold_book_name string"
REQUIRED = ("id", "book_name", "chunk_index", "start", "end", "text")


class SourceError(ValueError):
    """A source that is missing, empty or malformed."""


def _json_lines(spark: SparkSession, path: str, schema: str, what: str) -> DataFrame:
    """Lines of JSON objects; blank lines are skipped, a bad line raises with its text's beginning when it is read."""
    full = T._parse_datatype_string(schema).add("_corrupt_record", T.StringType())
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    bad = F.concat(F.lit(f"bad line in {what}: "), F.substring("_corrupt_record", 1, 80))
    first = rows.columns[0]
    checked = rows.withColumn(first, F.when(F.col("_corrupt_record").isNotNull(), F.raise_error(bad).cast(rows.schema[first].dataType)).otherwise(F.col(first)))
    return checked.drop("_corrupt_record")


def read_chunks(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """The chunk index with ``ord`` from the order of lines; required fields must be there, the others have defaults.

    An index without rows raises, as does any bad line or missing field (when it is read).
    """
    rows = _json_lines(spark, path, CHUNK, "the chunk index") if kind == "json" else spark.read.parquet(path)
    if rows.isEmpty():
        raise SourceError(f"no chunks in {path}")
    absent = {f.name: F.lit(None).cast(f.dataType) for f in T._parse_datatype_string(CHUNK) if f.name not in (*rows.columns, *REQUIRED)}
    rows = rows.withColumns(absent) if absent else rows
    need = {c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"chunk without {c}")).cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c in REQUIRED}
    out = rows.withColumns(need).withColumns({"chapter_index": F.coalesce("chapter_index", F.lit(0)), "scene_index": F.coalesce("scene_index", F.lit(0)), "scene_id": F.coalesce("scene_id", F.lit(fixed.NO_SCENE))})
    return out if "ord" in out.columns else _in_order(out)


def _in_order(rows: DataFrame) -> DataFrame:
    """``rows`` read from files, with ``ord`` counting them in the order of files, and of lines in each, from 0.

    Rows are counted by the stretches of files that Spark reads, which are few; a row's number is that of its stretch
    and its place therein.
    """
    at = rows.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    parts = at.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = at.join(parts.withColumn("_before", before).drop("_n"), ["_f", "_b"])
    return numbered.withColumn("ord", F.col("_before") + F.col("_m") - F.col("_first")).drop("_f", "_b", "_m", "_first", "_before")


def write_chunks(chunks: DataFrame, path: str, kind: str = "parquet") -> None:
    """Overwrites the index; parquet is laid out by book, so that a book's rows are read alone."""
    writer = chunks.write.mode("overwrite")
    if kind == "parquet":
        writer.partitionBy("book_name").parquet(path)
    else:
        writer.json(path)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of entities; a missing file is an empty dictionary, required fields must not be blank."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], ENTITY)
    rows = spark.read.schema(ENTITY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    blank = {c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.raise_error(F.lit(f"entity without {c}")).cast("string")).otherwise(F.trim(c)) for c in ("id", "type", "canonical")}
    return rows.withColumns(blank)


def read_eval_items(spark: SparkSession, path: str) -> DataFrame:
    rows = _json_lines(spark, path, EVAL_ITEM, "the evaluation set")
    if rows.isEmpty():
        raise SourceError(f"no evaluation items in {path}")
    return rows


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Every field of every row, nulls too, so that a column of nulls is there when the file is read."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_cache(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``key`` and a value column (``embedding array<double>`` or ``score double``); malformed entries are left out."""
    name = value.split()[0]
    rows = spark.read.schema(f"key string, {value}").option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("key").isNotNull() & F.col(name).isNotNull())


def write_cache(rows: DataFrame, path: str) -> None:
    """The cache in the order of its keys, so that equal caches are equal files part by part."""
    rows.orderBy("key").write.mode("overwrite").json(path)


def cache_key(*parts: str) -> Column:
    """SHA-256 of the parts, one on each line; nulls count as empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)


def split_by_cache(rows: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Rows whose key the cache holds, with its value, and those still to be computed."""
    return rows.join(cache, key), rows.join(cache.select(key), key, "left_anti")


def resolve_book_names(stems: list[str], names: list[str] | None = None) -> dict[str, str]:
    """The name of each text: its own in ``names``, in the order of the files, or its file's without the ending.

    As many names as files, none blank, none twice; else an error says what is wrong.
    """
    if not names:
        return dict(zip(stems, stems))
    names = [n.strip() for n in names]
    if len(names) != len(stems):
        raise SourceError(f"{len(names)} names for {len(stems)} texts")
    if not all(names):
        raise SourceError("a name is blank")
    if len(set(names)) < len(names):
        raise SourceError("a name comes twice")
    return dict(zip(stems, names))


def read_texts(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """``book_name, text`` of UTF-8 files, whole; the name is that of the file without its ending, or one of ``names``. Empty files raise."""
    stem = F.udf(lambda f: unquote(f).rsplit(".", 1)[0], "string")  # one row a file
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), stem(F.col("_metadata.file_name")).alias("f"))
    name = F.col("f")
    if names:
        wanted = resolve_book_names(sorted(r["f"] for r in rows.select("f").collect()), names)  # as many as names
        name = F.element_at(F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair]), name)
    text = F.when(F.trim("text") == "", F.raise_error(F.concat(F.lit("empty text: "), "f")).cast("string")).otherwise(F.col("text"))
    return rows.select(name.alias("book_name"), text.alias("text"))


def write_texts(texts: DataFrame, path: str) -> DataFrame:
    """Overwrites the folder with a file of each book's text and returns ``book_name, paragraphs, chars``; no text at all raises.

    The file has the text's bytes and the book's name, so ``read_texts`` gives both back. What Spark can't have in a name (slash, colon, a
    dot or underscore at the beginning) is written %XX. A name that comes twice raises, as one text would be lost. Tasks write
    the files themselves: Spark's writer makes a folder for each and moves them one by one on the driver.
    """
    spark = texts.sparkSession
    if texts.where(F.trim("text") != "").isEmpty():
        raise SourceError("no text to write")
    delete(spark, path)
    folder = re.sub("^file:/+", "file:///", path) if re.match(r"\w+:/", path) else Path(path).absolute().as_uri()
    fs, root = FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        for batch in batches:
            for name, text in zip(batch.column("book_name").to_pylist(), batch.column("text").to_pylist()):
                own = re.sub(r"[/:\0]|^[._]", lambda m: f"%{ord(m[0]):02X}", name)
                with fs.open_output_stream(f"{root}/{own}.txt") as f:
                    f.write(text or b"")
            yield batch.select(["book_name", "paragraphs", "chars"])

    each = texts.select("book_name", F.col("text").cast("binary").alias("text"), paragraph_count(F.col("text")).alias("paragraphs"), F.length("text").alias("chars"))
    counts = saved(each.mapInArrow(put, "book_name string, paragraphs int, chars int"), "text-counts")
    if not counts.groupBy("book_name").count().where("count > 1").isEmpty():
        raise SourceError("a book comes twice")
    return counts


def append_queries(log: DataFrame, path: str) -> None:
    """Appends to the query log; usage counts are aggregates of it, never updated in place."""
    log.write.mode("append").parquet(path)
