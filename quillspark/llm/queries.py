"""The registered queries of the numbered problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import defects, langs, leaks, looks, mix, neardup, pieces, vectors
from quillspark.session import saved, table


PAIRED = 1000  # members of a group that are paired in one task with all of it


def p1_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar chunks of every chunk with a usable vector."""
    return vectors.most_similar(table(spark, sf, "chunks"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = p1_neighbours(spark, sf)
    return pairs.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    model = langs.fit_on(table(spark, sf, "lang_samples"))
    sides = (("visitor_queries", "id", "question", "answer"), ("eval_items", "eval_id", "question", "reference_answer"))
    parts = [defects.defective_pairs(table(spark, sf, name), model, key, prompt, response).select(F.lit(name).alias("tbl"), F.col("key").alias("row_id"), "defect") for name, key, prompt, response in sides]
    return parts[0].unionByName(parts[1])


def p3_canonical_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk text in its one form."""
    return looks.canonical_text(table(spark, sf, "chunks").select("ord", "id", "text"), "text").drop("text")


def p3_canonical_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Every alias in its one form."""
    rows = table(spark, sf, "entities").select("id", F.posexplode("aliases").alias("alias_pos", "alias"))
    return looks.canonical_text(rows, "alias")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunks").select("id", "text").where("text is not null")
    aliases = table(spark, sf, "entities").select("id", F.explode("aliases").alias("alias")).where("alias is not null")
    parts = [looks.look_alikes(rows, F.col("id"), F.col(text)).select(F.lit(name).alias("tbl"), "key_a", "key_b") for name, rows, text in (("chunks", chunks, "text"), ("entities", aliases, "alias"))]
    return parts[0].unionByName(parts[1])


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk with the class of its look and the class of its characters."""
    return looks.look_classes(table(spark, sf, "chunks"), F.col("id"), F.col("text"))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    return pieces.chunk_pieces(table(spark, sf, "chunks"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_pieces(spark, sf).select("id", F.col("scene_start").alias("cut_at")).distinct()


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Per target source its tokens, blocks drawn and placed, and the share reached."""
    return mix.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).report


def p7_chosen(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mixture with the times each is used."""
    return mix.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets")).chosen


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_shares(spark, sf).where("short").select("source")


def p8_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every stretch of whole sentences in one language."""
    return langs.language_segments(table(spark, sf, "documents"), langs.fit_on(table(spark, sf, "lang_samples")), "doc_id", "text")


def p8_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The main language of every document."""
    return langs.document_languages(p8_segments(spark, sf), "doc_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = langs.language_segments(docs, langs.fit_on(table(spark, sf, "lang_samples")), "doc_id", "text", keep="lang")
    stated = F.coalesce(langs.named_language(F.col("lang")), F.lit(""))
    return found.where((F.col("end") - F.col("start") >= langs.LEAST_CHARS) & (F.col("detected") != stated)).select("doc_id", F.col("detected").alias("lang")).distinct()


def _alike(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, sf, "chunks").select("ord", "id", "text")
    return neardup.near_duplicates(chunks, "ord", "text", run=5, similarity=0.6)


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk with its class of equal texts, its group, and its number of links to other classes."""
    links, groups = _alike(spark, sf)
    ends = links.select(F.col("row_a").alias("class")).unionByName(links.select(F.col("row_b").alias("class"))).groupBy("class").agg(F.count("*").alias("n_links"))
    ids = table(spark, sf, "chunks").select(F.col("ord").alias("row"), "id")
    return groups.join(ends, "class", "left").join(ids, "row").select("id", F.col("row").alias("ord"), "class", "group", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    _, groups = _alike(spark, sf)
    ids = table(spark, sf, "chunks").select(F.col("ord").alias("row"), "id")
    own = groups.join(ids, "row").select("group", "id").distinct()
    sizes = own.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    own = saved(own.join(sizes, "group").withColumn("parts", F.ceil(F.col("n") / PAIRED)), "p5-members")
    # a large group is dealt into parts, each of which meets the whole group in a task of its own
    one = own.select("group", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), F.col("id").alias("id_a"))
    all_ = own.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("id").alias("id_b"))
    return one.join(all_, ["group", "part"]).where("id_a < id_b").select("id_a", "id_b")


def p6_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with the held-out items it holds and where."""
    return leaks.leaked_passages(table(spark, sf, "documents"), table(spark, sf, "heldout_items"), "doc_id", "text", "item_id", "text")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_leaks(spark, sf).select("doc_id", "item_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p3_found, p3_classes, p3_canonical_chunks, p3_canonical_aliases, p4_found, p4_pieces, p5_found, p5_groups, p6_found, p6_leaks, p7_found, p7_shares, p7_chosen, p8_found, p8_segments, p8_documents)}
ORACLE: dict[str, str] = {}
