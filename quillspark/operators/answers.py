"""Parsing of judgements and answers, and the layout of contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JUDGEMENT = "answerable string, missing_info array<string>, clarification_questions array<string>"


def json_object(text: Column) -> Column:
    """The JSON object in a model's reply: without code fences, else from the first to the last brace; null if there is none."""
    bare = F.trim(F.regexp_replace(text, r"(?s)^\s*```[A-Za-z]*\s*|\s*```\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT")
    return F.when(ok(bare), bare).when(ok(inner), inner)


def judgement(text: Column) -> Column:
    """``answerable, missing_info, clarification_questions`` of a judge's reply; null where it holds no JSON object.

    Only true, or the string "true" in any case, is answerable; lists are trimmed, without blanks and repeats, and hold
    at most five and three entries.
    """
    parsed = F.from_json(json_object(text), JUDGEMENT)
    tidy = lambda c, n: F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))), 1, n)
    return F.when(
        json_object(text).isNotNull(),
        F.struct((F.lower(F.trim(F.coalesce(parsed["answerable"], F.lit("")))) == "true").alias("answerable"), tidy(parsed["missing_info"], 5).alias("missing_info"), tidy(parsed["clarification_questions"], 3).alias("clarification_questions")),
    )


def context_block(results: DataFrame, query: str, rank: str, book: str, chunk_id: str, score: str, text: str) -> DataFrame:
    """``query, context``: the results of each query as numbered passages with book, id and score to four places.

    Bounded by the results of one query, which are a top k.
    """
    head = F.format_string("[片段 %d | book=%s | chunk_id=%s | score=%s]", F.col(rank), F.col(book), F.col(chunk_id), F.format_string("%.4f", F.col(score)))
    part = F.concat(head, F.lit("\n"), F.coalesce(F.col(text), F.lit("")))
    rows = results.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), part.alias("p")))).alias("ps"))
    return rows.select(query, F.array_join(F.col("ps.p"), "\n\n").alias("context"))
