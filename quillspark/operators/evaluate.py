"""Sampling, ranks of gold chunks, metrics and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed
from quillspark.functions.exprs import book_from_id, preview


def _drawn(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def sample_exact(rows: DataFrame, key: str, n: int = fixed.EVAL_SAMPLE, seed: int = fixed.EVAL_SEED) -> DataFrame:
    """Exactly ``min(n, all)`` rows, those with the smallest seeded hashes of their key."""
    return rows.orderBy(_drawn(key, seed), key).limit(n)


def sample_stratified(rows: DataFrame, key: str, group: str, counts: dict[str, int] | int, seed: int = fixed.EVAL_SEED) -> DataFrame:
    """Exactly so many rows of each group: one number for all, or a number for each named group and none of others.

    An error says which named group is missing or too small.
    """
    by = Window.partitionBy(group).orderBy(_drawn(key, seed), key)
    if isinstance(counts, int):
        return rows.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= counts).drop("_n")
    there = {r[0]: r[1] for r in rows.where(F.col(group).isin(*counts)).groupBy(group).count().collect()}
    for name, n in counts.items():
        if there.get(name, 0) < n:
            raise ValueError(f"{name} has {there.get(name, 0)} rows, {n} are wanted")
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in counts.items() for x in pair]), F.col(group))
    return rows.where(F.col(group).isin(*counts)).withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= wanted).drop("_n")


def gold_ranks(items: DataFrame, results: DataFrame, query: str, gold: str, chunk: str, rank: str, name: str = "gold_rank") -> DataFrame:
    """``items`` with the rank of each item's gold chunk among its results; null where it is missing."""
    hits = results.select(query, F.col(chunk).alias(gold), F.col(rank).alias("_r")).groupBy(query, gold).agg(F.min("_r").alias(name))
    return items.join(hits, [query, gold], "left")


def scored(ranked: DataFrame) -> DataFrame:
    """``ranked`` (gold_rank) with hits at 1, 3 and 5 and the reciprocal rank, 0 where the gold chunk is missed."""
    hit = lambda k: F.coalesce(F.col("gold_rank") <= k, F.lit(False)).alias(f"hit_at_{k}")
    return ranked.select("*", *[hit(k) for k in fixed.RECALL_AT], F.coalesce(1.0 / F.col("gold_rank"), F.lit(0.0)).alias("reciprocal_rank"))


def failure_reason(gold_rank: Column, candidate_rank: Column, unbounded_rank: Column, top_k: int = fixed.TOP_K) -> Column:
    """Why the gold chunk was missed: no candidate, kept out by the cap, or lost in reranking; null where it was found."""
    return F.when(gold_rank.isNotNull(), F.lit(None).cast("string")).when(candidate_rank.isNull(), "candidate_miss").when(unbounded_rank <= top_k, "book_cap_filtered").otherwise("rerank_lost")


def metrics(results: DataFrame, group: str | None = None) -> DataFrame:
    """One row of metrics, or with ``group`` one more for each of its values; overall is the row whose group is null.

    ``results`` has gold_rank, hits, reciprocal_rank and candidate_rank. Without results all rates are 0 and the average
    rank is null.
    """
    rate = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 6)
    found = F.col("candidate_rank").isNotNull()
    aggs = [
        F.count("*").alias("n"),
        *[rate(F.col(f"hit_at_{k}")).alias(f"recall_at_{k}") for k in fixed.RECALL_AT],
        F.round(F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.avg("gold_rank"), 6).alias("avg_gold_rank"),
        F.count_if(F.col("gold_rank").isNull()).alias("missed"),
        rate(found).alias("candidate_hit_rate"),
        F.count_if(~found).alias("candidate_miss"),
        F.count_if(found & F.col("gold_rank").isNull()).alias("rerank_lost"),
    ]
    return results.rollup(group).agg(*aggs) if group else results.agg(*aggs)


def gold_book(book: Column, gold_id: Column) -> Column:
    return F.coalesce(book, book_from_id(gold_id))


def representative_failures(results: DataFrame, order: str, gold: str = "gold_chunk_id", limit: int = 5) -> DataFrame:
    """At most ``limit`` failures: the first of each reason, then others in their order, each gold chunk once.

    If there are no more failures than that, all of them are given, repeats too.
    """
    failed = results.where("gold_rank is null")
    few = failed.orderBy(order).limit(limit + 1)  # tells whether there are more
    reasons = F.create_map(*[F.lit(x) for pair in (("candidate_miss", 0), ("rerank_lost", 1), ("book_cap_filtered", 2)) for x in pair])
    once = failed.withColumn("_k", F.row_number().over(Window.partitionBy(gold).orderBy(order))).where("_k = 1").drop("_k")
    firsts = once.withColumn("_f", F.row_number().over(Window.partitionBy("failure_reason").orderBy(order)))
    priority = F.when(F.col("_f") == 1, F.coalesce(F.element_at(reasons, F.col("failure_reason")), F.lit(3))).otherwise(3)
    picked = firsts.withColumn("_p", priority).orderBy("_p", order).limit(limit).drop("_f", "_p")
    n_few = F.broadcast(few.agg(F.count("*").alias("_n")))  # one row
    return picked.crossJoin(n_few).where(F.col("_n") > limit).drop("_n").unionByName(few.crossJoin(n_few).where(F.col("_n") <= limit).drop("_n"))


def results_table(items: DataFrame, results: DataFrame, query: str) -> DataFrame:
    """``query, gold_chunk_id, retrieved_chunks``: each item with its results in their order, as they are stored.

    ``results`` has id, book, base_score, rerank_score, out_rank and text of a top k of each query; an item without any
    has an empty list.
    """
    one = F.struct("out_rank", F.col("id").alias("chunk_id"), F.col("book").alias("book_name"), "base_score", "rerank_score", preview(F.col("text")).alias("text_preview"))
    lists = results.groupBy(query).agg(F.array_sort(F.collect_list(one)).alias("rs"))
    kept = F.transform("rs", lambda r: F.struct(r["chunk_id"].alias("chunk_id"), r["book_name"].alias("book_name"), r["base_score"].alias("base_score"), r["rerank_score"].alias("rerank_score"), r["text_preview"].alias("text_preview")))
    return items.join(lists, query, "left").select(query, "gold_chunk_id", F.coalesce(kept, F.array()).alias("retrieved_chunks"))
