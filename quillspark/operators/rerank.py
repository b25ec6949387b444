"""Scores of a reranking model, with a cache of those that are known."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.clients import Embedder, Scorer, aligned, embed_column
from quillspark.session import saved
from quillspark.sources.relations import cache_key, split_by_cache


def model_scores(pairs: DataFrame, scorer: Scorer, query: str, query_text: str, order: str, text: str) -> DataFrame:
    """``pairs`` with ``rerank_score``: one call of the model for the candidates of each query, in their order.

    A query's candidates are a top k. A document that the model leaves out has 0; null texts count as empty.
    """
    out = T.StructType([*pairs.schema.fields, T.StructField("rerank_score", T.DoubleType())])

    def ask(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        scores = scorer.score(group[query_text].iloc[0] or "", group[text].fillna("").to_list())
        return group.assign(rerank_score=aligned(scores, len(group)))

    return pairs.groupBy(query).applyInPandas(ask, out)


def cached_scores(pairs: DataFrame, cache: DataFrame, scorer: Scorer, query: str = "eval_id", query_text: str = "question", chunk: str = "id", order: str = "cand_rank", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of all pairs, the cache with the new ones, and ``cache_hits, api_scored, api_calls``.

    A pair's key is the hash of model, query, chunk and text. What the cache (key, score) holds is joined, only the rest
    is asked for; of a key that the cache holds twice the highest score counts. Write the second frame back with
    ``write_cache``.
    """
    keyed = pairs.withColumn("_model", F.lit(scorer.model)).withColumn("key", cache_key("_model", query_text, chunk, text)).drop("_model")
    known = cache.groupBy("key").agg(F.max("score").alias("score"))
    hits, misses = split_by_cache(keyed, known)
    fresh = saved(model_scores(misses, scorer, query, query_text, order, text), "scores")
    every = hits.withColumnRenamed("score", "rerank_score").unionByName(fresh)
    grown = known.unionByName(fresh.select("key", F.col("rerank_score").alias("score")).distinct())
    stats = hits.agg(F.count("*").alias("cache_hits")).crossJoin(fresh.agg(F.count("*").alias("api_scored"), F.count_distinct(query).alias("api_calls")))  # one row each
    return every, grown, stats


def cached_embeddings(questions: DataFrame, cache: DataFrame, embedder: Embedder, model: str, text: str = "question") -> tuple[DataFrame, DataFrame]:
    """``questions`` with ``embedding`` and the cache (key, embedding) with those that it lacked; null texts have no vector."""
    keyed = questions.withColumn("_model", F.lit(model)).withColumn("key", cache_key("_model", text)).drop("_model")
    known = cache.dropDuplicates(["key"])
    hits, misses = split_by_cache(keyed, known)
    fresh = saved(embed_column(misses.select("key", text).dropDuplicates(["key"]), text, embedder), "embeddings")
    grown = known.unionByName(fresh.where("embedding is not null").select("key", "embedding"))
    return hits.unionByName(misses.join(fresh.select("key", "embedding"), "key")), grown
