"""Usage of visitors by day and statistics of books."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed
from quillspark.functions.exprs import utc_day


def once(log: DataFrame, key: str = "id", loaded: str = "loaded_at") -> DataFrame:
    """The log with one row per key, the one loaded first."""
    by = Window.partitionBy(key).orderBy(loaded)
    return log.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def daily_usage(log: DataFrame, quota: int = fixed.DAILY_QUOTA) -> DataFrame:
    """``visitor_id, usage_date, asked, used_count, remaining``: queries without an own key by UTC day, counted up to the quota."""
    own = log.where("coalesce(used_custom_api_key, 0) = 0 and visitor_id is not null and created_at is not null")
    by = own.groupBy("visitor_id", utc_day(F.col("created_at")).alias("usage_date")).agg(F.count("*").alias("asked"))
    return by.select("visitor_id", "usage_date", "asked", F.least("asked", F.lit(quota)).alias("used_count"), F.greatest(F.lit(quota) - F.col("asked"), F.lit(0)).alias("remaining"))


def in_order(log: DataFrame) -> DataFrame:
    """The log with ``day_rank``: the how-manieth query without an own key of its visitor on its UTC day."""
    own = log.where("coalesce(used_custom_api_key, 0) = 0 and visitor_id is not null and created_at is not null")
    by = Window.partitionBy("visitor_id", utc_day(F.col("created_at"))).orderBy("created_at", "id")
    return own.withColumn("day_rank", F.row_number().over(by))


def recount(log: DataFrame, usage: DataFrame, quota: int = fixed.DAILY_QUOTA) -> DataFrame:
    """Where the stored counts differ from the log: ``visitor_id, usage_date, stored, counted``."""
    counted = daily_usage(log, quota).select("visitor_id", "usage_date", F.col("used_count").alias("counted"))
    stored = usage.select("visitor_id", "usage_date", F.col("used_count").cast("long").alias("stored"))
    both = stored.join(counted, ["visitor_id", "usage_date"], "full")
    return both.select("visitor_id", "usage_date", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("counted", F.lit(0)).alias("counted")).where("stored <> counted")


def book_stats(chunks: DataFrame) -> DataFrame:
    """``book, chunks, first_ord``: chunks per book in the order of loading; without a name they are of the unknown book."""
    book = F.coalesce(F.when(F.col("book_name") != "", F.col("book_name")), F.lit(fixed.UNKNOWN_BOOK))
    return chunks.groupBy(book.alias("book")).agg(F.count("*").alias("chunks"), F.min("ord").alias("first_ord"))
