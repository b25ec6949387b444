"""Daily usage and the order of queries over a stream of the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.exprs import utc_day
from quillspark.session import scratch

LATE = "7 days"  # how long a day stays open for rows that arrive late


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The query log as a stream; ``path`` is a folder of files, or one file."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def daily_counts(log: DataFrame, late: str = LATE) -> DataFrame:
    """``visitor_id, usage_date, asked`` of a stream, each id counted once within the watermark."""
    own = log.where("coalesce(used_custom_api_key, 0) = 0 and visitor_id is not null and created_at is not null")
    once = own.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])
    by = once.groupBy(F.window("created_at", "1 day"), "visitor_id").agg(F.count("*").alias("asked"))
    return by.select("visitor_id", utc_day(F.col("window.start")).alias("usage_date"), "asked")


def run_once(counts: DataFrame, name: str, keys: tuple[str, ...] = ("visitor_id", "usage_date")) -> DataFrame:
    """Runs a streaming aggregate over what is there and returns its result as a table.

    Each batch gives the counts it has changed, the last one of a key holds; so the state may forget days that the
    watermark has passed. Rows that come later than it are left out.
    """
    spark = counts.sparkSession
    path = f"{scratch(spark)}/stream-{name}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{path}-state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:  # nothing has come
        return spark.createDataFrame([], counts.schema)
    changed = spark.read.schema(T.StructType([*counts.schema.fields, T.StructField("epoch", T.LongType())])).parquet(path)
    rest = [c for c in counts.columns if c not in keys]
    last = changed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("last"))
    return last.select(*keys, "last.*").select(*counts.columns)
