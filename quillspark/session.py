"""Session helpers shared by every module: table reading, scratch folder, partition counts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
OPEN_COST = "spark.sql.files.openCostInBytes"


def local_session(app: str = "quillspark", cores: str = "8", shuffle: int = 8) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer tasks than there are; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def packed(df: DataFrame) -> DataFrame:
    """``df`` in no more tasks than there are cores, for tasks that each keep their own best rows: fewer tasks leave fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(cores) if df.rdd.getNumPartitions() > cores else df


def scratch(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a folder of its own only where Spark runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspark-"))
    return sc.getCheckpointDir()


def _kept(spark: SparkSession) -> list[str]:
    """Paths this application has written to the shared folder; they are deleted when it ends."""
    sc = spark.sparkContext
    if not hasattr(sc, "_quillspark_kept"):
        sc._quillspark_kept = []
        atexit.register(release, spark)
    return sc._quillspark_kept


def release(spark: SparkSession) -> None:
    """Deletes every table that ``saved`` has written so far; results that still read one must be stored before."""
    paths = _kept(spark)
    while paths and spark.sparkContext._jsc is not None:
        try:
            delete(spark, paths[-1])
        except Exception:  # the session's end must not fail over a folder that is gone, or a gateway that is
            return
        paths.pop()


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """What is written inside leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    return _setting(spark, CLEANUP, "true")


def small_files(spark: SparkSession) -> AbstractContextManager[None]:
    """What is read inside has many files in a task; else Spark counts each as 4 MB and makes a task of a few."""
    return _setting(spark, OPEN_COST, "16384")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet under the shared folder and read back; cuts lineage and survives a lost executor."""
    return saved_parts([df], name)


def saved_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Frames of one schema, at least one, made and written one after the other, read back as one."""
    path = schema = None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        if path is None:
            path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
            _kept(spark).append(path)
        with _shuffles_dropped(spark):
            df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` gives, stored; the other tables that it stored on the way are deleted."""
    paths = _kept(spark)
    before = len(paths)
    out = saved(make(), name)
    own = paths.pop()
    while len(paths) > before:
        delete(spark, paths.pop())
    paths.append(own)
    return out


def few(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """``rows``, which are stored, to be broadcast if they are counted to be at most so many."""
    return F.broadcast(rows) if rows.count() <= most else rows


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per context; needless where it is installed, but then it does no harm."""
    sc = spark.sparkContext
    if getattr(sc, "_quillspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="quillspark-py-")) / "quillspark.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    sc._quillspark_shipped = True
