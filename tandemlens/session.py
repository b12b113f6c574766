"""Session defaults for local runs, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_CONF = "spark.checkpoint.dir"
SPLIT_ROWS_CONF = "spark.tandemlens.splitRows"
SPLIT_ROWS = 4_000_000
BROADCAST_ROWS_CONF = "spark.tandemlens.broadcastRows"
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
_WRITTEN: list[str] = []


def local_session(cpus: int | str = 8, memory: str = "8g", app: str = "tandemlens") -> SparkSession:
    """Session for tests and benchmarks. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


@lru_cache(maxsize=None)
def _local_root(master: str) -> str:
    if not master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="tandemlens-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path in the cluster's shared checkpoint folder (a local one only if none is set)."""
    root = spark.conf.get(CHECKPOINT_CONF, None) or _local_root(spark.sparkContext.master)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, which cuts lineage and fixes its rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> list[str]:
    """Paths of the tables that `durable` wrote in this process and that are not deleted yet."""
    return list(_WRITTEN)


def drop_tables(spark: SparkSession, paths: Iterable[str]) -> int:
    """Delete those of `paths` that `durable` wrote; returns how many. Any file system that Spark can write to will do."""
    count = 0
    for path in set(paths).intersection(_WRITTEN):
        _WRITTEN.remove(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        count += 1
    return count


def release(spark: SparkSession) -> int:
    """Delete all tables that `durable` wrote in this process; to be called once their results are used."""
    return drop_tables(spark, tables_written())


def fits_broadcast(df: DataFrame) -> bool:
    """Rows and bytes of the whole table are within the limits: counted, not guessed.

    A table that Spark estimates at many times the limit is not looked at, and of a longer one no
    more than one row over the limit is counted.
    """
    limit = int(df.sparkSession.conf.get(BROADCAST_ROWS_CONF, str(BROADCAST_ROWS)))
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) in range(
        64 * BROADCAST_BYTES, 1 << 60
    ):
        return False
    width = F.lit(0).cast("long")
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            width += F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            width += F.coalesce(F.size(field.name), F.lit(0)) * 16 + 16
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            width += F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)) + 16
        else:
            width += 8
    widths = df.select(width.alias("width")).limit(limit + 1)
    size = widths.agg(F.count("*").alias("rows"), F.sum("width").alias("bytes")).first()
    return size["rows"] <= limit and (size["bytes"] or 0) <= BROADCAST_BYTES


def split_rows(spark: SparkSession) -> int:
    """Rows above which a group counts as hot and is spread over several tasks."""
    return int(spark.conf.get(SPLIT_ROWS_CONF, str(SPLIT_ROWS)))
