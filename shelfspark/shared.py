"""Tables kept in the folder that all machines share, sides small enough to send, and spread reads."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table, by its rows and types, up to which it is sent to all tasks.
SMALL_BYTES = 8 << 20
_WIDTH = {"tinyint": 8, "smallint": 8, "int": 8, "bigint": 8, "float": 8, "double": 8, "boolean": 8, "date": 8, "timestamp": 8, "string": 256}

_local: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master where it is unset, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return _local.setdefault(id(spark.sparkContext), "file://" + tempfile.mkdtemp(prefix="spark-shared-"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/shelfspark-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return f"{path}/{name}"


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: cuts lineage, and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame) -> DataFrame:
    """A stored df marked for broadcast if its rows, counted, take at most SMALL_BYTES; else as it is (then the join shuffles)."""
    kinds = [t for _, t in df.dtypes]
    if any(t not in _WIDTH for t in kinds):
        return df
    most = SMALL_BYTES // (16 + sum(_WIDTH[t] for t in kinds))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df over all tasks where its files give fewer parts than the session's shuffles have."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def numbered(df: DataFrame, order: list[str], out: str = "rn") -> DataFrame:
    """df with the number of each row (from 1) in the whole order, without one task for all rows.

    Rows are dealt by ranges of the order and stored; ranges are counted, and a row's number is
    that of its range's start plus its own in the range. Equal rows may take each other's numbers.
    """
    held = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    from pyspark.sql import Window

    sizes = held.groupBy("__part").agg(F.count("*").alias("__n"))  # a row a partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return held.join(F.broadcast(starts), "__part").withColumn(out, own + F.col("__start")).drop("__part", "__start")
