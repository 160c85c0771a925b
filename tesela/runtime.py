"""Session-level helpers: lineage cuts in shared storage, broadcast decisions, stable ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a measured lookup table may be broadcast.
BROADCAST_LIMIT = 16 << 20
_made: list[str] = []


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``; make a private one only where none is set and all runs on this machine (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tesela-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path inside the folder that all executors share; :func:`clean_up` deletes it."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Delete the tables that cut lineages so far, once no DataFrame that came from them is used any more. Returns their number."""
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it as a table in the folder that all executors share, and read that.

    Unlike ``checkpoint()``, the table is compressed, read by column, and known by its true size to the join planner.
    """
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, *weights: Column, limit: int = BROADCAST_LIMIT, row_bytes: int = 48) -> DataFrame:
    """Mark ``df`` for broadcast if its measured size is within ``limit`` bytes, else leave it to a shuffled join.

    The size is ``row_bytes`` a row plus the sum of ``weights`` (lengths in bytes of its variable columns).
    ``df`` should be cut or cheap, as it is evaluated once for the measurement.
    """
    extra = sum((F.coalesce(w.cast("long"), F.lit(0)) for w in weights), F.lit(0))
    size = df.agg(F.sum(extra + F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """``df``, shuffled only where a scan has fewer partitions than there are cores; a large table is read as it lies."""
    spark = df.sparkSession
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = spark.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(2 * cores)


def lookup(rows: DataFrame, column: str, known: DataFrame, key: str, weight: str, telling: Column | None = None) -> DataFrame:
    """``rows`` left-joined to ``known`` (unique ``key``) on ``column``, without ``key`` and ``weight``, safe where few keys hold most rows.

    ``weight`` is the number of rows with the key. A ``known`` of small measured size is broadcast whole. Else the keys with
    more than a partition's share of the rows, of which there are no more than partitions, are broadcast, and the others shuffled.
    Rows of ``known`` that are not ``telling`` may be left out, where the caller takes a missing row for one that tells nothing.
    """
    needed = F.lit(True) if telling is None else telling
    size = known.agg(F.sum(F.when(needed, F.octet_length(F.col(key).cast("string")) + 48)), F.sum(weight)).first()
    on = F.col(column) == F.col(f"__{key}")
    if (size[0] or 0) <= BROADCAST_LIMIT:
        return rows.join(F.broadcast(known.filter(needed).withColumnRenamed(key, f"__{key}").drop(weight)), on, "left").drop(f"__{key}")
    share = size[1] / int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col("__weight") >= share
    weighed = known.withColumnRenamed(key, f"__{key}").withColumnRenamed(weight, "__weight")
    hot = F.broadcast(weighed.filter(is_hot).drop("__weight"))
    return rows.join(hot, on).drop(f"__{key}").unionByName(rows.join(hot, on, "left_anti").join(weighed.filter(~is_hot).drop("__weight"), on, "left").drop(f"__{key}"))


def with_ids(df: DataFrame, order: list[str], name: str = "id", partitions: int | None = None) -> DataFrame:
    """Give every row a dense number from 0 in the global order of ``order`` (which must be a unique key).

    Rows are range-partitioned and sorted; only one count for each partition goes through the driver.
    The result is cut, so that the numbers survive a lost executor.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, here = f"__{name}_part", f"__{name}_here"
    ranged = cut(df.repartitionByRange(n, *[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).withColumn(here, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(part).count().collect())
    if not sizes:
        return ranged.select(*df.columns, F.lit(0).cast("long").alias(name))
    base, at = [0] * (sizes[-1][0] + 1), 0
    for p, c in sizes:
        base[p], at = at, at + c
    # a constant array, by which a row finds its offset in one step
    offsets = F.split(F.lit(",".join(map(str, base))), ",").cast("array<bigint>")
    return ranged.select(*df.columns, (F.get(offsets, F.col(part)) + F.col(here)).alias(name))


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
