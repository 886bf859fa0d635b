"""Tables that cut lineage, on the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Paths that this process has written, by application, for discard().
_WRITTEN: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, in a local session only, a temporary folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(scratch_dir, "own", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = scratch_dir.own = tempfile.mkdtemp(prefix="waymill-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder, remembered for discard()."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the scratch folder and read it back; lost executors don't recompute it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Delete all that this application has written to the scratch folder so far, and say how many paths.

    Results read from there when they are used, so this comes after they have been written elsewhere.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete(spark, path)
    return len(paths)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder by Spark's own file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, order: list[Column], name: str = "position", start: int = 1) -> DataFrame:
    """Number all rows in a total order, without a window over everything.

    Rows are range-partitioned and written with their partition; one count for each
    partition comes to the driver and moves that partition's own numbers.
    """
    keys = [f"__k{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(keys, order, strict=True)))
    parted = materialise(keyed.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = {r["__part"]: r["count"] for r in parted.groupBy("__part").count().collect()}  # a row for each partition
    ahead, offsets = start, []
    for part in sorted(counts):
        offsets.append((part, ahead))
        ahead += counts[part]
    moved = df.sparkSession.createDataFrame(offsets or [(0, start)], "__part int, __ahead long")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    out = parted.withColumn("__row", within).join(F.broadcast(moved), "__part")
    return out.withColumn(name, F.col("__ahead") + F.col("__row")).drop(*keys, "__part", "__row", "__ahead")


def adjacent_pairs(df: DataFrame, order: list[str], value: Column) -> DataFrame:
    """(before, here): the value of each row and that of the row ahead of it in the order.

    The order is cut into ranges; within one a window pairs the rows, and the first of each is
    paired with the last of the range ahead, of which there is one row each.
    """
    parted = df.select(*order, value.alias("here")).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    parted = materialise(parted, "ordered-ranges")
    pairs = parted.select(F.lag("here").over(Window.partitionBy("part").orderBy(*order)).alias("before"), "here")
    place = F.struct(*order)
    edges = parted.groupBy("part").agg(F.min_by("here", place).alias("first"), F.max_by("here", place).alias("last"))
    seams = edges.select(F.lag("last").over(Window.orderBy("part")).alias("before"), F.col("first").alias("here"))
    return pairs.unionByName(seams).where("before is not null")


def by_place(df: DataFrame, key: str | list[str], values: list[str], name: str) -> DataFrame:
    """(key, name): each key's values as an array in the order of pos, counted from 0 without gaps. A key may be several columns.

    Rows are dealt by key as they are: there is nothing to gather before, and lists of one take more room
    than their row. Rows that are there twice count once.
    """
    every = F.sort_array(F.collect_list(F.struct("pos", *values)))
    once = F.when(F.size(every) > F.max("pos") + 1, F.array_distinct(every)).otherwise(every)
    keys = [key] if isinstance(key, str) else key
    return df.repartition(*keys).groupBy(*keys).agg(once.alias(name))
