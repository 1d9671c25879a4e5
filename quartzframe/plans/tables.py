"""Tables in the shared folder, orders by keyed hash, and distributed ranks and quantiles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's tables in the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has made here. DataFrames that read them are of no use afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which ends its lineage and fixes what is random in it."""
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return df.sparkSession.read.schema(schema).parquet(path)


def hash_key(key: Column, seed: int | str) -> Column:
    """A random order that needs no generator: md5 of seed and key, the same on any partitioning and in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def with_rank(df: DataFrame, order: list[Column], rank: str = "rank", group: list[str] | None = None) -> DataFrame:
    """df with the rank from 0 of each row in order, within group if given.

    Rows are range-sorted, ranges counted, and ranks added up from a range's offset and the local row number, so
    neither the table nor a group meets in one task."""
    group = group or []
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = materialize(df.repartitionByRange(n, *group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long")).drop("_n")
    local = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order)) - 1
    keys = [ranges["_range"] == offsets["_range"], *(ranges[g].eqNullSafe(offsets[g]) for g in group)]
    joined = ranges.withColumn("_local", local)
    keys = [joined["_range"] == offsets["_range"], *(joined[g].eqNullSafe(offsets[g]) for g in group)]
    return joined.join(offsets, keys).select(*(joined[c] for c in df.columns), (F.col("_before") + F.col("_local")).cast("long").alias(rank))


def quantiles(values: DataFrame, group: str, value: str, probabilities: list[float]) -> DataFrame:
    """group, q, edge: exact quantiles with linear interpolation. Nulls and NaN do not count.

    Values are counted, the counts range-sorted and summed up by ranges, and the two values next to each position
    picked; so no task holds a group's values."""
    present = values.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    n = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = materialize(present.repartitionByRange(n, group, value).withColumn("range_no", F.spark_partition_id()), "values")
    sums = ranges.groupBy(group, "range_no").agg(F.sum("n").alias("m"))
    before = Window.partitionBy(group).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    offsets = sums.select(group, "range_no", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"), F.sum("m").over(whole).alias("total"))
    local = F.sum("n").over(Window.partitionBy("range_no", group).orderBy(value))
    placed = ranges.withColumn("upto", local).join(offsets, [group, "range_no"])
    placed = placed.select(group, value, "total", (F.col("before") + F.col("upto") - F.col("n")).alias("first"), (F.col("before") + F.col("upto")).alias("end"))
    wanted = F.explode(F.array(*(F.lit(float(q)) for q in probabilities)))
    at = placed.select("*", wanted.alias("q")).withColumn("position", (F.col("total") - 1) * F.col("q"))
    inside = lambda p: (p >= F.col("first")) & (p < F.col("end"))
    low, high = F.floor("position"), F.ceil("position")
    at = at.where(inside(low) | inside(high))
    picked = at.groupBy(group, "q").agg(F.max(F.when(inside(low), F.col(value))).alias("a"), F.max(F.when(inside(high), F.col(value))).alias("b"), F.max(F.col("position") - low).alias("t"))
    return picked.select(group, "q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("t")).alias("edge"))
