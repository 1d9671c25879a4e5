"""What the operators of this subpackage share: reading tables, tables that cut lineage, and lambda helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word separators of most contracts: space and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without the setting."""
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
    """Write df to the shared folder and read it back: a table that survives lost executors, ends the lineage, and
    whose file size tells the optimizer whether it may be broadcast."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(nullable(df.schema)).parquet(path)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row even if body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_key(text: Column) -> Column:
    """What only equal texts share: a hash and the length; a null text is a text of its own."""
    return F.struct(F.xxhash64(text).alias("hash"), F.coalesce(F.length(text), F.lit(-1)).alias("length"))


def partitions(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


#: A key is hot with more than this part of all rows, and more than so many rows.
HOT, LEAST_HOT = 10_000, 1000
#: Bits of a filter.
FILTER_BITS = 1 << 26


def hot_keys(counts: DataFrame, keys: list[str], least: int = 0) -> tuple[DataFrame, int]:
    """The keys with more than a HOT-th of all rows of counts (keys, n): HOT at most, whatever the table, and so marked
    for broadcast; and the greatest n of the others."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(least or LEAST_HOT, total // HOT)
    return F.broadcast(counts.where(F.col("n") > most).select(*keys)), most


def join_counted(df: DataFrame, counts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df joined (inner or left) with counts (keys, n and others; each key once): hot ones by a broadcast, the others by a
    join in which no key has many rows."""
    hot, most = hot_keys(counts, keys)
    many = F.broadcast(counts.where(F.col("n") > most))
    return df.join(many, keys).unionByName(df.join(hot, keys, "left_anti").join(counts.where(F.col("n") <= most).hint("merge"), keys, how))


#: Bits in one part of a native filter: what bitmap_construct_agg makes.
PART_BITS = 32_768


def join_filtered(df: DataFrame, counts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """As join_counted, for wide rows: only those are shuffled that a filter of FILTER_BITS bits lets pass. The filter saves
    work and decides nothing; it is broadcast, FILTER_BITS / 8 bytes whatever the table. DataFrame expressions only."""
    at = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS).cast("long"))
    part, place = F.call_function("div", at, F.lit(PART_BITS).cast("long")), at % PART_BITS
    bits = counts.select(part.alias("_part"), place.alias("_place")).groupBy("_part").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    bits = materialize(bits, "filter")
    byte = F.conv(F.hex(F.substring("_bits", (F.call_function("div", place, F.lit(8).cast("long")) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    marked = df.withColumn("_part", part).join(F.broadcast(bits), "_part", "left").withColumn("_passes", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop("_part", "_bits")
    joined = join_counted(marked.where("_passes"), counts, keys, how).drop("_passes", "n")
    return joined.unionByName(marked.where("NOT _passes").drop("_passes"), allowMissingColumns=True) if how == "left" else joined


def _bit(key: np.ndarray, n_bits: int) -> np.ndarray:
    """Where a long key's bit is in a filter; n_bits is a power of two."""
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - n_bits.bit_length() + 1)).astype(np.int64)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a filter lets pass: all that it was made of, and by chance some more."""
    at = _bit(keys, 8 * len(bits))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bit_filter(keys: DataFrame):
    """A filter of FILTER_BITS bits of a column of longs, broadcast. Tasks send what they have set of it, and the parts are
    united on the executors; so no size depends on the table."""
    (name,) = keys.columns
    size, step = FILTER_BITS // 8, 1 << 16

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            at = _bit(batch[name].to_numpy(np.int64), 8 * size)
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        parts = [bits[at : at + step] for at in range(0, size, step)]
        yield pd.DataFrame([(i, zlib.compress(x.tobytes(), 1)) for i, x in enumerate(parts) if x.any()], columns=["part", "bits"])

    def united(batch: pd.DataFrame) -> pd.DataFrame:
        out = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.uint8) for x in batch["bits"]])
        return pd.DataFrame({"part": [batch["part"].iloc[0]], "bits": [zlib.compress(out.tobytes(), 1)]})

    bits = np.zeros(size, np.uint8)
    for row in ship(keys).mapInPandas(places, "part int, bits binary").groupBy("part").applyInPandas(united, "part int, bits binary").collect():
        own = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
        bits[row["part"] * step : row["part"] * step + len(own)] = own
    return keys.sparkSession.sparkContext.broadcast(bits)


def passing(wanted, key: Column) -> Column:
    """Does the filter wanted, as bit_filter gives it, let key pass."""

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(passes(wanted.value, keys.to_numpy(np.int64)))

    return test(key)


def ship(df: DataFrame) -> DataFrame:
    """df, once its session's Python workers can import this subpackage wherever they run: a zip of it is added to the
    session's Python files once per application."""
    context = df.sparkSession.sparkContext
    if getattr(context, "_quartzframe_shipped", None) is None:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp()) / "quartzframe_llm.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in [package / "__init__.py", *sorted((package / "llm").glob("*.py"))]:
                out.write(path, path.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._quartzframe_shipped = True
    return df
