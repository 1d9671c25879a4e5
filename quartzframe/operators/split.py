"""Leakage-safe splits by keyed hash order: the same rows on any partitioning, run after run.

Every operator adds a ``split`` (train, val, test) or ``fold`` column; none moves or copies rows into new tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzframe.plans import tables

RATIOS = (0.7, 0.15, 0.15)


def check_ratios(ratios: tuple[float, float, float]) -> None:
    if abs(sum(ratios) - 1) > 1e-6 or min(ratios) < 0:
        raise ValueError(f"ratios must be at least 0 and sum to 1: {ratios}")


def _assign(rank: Column, n: Column, ratios) -> Column:
    """Ranks from 0 up to the rounded train share, then up to the rounded val share, then the rest."""
    train, val = F.bround(n * ratios[0]), F.bround(n * ratios[1])
    return F.when(rank < train, "train").when(rank < train + val, "val").otherwise("test")


def random_split(df: DataFrame, key: str, seed: int = 42, ratios=RATIOS, stratify: str | None = None) -> DataFrame:
    """Within each class of stratify (or over all), rows by hash of key up to the rounded shares."""
    check_ratios(ratios)
    group = [stratify] if stratify else []
    rows = df.withColumn("_hash", tables.hash_key(F.col(key), seed))
    ranked = tables.with_rank(rows, [F.col("_hash"), F.col(key)], "_rank", group)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")) if group else df.agg(F.count(F.lit(1)).alias("_n"))
    if group:
        joined = ranked.join(sizes.withColumnRenamed(stratify, "_class"), F.col(stratify).eqNullSafe(F.col("_class"))).drop("_class")
    else:
        joined = ranked.join(F.broadcast(sizes), F.lit(True))  # one row
    return joined.withColumn("split", _assign(F.col("_rank"), F.col("_n"), ratios)).drop("_hash", "_rank", "_n")


def can_stratify(df: DataFrame, target: str) -> bool:
    """A class needs two rows, and no row may lack it."""
    row = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.count_if(F.col(target).isNull())).first()
    return bool(row[0] and row[0] >= 2 and not row[1])


def group_split(df: DataFrame, group: str, seed: int = 42, ratios=RATIOS) -> DataFrame:
    """Whole groups by hash: shares are of groups, not rows; the held-out sides are rounded up. Needs three groups."""
    check_ratios(ratios)
    groups = df.select(group).distinct().withColumn("_hash", tables.hash_key(F.col(group), seed))
    n = groups.count()
    if n < 3:
        raise ValueError(f"a group split needs three groups or more, found {n}")
    held = min(n - 1, max(2, -int(-(ratios[1] + ratios[2]) * n // 1)))
    test = min(held - 1, max(1, -int(-round(ratios[2] / (ratios[1] + ratios[2]) * held, 9) // 1)))
    ranked = tables.with_rank(groups, [F.col("_hash"), F.col(group)], "_rank")
    side = F.when(F.col("_rank") < test, "test").when(F.col("_rank") < held, "val").otherwise("train")
    sides = ranked.select(F.col(group).alias("_group"), side.alias("split"))
    return df.join(sides, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def holdout(df: DataFrame, group: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Two sides by whole groups in hash order: val has the share of the groups, rounded up, and leaves one to train."""
    if not 0 < share < 1:
        raise ValueError(f"a holdout share lies between 0 and 1: {share}")
    groups = df.select(group).distinct().withColumn("_hash", tables.hash_key(F.col(group), seed))
    n = groups.count()
    if n < 2:
        raise ValueError(f"a grouped holdout needs two groups or more, found {n}")
    held = min(n - 1, max(1, -int(-round(share * n, 9) // 1)))
    # the hash at the cut is all that the rows need
    cut = groups.orderBy("_hash", group).limit(held).agg(F.max(F.struct("_hash", F.col(group).alias("g"))).alias("c")).first()["c"]
    own = F.struct(tables.hash_key(F.col(group), seed).alias("_hash"), F.col(group).alias("g"))
    return df.withColumn("split", F.when(own <= F.struct(F.lit(cut["_hash"]).alias("_hash"), F.lit(cut["g"]).alias("g")), "val").otherwise("train"))


def temporal_split(df: DataFrame, time: str, key: str, ratios=RATIOS) -> DataFrame:
    """Rows in order of time, nulls last, ties by key, cut at the rounded shares."""
    check_ratios(ratios)
    n = df.count()
    ranked = tables.with_rank(df, [F.col(time).asc_nulls_last(), F.col(key)], "_rank")
    return ranked.withColumn("split", _assign(F.col("_rank"), F.lit(n), ratios)).drop("_rank")


def split(df: DataFrame, key: str, target: str | None = None, group: str | None = None, time: str | None = None, seed: int = 42, ratios=RATIOS, stratify: bool | None = None) -> DataFrame:
    """Time before group before random. A named column that is missing is an error, not another method."""
    for c in (target, group, time):
        if c is not None and c not in df.columns:
            raise ValueError(f"no column {c}")
    if time:
        return temporal_split(df, time, key, ratios)
    if group:
        return group_split(df, group, seed, ratios)
    wanted = target is not None and stratify is not False and can_stratify(df, target)
    return random_split(df, key, seed, ratios, target if wanted else None)


def k_fold(df: DataFrame, key: str, k: int, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """fold 0..k-1: hash ranks modulo k, within classes if stratified."""
    if k < 2:
        raise ValueError("k must be 2 or more")
    rows = df.withColumn("_hash", tables.hash_key(F.col(key), seed))
    ranked = tables.with_rank(rows, [F.col("_hash"), F.col(key)], "_rank", [stratify] if stratify else [])
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_hash", "_rank")


def group_k_fold(df: DataFrame, group: str, k: int) -> DataFrame:
    """group, n, fold: groups by size, largest first (ties by name), each into the lightest fold (ties to the first).
    The fold over groups is one task over one row a group."""
    if k < 2:
        raise ValueError("k must be 2 or more")
    sizes = df.groupBy(F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), F.col("group"))))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), k).alias("load"), F.array().cast(f"array<struct<group:{df.schema[group].dataType.simpleString()},n:bigint,fold:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fold = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int")
        load = F.transform(acc["load"], lambda v, i: F.when(i == fold - 1, v - x["minus_n"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(acc["out"], F.array(F.struct(x["group"].alias("group"), (-x["minus_n"]).alias("n"), (fold - 1).alias("fold")))).alias("out"))

    folded = sizes.agg(F.aggregate(ordered, start, step)["out"].alias("out"))
    return folded.select(F.inline("out"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the first in hash order."""
    return df.withColumn("_hash", tables.hash_key(F.col(key), seed)).orderBy("_hash", key).limit(n).drop("_hash")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """split, class, n, share of the split."""
    counts = df.groupBy("split", F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split")))


def target_stats(df: DataFrame, target: str) -> DataFrame:
    """split, n_rows, mean, std, min, max of a numeric target; rows without one count as rows."""
    c = F.col(target).cast("double")
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))


def leakage(df: DataFrame, key: str, group: str | None = None, content: list[str] | None = None) -> DataFrame:
    """One row: keys and groups that lie in more than one split, contents that do, repeated rows."""
    sides = lambda c: df.groupBy(c).agg(F.count_distinct("split").alias("s"), F.count(F.lit(1)).alias("n"))
    out = sides(key).agg(F.count_if(F.col("s") > 1).alias("keys_in_several"))
    if group:
        out = out.join(sides(group).agg(F.count_if(F.col("s") > 1).alias("groups_in_several")), F.lit(True))
    if content:
        of = df.withColumn("_content", F.xxhash64(*content)).groupBy("_content").agg(F.count_distinct("split").alias("s"), F.count(F.lit(1)).alias("n"))
        out = out.join(of.agg(F.count_if(F.col("s") > 1).alias("contents_in_several"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_rows")), F.lit(True))
    return out


def straddling(df: DataFrame, group: str, side: str = "split") -> DataFrame:
    """Groups with rows on more than one side."""
    return df.groupBy(F.col(group).alias("group")).agg(F.count_distinct(side).alias("n_sides")).where("n_sides > 1")


def duplicates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """n_rows, n_distinct, n_duplicates; null and NaN are one value."""
    rows = same_missing(df.select(*(columns or df.columns)))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def drop_duplicates(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Of rows equal in columns, the one with the smallest key."""
    columns = columns or [c for c in df.columns if c != key]
    rows = same_missing(df)
    return rows.groupBy(*columns).agg(F.min(key).alias(key)).select(*df.columns)


def same_missing(df: DataFrame) -> DataFrame:
    """NaN becomes null in floating-point columns."""
    return df.select(*(F.nanvl(c, F.lit(None).cast(t)).alias(c) if t in ("float", "double") else F.col(c) for c, t in df.dtypes))


def with_provenance(df: DataFrame, group: str | None = None, acknowledged: bool = False) -> DataFrame:
    """df with how its split was made. A split by single items is refused unless its leakage is acknowledged."""
    if group is None and not acknowledged:
        raise ValueError("a split by single items may leak near-duplicates; name a group or acknowledge it")
    return df.withColumn("split_provenance", F.lit(f"grouped by {group}" if group else "per-image, acknowledged"))


def named_split(df: DataFrame, name: str) -> DataFrame:
    """The rows of one split; its name in any case."""
    rows = df.where(F.lower("split") == name.lower())
    if rows.isEmpty():
        raise ValueError(f"no split {name}")
    return rows
