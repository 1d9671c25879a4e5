"""Population drift between a reference and a current snapshot: PSI, total variation, unseen share, Kolmogorov-Smirnov.

Features become rows: both sides are melted once, and all features share one edge aggregate, one count and one final
aggregate. Missing is null or NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartzframe.plans import tables

BINS = 10
MAX_CATEGORIES = 20
MINOR, MAJOR = 0.1, 0.25
OTHER, UNSEEN, MISSING = "other", "unseen", "missing"


def numeric_value(df: DataFrame, column: str) -> Column:
    """As double, missing as null. Times count as seconds, booleans as 0 and 1."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        c = F.unix_timestamp(c.cast("timestamp"))
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType))


def _melt(ref: DataFrame, cur: DataFrame, columns: list[str], value, name: str) -> DataFrame:
    one = lambda df, side: df.select(F.lit(side).alias("side"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), value(df, c).alias(name)) for c in columns))).alias("x")).select("side", "x.*")
    return one(ref, "ref").unionByName(one(cur, "cur"))


def psi(counts: DataFrame, keys: list[str], e: str = "e", a: str = "a") -> DataFrame:
    """Population stability index over rows of (keys, bin), with half a count added to each bin."""
    w = Window.partitionBy(*keys)
    share = lambda c: (F.col(c) + 0.5) / (F.sum(c).over(w) + 0.5 * F.count(F.lit(1)).over(w))
    shares = counts.withColumns({"_e": share(e), "_a": share(a)})
    return shares.groupBy(*keys).agg(F.sum((F.col("_a") - F.col("_e")) * F.log(F.col("_a") / F.col("_e"))).alias("psi"), F.count(F.lit(1)).alias("n_bins"))


def band(value: Column, minor: float = MINOR, major: float = MAJOR) -> Column:
    return F.when(value < minor, "none").when(value < major, "moderate").otherwise("major")


def numeric_drift(ref: DataFrame, cur: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """feature, psi, n_bins. Edges are frozen on the reference, outer ones open, bins right-closed, missing a bin of its
    own; a feature with fewer than two values or three distinct edges has no row."""
    melted = _melt(ref, cur, columns, numeric_value, "value")
    edges = tables.quantiles(melted.where("side = 'ref'"), "feature", "value", [i / bins for i in range(bins + 1)])
    edges = edges.groupBy("feature").agg(F.array_sort(F.collect_set("edge")).alias("edges")).where(F.size("edges") >= 3)
    edges = edges.withColumn("inner_edges", F.slice("edges", 2, F.size("edges") - 2))
    binned = melted.join(F.broadcast(edges), "feature")  # one row for a feature
    place = F.when(F.col("value").isNull(), -1).otherwise(F.size(F.filter("inner_edges", lambda x: x < F.col("value"))))
    counts = binned.groupBy("feature", place.alias("bin")).agg(F.count_if(F.col("side") == "ref").alias("e"), F.count_if(F.col("side") == "cur").alias("a"))
    grid = edges.select("feature", F.explode(F.sequence(F.lit(-1), F.size("inner_edges"))).alias("bin"))
    full = grid.join(counts, ["feature", "bin"], "left").na.fill(0, ["e", "a"])
    return psi(full, ["feature"])


def category(df: DataFrame, column: str) -> Column:
    """As text. Whole numbers lose their fraction, so 1 and 1.0 are one category."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        return F.when(d == F.floor(d), F.floor(d).cast("string")).otherwise(d.cast("string"))
    return c.cast("string")


def categorical_drift(ref: DataFrame, cur: DataFrame, columns: list[str], max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """feature, psi, n_bins, tvd, unseen_share. The reference's most frequent categories, ties by value, have bins of
    their own; its others, and categories that only the current side has, share one bin each. Missing is a category."""
    melted = _melt(ref, cur, columns, category, "value")
    counts = melted.groupBy("feature", "value").agg(F.count_if(F.col("side") == "ref").alias("e"), F.count_if(F.col("side") == "cur").alias("a"))
    seen = F.col("e") > 0
    order = F.row_number().over(Window.partitionBy("feature").orderBy(F.col("e").desc(), F.col("value").asc_nulls_first()))
    ranked = counts.withColumn("n", F.when(seen, order)).withColumn("kind", F.when(~seen, UNSEEN).when(F.col("n") > max_categories, OTHER).when(F.col("value").isNull(), MISSING).otherwise("value"))
    bins = ranked.groupBy("feature", "kind", F.when(F.col("kind") == "value", F.col("value")).alias("bin")).agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    fixed = counts.select("feature").distinct().select("feature", F.explode(F.array(F.lit(OTHER), F.lit(UNSEEN))).alias("kind")).select("feature", "kind", F.lit(None).cast("string").alias("bin"), F.lit(0).alias("e"), F.lit(0).alias("a"))
    bins = bins.unionByName(fixed).groupBy("feature", "kind", "bin").agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    w = Window.partitionBy("feature")
    gap = bins.select("feature", "kind", "a", F.abs(F.try_divide(F.col("a"), F.sum("a").over(w)) - F.try_divide(F.col("e"), F.sum("e").over(w))).alias("gap"))
    tvd = gap.groupBy("feature").agg((0.5 * F.sum("gap")).alias("tvd"), F.try_divide(F.sum(F.when(F.col("kind") == UNSEEN, F.col("a")).otherwise(0)), F.sum("a")).alias("unseen_share"))
    return psi(bins, ["feature"]).join(tvd, "feature")


def ks(ref: DataFrame, cur: DataFrame, columns: list[str]) -> DataFrame:
    """feature, ks_d, ks_p, n_ref, n_cur: the largest gap between the two distribution functions. Values are counted first."""
    melted = _melt(ref, cur, columns, numeric_value, "value").where("value IS NOT NULL")
    counts = melted.groupBy("feature", "value").agg(F.count_if(F.col("side") == "ref").alias("e"), F.count_if(F.col("side") == "cur").alias("a"))
    n = max(1, int(ref.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = tables.materialize(counts.repartitionByRange(n, "feature", "value").withColumn("range_no", F.spark_partition_id()), "ks")
    sums = ranges.groupBy("feature", "range_no").agg(F.sum("e").alias("se"), F.sum("a").alias("sa"))
    before, whole = Window.partitionBy("feature").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("feature")
    offsets = sums.select("feature", "range_no", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in ("se", "sa")), *(F.sum(c).over(whole).alias(f"all_{c}") for c in ("se", "sa")))
    local = Window.partitionBy("range_no", "feature").orderBy("value")
    running = ranges.withColumns({"re": F.sum("e").over(local), "ra": F.sum("a").over(local)}).join(offsets, ["feature", "range_no"])
    gap = F.abs((F.col("before_se") + F.col("re")) / F.col("all_se") - (F.col("before_sa") + F.col("ra")) / F.col("all_sa"))
    found = running.groupBy("feature").agg(F.max(gap).alias("ks_d"), F.max("all_se").alias("n_ref"), F.max("all_sa").alias("n_cur")).where("n_ref > 0 AND n_cur > 0")
    return found.withColumn("ks_p", ks_p(F.col("ks_d"), F.col("n_ref"), F.col("n_cur")))


def ks_p(d: Column, n: Column, m: Column) -> Column:
    """The probability of so large a gap by chance: Kolmogorov's limit with Stephens' correction for finite samples."""
    root = F.sqrt(n * m / (n + m))
    scaled = d * (root + 0.12 + 0.11 / root)
    term = lambda j: F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * scaled * scaled)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, j: acc + term(j))
    return F.when(scaled < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * total)))


def column_kinds(ref: DataFrame, columns: list[str]) -> dict[str, str]:
    """categorical if not numeric, or with at most five distinct values in the reference; one pass over all columns."""
    numeric = [c for c in columns if is_numeric(ref, c)]
    distinct = ref.agg(*(F.count_distinct(numeric_value(ref, c)).alias(f"c{i}") for i, c in enumerate(numeric))).first() if numeric else []
    few = {c for c, n in zip(numeric, distinct, strict=True) if n <= 5}
    return {c: "numeric" if c in set(numeric) - few else "categorical" for c in columns}


def report(ref: DataFrame, cur: DataFrame, columns: list[str] | None = None, exclude: tuple[str, ...] = (), bins: int = BINS, max_categories: int = MAX_CATEGORIES, minor: float = MINOR, major: float = MAJOR) -> DataFrame:
    """One row for each shared feature: feature, type, psi, tvd, unseen_share, n_cur (not missing), low_n and band."""
    shared = [c for c in (columns or ref.columns) if c in ref.columns and c in cur.columns and c not in exclude]
    kinds = column_kinds(ref, shared)
    floor = max(200, 20 * bins)
    present = cur.agg(*(F.count(F.when(~F.isnan(F.col(c).cast("double")), 1) if isinstance(cur.schema[c].dataType, (T.FloatType, T.DoubleType)) else F.col(c)).alias(f"c{i}") for i, c in enumerate(shared)))
    sizes = present.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("n_cur")) for i, c in enumerate(shared)))).alias("x")).select("x.*")
    parts = []
    if numbers := [c for c in shared if kinds[c] == "numeric"]:
        parts.append(numeric_drift(ref, cur, numbers, bins).select("feature", F.lit("numeric").alias("type"), "psi", F.lit(None).cast("double").alias("tvd"), F.lit(None).cast("double").alias("unseen_share")))
    if names := [c for c in shared if kinds[c] == "categorical"]:
        parts.append(categorical_drift(ref, cur, names, max_categories).select("feature", F.lit("categorical").alias("type"), "psi", "tvd", "unseen_share"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.join(sizes, "feature").select("*", (F.col("n_cur") < floor).alias("low_n"), band(F.col("psi"), minor, major).alias("band"))


def summary(rows: DataFrame) -> DataFrame:
    """The frame-level row of a report: counts by band, the overall band, the feature that drifted most."""
    level = F.max(F.when(F.col("band") == "major", 2).when(F.col("band") == "moderate", 1).otherwise(0))
    top = F.max_by("feature", F.struct("psi", F.col("feature")))
    return rows.agg(
        F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("band") == "major").alias("n_major"), F.count_if(F.col("band") == "moderate").alias("n_moderate"),
        F.element_at(F.array(F.lit("stable"), F.lit("moderate shift"), F.lit("major shift")), level + 1).alias("overall"), top.alias("top_feature"), F.max("psi").alias("top_psi"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("low_n"), F.col("feature")))), ",").alias("low_n_features"),
    )


def frame_summary(ref: DataFrame, cur: DataFrame, target: str | None = None, prediction: str | None = None, **settings) -> DataFrame:
    """summary of the shared features without target and prediction, whose own drift stands in columns; features that
    have too few distinct values for a row; the target if a side lacks it; rows and columns of both sides."""
    shared = [c for c in ref.columns if c in cur.columns]
    special = [c for c in (target, prediction) if c in shared]
    rows = tables.materialize(report(ref, cur, shared, **settings), "drift-report")
    features = sorted(set(shared) - set(special))
    psi_of = lambda c, name: F.max(F.when(F.col("feature") == c, F.col("psi"))).alias(name) if c in special else F.lit(None).cast("double").alias(name)
    more = rows.agg(
        psi_of(target, "target_psi"), psi_of(prediction, "prediction_psi"),
        F.array_join(F.array_except(F.array(*map(F.lit, features)) if features else F.array().cast("array<string>"), F.collect_set("feature")), ",").alias("skipped_features"),
        F.lit(target if target and target not in shared else None).cast("string").alias("missing_target"),
    )
    sizes = [df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((ref, "n_ref"), (cur, "n_cur"))]
    only = [F.lit(",".join(c for c in a.columns if c not in b.columns)).alias(n) for a, b, n in ((ref, cur, "ref_only"), (cur, ref, "cur_only"))]
    out = summary(rows.where(~F.col("feature").isin(*special)) if special else rows)
    for one_row in (more, *sizes):
        out = out.join(one_row, F.lit(True))
    return out.select("*", *only)


def schema_diff(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """column, side: columns that only one side has, in its order."""
    rows = [(c, "reference only") for c in ref.columns if c not in cur.columns] + [(c, "current only") for c in cur.columns if c not in ref.columns]
    return ref.sparkSession.createDataFrame(rows, "column string, side string")
