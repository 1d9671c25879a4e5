"""Sceptical statistical tests with effect sizes, verdicts and stability over random parts.

Statistics are grouped moments and plain joins. Only finished moments reach the driver, where p-values come from the
distributions of the JVM's math library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzframe.plans import tables

#: Effects from which a finding is small and medium.
FLOORS = {"pearson": (0.1, 0.3), "two_group": (0.2, 0.5), "anova": (0.01, 0.06), "chi2": (0.1, 0.3)}
MIN_N = 30
TINY = 20


def clean_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, y of the rows that have both."""
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y"))
    for c, t in rows.dtypes:
        if t in ("float", "double"):
            rows = rows.withColumn(c, F.nanvl(c, F.lit(None).cast(t)))
    return rows.na.drop()


def pearson(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """n, r (null if x or y does not vary)."""
    rows = clean_pair(df, x, y) if not keys else df
    a, b = F.col("x").cast("double"), F.col("y").cast("double")
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return rows.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"), r.alias("r"))


def moments(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    y = F.col("y").cast("double")
    return df.groupBy(*(keys or []), "x").agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.var_samp(y).alias("var"))


def two_group(df: DataFrame, x: str, y: str) -> DataFrame:
    """level_a < level_b, sizes and means, Welch t with its degrees of freedom, Cohen's d; no row unless there are two levels."""
    m = moments(clean_pair(df, x, y))
    a, b = F.min_by, F.max_by
    both = m.agg(F.count(F.lit(1)).alias("levels"), F.min("x").alias("level_a"), F.max("x").alias("level_b"), *(f(c, "x").alias(f"{c}_{s}") for c in ("n", "mean", "var") for f, s in ((a, "a"), (b, "b"))))
    sa, sb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2))
    gap = F.col("mean_a") - F.col("mean_b")
    return both.where("levels = 2").select(
        "level_a", "level_b", "n_a", "n_b", "mean_a", "mean_b", F.when(sa + sb > 0, gap / F.sqrt(sa + sb)).alias("t"),
        F.when(sa + sb > 0, (sa + sb) * (sa + sb) / (sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1))).alias("df"), F.when(pooled > 0, gap / pooled).alias("cohens_d"),
    )


def mann_whitney(df: DataFrame, x: str, y: str) -> DataFrame:
    """u of the lesser level, n_a, n_b, ties (sum of t^3 - t): values are counted, then ranked by ranges."""
    rows = clean_pair(df, x, y)
    bounds = rows.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count_distinct("x").alias("levels"))
    counts = rows.join(F.broadcast(bounds), F.lit(True)).where("levels = 2").groupBy("y").agg(F.count_if(F.col("x") == F.col("low")).alias("a"), F.count_if(F.col("x") == F.col("high")).alias("b"))
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = tables.materialize(counts.repartitionByRange(n, "y").withColumn("range_no", F.spark_partition_id()), "values")
    offsets = ranges.groupBy("range_no").agg(F.sum("b").alias("m")).select("range_no", F.coalesce(F.sum("m").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    below = F.sum("b").over(Window.partitionBy("range_no").orderBy("y")) - F.col("b")
    joined = ranges.withColumn("below", below).join(F.broadcast(offsets), "range_no")
    t = F.col("a") + F.col("b")
    return joined.agg(F.sum(F.col("a") * (F.col("before") + F.col("below") + F.col("b") / 2)).alias("u"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum((t * t * t - t).cast("double")).alias("ties")).where("n_a IS NOT NULL")


def anova(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """k, n, f, eta_squared. Groups of one row leave F and the sum between, but not the grand mean, the total and n."""
    keys = keys or []
    rows = clean_pair(df, x, y) if not keys else df
    m = moments(rows, keys)
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    m = m.withColumns({"grand": grand, "used": F.col("n") >= 2})
    used = lambda c: F.sum(F.when(F.col("used"), c))
    own = m.withColumn("own_mean", F.sum(F.when(F.col("used"), F.col("n") * F.col("mean"))).over(w) / F.sum(F.when(F.col("used"), F.col("n"))).over(w))
    out = own.groupBy(*keys).agg(
        F.count_if("used").alias("k"), F.sum("n").alias("n"), used(F.col("n")).alias("n_used"), used(F.col("n") * (F.col("mean") - F.col("own_mean")) ** 2).alias("between_f"),
        used(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("between"), used((F.col("n") - 1) * F.col("var")).alias("within"),
        (F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2) + F.sum(F.coalesce((F.col("n") - 1) * F.col("var"), F.lit(0.0)))).alias("total"),
    )
    f = F.try_divide(F.col("between_f") / (F.col("k") - 1), F.try_divide(F.col("within"), F.col("n_used") - F.col("k")))
    return out.where("k >= 2").select(*keys, "k", "n", "n_used", F.when(F.col("within") > 0, f).alias("f"), F.when(F.col("total") > 0, F.col("between") / F.col("total")).alias("eta_squared"))


def chi2(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, n_x, n_y (levels), dof, chi2 (with Yates' correction on two by two), cramers_v."""
    rows = clean_pair(df, x, y)
    cells = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("o"))
    xs, ys = cells.groupBy("x").agg(F.sum("o").alias("rx")), cells.groupBy("y").agg(F.sum("o").alias("ry"))
    grid = xs.withColumn("g", F.lit(1)).join(ys.withColumn("g", F.lit(1)), "g").drop("g").join(cells, ["x", "y"], "left").na.fill(0, ["o"])
    size = cells.agg(F.sum("o").alias("n"), F.count_distinct("x").alias("n_x"), F.count_distinct("y").alias("n_y"))
    grid = grid.join(F.broadcast(size), F.lit(True))
    e = F.col("rx") * F.col("ry") / F.col("n")
    gap = F.abs(F.col("o") - e)
    corrected = F.when((F.col("n_x") == 2) & (F.col("n_y") == 2), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = grid.groupBy("n", "n_x", "n_y").agg(F.sum(corrected * corrected / e).alias("chi2")).where("n_x >= 2 AND n_y >= 2")
    least = F.least("n_x", "n_y") - 1
    return out.select("n", "n_x", "n_y", ((F.col("n_x") - 1) * (F.col("n_y") - 1)).alias("dof"), "chi2", F.sqrt(F.col("chi2") / (F.col("n") * least)).alias("cramers_v"))


def verdict(p: Column, effect: Column, n: Column, small: float, medium: float, alpha: float = 0.05, min_n: int = MIN_N) -> Column:
    size = F.abs(F.coalesce(F.nanvl(effect, F.lit(0.0)), F.lit(0.0)))
    return F.when(p.isNull() | F.isnan(p) | (p >= alpha) | (size < small), "refuted").when((size >= medium) & (n >= min_n), "confirmed").otherwise("weak")


def parts(df: DataFrame, x: str, y: str, key: str, n: int = 5, seed: int = 0) -> DataFrame:
    """x, y, part: random parts of equal size, larger ones first, as ranks in hash order."""
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(key).alias("key")).na.drop(subset=["x", "y"])
    total = rows.count()
    if total < 2 * n:
        raise ValueError(f"not enough rows ({total}) for {n} parts")
    ranked = tables.with_rank(rows.withColumn("h", tables.hash_key(F.col("key"), seed)), [F.col("h"), F.col("key")], "r")
    small, larger = divmod(total, n)
    edge = larger * (small + 1)
    return ranked.select("x", "y", F.when(F.col("r") < edge, F.floor(F.col("r") / (small + 1))).otherwise(larger + F.floor((F.col("r") - edge) / max(1, small))).cast("int").alias("part"))


def stability(values: DataFrame) -> DataFrame:
    """values: one value a part. n_used, mean, variance, sign_flips, stable (no flip and spread below half the level)."""
    v = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    out = v.agg(F.count(F.lit(1)).alias("n_used"), F.avg("value").alias("mean"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"), (F.count_if(F.col("value") > 0) * F.count_if(F.col("value") < 0) > 0).alias("sign_flips"))
    return out.withColumn("stable", ~F.col("sign_flips") & (F.col("mean") != 0) & (F.sqrt("variance") < 0.5 * F.abs("mean")))


def largest_stratum(df: DataFrame, by: str) -> DataFrame:
    """The rows of the most frequent value of by, ties to the smallest value."""
    top = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), by).limit(1).select(F.col(by).alias("_by"))
    return df.join(F.broadcast(top), F.col(by) == F.col("_by"), "left_semi")


def _distribution(spark: SparkSession, name: str, *parameters: float):
    # without a generator: nothing is drawn
    return getattr(spark._jvm.org.apache.commons.math3.distribution, name)(*(float(p) for p in parameters))


def p_value(spark: SparkSession, test: str, row) -> float | None:
    """Two-sided p-value of a row of pearson, two_group (Welch), mann_whitney (normal), anova or chi2."""
    if row is None:
        return None
    if test == "pearson":
        n, r = row["n"], row["r"]
        if n < 3 or r is None:
            return None
        if abs(r) >= 1:
            return 0.0
        t = abs(r) * ((n - 2) / (1 - r * r)) ** 0.5
        return 2 * _distribution(spark, "TDistribution", n - 2).cumulativeProbability(float(-t))
    if test == "two_group":
        return None if row["t"] is None or row["df"] is None else 2 * _distribution(spark, "TDistribution", row["df"]).cumulativeProbability(float(-abs(row["t"])))
    if test == "mann_whitney":
        a, b = row["n_a"], row["n_b"]
        n = a + b
        spread = (a * b / 12 * (n + 1 - row["ties"] / (n * (n - 1)))) ** 0.5 if n > 1 else 0
        if not spread:
            return 1.0
        z = max(0.0, abs(row["u"] - a * b / 2) - 0.5) / spread
        return min(1.0, 2 * _distribution(spark, "NormalDistribution", 0, 1).cumulativeProbability(float(-z)))
    if test == "anova":
        return None if row["f"] is None else 1 - _distribution(spark, "FDistribution", row["k"] - 1, row["n_used"] - row["k"]).cumulativeProbability(float(row["f"]))
    if test == "chi2":
        return 1 - _distribution(spark, "ChiSquaredDistribution", row["dof"]).cumulativeProbability(float(row["chi2"]))
    raise ValueError(test)


def run(df: DataFrame, test: str, x: str, y: str, alpha: float = 0.05, family_size: int = 1) -> DataFrame:
    """One row: test, method, n, statistic, p_value, effect, verdict. alpha is divided by the size of the family."""
    spark = df.sparkSession
    method = test
    if test == "two_group":
        row = two_group(df, x, y).first()
        effect, n = ("cohens_d", row["n_a"] + row["n_b"]) if row else (None, 0)
        if row and min(row["n_a"], row["n_b"]) < TINY:
            method = "mann_whitney"
    else:
        row = {"pearson": pearson, "anova": anova, "chi2": chi2}[test](df, x, y).first()
        effect, n = {"pearson": "r", "anova": "eta_squared", "chi2": "cramers_v"}[test], row["n"] if row else 0
    other = mann_whitney(df, x, y).first() if method == "mann_whitney" else row
    p = p_value(spark, method, other)
    statistic = other and other[{"pearson": "r", "two_group": "t", "mann_whitney": "u", "anova": "f", "chi2": "chi2"}[method]]
    small, medium = FLOORS[test]
    values = [(test, method, int(n), float(statistic) if statistic is not None else None, p, float(row[effect]) if row and row[effect] is not None else None)]
    out = spark.createDataFrame(values, "test string, method string, n long, statistic double, p_value double, effect double")
    enough = F.lit(row is not None and n >= 3)
    return out.withColumn("verdict", F.when(~enough, "inconclusive").otherwise(verdict(F.col("p_value"), F.col("effect"), F.col("n"), small, medium, alpha / family_size)))
