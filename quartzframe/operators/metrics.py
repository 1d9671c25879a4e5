"""Metrics and error analysis of a prediction table: y_true, y_pred, y_score, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzframe.operators.drift import is_numeric
from quartzframe.plans import tables

LOWER_IS_BETTER = frozenset(("mae", "rmse", "mape"))
RESERVED = ("y_true", "y_pred", "y_score")
MIN_SLICE = 20
MAX_GROUPS = 12


def check_reserved(columns: list[str]) -> None:
    if clash := set(columns) & set(RESERVED):
        raise ValueError(f"features must not be named {sorted(clash)}")


def per_label(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, label, support, precision, recall, f1 over the labels of truth and prediction; 0 where undefined."""
    keys = keys or []
    sides = F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.lit(1).alias("is_true")), F.struct(F.col("y_pred").alias("label"), F.lit(0).alias("is_true"))))
    hit = (F.col("y_true") == F.col("y_pred")).cast("int")
    rows = df.select(*keys, hit.alias("hit"), sides.alias("s")).select(*keys, "hit", "s.*")
    counts = rows.groupBy(*keys, "label").agg(F.sum(F.col("hit") * F.col("is_true")).alias("tp"), F.sum("is_true").alias("support"), F.sum(1 - F.col("is_true")).alias("n_pred"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    counts = counts.withColumns({"precision": ratio(F.col("tp"), F.col("n_pred")), "recall": ratio(F.col("tp"), F.col("support"))})
    return counts.withColumn("f1", ratio(2.0 * F.col("tp"), F.col("support") + F.col("n_pred")))


def classification(df: DataFrame) -> DataFrame:
    """One row: n, accuracy, macro precision, recall and F1, F1 weighted by support."""
    return per_label(df).agg(
        F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
    )


def confusion(df: DataFrame) -> DataFrame:
    """y_true, y_pred, n for every pair of labels; labels are few, their grid is built from the distinct ones."""
    labels = df.select("y_true").union(df.select("y_pred")).distinct().toDF("label")
    grid = labels.select(F.col("label").alias("y_true"), F.lit(1).alias("g")).join(labels.select(F.col("label").alias("y_pred"), F.lit(1).alias("g")), "g").drop("g")
    counts = df.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["y_true", "y_pred"], "left").na.fill(0, ["n"])


def roc_auc(df: DataFrame) -> DataFrame:
    """auc, n_pos, n_neg for two labels, the greater one positive. Scores are counted, so ties share a middle rank, and
    counts are summed up by ranges; no row if there are not two labels."""
    bounds = df.agg(F.min("y_true").alias("low"), F.max("y_true").alias("high"), F.count_distinct("y_true").alias("labels"))
    counts = df.join(F.broadcast(bounds), F.lit(True)).where("labels = 2").groupBy("y_score").agg(F.count_if(F.col("y_true") == F.col("high")).alias("pos"), F.count_if(F.col("y_true") == F.col("low")).alias("neg"))
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = tables.materialize(counts.repartitionByRange(n, "y_score").withColumn("range_no", F.spark_partition_id()), "scores")
    sums = ranges.groupBy("range_no").agg(F.sum("neg").alias("range_neg"))
    offsets = sums.select("range_no", F.coalesce(F.sum("range_neg").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    below = F.sum("neg").over(Window.partitionBy("range_no").orderBy("y_score")) - F.col("neg")
    won = ranges.withColumn("below", below).join(F.broadcast(offsets), "range_no")
    out = won.agg(F.sum(F.col("pos") * (F.col("before") + F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.where("n_pos > 0 AND n_neg > 0").select((F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def regression(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """n, mae, rmse, r2, bias, mape (null if a truth is 0), residual_std, residual_max, residual_min."""
    y, e = F.col("y_true").cast("double"), F.col("y_pred").cast("double") - F.col("y_true").cast("double")
    spread = F.var_pop(y) * F.count(y)
    return df.groupBy(*(keys or [])).agg(
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(spread > 0, 1 - F.sum(e * e) / spread).alias("r2"), F.avg(e).alias("bias"),
        F.when(F.min(F.abs(y)) > 0, F.avg(F.abs(e / F.when(y != 0, y)))).alias("mape"), F.stddev_samp(e).alias("residual_std"), F.max(e).alias("residual_max"), F.min(e).alias("residual_min"),
    )


def slice_columns(df: DataFrame, most: int = 4) -> list[str]:
    """Up to four features to slice by: others before numeric, few values before many."""
    features = [c for c in df.columns if c not in RESERVED]
    if not features:
        return []
    n = df.agg(*(F.count_distinct(c).alias(f"c{i}") for i, c in enumerate(features))).first()
    found = [(is_numeric(df, c), n[i], c) for i, c in enumerate(features) if 1 < n[i] and (n[i] <= MAX_GROUPS or is_numeric(df, c))]
    return [c for *_, c in sorted(found, key=lambda t: t[:2])[:most]]


def with_groups(df: DataFrame, columns: list[str], kinds: dict[str, bool] | None = None) -> DataFrame:
    """Prediction columns, feature, group: each row once for each sliced feature. Numeric features with more than twelve
    values fall into quintiles q1..q5 (right-closed, repeated edges dropped), others into their twelve most frequent
    values and (other)."""
    kept = [c for c in RESERVED if c in df.columns]
    numbers = [c for c in columns if (kinds or {}).get(c, is_numeric(df, c) and df.agg(F.count_distinct(c)).first()[0] > MAX_GROUPS)]
    names = [c for c in columns if c not in numbers]
    parts = []
    if numbers:
        rows = df.select(*kept, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")) for c in numbers))).alias("x")).select(*kept, "x.*")
        edges = tables.quantiles(rows, "feature", "value", [0, 0.2, 0.4, 0.6, 0.8, 1.0]).groupBy("feature").agg(F.array_sort(F.collect_set("edge")).alias("edges"))
        inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
        group = F.when(F.col("value").isNull(), "nan").otherwise(F.concat(F.lit("q"), (F.size(F.filter(inner, lambda x: x < F.col("value"))) + 1).cast("string")))
        parts.append(rows.join(F.broadcast(edges), "feature").select(*kept, "feature", group.alias("group")))
    if names:
        rows = df.select(*kept, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in names))).alias("x")).select(*kept, "x.*")
        counts = rows.where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        top = counts.withColumn("r", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "value"))).where(F.col("r") <= MAX_GROUPS).select("feature", "value", F.col("value").alias("group"))
        parts.append(rows.join(F.broadcast(top), ["feature", "value"], "left").select(*kept, "feature", F.coalesce("group", F.lit("(other)")).alias("group")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def slices(df: DataFrame, columns: list[str], task: str, min_n: int = MIN_SLICE) -> DataFrame:
    """feature, group, n, metric (macro F1 or MAE) of every slice with at least min_n rows; one pass over all slices."""
    rows = with_groups(df, columns)
    keys = ["feature", "group"]
    if task == "classification":
        out = per_label(rows, keys).groupBy(*keys).agg(F.sum("support").alias("n"), F.avg("f1").alias("metric"))
    else:
        out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("metric"))
    return out.where(F.col("n") >= min_n)


def worst_slices(df: DataFrame, columns: list[str], task: str, min_n: int = MIN_SLICE, most: int = 8) -> DataFrame:
    order = F.asc("metric") if task == "classification" else F.desc("metric")
    return slices(df, columns, task, min_n).orderBy(order, "feature", "group").limit(most)


def compare(baseline: DataFrame, tuned: DataFrame) -> DataFrame:
    """One row for each (primary, eval_on) of both: values, delta in the better direction, verdict."""
    b, t = baseline.select("primary", "eval_on", F.col("value").alias("baseline")), tuned.select("primary", "eval_on", F.col("value").alias("tuned"))
    delta = F.when(F.col("primary").isin(*LOWER_IS_BETTER), F.col("baseline") - F.col("tuned")).otherwise(F.col("tuned") - F.col("baseline"))
    return b.join(t, ["primary", "eval_on"]).withColumn("gain", delta).withColumn("verdict", verdict_of_gain(F.col("gain")))


def verdict_of_gain(gain: Column) -> Column:
    return F.when(gain.isNull() | F.isnan(gain), "not comparable").when(gain > 0, "beats baseline").otherwise("does not beat baseline")


def number_to_beat(spark: SparkSession, task: str, recorded: DataFrame | None = None, predictions: DataFrame | None = None, override: str | None = None) -> DataFrame:
    """primary, value, lower_is_better, eval_on: what a later model is held against. An override ("f1_macro=0.8") wins,
    then what a baseline has recorded (one such row), then its predictions, measured for this task; no row without any."""
    columns = "primary string, value double, lower_is_better boolean, eval_on string"
    if override:
        name, _, value = override.partition("=")
        return spark.createDataFrame([(name.strip(), float(value.replace(",", "")), name.strip() in LOWER_IS_BETTER, None)], columns)
    if recorded is not None and not recorded.isEmpty():
        has = {f.name for f in recorded.schema.fields}
        return recorded.select("primary", F.col("value").cast("double").alias("value"), "lower_is_better", (F.col("eval_on") if "eval_on" in has else F.lit(None).cast("string")).alias("eval_on"))
    if predictions is not None:
        name, made = ("f1_macro", classification(predictions)) if task == "classification" else ("mae", regression(predictions))
        return made.select(F.lit(name).alias("primary"), F.col(name).cast("double").alias("value"), F.lit(name in LOWER_IS_BETTER).alias("lower_is_better"), F.lit(None).cast("string").alias("eval_on"))
    return spark.createDataFrame([], columns)
