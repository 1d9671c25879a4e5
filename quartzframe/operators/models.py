"""Baselines and tuned models on pyspark.ml."""

from __future__ import annotations

import math
import random

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzframe.operators import metrics, profile
from quartzframe.plans import tables

MAX_CATEGORIES = 20
FAMILIES = ("gbt", "rf", "linear")


def preprocessor(df: DataFrame, target: str, features: list[str] | None = None) -> list:
    """Medians for missing numbers and standard scale; the most frequent value for missing others and one column a
    value, where values beyond the twenty most frequent, and unseen ones, share one."""
    names = [c for c in (features or df.columns) if c != target]
    metrics.check_reserved(names)
    numbers, others = profile.numeric_columns(df.select(*names))
    stages, parts = [], []
    if numbers:
        filled = [f"{c}__filled" for c in numbers]
        stages += [Imputer(strategy="median", inputCols=numbers, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="numbers__raw", handleInvalid="keep"), StandardScaler(inputCol="numbers__raw", outputCol="numbers__scaled", withMean=True)]
        parts.append("numbers__scaled")
    if others:
        stages += [StringIndexer(inputCols=others, outputCols=[f"{c}__index" for c in others], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__index" for c in others], outputCols=[f"{c}__hot" for c in others], handleInvalid="keep", dropLast=False)]
        parts += [f"{c}__hot" for c in others]
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")]


def prepared(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Numbers as doubles with NaN for missing, others as text with rare values as one; rows without a target leave."""
    numbers, others = profile.numeric_columns(df.select(*features))
    out = df.where(F.col(target).isNotNull()).select("*", *(F.col(c).cast("double").alias(f"{c}__n") for c in numbers)).drop(*numbers).withColumnsRenamed({f"{c}__n": c for c in numbers})
    if others:
        cells = out.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in others))).alias("x")).select("x.*").where("v IS NOT NULL")
        top = cells.groupBy("c", "v").count().withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("count"), "v"))).where(F.col("r") <= MAX_CATEGORIES)
        kept: dict[str, list[str]] = {c: [] for c in others}
        for r in top.orderBy("c", "r").collect():  # at most twenty for each column
            kept[r["c"]].append(r["v"])
        out = out.withColumns({c: F.when(F.col(c).isNull(), kept[c][0] if kept[c] else "").when(F.col(c).cast("string").isin(kept[c]), F.col(c).cast("string")).otherwise("(rare)") for c in others})
    return out


def dummy(train: DataFrame, dev: DataFrame, target: str, task: str, key: str | None = None, strategy: str = "prior", seed: int = 42) -> DataFrame:
    """dev with y_true and y_pred: the most frequent class (ties to the least), classes drawn by hash in train's shares
    (strategy stratified), the mean, or the median."""
    y = F.col(target)
    if task == "regression":
        level = train.agg((F.percentile(y, 0.5) if strategy == "median" else F.avg(y)).alias("y_pred"))
        return dev.join(F.broadcast(level), F.lit(True)).withColumn("y_true", y)
    counts = train.where(y.isNotNull()).groupBy(y.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    if strategy != "stratified":
        top = counts.orderBy(F.desc("n"), "label").limit(1).select(F.col("label").alias("y_pred"))
        return dev.join(F.broadcast(top), F.lit(True)).withColumn("y_true", y)
    classes = counts.agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("classes"), F.sum("n").alias("total"))
    draw = F.conv(F.substring(tables.hash_key(F.col(key), seed), 1, 8), 16, 10).cast("double") / 4294967296.0 * F.col("total")
    start = F.struct(F.lit(0).cast("double").alias("upto"), F.lit(None).cast(train.schema[target].dataType).alias("label"))
    step = lambda acc, x: F.struct((acc["upto"] + x["n"]).alias("upto"), F.when(acc["label"].isNull() & (F.col("_draw") < acc["upto"] + x["n"]), x["label"]).otherwise(acc["label"]).alias("label"))
    joined = dev.join(F.broadcast(classes), F.lit(True)).withColumn("_draw", draw)
    return joined.withColumns({"y_pred": F.aggregate("classes", start, step)["label"], "y_true": y}).drop("classes", "total", "_draw")


#: Names of models that are trained elsewhere.
ELSEWHERE = ("nn", "neural", "mlp", "cnn", "rnn", "lstm", "transformer", "torch", "keras", "tensorflow", "rl", "dqn", "ppo")


def require_tabular(name: str) -> str:
    """name, unless something in it says that the model is no tabular one."""
    if found := [p for p in ELSEWHERE if p in name.lower()]:
        raise ValueError(f"{name} ({found[0]}) is not trained here; tabular families are {', '.join(FAMILIES)}")
    return name


def estimator(family: str, task: str, n_classes: int = 2, seed: int = 42) -> tuple[Estimator, str]:
    """An estimator and the family that it is: boosting of more than two classes falls back to a forest; families of
    other libraries fall back to boosting."""
    if task == "regression":
        made = {"gbt": lambda: GBTRegressor(seed=seed, maxIter=30), "rf": lambda: RandomForestRegressor(seed=seed), "linear": lambda: LinearRegression(regParam=0.0)}
    else:
        made = {"gbt": lambda: GBTClassifier(seed=seed, maxIter=30), "rf": lambda: RandomForestClassifier(seed=seed), "linear": lambda: LogisticRegression(maxIter=1000)}
    real = family if family in FAMILIES else "gbt"
    if real == "gbt" and task == "classification" and n_classes > 2:
        real = "rf"
    return made[real]().setLabelCol("label").setFeaturesCol("features"), real


def search_space(family: str, task: str, n_rows: int, n_iter: int, seed: int = 42) -> list[dict]:
    """n_iter settings drawn by seed: rates and penalties on a log scale, whole numbers evenly."""
    draw = random.Random(seed)
    log = lambda a, b: math.exp(draw.uniform(math.log(a), math.log(b)))
    leaf = max(20, min(200, n_rows // 20))
    make = {
        "gbt": lambda: {"stepSize": log(0.01, 0.3), "maxDepth": draw.randint(2, 6), "minInstancesPerNode": draw.randint(1, leaf)},
        "rf": lambda: {"numTrees": draw.randint(20, 100), "maxDepth": draw.randint(3, 10), "minInstancesPerNode": draw.randint(1, leaf)},
        "linear": lambda: {"regParam": log(1e-4, 10.0), "elasticNetParam": draw.choice([0.0, 0.5, 1.0])},
    }[family]
    return [make() for _ in range(n_iter)]


class MacroF1(Evaluator):
    """Mean F1 over labels, which the built-in evaluator lacks."""

    def _evaluate(self, dataset: DataFrame) -> float:
        rows = dataset.select(F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
        return float(metrics.classification(rows).first()["f1_macro"] or 0.0)

    def isLargerBetter(self) -> bool:  # noqa: N802
        return True


class MeanAbsoluteError(Evaluator):
    def _evaluate(self, dataset: DataFrame) -> float:
        return float(dataset.agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0] or 0.0)

    def isLargerBetter(self) -> bool:  # noqa: N802
        return False


def indexed(df: DataFrame, target: str, task: str) -> tuple[DataFrame, list]:
    """df with label: the target, or its place among the sorted classes; and the classes (a target's, so few)."""
    if task == "regression":
        return df.withColumn("label", F.col(target).cast("double")), []
    classes = [r[0] for r in df.select(target).distinct().orderBy(target).collect()]
    place = F.array_position(F.array(*map(F.lit, classes)), F.col(target)) - 1
    return df.withColumn("label", place.cast("double")), classes


def fit_predict(train: DataFrame, dev: DataFrame, target: str, task: str, features: list[str], family: str = "linear", seed: int = 42) -> DataFrame:
    """dev with y_true, y_pred and, for two classes, y_score. Fitted on train only."""
    rows, classes = indexed(prepared(train, target, features), target, task)
    model_of, _ = estimator(family, task, len(classes), seed)
    model = Pipeline(stages=[*preprocessor(rows, target, features), model_of]).fit(rows)
    return predictions(model, prepared(dev, target, features), target, task, classes)


def predictions(model, dev: DataFrame, target: str, task: str, classes: list) -> DataFrame:
    out = model.transform(dev)
    if task == "regression":
        made = out.withColumn("y_pred", F.col("prediction"))
    else:
        made = out.withColumn("y_pred", F.element_at(F.array(*map(F.lit, classes)), F.col("prediction").cast("int") + 1))
        if len(classes) == 2:
            made = made.withColumn("y_score", vector_to_array("probability")[1])
    kept = [c for c in ("y_pred", "y_score") if c in made.columns]
    return made.select(F.col(target).alias("y_true"), *kept, *[c for c in dev.columns if c != target])


def tune(train: DataFrame, target: str, task: str, features: list[str], key: str, family: str = "gbt", n_iter: int = 40, k: int = 5, seed: int = 42, parallelism: int = 4):
    """Random search with folds by hash of key over the whole pipeline. Returns the best model, its classes and a table
    of settings with their scores; the best score is optimistic."""
    from quartzframe.operators.split import k_fold

    rows, classes = indexed(prepared(train, target, features), target, task)
    rows = tables.materialize(k_fold(rows, key, k, seed, "label" if task == "classification" else None), "folds")
    model_of, real = estimator(family, task, len(classes), seed)
    settings = search_space(real, task, rows.count(), n_iter, seed)
    maps = [{model_of.getParam(name): v for name, v in s.items()} for s in settings]
    search = CrossValidator(estimator=Pipeline(stages=[*preprocessor(rows, target, features), model_of]), estimatorParamMaps=maps, evaluator=MacroF1() if task == "classification" else MeanAbsoluteError(), numFolds=k, foldCol="fold", parallelism=parallelism)
    fitted = search.fit(rows)
    scores = train.sparkSession.createDataFrame([(i, {n: str(v) for n, v in s.items()}, float(m)) for i, (s, m) in enumerate(zip(settings, fitted.avgMetrics, strict=True))], "setting int, params map<string,string>, score double")
    return fitted.bestModel, classes, scores

