"""The engine's operators as queries over the driver's tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzframe.functions import scalars
from quartzframe.operators import components, detection, drift, governance, images, ladder, metrics, models, profile, split, stats, submission
from quartzframe.streaming import drift_stream

Query = Callable[[SparkSession, str], DataFrame]
CUT = "timestamp_ntz '2024-01-21 00:00:00'"
_REGISTERED: dict[str, Query] = {}


def query(function: Query) -> Query:
    _REGISTERED[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_REGISTERED)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


# inputs that the tables stand in for


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    return e.where(f"ts < {CUT}"), e.where(f"ts >= {CUT}")


def line_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "l_shipdate")
    cut = "l_shipdate < timestamp_ntz '1996-01-01 00:00:00'"
    return li.where(cut).drop("l_shipdate"), li.where(f"NOT {cut}").drop("l_shipdate")


def clf_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.col("quality").alias("y_true"), (F.col("n_chars") > 1000).cast("int").alias("y_pred"), F.col("n_chars").cast("double").alias("y_score"), "lang", "source", "n_chars")


def reg_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    means = li.groupBy("l_quantity").agg(F.round(F.avg("l_extendedprice"), 4).alias("y_pred"))
    return li.join(means, "l_quantity").select(F.col("l_extendedprice").alias("y_true"), "y_pred", "l_returnflag", "l_linestatus", "l_discount", "l_quantity")


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    g = o.select(
        k.alias("gt_id"), F.concat(F.lit("im"), F.floor(k / 30).cast("string")).alias("image_id"), (k % 3).cast("int").alias("class_id"), (c % 80 * 10).cast("double").alias("x"), (k % 70 * 10).cast("double").alias("y"),
        (c % 40 + 10).cast("double").alias("w"), (k % 45 + 10).cast("double").alias("h"), F.lit(1000).alias("width"), F.lit(800).alias("height"),
    )
    score = F.conv(F.substring(F.md5(F.col("gt_id").cast("string")), 1, 6), 16, 10).cast("double") / 16777216.0
    p = g.where("gt_id % 7 <> 0").select(F.col("gt_id").alias("pred_id"), "image_id", "class_id", score.alias("score"), (F.col("x") + F.col("gt_id") % 5).alias("x"), (F.col("y") + F.col("gt_id") % 4).alias("y"), "w", "h")
    return g, p


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    second = (c % 4 + 1 + k % 3) % 4
    price = F.floor(F.col("o_totalprice")).cast("long")
    slot = lambda i, a, r: F.struct(F.lit(i).alias("slot"), F.concat(F.lit("agent"), a.cast("string")).alias("agent"), r.cast("double").alias("reward"))
    rows = o.select(k.alias("seq"), F.explode(F.array(slot(0, c % 4, price % 3), slot(1, second, price % 5 % 3))).alias("s"), F.when(k % 97 == 0, "TIMEOUT").otherwise("DONE").alias("status"))
    return rows.select("seq", F.concat(F.lit("m"), F.col("seq").cast("string")).alias("match_id"), "s.*", "status")


def submissions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    expected = o.select(k.alias("line"), F.concat(F.lit("o"), k.cast("string")).alias("id"), F.lit("0.5").alias("prediction"), F.lit("a").alias("note"))
    cell = F.when(k % 101 == 0, "nan").when(k % 103 == 0, "high").when(k % 107 == 0, "1_000").otherwise(F.round(F.col("o_totalprice"), 2).cast("string"))
    ident = F.when(k % 211 == 0, F.concat(F.lit("o"), (k - 1).cast("string"))).when(k % 223 == 0, F.concat(F.lit("z"), k.cast("string"))).otherwise(F.concat(F.lit("o"), k.cast("string")))
    return o.where("o_orderkey % 199 <> 0").select(k.alias("line"), ident.alias("id"), cell.alias("prediction"), F.lit("a").alias("note")), expected


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)


def grouped_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    items = d.select(F.col("doc_id").alias("item"), F.floor(F.col("doc_id") / 3).alias("base"))
    return items, d.select(F.md5("text").alias("cluster"), F.col("doc_id").alias("item"))


# drift


@query
def drift_numeric_psi(spark, d):
    ref, cur = snapshots(spark, d)
    return rounded(drift.numeric_drift(ref, cur, ["value"]).withColumn("band", drift.band(F.col("psi"))))


@query
def drift_categorical_psi_tvd(spark, d):
    ref, cur = snapshots(spark, d)
    return rounded(drift.categorical_drift(ref, cur, ["event_type", "user_id"]))


@query
def drift_all_features(spark, d):
    return rounded(drift.report(*line_halves(spark, d)))


@query
def drift_summary(spark, d):
    return rounded(drift.summary(drift.report(*line_halves(spark, d))))


@query
def drift_frame_summary(spark, d):
    return rounded(drift.frame_summary(*line_halves(spark, d), target="l_returnflag", prediction="l_linestatus"))


@query
def drift_ks_d(spark, d):
    return rounded(drift.ks(*snapshots(spark, d), ["value"]))


@query
def drift_windowed_psi(spark, d):
    ref, cur = snapshots(spark, d)
    edges, counts = drift_stream.frozen_edges(ref, "value")
    return rounded(drift_stream.windowed_psi(cur, "ts", "value", edges, counts))


@query
def drift_schema_diff(spark, d):
    return drift.schema_diff(table(spark, d, "events"), table(spark, d, "events").withColumnRenamed("props", "properties"))


# splits


@query
def split_random(spark, d):
    return split.random_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 42)


@query
def split_random_stratified(spark, d):
    return split.random_split(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", 42, stratify="quality")


@query
def split_group(spark, d):
    return split.group_split(table(spark, d, "events").select("event_id", "user_id"), "user_id", 42)


@query
def split_holdout(spark, d):
    return split.holdout(table(spark, d, "events").select("event_id", "user_id"), "user_id")


@query
def split_temporal(spark, d):
    return split.temporal_split(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").drop("o_orderdate")


@query
def split_leakage_check(spark, d):
    rows = split.random_split(table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id", 42)
    return split.leakage(rows, "doc_id", "source", ["text"])


@query
def split_class_balance(spark, d):
    return rounded(split.class_balance(split_random_stratified(spark, d), "quality"))


@query
def split_target_stats(spark, d):
    rows = split.random_split(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 42)
    return rounded(split.target_stats(rows, "o_totalprice"), 4)


@query
def k_fold_stratified(spark, d):
    return split.k_fold(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", 5, 7, "quality")


@query
def group_k_fold(spark, d):
    return split.group_k_fold(table(spark, d, "events"), "user_id", 4)


@query
def seeded_sample(spark, d):
    return split.sample(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 3)


@query
def duplicate_rows(spark, d):
    return split.duplicates(table(spark, d, "documents"), ["text"])


@query
def drop_duplicates(spark, d):
    return split.drop_duplicates(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.length("text").alias("n"))


@query
def straddling_groups(spark, d):
    rows = split.random_split(table(spark, d, "events").select("event_id", "user_id"), "event_id", 42)
    return split.straddling(rows, "user_id")


# profile


@query
def infer_task(spark, d):
    c, ev = table(spark, d, "customer"), table(spark, d, "events")
    parts = [profile.infer_task(t, n).withColumn("target", F.lit(n)) for t, n in ((c, "c_mktsegment"), (c, "c_acctbal"), (c, "c_nationkey"), (ev, "event_type"), (ev, "user_id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def fingerprint(spark, d):
    return rounded(profile.fingerprint(table(spark, d, "customer"), "c_mktsegment"))


@query
def modality_flags(spark, d):
    return rounded(profile.modality(table(spark, d, "documents").select("text", "lang", "source")))


@query
def model_recommendation(spark, d):
    return profile.recommend(profile.fingerprint(table(spark, d, "customer"), "c_mktsegment")).select("family", "alternatives", "prefer_native_categoricals", "veto")


# metrics


@query
def clf_metrics(spark, d):
    return rounded(metrics.classification(clf_predictions(spark, d)))


@query
def clf_per_label(spark, d):
    return rounded(metrics.per_label(clf_predictions(spark, d)))


@query
def confusion(spark, d):
    return metrics.confusion(clf_predictions(spark, d))


@query
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(clf_predictions(spark, d)))


@query
def regression_metrics(spark, d):
    return rounded(metrics.regression(reg_predictions(spark, d)), 4)


@query
def slice_errors_worst8(spark, d):
    return rounded(metrics.worst_slices(clf_predictions(spark, d), ["lang", "source", "n_chars"], "classification"))


@query
def slice_errors_regression(spark, d):
    return rounded(metrics.slices(reg_predictions(spark, d), ["l_returnflag", "l_quantity", "l_discount"], "regression"), 4)


@query
def dummy_baseline_metrics(spark, d):
    rows = split.random_split(table(spark, d, "labels"), "doc_id", 42, stratify="quality")
    made = models.dummy(rows.where("split = 'train'"), rows.where("split = 'val'"), "quality", "classification")
    return rounded(metrics.classification(made))


@query
def dummy_stratified(spark, d):
    rows = split.random_split(table(spark, d, "labels"), "doc_id", 42, stratify="quality")
    made = models.dummy(rows.where("split = 'train'"), rows.where("split = 'val'"), "quality", "classification", "doc_id", "stratified")
    return made.select("doc_id", "y_true", "y_pred")


@query
def dummy_regression(spark, d):
    rows = split.random_split(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 42)
    made = models.dummy(rows.where("split = 'train'"), rows.where("split = 'val'"), "o_totalprice", "regression", strategy="median")
    return rounded(metrics.regression(made).select("n", "mae", "bias"), 4)


@query
def metric_compare(spark, d):
    base = metrics.classification(clf_predictions(spark, d)).select(F.lit("f1_macro").alias("primary"), F.lit("val").alias("eval_on"), F.col("f1_macro").alias("value"))
    tuned = base.withColumn("value", F.col("value") + 0.05)
    return rounded(metrics.compare(base, tuned))


# statistics


@query
def stat_corr(spark, d):
    return rounded(stats.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query
def stat_welch(spark, d):
    return rounded(stats.two_group(table(spark, d, "lineitem"), "l_linestatus", "l_extendedprice"))


@query
def stat_mann_whitney(spark, d):
    return stats.mann_whitney(table(spark, d, "lineitem"), "l_linestatus", "l_quantity").select(F.col("u"), "n_a", "n_b", "ties")


@query
def stat_anova(spark, d):
    return rounded(stats.anova(table(spark, d, "orders"), "o_orderpriority", "o_totalprice").select("k", "n", "f", "eta_squared"))


@query
def stat_chi2(spark, d):
    return rounded(stats.chi2(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus"))


@query
def stat_chi2_yates(spark, d):
    return rounded(stats.chi2(table(spark, d, "labels"), "quality", "toxic"))


@query
def stat_stability(spark, d):
    rows = stats.parts(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey", 5, 0)
    return rounded(stats.stability(stats.pearson(rows, "x", "y", ["part"]).withColumnRenamed("r", "value")))


@query
def stat_parts_r(spark, d):
    rows = stats.parts(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey", 5, 0)
    return rounded(stats.pearson(rows, "x", "y", ["part"]))


@query
def stat_largest_stratum(spark, d):
    return rounded(stats.pearson(stats.largest_stratum(table(spark, d, "lineitem"), "l_returnflag"), "l_quantity", "l_extendedprice"))


@query
def stat_verdicts(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    parts = [stats.run(li, "pearson", "l_quantity", "l_extendedprice", family_size=4), stats.run(li, "two_group", "l_linestatus", "l_extendedprice", family_size=4), stats.run(o, "anova", "o_orderpriority", "o_totalprice", family_size=4), stats.run(o, "chi2", "o_orderpriority", "o_orderstatus", family_size=4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out, 4)


# detection


@query
def det_per_class_ap(spark, d):
    return rounded(detection.average_precision(*boxes(spark, d), (0.5, 0.75)))


@query
def det_map50(spark, d):
    return rounded(detection.mean_average_precision(detection.average_precision(*boxes(spark, d))))


@query
def det_coco_map(spark, d):
    return rounded(detection.mean_average_precision(detection.average_precision(*boxes(spark, d), detection.COCO_THRESHOLDS)))


@query
def det_caveats(spark, d):
    return rounded(detection.honesty(boxes(spark, d)[1], "per-image random"))


@query
def det_class_map(spark, d):
    return detection.class_map(table(spark, d, "nation").select((F.col("n_nationkey") * 3 + 1).alias("id"), F.col("n_name").alias("name")))


@query
def streak_submission(spark, d):
    g, p = boxes(spark, d)
    return detection.streak_submission(sample_images(g), p, threshold=0.2, most=4)


@query
def streak_manifest(spark, d):
    g, p = boxes(spark, d)
    return detection.streak_manifest(sample_images(g), p, threshold=0.2, most=4)


def sample_images(truth: DataFrame) -> DataFrame:
    """A sample submission: line and image_id (a file name) of all images but every ninth, and as many without boxes."""
    n = F.regexp_extract("image_id", r"(\d+)", 1).cast("long")
    known = truth.select("image_id", n.alias("line")).distinct().where("line % 9 <> 0")
    empty = known.select(F.concat(F.lit("none"), F.col("line").cast("string")).alias("image_id"), (-F.col("line") - 1).alias("line"))
    return known.union(empty).select("line", F.concat("image_id", F.lit(".png")).alias("image_id"))


@query
def streak_foreign_images(spark, d):
    g, p = boxes(spark, d)
    return detection.foreign_images(sample_images(g), p)


@query
def coco_results(spark, d):
    g, p = boxes(spark, d)
    out = detection.coco_results(p, None, 0.9)
    return out.select("image_id", "category_id", *(F.col("bbox")[i].alias(c) for i, c in enumerate("xywh")), "score")


@query
def yolo_labels(spark, d):
    return detection.yolo_labels(boxes(spark, d)[0])


@query
def coco_summary(spark, d):
    return detection.summary(boxes(spark, d)[0])


@query
def coco_class_distribution(spark, d):
    return detection.class_distribution(boxes(spark, d)[0])


# images and groups


@query
def grid_canonical_hash(spark, d):
    return grids(spark, d).select("vec_id", images.canonical_hash(F.col("embedding"), 8).alias("hash"))


@query
def near_dup_clusters(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"))
    return images.clusters(rows, "hash", "doc_id").select("hash", "size", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query
def hash_entropy(spark, d):
    return rounded(images.reliability(table(spark, d, "documents").select(F.md5("text").alias("hash")), "hash"))


@query
def group_key_candidates(spark, d):
    rows = table(spark, d, "events").select(F.concat(F.lit("seq"), (F.col("user_id") % 20).cast("string"), F.lit("_frame_"), F.col("event_id").cast("string")).alias("stem"))
    return images.group_candidates(rows, "stem")


@query
def pixel_stretch(spark, d):
    return grids(spark, d).select("vec_id", F.array_join(F.transform(images.stretch(F.col("embedding")), lambda x: x.cast("string")), ",").alias("pixels"))


@query
def group_components(spark, d):
    items, clusters = grouped_items(spark, d)
    return components.assign_groups(items, "base", clusters)


@query
def group_size_summary(spark, d):
    items, clusters = grouped_items(spark, d)
    return components.group_sizes(components.assign_groups(items, "base", clusters))


@query
def spanning_clusters(spark, d):
    items, clusters = grouped_items(spark, d)
    return components.spanning_clusters(items, "base", clusters)


# submissions and scalars


@query
def submission_check(spark, d):
    return submission.check(*submissions(spark, d), ["prediction", "note"])


@query
def submission_columns(spark, d):
    return submission.columns(*submissions(spark, d), ["prediction", "note"])


@query
def submission_id_errors(spark, d):
    s, e = submissions(spark, d)
    of = lambda df, k: df.select(F.lit(k).alias("problem"), "id")
    return of(submission.repeated_ids(s), "repeated").union(of(submission.missing_ids(s, e), "missing")).union(of(submission.extra_ids(s, e), "extra"))


@query
def value_kinds(spark, d):
    cells = [" 1.5", "1e5", "1_000", "1d", "0x10", "inf", "-Infinity", "NA", "", "nan", "None", "text", ".5", "5.", "1__0", "1e999", "+7", "--1"]
    return spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "n int, cell string").select("n", "cell", scalars.value_kind(F.col("cell")).alias("kind"))


@query
def scalar_functions(spark, d):
    o = table(spark, d, "orders")
    path = F.concat(F.lit("a/b.c/"), F.col("o_orderpriority"), F.lit(".x."), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", scalars.stem_of(path).alias("stem"), scalars.fixed(F.col("o_totalprice") / 8, 2).alias("text"), scalars.capture(F.col("o_orderpriority"), r"(\d)-").alias("level"), scalars.agent_name(path).alias("agent"), scalars.days_left(F.col("o_orderdate").cast("string"), F.lit("1999-01-01").cast("date")).alias("days"))


# ladders


@query
def match_outcomes(spark, d):
    return ladder.outcomes(matches(spark, d)).select("match_id", "slot", "agent", "outcome")


@query
def win_rates(spark, d):
    return rounded(ladder.recommendation(ladder.rates(matches(spark, d))))


@query
def win_matrix(spark, d):
    return ladder.win_matrix(matches(spark, d))


@query
def matchup_shares(spark, d):
    return rounded(ladder.matchup_shares(matches(spark, d)))


@query
def ladder_profile(spark, d):
    return rounded(ladder.profile(matches(spark, d)))


@query
def elo_ladder(spark, d):
    return rounded(ladder.elo(matches(spark, d)))


@query
def ladder_lineups(spark, d):
    return ladder.lineups(matches(spark, d).select("agent").distinct(), 5)


# audits


@query
def competition_check(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    facts = F.struct(
        F.concat(F.lit("c"), k.cast("string")).alias("name"), F.when(k % 7 == 0, "elsewhere").otherwise("kaggle").alias("platform"), F.when(k % 5 == 0, "cv-detection").otherwise("tabular").alias("track"),
        F.struct(F.when(k % 11 != 0, "auc").alias("name"), F.lit("maximize").alias("direction")).alias("metric"), F.struct(F.when(k % 13 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("final_submission")).alias("deadlines"),
        F.struct((k % 3 != 0).alias("rules_accepted")).alias("rules"), F.struct(F.lit(" ").alias("scheme")).alias("validation"),
    )
    documents = o.select(k.alias("id"), F.to_json(facts).alias("document"))
    return governance.competition_check(documents, "1998-01-01").select("id", "status", "pipeline", "days_left", "missing_required", "problems")


@query
def readiness_score(spark, d):
    return rounded(governance.readiness_score(governance.readiness_checks(artifacts(spark, d))))


def artifacts(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("pipeline"), F.when(k % 4 != 0, k % 9 != 0).alias("no_row_overlap"), (k % 2).alias("group_overlap"), (k % 3).alias("duplicates"), (k % 6 == 1).alias("dropped_duplicates"), F.round("s_acctbal", 2).alias("baseline"),
        F.when(k % 5 != 0, "val").alias("baseline_on"), F.round(F.col("s_acctbal") + k % 3 - 1, 2).alias("tuned"), F.when(k % 7 != 0, F.when(k % 8 == 0, "test").otherwise("val")).alias("tuned_on"), F.lit(True).alias("same_primary"),
        (k % 2 == 0).alias("lower_is_better"), F.when(k % 10 != 0, F.lit(40)).alias("n_iter"), (k % 3 != 0).alias("has_params"), (k % 5 != 1).alias("has_report"), (k % 2).alias("n_slices"), F.when(k % 11 != 0, F.lit(42)).alias("seed"), F.lit("ab").alias("data_hash"), F.lit(True).alias("has_versions"),
    )


@query
def experiment_log_latest(spark, d):
    o = table(spark, d, "orders")
    runs = o.select(F.concat(F.lit("r"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"), F.col("o_orderpriority").alias("model_family"))
    return governance.latest_runs(runs, "model_family", "timestamp")


# models


@query
def ml_logreg(spark, d):
    rows = labelled(spark, d)
    made = models.fit_predict(rows.where("split = 'train'"), rows.where("split = 'val'"), "quality", "classification", ["n_chars", "lang"])
    return metrics.classification(made)


@query
def ml_linreg(spark, d):
    rows = split.random_split(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus"), "o_orderkey", 42)
    made = models.fit_predict(rows.where("split = 'train'"), rows.where("split = 'val'"), "o_totalprice", "regression", ["o_custkey", "o_orderstatus"])
    return metrics.regression(made)


@query
def ml_cv(spark, d):
    rows = labelled(spark, d)
    return models.tune(rows.where("split = 'train'"), "quality", "classification", ["n_chars", "lang"], "doc_id", "gbt", n_iter=2, k=2)[2]


def labelled(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return split.random_split(docs, "doc_id", 42, stratify="quality")
