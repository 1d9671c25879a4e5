"""Audits: competition facts, readiness rubric, run manifest, one-time test lock."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzframe.functions.scalars import days_left, is_unknown

#: What must be known before modelling, what is asked next, and allowed values.
REQUIRED = ("name", "platform", "track", "metric.name", "metric.direction", "deadlines.final_submission", "rules.rules_accepted", "validation.scheme")
OPEN = (
    "rules.external_data_allowed", "rules.pretrained_models_allowed", "rules.team_size_max", "submission.daily_limit", "submission.final_selection_count", "submission.code_competition",
    "submission.runtime_limit_hours", "submission.internet_allowed", "submission.format_file", "leaderboard.public_fraction", "validation.mirrors_test_because",
)
PLATFORMS = ("kaggle", "drivendata", "aicrowd", "zindi", "codalab", "huggingface", "other")
TRACKS = {"tabular": "model-builder", "game-agent": "game-agent-builder", "cv-detection": "cv-modeler", "other": None}
DIRECTIONS = ("maximize", "minimize")
#: Checks of the rubric with their section and whether they count in full.
CHECKS = (
    ("leakage_safe_split", "Features & Data", True), ("duplicates_handled", "Features & Data", False), ("baseline", "Model Development", True), ("tuned_beats_baseline", "Model Development", True),
    ("hyperparameters_tuned", "Model Development", True), ("slice_analysis", "Model Development", False), ("reproducibility", "ML Infrastructure", True), ("test_held_out", "ML Infrastructure", True),
)


def field(document: str, path: str):
    """A dotted path in a JSON text; null on any miss."""
    return F.get_json_object(document, f"$.{path}")


def competition_check(documents: DataFrame, today: str | None = None) -> DataFrame:
    """documents: id, document (JSON text). id, status, pipeline, days_left, missing_required, open_questions, problems."""
    at = F.lit(today).cast("date") if today else F.current_date()
    found = lambda p: field("document", p)
    listed = lambda xs: F.array_join(F.filter(F.array(*xs), lambda x: x.isNotNull()), ",")
    missing = [F.when(is_unknown(found(p)), p) for p in REQUIRED] + [F.when(found("rules.rules_accepted") == "false", "rules.rules_accepted")]
    outside = lambda p, allowed: F.when(~is_unknown(found(p)) & ~found(p).isin(*allowed), p)
    left = days_left(found("deadlines.final_submission"), at)
    bad_date = F.when(~is_unknown(found("deadlines.final_submission")) & left.isNull(), "deadlines.final_submission")
    pipeline = F.lit(None).cast("string")
    for track, agent in TRACKS.items():
        pipeline = F.when(found("track") == track, F.lit(agent).cast("string")).otherwise(pipeline)
    out = documents.select(
        "id", pipeline.alias("pipeline"), left.alias("days_left"), listed(missing).alias("missing_required"), listed([F.when(is_unknown(found(p)), p) for p in OPEN]).alias("open_questions"),
        listed([outside("platform", PLATFORMS), outside("track", TRACKS), outside("metric.direction", DIRECTIONS), bad_date]).alias("problems"),
    )
    ready = (F.col("missing_required") == "") & (F.col("problems") == "")
    return out.withColumn("status", F.when(ready, "READY").otherwise("INCOMPLETE"))


def experiment_log(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a JSON-lines log; blank and broken lines are skipped."""
    schema = "run_id string, timestamp string, seed long, dataset_sha256 string, n_iter long, eval_on string, primary string, best_params map<string,string>, versions map<string,string>, val_metrics map<string,double>"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("run_id IS NOT NULL")


def latest_runs(runs: DataFrame, by: str, order: str) -> DataFrame:
    """The last run of each value of by, ties to the greatest run_id."""
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), F.desc("run_id")))).where("_n = 1").drop("_n")


def readiness_checks(artifacts: DataFrame) -> DataFrame:
    """artifacts: pipeline and, null where absent, no_row_overlap, group_overlap, duplicates, dropped_duplicates, baseline,
    baseline_on, tuned, tuned_on, same_primary, lower_is_better, n_iter, has_params, has_report, n_slices, seed, data_hash,
    has_versions. pipeline, check, status."""
    c = F.col
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    beats = F.when(c("lower_is_better"), c("tuned") < c("baseline")).otherwise(c("tuned") > c("baseline"))
    split, base, tuned = c("no_row_overlap").isNotNull(), c("baseline_on").isNotNull(), c("tuned_on").isNotNull()
    grade = lambda present, good: F.when(~present, "FAIL").when(F.coalesce(good, F.lit(False)), "PASS").otherwise("PARTIAL")
    status = {
        "leakage_safe_split": F.when(split & c("no_row_overlap") & (F.coalesce("group_overlap", F.lit(0)) == 0), "PASS").otherwise("FAIL"),
        "duplicates_handled": grade(split, (c("duplicates") == 0) | c("dropped_duplicates")),
        "baseline": F.when(base, "PASS").otherwise("FAIL"),
        "tuned_beats_baseline": F.when(~base & ~tuned, "FAIL").when(base & tuned & c("same_primary") & (c("baseline_on") == c("tuned_on")) & finite(c("baseline")) & finite(c("tuned")) & beats, "PASS").otherwise("PARTIAL"),
        "hyperparameters_tuned": F.when((F.coalesce("n_iter", F.lit(0)) > 0) & F.coalesce("has_params", F.lit(False)), "PASS").otherwise("FAIL"),
        "slice_analysis": grade(F.coalesce("has_report", F.lit(False)), c("n_slices") > 0),
        "reproducibility": grade(c("n_iter").isNotNull(), c("seed").isNotNull() & c("data_hash").isNotNull() & c("has_versions")),
        "test_held_out": F.when((base | tuned) & ~F.coalesce(c("baseline_on") == "test", F.lit(False)) & ~F.coalesce(c("tuned_on") == "test", F.lit(False)), "PASS").otherwise("PARTIAL"),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("check"), F.lit(section).alias("section"), F.lit(1.0 if full else 0.5).alias("weight"), status[name].alias("status")) for name, section, full in CHECKS)))
    return artifacts.select("pipeline", rows.alias("r")).select("pipeline", "r.*")


def readiness_score(checks: DataFrame) -> DataFrame:
    """pipeline, points, most, fraction, label, n_fail, n_partial. Partial counts half."""
    points = F.col("weight") * F.when(F.col("status") == "PASS", 1.0).when(F.col("status") == "PARTIAL", 0.5).otherwise(0.0)
    n = lambda s: F.count_if(F.col("status") == s)
    out = checks.groupBy("pipeline").agg(F.sum(points).alias("points"), F.sum("weight").alias("most"), n("FAIL").alias("n_fail"), n("PARTIAL").alias("n_partial"))
    out = out.withColumn("fraction", F.col("points") / F.col("most"))
    return out.withColumn("label", F.when(F.col("fraction") >= 0.8, "strong").when(F.col("fraction") >= 0.5, "partial").otherwise("weak"))


def content_hash(df: DataFrame) -> str:
    """The first 16 digits of a hash of all rows, whatever their order: hashes of rows are added up."""
    row = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.sum("h"), F.count("h")).first()
    return hashlib.sha256(f"{row[0]}:{row[1]}".encode()).hexdigest()[:16]


def log_run(spark: SparkSession, path: str, run: dict) -> str:
    """Append a run as a line of JSON; returns its id."""
    run_id = run.get("run_id") or uuid.uuid4().hex[:12]
    spark.createDataFrame([(json.dumps({"run_id": run_id} | run, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)
    return run_id


class TestLock:
    """The test split is scored once. The lock is a file beside the data, on whatever store these are."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_test_consumed.json")
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def taken(self) -> bool:
        return self.files.exists(self.path)

    def take(self, by: str, allow: bool = False) -> None:
        if not allow:
            raise PermissionError("scoring the test split must be allowed explicitly")
        if self.taken():
            raise PermissionError("the test split was scored before")
        out = self.files.create(self.path, False)
        out.write(bytearray(json.dumps({"by": by}).encode()))
        out.close()

    def clear(self) -> None:
        """For a fresh split."""
        self.files.delete(self.path, False)
