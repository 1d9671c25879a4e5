"""Object detection: box matching, average precision, submissions and label conversion.

ground truth: gt_id, image_id, class_id, x, y, w, h. predictions: pred_id, image_id, class_id, score, x, y, w, h.
Boxes are x, y (top left), width, height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzframe.functions.scalars import fixed, stem_of
from quartzframe.plans import tables

COCO_THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
COCO = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>>>, categories array<struct<id:int,name:string>>"


def coco_tables(document: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations and categories of COCO documents (one row each)."""
    return tuple(document.select(F.inline(c)) for c in ("images", "annotations", "categories"))


def class_map(categories: DataFrame) -> DataFrame:
    """category_id, name, class_id: category ids in order become 0, 1, ..; one row a category."""
    return categories.select(F.col("id").alias("category_id"), "name", (F.dense_rank().over(Window.orderBy("id")) - 1).alias("class_id"))


def coco_boxes(images: DataFrame, annotations: DataFrame, classes: DataFrame) -> DataFrame:
    """Ground truth of well-formed annotations of known images and categories; image_id is the file's stem."""
    stems = images.select(F.col("id").alias("image_id"), stem_of(F.col("file_name")).alias("stem"), "width", "height")
    good = annotations.where(F.size("bbox") == 4)
    box = [F.col("bbox")[i].alias(c) for i, c in enumerate("xywh")]
    return good.join(stems, "image_id").join(F.broadcast(classes), "category_id").select(F.col("id").alias("gt_id"), F.col("stem").alias("image_id"), "class_id", *box, "width", "height")


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes of aliases a and b, 0 if nothing is covered."""
    c = lambda t, f: F.col(f"{t}.{f}")
    wide = F.least(c(a, "x") + c(a, "w"), c(b, "x") + c(b, "w")) - F.greatest(c(a, "x"), c(b, "x"))
    high = F.least(c(a, "y") + c(a, "h"), c(b, "y") + c(b, "h")) - F.greatest(c(a, "y"), c(b, "y"))
    both = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
    union = c(a, "w") * c(a, "h") + c(b, "w") * c(b, "h") - both
    return F.when(union > 0, both / union).otherwise(0.0)


def best_matches(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every prediction with its best ground truth of the same image and class (gt_id null, iou 0 if none overlaps).
    The best does not depend on a threshold, so it is found once for all thresholds."""
    g, p = truth.alias("g"), predictions.alias("p")
    overlap = p.join(g, (F.col("p.image_id") == F.col("g.image_id")) & (F.col("p.class_id") == F.col("g.class_id"))).select("p.pred_id", "g.gt_id", iou("p", "g").alias("iou")).where("iou > 0")
    best = overlap.groupBy("pred_id").agg(F.max_by(F.struct("gt_id", "iou"), F.struct("iou", (-F.col("gt_id")).alias("t"))).alias("m")).select("pred_id", "m.*")
    return predictions.select("pred_id", "image_id", "class_id", "score").join(best, "pred_id", "left")


def average_precision(truth: DataFrame, predictions: DataFrame, thresholds=(0.5,)) -> DataFrame:
    """threshold, class_id, n_gt, n_pred, ap of every class that has ground truth.

    For each ground truth the first prediction by score that reaches the threshold is a hit; a prediction's best truth
    is its only one. Recall grows at hits only, so the area is the sum of the precision envelope over hits."""
    matched = tables.materialize(best_matches(truth, predictions), "matches")
    each = F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))
    rows = matched.select("*", each.alias("threshold")).withColumn("reached", F.coalesce(F.col("iou") >= F.col("threshold"), F.lit(False)))
    # of those that reach it only: the others have no ground truth in common
    first = F.row_number().over(Window.partitionBy("threshold", "gt_id").orderBy(F.desc("score"), "pred_id"))
    hits = rows.where("reached").withColumn("tp", (first == 1).cast("int"))
    rows = hits.unionByName(rows.where("NOT reached").withColumn("tp", F.lit(0)))
    order = Window.partitionBy("threshold", "class_id").orderBy(F.desc("score"), "pred_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("precision", F.sum("tp").over(upto) / F.count(F.lit(1)).over(upto))
    # a running maximum from the end: a frame up to the end would be computed anew for every row
    backwards = Window.partitionBy("threshold", "class_id").orderBy("score", F.desc("pred_id")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("envelope", F.max("precision").over(backwards))
    area = rows.groupBy("threshold", "class_id").agg(F.sum(F.when(F.col("tp") == 1, F.col("envelope"))).alias("area"), F.count(F.lit(1)).alias("n_pred"))
    wanted = truth.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_gt")).select("*", each.alias("threshold"))
    joined = wanted.join(area, ["threshold", "class_id"], "left")
    return joined.select("threshold", "class_id", "n_gt", F.coalesce("n_pred", F.lit(0)).cast("long").alias("n_pred"), F.coalesce(F.col("area") / F.col("n_gt"), F.lit(0.0)).alias("ap"))


def mean_average_precision(ap: DataFrame) -> DataFrame:
    """map: the mean over thresholds of the mean over classes."""
    return ap.groupBy("threshold").agg(F.avg("ap").alias("m")).agg(F.avg("m").alias("map"), F.count(F.lit(1)).alias("n_thresholds"))


def honesty(predictions: DataFrame, provenance: str | None = None) -> DataFrame:
    """One row: most boxes of an image, least score, images, and the caveats that follow."""
    per = predictions.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
    row = per.agg(F.max("n").alias("max_boxes_per_image"), F.min("s").alias("min_confidence"), F.count(F.lit(1)).alias("n_images"))
    leaky = provenance is not None and provenance.startswith("per-image")
    flags = F.array(F.when(F.col("max_boxes_per_image") > 100, "over 100 boxes in an image"), F.when(F.col("min_confidence") < 0.05, "scores below 0.05"), F.when(F.lit(provenance is None), "unknown split"), F.when(F.lit(leaky), "leaky split"))
    return row.withColumn("caveats", F.array_join(F.filter(flags, lambda x: x.isNotNull()), "; "))


def restrict(predictions: DataFrame, ids: DataFrame) -> DataFrame:
    return predictions.join(ids.select(F.col("image_id")).distinct(), "image_id", "left_semi")


def select_boxes(predictions: DataFrame, threshold: float = 0.0, most: int = 0) -> DataFrame:
    """Boxes at or above the threshold; of each image the best ``most`` (0: all), ties by pred_id. Adds place (from 1)."""
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "pred_id")
    rows = predictions.where(F.col("score") >= threshold).withColumn("place", F.row_number().over(order))
    return rows.where(F.col("place") <= most) if most else rows


#: The fields of a box in a submission, in their usual order.
BOX_FIELDS = ("conf", "x", "y", "w", "h")


def _submitted(predictions: DataFrame, threshold: float, most: int) -> DataFrame:
    """The boxes to submit; an image is known by its file's stem."""
    return select_boxes(predictions.withColumn("image_id", stem_of(F.col("image_id"))), threshold, most)


def streak_submission(sample: DataFrame, predictions: DataFrame, order=BOX_FIELDS, threshold: float = 0.0, most: int = 0) -> DataFrame:
    """image_id, prediction, n_boxes for every row of the sample: its boxes in one string, best first, '' without any.
    sample: image_id, and line if its order matters (then the result has it, too). Scores have six digits, others two."""
    if sorted(order) != sorted(BOX_FIELDS):
        raise ValueError(f"not an order of the box fields {BOX_FIELDS}: {order}")
    text = {"conf": fixed(F.col("score"), 6)} | {c: fixed(F.col(c), 2) for c in "xywh"}
    boxes = _submitted(predictions, threshold, most).select("image_id", F.struct("place", F.concat_ws(" ", *(text[f] for f in order)).alias("box")).alias("b"))
    per = boxes.groupBy(F.col("image_id").alias("stem")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["box"]), " ").alias("prediction"), F.count(F.lit(1)).alias("n_boxes"))
    place = ["line"] if "line" in sample.columns else []
    joined = sample.select(*place, "image_id").join(per, stem_of(F.col("image_id")) == F.col("stem"), "left")
    return joined.select(*place, "image_id", F.coalesce("prediction", F.lit("")).alias("prediction"), F.coalesce("n_boxes", F.lit(0)).cast("long").alias("n_boxes"))


def streak_manifest(sample: DataFrame, predictions: DataFrame, order=BOX_FIELDS, threshold: float = 0.0, most: int = 0) -> DataFrame:
    """One row: images of the sample, with and without boxes, predicted ones that it lacks, a warning if boxes are sparse."""
    made = streak_submission(sample, predictions, order, threshold, most)
    row = made.agg(F.count(F.lit(1)).alias("n_images"), F.count_if(F.col("n_boxes") > 0).alias("n_with_detections"))
    row = row.withColumn("n_empty", F.col("n_images") - F.col("n_with_detections")).join(foreign_images(sample, predictions), F.lit(True))
    sparse = F.when(F.col("n_with_detections") == 0, "no image has a box").when(F.col("n_with_detections") < 0.05 * F.col("n_images"), "few images have boxes").otherwise("")
    return row.withColumns({"warning": sparse, "box_order": F.lit(",".join(order))})


def foreign_images(sample: DataFrame, predictions: DataFrame) -> DataFrame:
    """n_foreign: predicted images that the sample lacks."""
    stems = predictions.select(stem_of(F.col("image_id")).alias("stem")).distinct()
    return stems.join(sample.select(stem_of(F.col("image_id")).alias("stem")), "stem", "left_anti").agg(F.count(F.lit(1)).alias("n_foreign"))


def coco_results(predictions: DataFrame, classes: DataFrame | None = None, threshold: float = 0.0, most: int = 0) -> DataFrame:
    """image_id, category_id, bbox (two digits), score (six digits); classes without a category keep their number."""
    rows = select_boxes(predictions, threshold, most)
    category = F.col("class_id")
    if classes is not None:
        rows = rows.join(F.broadcast(classes.select("class_id", "category_id")), "class_id", "left")
        category = F.coalesce("category_id", "class_id")
    return rows.select("image_id", category.cast("int").alias("category_id"), F.array(*(F.bround(c, 2) for c in "xywh")).alias("bbox"), F.bround("score", 6).alias("score"))


def yolo_labels(boxes: DataFrame) -> DataFrame:
    """image_id, label: a line 'class cx cy w h' for each box, relative to the image, in order of gt_id."""
    part = {"cx": (F.col("x") + F.col("w") / 2) / F.col("width"), "cy": (F.col("y") + F.col("h") / 2) / F.col("height"), "w": F.col("w") / F.col("width"), "h": F.col("h") / F.col("height")}
    line = F.concat_ws(" ", F.col("class_id").cast("string"), *(fixed(part[c], 6) for c in ("cx", "cy", "w", "h")))
    rows = boxes.select("image_id", F.struct("gt_id", line.alias("line")).alias("b"))
    return rows.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["line"]), "\n").alias("label"))


def missing_sources(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images without a file of their stem."""
    return images.select("image_id").join(files.select(stem_of(F.col("path")).alias("image_id")), "image_id", "left_anti")


def without_entry(files: DataFrame, images: DataFrame) -> DataFrame:
    """Files (path) whose stem no image of a COCO table (file_name) has."""
    stems = images.select(stem_of(F.col("file_name")).alias("image_id"))
    return files.select("path", stem_of(F.col("path")).alias("image_id")).join(stems, "image_id", "left_anti")


def require_entries(files: DataFrame, images: DataFrame) -> DataFrame:
    """files, if every one has an entry; else an error that names some."""
    missing = without_entry(files, images)
    if examples := [r["image_id"] for r in missing.orderBy("image_id").limit(3).collect()]:
        raise ValueError(f"{missing.count()} images have no entry, as {examples}: every image must map to a group")
    return files


def summary(boxes: DataFrame, include_empty: DataFrame | None = None) -> DataFrame:
    """One row: boxes in all; fewest, middle and most boxes of an annotated image; elongated boxes (5 to 1 or more).
    include_empty: images that count with 0 boxes if they have none."""
    per = boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    if include_empty is not None:
        per = include_empty.select("image_id").distinct().join(per, "image_id", "left").na.fill(0, ["n"])
    long = F.count_if((F.least("w", "h") > 0) & (F.greatest("w", "h") >= 5 * F.least("w", "h")))
    row = per.agg(F.count(F.lit(1)).alias("n_images"), F.min("n").alias("min_boxes"), F.floor(F.percentile("n", 0.5)).alias("median_boxes"), F.max("n").alias("max_boxes"))
    return row.join(boxes.agg(F.count(F.lit(1)).alias("n_boxes"), long.alias("n_elongated")), F.lit(True))


def class_distribution(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))


def prediction_columns(header: list[str]) -> tuple[str, str]:
    """The id and the prediction column of a sample submission: the first name with 'predict' in it, else the second
    column; the id is the first other one."""
    if len(header) < 2:
        raise ValueError(f"a sample submission has two columns or more: {header}")
    prediction = next((c for c in header if "predict" in c.lower()), header[1])
    return next(c for c in header if c != prediction), prediction


def require_labels(labels: DataFrame) -> int:
    """How many label lines there are; none at all is an error, not an empty training set."""
    n = labels.agg(F.sum(F.size(F.split("label", "\n")))).first()[0] or 0
    if not n:
        raise ValueError("no labels were made")
    return n
