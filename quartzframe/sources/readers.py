"""Readers: tables by their file ending, raw lines, JSON lines, COCO documents, file listings."""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartzframe.operators.detection import COCO

#: Texts that mean missing in delimited files; image file endings; folders that hold no images.
NULLS = ("", "#N/A", "#NA", "N/A", "NA", "<NA>", "n/a", "nan", "NaN", "-NaN", "-nan", "null", "NULL", "None")
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "fits", "fit", "fts")
SKIPPED_FOLDERS = ("labels", "smoke_throwaway")
DETECTIONS = "image_id string, class_id double, score double, x double, y double, w double, h double"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, JSON, JSON lines, ORC, tab- or comma-separated by the file's ending (comma if unknown)."""
    ending = path.rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if ending in ("parquet", "pq"):
        return reader.parquet(path)
    if ending == "orc":
        return reader.orc(path)
    if ending == "json":
        return read_json(spark, path, schema)
    if ending in ("jsonl", "ndjson"):
        return reader.json(path)
    if ending in ("xlsx", "xls"):
        raise NotImplementedError("no reader for spreadsheets is installed; export the sheet as CSV")
    return read_delimited(spark, path, "\t" if ending in ("tsv", "tab") else ",", schema)


def read_delimited(spark: SparkSession, path: str, separator: str = ",", schema: str | None = None, encoding: str = "UTF-8", line_breaks: bool | None = None) -> DataFrame:
    """With a header. Texts that mean missing become null; without a schema, types follow the values that are left.
    line_breaks: may quoted cells hold some; then a file is one task. By default files are split unless a line has an odd
    number of quotes."""
    if line_breaks is None:
        lines = spark.read.text(path)
        line_breaks = not lines.where(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).isEmpty()
    reader = spark.read.option("header", True).option("sep", separator).option("encoding", encoding).option("multiLine", line_breaks)
    text = reader.csv(path)
    cleaned = text.select(*(F.when(F.trim(F.col(f"`{c}`")).isin(*NULLS), None).otherwise(F.col(f"`{c}`")).alias(c) for c in text.columns))
    if schema:
        wanted = {f.name: f.dataType for f in T.StructType.fromDDL(schema)}
        return cleaned.select(*(F.col(f"`{c}`").cast(wanted[c]).alias(c) if c in wanted else F.col(f"`{c}`") for c in cleaned.columns))
    tests = {c: F.trim(F.col(f"`{c}`")) for c in cleaned.columns}
    fits = lambda c, t: F.coalesce(F.bool_and(F.when(tests[c].isNotNull(), t)), F.lit(False))
    flags = cleaned.agg(*(f for i, c in enumerate(cleaned.columns) for f in (fits(c, tests[c].rlike(r"^[+-]?[0-9]{1,18}$")).alias(f"i{i}"), fits(c, tests[c].try_cast("double").isNotNull() & ~tests[c].rlike("[dDfF]$")).alias(f"d{i}"), fits(c, F.lower(tests[c]).isin("true", "false")).alias(f"b{i}")))).first()
    kind = lambda i: "bigint" if flags[f"i{i}"] else "double" if flags[f"d{i}"] else "boolean" if flags[f"b{i}"] else "string"
    return cleaned.select(*((F.col(f"`{c}`") if kind(i) == "string" else tests[c].cast(kind(i))).alias(c) for i, c in enumerate(cleaned.columns)))


def sniff(spark: SparkSession, path: str) -> str:
    """The delimiter that the first line has most of: comma, semicolon, tab or bar."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max(",;\t|", key=lambda c: (line.count(c), -",;\t|".index(c)))


def read_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text with its delimiter found; Latin-1 if it is no UTF-8."""
    broken = not spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()
    return read_delimited(spark, path, sniff(spark, path), encoding="ISO-8859-1" if broken else "UTF-8")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """An array of records, one record, a dictionary of columns (lists, or dictionaries by row), or JSON lines. Lines are
    read as such if the first that is not blank is a whole value and others follow."""
    reader = spark.read.schema(schema) if schema else spark.read
    first = [r[0] for r in spark.read.text(path).where(F.trim("value") != "").limit(2).collect()]
    if len(first) == 2 and spark.createDataFrame([(first[0],)], "v string").where(F.try_parse_json("v").isNotNull()).count():
        return reader.json(path)
    whole = reader.option("multiLine", True).json(path)
    if schema or not whole.columns or whole.columns == ["_corrupt_record"]:
        return whole
    kinds = [f.dataType for f in whole.schema.fields]
    if all(isinstance(k, T.ArrayType) for k in kinds):
        return whole.select(F.inline(F.arrays_zip(*(f"`{c}`" for c in whole.columns)))).toDF(*whole.columns)
    if all(isinstance(k, T.StructType) for k in kinds) and len({tuple(k.names) for k in kinds}) == 1:
        order = sorted(kinds[0].names, key=lambda n: (not n.isdigit(), int(n) if n.isdigit() else 0, n))
        return whole.select(F.inline(F.array(*(F.struct(*(F.col(f"`{c}`")[n].alias(c) for c in whole.columns)) for n in order))))
    return whole


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank and broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """line (1 is the header; lines without text are not counted) and cells of a delimited text, ragged lines kept as they
    are. Quotes are honoured, also around commas and line breaks, in cells of any length."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            for content in batch["content"]:
                rows = csv.reader(io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", errors="replace", newline=""))
                numbered = enumerate((r for r in rows if r), 1)
                while part := list(itertools.islice(numbered, 10_000)):
                    yield pd.DataFrame(part, columns=["line", "cells"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parsed, "line long, cells array<string>")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections; any bad row fails the read. class_id may be written as 3.0."""
    rows = spark.read.schema(DETECTIONS).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    return rows.withColumn("class_id", F.col("class_id").cast("int"))


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """One row: images, annotations, categories."""
    return spark.read.schema(COCO).option("multiLine", True).json(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias("image_id")).where("image_id <> ''")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime of image files below folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    inside = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*IMAGE_ENDINGS) & ~F.arrays_overlap(inside, F.array(*map(F.lit, SKIPPED_FOLDERS))))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of PNG files below folder, for operators.images.decode_png."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][nN][gG]").load(folder).select("path", "content")


def find_file(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """path of the shallowest file of this name below folder, the newest of these; no row if there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(folder).select("path", "modificationTime")
    return files.withColumn("depth", F.size(F.split("path", "/"))).orderBy("depth", F.desc("modificationTime"), "path").limit(1).select("path")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """id, document of whole JSON files, for operators.governance.competition_check."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("id"), F.col("value").alias("document"))


def read_folds(spark: SparkSession, folder: str) -> DataFrame:
    """image_id and a column for each level of folders (fold, side), as sources.writers.write_ids has made them."""
    return spark.read.text(folder).withColumnRenamed("value", "image_id").where("image_id <> ''")


def read_held_out(spark: SparkSession, folder: str, fold: int = 0) -> DataFrame:
    """image_id and split_provenance of the held-out ids of a folder of splits: val_ids.txt in it or, failing that, in its
    fold_<fold>; the provenance of split_summary.json beside it, UNKNOWN without one. No such ids are an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    top = F.element_at(F.split("path", "/"), -2)
    ids = files.where(F.col("path").endswith("/val_ids.txt") & (top != f"fold_{fold}") & ~top.rlike("^fold_[0-9]+$") | F.col("path").endswith(f"/fold_{fold}/val_ids.txt"))
    found = [r["path"] for r in ids.orderBy(F.size(F.split("path", "/")), "path").limit(1).collect()]
    if not found:
        raise ValueError(f"no val_ids.txt in {folder} or its fold_{fold}")
    summary = [r["path"] for r in files.where(F.col("path").endswith("/split_summary.json")).orderBy(F.size(F.split("path", "/")), "path").limit(1).collect()]
    said = spark.read.schema("split_provenance string").option("multiLine", True).json(summary).first() if summary else None
    return read_ids(spark, found[0]).withColumn("split_provenance", F.lit(said["split_provenance"] if said and said["split_provenance"] else "UNKNOWN"))


def mentions(spark: SparkSession, path: str, text: str) -> bool:
    """Does a text file hold text, in any case."""
    return not spark.read.text(path).where(F.contains(F.lower("value"), F.lit(text.lower()))).isEmpty()
