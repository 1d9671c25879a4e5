"""Writers. Every stage writes a new path; nothing is overwritten."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, CSV, tab-separated, JSON lines or ORC by the path's ending."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("csv", "tsv"):
        writer.option("header", True).option("sep", "\t" if ending == "tsv" else ",").csv(path)
    elif ending in ("json", "jsonl"):
        writer.json(path)
    elif ending == "orc":
        writer.orc(path)
    else:
        writer.parquet(path)


def write_split(df: DataFrame, path: str) -> None:
    write_table(df, path, ["split"])


def write_ids(df: DataFrame, path: str, by: list[str]) -> None:
    """Sorted ids as text, a folder for each fold and side."""
    rows = df.select(*by, F.col("image_id").cast("string").alias("value"))
    rows.repartition(*by).sortWithinPartitions(*by, "value").write.mode("errorifexists").partitionBy(*by).text(path)


def write_sidecar(df: DataFrame, path: str) -> None:
    """A one-row summary as JSON."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("append").json(path)


def coco_document(results: DataFrame) -> DataFrame:
    """document: results as one JSON array; for submissions, which one machine reads."""
    return results.agg(F.to_json(F.sort_array(F.collect_list(F.struct("image_id", "category_id", "bbox", "score")))).alias("document"))


def _few(df: DataFrame, most: int) -> list:
    """The rows of a result that must be small."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the table instead")
    return rows


def as_json(df: DataFrame, most: int = 100_000) -> str:
    """A small result for standard output; more than most rows are an error."""
    return json.dumps([r.asDict(recursive=True) for r in _few(df, most)], default=str)


def as_markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table; bars and line breaks in cells are escaped. More than most rows are an error."""
    cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ") if v is not None else "n/a"
    number = lambda v: f"{v:,.4g}" if isinstance(v, float) else cell(v)
    rows = _few(df, most)
    lines = [f"# {title}", "", "| " + " | ".join(map(cell, df.columns)) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(number(v) for v in r) + " |" for r in rows]) + "\n"
