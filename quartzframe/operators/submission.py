"""Submission check against a format file. Both tables have line (file order), id and text cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzframe.functions.scalars import value_kind

EXAMPLES = 5


def header_errors(submission: list[str], expected: list[str]) -> tuple[list[str], list[str]]:
    """Errors and warnings of the column names."""
    if submission == expected:
        return [], []
    return ([], ["column order"]) if sorted(submission) == sorted(expected) else (["columns"], [])


def ragged(raw: DataFrame, n_cells: int) -> DataFrame:
    """raw: line, cells. Lines with another number of cells."""
    return raw.where(F.size("cells") != n_cells).select("line", F.size("cells").alias("n_cells"))


def repeated_ids(submission: DataFrame) -> DataFrame:
    """Second and later rows of an id, in file order."""
    return submission.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("line"))).where("n > 1").select("line", "id")


def missing_ids(submission: DataFrame, expected: DataFrame) -> DataFrame:
    return expected.select("id").distinct().join(submission, "id", "left_anti")


def extra_ids(submission: DataFrame, expected: DataFrame) -> DataFrame:
    return submission.select("id").distinct().join(expected, "id", "left_anti")


def order_differs(submission: DataFrame, expected: DataFrame) -> DataFrame:
    """differs: whether any line number holds different ids."""
    joined = submission.select("line", F.col("id").alias("a")).join(expected.select("line", F.col("id").alias("b")), "line", "full")
    return joined.agg(F.coalesce(F.bool_or(~F.col("a").eqNullSafe(F.col("b"))), F.lit(False)).alias("differs"))


def columns(submission: DataFrame, expected: DataFrame, names: list[str]) -> DataFrame:
    """column, n_missing, n_text, n_values (distinct), expects_number, constant for each value column; one pass a side."""
    melt = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in names))).alias("x")).select("x.*").withColumn("kind", value_kind(F.col("cell")))
    own = melt(submission).groupBy("column").agg(F.count_if(F.col("kind") == "missing").alias("n_missing"), F.count_if(F.col("kind") == "text").alias("n_text"), F.count_distinct("cell").alias("n_values"), F.count_distinct(F.when(F.col("kind") != "missing", F.col("kind"))).alias("n_kinds"))
    theirs = melt(expected).groupBy("column").agg((F.coalesce(F.bool_and(F.when(F.col("kind") != "missing", F.col("kind") == "number")), F.lit(False))).alias("expects_number"))
    return own.join(theirs, "column").select("column", "n_missing", "n_text", "n_values", "expects_number", ((F.col("n_kinds") == 1) & (F.col("n_values") == 1)).alias("constant"))


def check(submission: DataFrame, expected: DataFrame, names: list[str], raw: DataFrame | None = None) -> DataFrame:
    """One row: status, n_rows, n_expected, n_repeated, n_missing_ids, n_extra_ids, n_empty_cells, n_wrong_kind,
    n_constant, n_ragged, order_differs, repeated (first ids)."""
    one = F.lit(True)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    repeated = repeated_ids(submission)
    cells = columns(submission, expected, names).agg(
        F.sum("n_missing").alias("n_empty_cells"), F.count_if(F.col("expects_number") & (F.col("n_text") > 0)).alias("n_wrong_kind"), F.count_if("constant").alias("n_constant")
    )
    first = repeated.orderBy("line").limit(EXAMPLES).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.col("id").cast("string").alias("id")))), lambda x: x["id"]), ",").alias("repeated"))
    row = n(submission, "n_rows").join(n(expected, "n_expected"), one).join(n(repeated, "n_repeated"), one).join(n(missing_ids(submission, expected), "n_missing_ids"), one).join(n(extra_ids(submission, expected), "n_extra_ids"), one)
    row = row.join(cells, one).join(first, one).join(order_differs(submission, expected), one)
    row = row.join(n(ragged(raw, len(names) + 1), "n_ragged"), one) if raw is not None else row.withColumn("n_ragged", F.lit(0).cast("long"))
    wrong = sum((F.col(c) for c in ("n_repeated", "n_missing_ids", "n_extra_ids", "n_empty_cells", "n_wrong_kind", "n_ragged")), F.lit(0))
    bad = (wrong > 0) | (F.col("n_rows") != F.col("n_expected"))
    differs = F.col("differs") & (F.col("n_repeated") + F.col("n_missing_ids") + F.col("n_extra_ids") == 0)
    return row.select(F.when(bad, "INVALID").otherwise("VALID").alias("status"), "n_rows", "n_expected", "n_repeated", "n_missing_ids", "n_extra_ids", "n_empty_cells", "n_wrong_kind", "n_constant", "n_ragged", differs.alias("order_differs"), "repeated")
