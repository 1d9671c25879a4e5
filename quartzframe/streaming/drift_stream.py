"""Extensions for streams: drift of each time window, and of each micro-batch, against a frozen reference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzframe.operators import drift
from quartzframe.plans import tables


def frozen_edges(ref: DataFrame, column: str, bins: int = drift.BINS) -> tuple[list[float], list[int]]:
    """Inner edges and the reference's counts by bin, missing first: a few numbers that a stream can carry."""
    values = ref.select(F.lit(column).alias("feature"), drift.numeric_value(ref, column).alias("value"))
    edges = sorted({r["edge"] for r in tables.quantiles(values, "feature", "value", [i / bins for i in range(bins + 1)]).collect()})[1:-1]
    counts = {r["bin"]: r["n"] for r in values.groupBy(_bin(F.col("value"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return edges, [counts.get(b, 0) for b in range(-1, len(edges) + 1)]


def _bin(value: Column, edges: list[float]) -> Column:
    place = sum((F.when(F.lit(e) < value, 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(value.isNull(), -1).otherwise(place)


def windowed_psi(stream: DataFrame, time: str, column: str, edges: list[float], reference: list[int], window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, n, psi of each window of a stream or table; one aggregate with a column for each bin."""
    value = drift.numeric_value(stream, column)
    bins = range(-1, len(edges) + 1)
    counts = stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(_bin(value, edges) == b).alias(f"b{b + 1}") for b in bins))
    k, total = len(reference), sum(reference)
    psi = F.lit(0.0)
    for b in bins:
        e = F.lit((reference[b + 1] + 0.5) / (total + 0.5 * k))
        a = (F.col(f"b{b + 1}") + 0.5) / (F.col("n") + 0.5 * k)
        psi = psi + (a - e) * F.log(a / e)
    return counts.select(F.col("window.start").alias("window_start"), "n", psi.alias("psi"))


def monitor(stream: DataFrame, ref: DataFrame, columns: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A streaming query that hands a drift report of each micro-batch to sink."""

    def each(batch: DataFrame, number: int) -> None:
        sink(drift.report(ref, batch, columns), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def live_win_counts(stream: DataFrame) -> DataFrame:
    """winner, n of a stream of finished two-player matches: match_id, winner."""
    return stream.groupBy("winner").agg(F.count(F.lit(1)).alias("n"))
