"""Packing of tokenized documents into fixed-length sequences: shortest-pack-first over the length histogram.

1. Every document is tokenized once and cut into pieces of at most ``capacity`` ids: full pieces, then the rest.
2. The histogram of piece lengths has at most ``capacity`` rows whatever the corpus, so it is packed on the driver:
   lengths longest first, each going to the least filled pattern that it fits, with counts of patterns, not packs.
3. Each pattern's slots of one length are an interval of that length's ranks. Ranks are distributed: a range sort by
   (length, document), a count for each range and length, and a local row number. A hot length spreads over ranges.

Rows: texts are tokenized whole, whatever their length, and cut into as many pieces as they need; a null text is an
empty one (its only id is the end id); a null doc_id is kept. Repeated rows are packed each.
An empty table gives no rows. Extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartzframe.llm import common

CAPACITY = 2048
END_ID = 1
PIECES = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType(), False) for c in ("start", "length", "ids_crc32", "doc_tokens")]
)
SLOTS = "length long, rank_from long, rank_to long, per_pack long, first_sequence long, first_offset long"


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32 and doc_tokens."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from quartzframe.llm.tokens import tokenizer

        to_ids, step = tokenizer(tokenizer_path).ids, 4 * capacity
        for batch in batches:
            owner, start, length, crc, tokens = [], [], [], [], []
            for i, text in enumerate(batch["text"]):
                ids = to_ids(text) + end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    owner.append(i)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    tokens.append(len(ids) // 4)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").take(owner).array, "start": start, "length": length, "ids_crc32": crc, "doc_tokens": tokens})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return common.ship(rows).mapInPandas(cut, PIECES)


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Shortest-pack-first over {length: count}. Returns SLOTS rows: ranks rank_from to rank_to of a length (exclusive)
    lie per_pack to a sequence, from first_sequence on, the first of a sequence at first_offset."""
    open_packs: list[tuple[int, int, int, int]] = []  # fill, tie-break, first sequence, how many sequences
    slots: list[tuple[int, int, int, int, int, int]] = []
    sequences = made = 0

    def keep_open(fill: int, first: int, count: int) -> None:
        nonlocal made
        if fill < capacity:
            heapq.heappush(open_packs, (fill, made, first, count))
            made += 1

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if open_packs and open_packs[0][0] + length <= capacity:
                fill, _, first, count = heapq.heappop(open_packs)
                if count > left:
                    keep_open(fill, first + left, count - left)
                    count = left
                # the least filled packs stay the least filled until they reach the next fill
                level = open_packs[0][0] if open_packs else capacity
                each = max(1, min((capacity - fill) // length, (level - fill) // length, left // count))
            else:
                each = capacity // length
                fill, first, count = 0, sequences, max(1, left // each)
                each = min(each, left)
                sequences += count
            slots.append((length, rank, rank + each * count, each, first, fill))
            keep_open(fill + each * length, first, count)
            rank += each * count
            left -= each * count
    return slots


def ranked(df: DataFrame, group: str, order: list[str], rank: str) -> DataFrame:
    """df with the distributed rank (from 0) of each row within group, ties in order broken anyhow but consistently.

    Groups of any size: rows are range-sorted by (group, order), so a hot group fills many ranges."""
    spark = df.sparkSession
    n = common.partitions(df)
    ranges = common.materialize(df.repartitionByRange(n, group, *order).withColumn("range_no", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("range_no", group).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = common.materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "offsets")
    local = F.row_number().over(Window.partitionBy("range_no", group).orderBy(*order)) - 1
    return ranges.withColumn("local", local).join(offsets, ["range_no", group]).withColumn(rank, F.col("before") + F.col("local")).drop("local", "before", "range_no")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark: SparkSession = docs.sparkSession
    pieces = common.materialize(tokenized_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    # at most capacity rows
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = common.materialize(spark.createDataFrame(pack_histogram(histogram, capacity), SLOTS).coalesce(1), "slots")
    placed = ranked(pieces, "length", ["doc_id", "start", "ids_crc32"], "rank").alias("p")
    # the slots of a length split its ranks; their number depends on capacity, not on the corpus
    slots = slots.alias("s")
    joined = placed.join(F.broadcast(slots), (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    nth = F.col("rank") - F.col("rank_from")
    return joined.select(
        "p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens",
        (F.col("first_sequence") + F.floor(nth / F.col("per_pack"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (nth % F.col("per_pack")) * F.col("p.length")).cast("long").alias("offset"),
    )
