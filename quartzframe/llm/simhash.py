"""SimHash near-duplicates by pigeonring filtering.

A fingerprint bit is set if it is set in over half of the hashes of a text's word shingles. Two fingerprints link if at
most ``distance`` = 2 bits differ. The 64 bits are a ring of three segments. By the pigeonring principle two linked
fingerprints have a segment from which every chain of l consecutive segments differs by at most l * 2 / 3 bits: none
in the first, at most one in the first two, at most two in all three. So the key of a candidate pair is the first
segment of the chain with the second one, where the second may have one bit more on one side: each fingerprint is
stored under 3 keys and looked up under these and with each set bit of the second segment cleared. Only pairs that
pass both budgets meet; the full Hamming check follows.

Everything works on distinct fingerprints, so a group of copies is one node however large. Linked nodes are joined
into components by alternating large-star and small-star rounds on tables in the shared folder.

Rows: a null text is an empty one; texts without words have fingerprint zero, which links like any other; a null
doc_id is kept and never is a component's id unless all of it are null. Repeated rows are one node. Texts are hashed
whole. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzframe.llm import common

SHINGLE = 3
SEED = 42
#: First bit and width of the three segments, in ring order.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
DISTANCE = 2
#: Hashes whose bits are counted at once, which bounds memory on very long texts.
BLOCK = 1 << 15
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text: bytes, shingle: int = SHINGLE) -> Iterator[list[bytes]]:
    """The word shingles of a text in blocks; of fewer words all in one, of none nothing."""
    words = _SPLIT.findall(text.translate(_LOWER))
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - shingle + 1)
    first, last = (ends - lengths)[:n].tolist(), ends[len(words) - n :].tolist()
    for at in range(0, n, BLOCK):
        yield [joined[a:b] for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)]


def hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    from xxhash import xxh64_intdigest

    for block in shingles(text, shingle):
        yield np.array([xxh64_intdigest(s, seed) for s in block], "<u8")


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for block in hashes(text, shingle, seed):
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(block)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every row."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = [simhash(t.encode(), shingle, seed) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": np.array(fp, np.int64)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return common.ship(rows).mapInPandas(hashed, "doc_id long, fp long")


def _mask(*segments: int) -> int:
    return sum(((1 << SEGMENTS[s % 3][1]) - 1) << SEGMENTS[s % 3][0] for s in segments)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame) -> DataFrame:
    """a < b: all pairs of distinct fingerprints in fps (column fp) with at most two differing bits."""
    kept = [(i, _signed(_mask(i, i + 1)), 0) for i in range(3)]
    cleared = [(i, mask, _signed(1 << b)) for i, mask, _ in kept for start, width in [SEGMENTS[(i + 1) % 3]] for b in range(start, start + width)]
    table = lambda keys: F.array(*(F.struct(F.lit(i).alias("chain"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for i, m, b in keys))
    key = F.col("k.mask").bitwiseAND(F.col("fp")).bitwiseXOR(F.col("k.bit"))
    stored = fps.select("fp", F.explode(table(kept)).alias("k")).select(F.col("k.chain").alias("chain"), key.alias("key"), F.col("fp").alias("a"))
    wanted = fps.select("fp", F.explode(table(kept + cleared)).alias("k")).where((F.col("k.bit") == 0) | (F.col("k.bit").bitwiseAND(F.col("fp")) != 0))
    wanted = wanted.select(F.col("k.chain").alias("chain"), key.alias("key"), F.col("fp").alias("b"))
    pairs = wanted.join(stored.hint("merge"), ["chain", "key"]).where((F.col("a") != F.col("b")) & within(F.col("a"), F.col("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def within(a: Column, b: Column, distance: int = DISTANCE) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node that it reaches) of every node of edges a, b. Alternating large-star and small-star;
    each round is a table in the shared folder, and the rounds end when one changes nothing."""
    spark = edges.sparkSession
    known = common.materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(known)
    for _ in range(rounds):
        if not now[0]:
            break
        both = known.union(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        known = common.materialize(small.where("u != v").distinct(), "edges")
        was, now = now, state(known)
        if was == now:
            break
    else:
        raise RuntimeError("components did not settle")
    return known.select(F.col("u").alias("node"), F.col("v").alias("root")) if now[0] else spark.createDataFrame([], "node long, root long")


def labels(rows: DataFrame) -> DataFrame:
    """fp, root (the component's least fp), component_id (its smallest doc_id) and n_links of every fingerprint of rows."""
    classes = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    edges = common.materialize(links(classes.select("fp")), "links")
    degree = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    found = classes.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").join(degree, "fp", "left")
    found = found.withColumn("root", F.coalesce("root", "fp"))
    ids = found.groupBy("root").agg(F.min("first").alias("component_id"))
    return common.materialize(found.join(ids, "root").select("fp", "root", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "labels")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) and n_links (of the fingerprint)
    of every row."""
    rows = common.materialize(fingerprints(docs, shingle, seed), "fingerprints")
    return rows.join(labels(rows), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
