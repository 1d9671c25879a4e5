"""One document of each group of near copies: SimHash links and bands first, then an exact join of what these miss.

Near copies are texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8. Their 64-bit
fingerprints differ in about ten bits, which no pigeonring filter can search with few candidates: fingerprints find the
closest copies only. So candidates come from two sides: pairs of fingerprints that ``simhash.links`` finds, and texts
that share a band of minimum hashes. A pair of similarity 0.8 shares one of 20 bands of six hashes with probability
0.997. In a band each text is held against one text of its bucket only, a different one in each band, so a text has at
most a candidate a band and a group is linked through many hubs. These links make most groups, cheaply; they miss some.

What they miss comes from a prefix join that loses no link, between texts of different groups only. With the shingles of
all texts in one order, near copies share at least l shingles among the first n - ceil(0.8 n) + l of each:

1. Of each text so many of its least hashes are kept, with l a tenth of n. Those that one text alone keeps link nothing,
   and a text with fewer than l others has no near copy. That leaves few texts.
2. The same with the shingles that texts of two groups keep: a group of near copies of any size leaves as a whole.
3. What is left is decided over all its shingles: 0.8 of them must be held by another group, too. Ordered by the number of
   texts that hold them, rare ones first, texts meet at one of their first n - ceil(0.8 n) + 1. Two texts of n and m must
   share 4 / 9 of n + m, so the first shingle that they share has so many at or after its place in both, or they part.

Every candidate pair is decided by its similarity over the whole texts. Only texts with a candidate are moved, once to
their own rows and once to each pair; pairs with one hub are dealt by the skew handling of the join. Copies of a text are
one node from the start, however many. Bit filters of a fixed size save work and decide nothing.

Rows: a null text is an empty one; texts without words are near copies of each other. A null doc_id counts as the
greatest. Repeated rows are one document. Texts are compared whole, whatever their length. An empty table gives no
rows. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzframe.llm import common, simhash

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 6
#: How many of the shingles that two near copies share lie among their kept ones: an eighth.
SHARE = 8
_NO_WORDS = (1 << 64) - 1


def _factors(n: int) -> np.ndarray:
    """Odd numbers that stand for n permutations of the 64-bit numbers."""
    return np.random.default_rng(20_25).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def needed(n, least: float):
    """The fewest shingles that a text with n of them shares with a near copy, and the fewest that such a copy has."""
    return np.ceil(least * n - 1e-9).astype(np.int64)


def among_first(n, least: float):
    """How many shingles two near copies share among their kept ones, the smaller one having n."""
    return -(-needed(n, least) // SHARE)


def sketch(text: bytes, factors: np.ndarray, shingle: int = SHINGLE, seed: int = simhash.SEED) -> tuple[int, np.ndarray, np.ndarray]:
    """The fingerprint of a text, its bands (hashes of the least shingles under each permutation), and its distinct hashes
    in order."""
    counts, n, every = np.zeros(64, np.int64), 0, [np.zeros(0, np.uint64)]
    least = np.full(len(factors), _NO_WORDS, np.uint64)
    for block in simhash.hashes(text, shingle, seed):
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(block)
        every.append(block)
        for at in range(0, len(block), 1024):
            mixed = block[at : at + 1024, None] * factors
            np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0), out=least)
    rows = least.reshape(-1, ROWS)
    bands = np.zeros(len(rows), np.uint64)
    for i in range(ROWS):
        bands = (bands ^ rows[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
        bands ^= bands >> np.uint64(31)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0]), bands.view(np.int64), np.unique(np.concatenate(every)).view(np.int64)


def _key(text: Column) -> Column:
    return common.text_key(F.coalesce(text, F.lit("")))


def sketches(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, least: float = SIMILARITY) -> DataFrame:
    """doc_id, hash and length (of the text), fp, bands, n (distinct shingles), first (the kept ones) and row (an id) of
    every row."""
    factors = _factors(bands * ROWS)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps, bands, first, sizes = [], [], [], []
            for t in batch["text"]:
                fp, band, found = sketch(t.encode(), factors, shingle)
                n = np.int64(len(found))
                fps.append(fp)
                bands.append(band)
                first.append(found[: n - needed(n, least) + among_first(n, least)].copy())
                sizes.append(n)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "hash": batch["hash"], "length": batch["length"], "fp": np.array(fps, np.int64), "bands": bands, "n": np.array(sizes, np.int64), "first": first})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.inline(F.array(_key(docs["text"]))))
    rows = common.ship(rows).mapInPandas(made, "doc_id long, hash long, length int, fp long, bands array<long>, n long, first array<long>")
    return rows.withColumn("row", F.monotonically_increasing_id())


def candidates(nodes: DataFrame) -> DataFrame:
    """nodes: node, fp, bands. node and hub: pairs that may be near copies, hub the smaller."""
    # one text of each bucket, another one in each band of the same texts
    banded = common.materialize(nodes.select("node", F.posexplode("bands").alias("band", "bucket")), "bands")
    buckets = banded.groupBy("band", "bucket").agg(F.min_by("node", F.xxhash64("node", "band")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    by_band = common.join_counted(banded, common.materialize(buckets, "buckets"), ["band", "bucket"]).select("node", "hub")
    # texts with one fingerprint, and with linked ones
    classes = nodes.groupBy("fp").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n"))
    classes = common.materialize(classes, "fingerprint-classes")
    same = common.join_counted(nodes.select("node", "fp"), classes.where("n > 1"), ["fp"]).select("node", "hub")
    links = simhash.links(classes.select("fp"))
    hub_of = lambda fp, name: classes.select(F.col("fp").alias(fp), F.col("hub").alias(name))
    linked = links.join(hub_of("a", "x"), "a").join(hub_of("b", "y"), "b").select(F.greatest("x", "y").alias("node"), F.least("x", "y").alias("hub"))
    both = by_band.union(same).union(linked).where("node <> hub")
    return both.select(F.greatest("node", "hub").alias("node"), F.least("node", "hub").alias("hub")).distinct()


def similarity(a: bytes, b: bytes, shingle: int = SHINGLE) -> float:
    """Jaccard similarity of the sets of shingles; one if there are none."""
    x, y = ({s for block in simhash.shingles(t, shingle) for s in block} for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def _similar(least: float, shingle: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [similarity(a.encode(), b.encode(), shingle) >= least for a, b in zip(batch["text"], batch["hub_text"], strict=True)]
            yield batch.loc[keep, ["node", "hub"]]

    return rows


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text of every row of wanted (node, hash, length)."""
    texts = common.ship(docs).select(F.inline(F.array(_key(docs["text"]))), F.coalesce(docs["text"], F.lit("")).alias("text"))
    texts = texts.where(common.passing(common.bit_filter(wanted.select("hash")), F.col("hash"))).dropDuplicates(["hash", "length"])
    return common.materialize(texts.join(wanted.hint("merge"), ["hash", "length"]).select("node", "text"), "moved-texts")


def _links(pairs: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """The pairs (node, hub) that are near copies; texts: node, text."""
    hubs = texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text"))
    both = pairs.join(texts.hint("merge"), "node").join(hubs.hint("merge"), "hub")
    return common.materialize(both.mapInPandas(_similar(least, shingle), "node long, hub long"), "near-copies")


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (node and others) with root, the least node that each reaches by links (node, hub)."""
    roots = simhash.components(links.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _first_shingles(wanted):
    """Kept shingles of the rows that wanted lets pass, counted in each batch."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[common.passes(wanted.value, batch["row"].to_numpy(np.int64))]
            if len(batch):
                found, n = np.unique(np.concatenate([np.asarray(x, np.int64) for x in batch["first"]]), return_counts=True)
                yield pd.DataFrame({"shingle": found, "n": n})

    return counted


def _alive(wanted, repeated, least: float):
    """Of rows that wanted lets pass: the kept shingles that repeated lets pass, if these are enough for a near copy."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[common.passes(wanted.value, batch["row"].to_numpy(np.int64))]
            enough = among_first(needed(batch["n"].to_numpy(np.int64), least), least)
            for row, first, k in zip(batch["row"], batch["first"], enough, strict=True):
                found = np.asarray(first, np.int64)
                found = found[common.passes(repeated.value, found)]
                if len(found) and len(found) >= k:
                    yield pd.DataFrame({"node": np.full(len(found), row), "enough": np.full(len(found), k), "shingle": found})

    return rows


def _of_two_groups(shingles: DataFrame, name: str) -> DataFrame:
    """shingles (shingle, root and others) that texts with different roots hold, with n, the number of rows of each."""
    counts = shingles.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    return common.join_counted(shingles, common.materialize(counts.select("shingle", "n"), name), ["shingle"])


def _all_shingles(shingle: int, least: float):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, root, text in zip(batch["node"], batch["root"], batch["text"], strict=True):
                found = np.unique(np.concatenate(list(simhash.hashes(text.encode(), shingle)))).view(np.int64)
                yield pd.DataFrame({"node": node, "root": root, "size": len(found), "needed": needed(np.int64(len(found)), least), "shingle": found})

    return rows


def missed(rows: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """node, hub: all near copies with different roots; rows: the sketches of docs, nodes: node (the row of one of each
    text), hash, length, root."""
    kept = rows.where("n > 0").select("row", "n", "first")
    one_each = common.bit_filter(nodes.select("node"))
    repeated = kept.mapInPandas(_first_shingles(one_each), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1").select("shingle")
    repeated = common.bit_filter(common.materialize(repeated, "repeated-shingles"))
    alive = common.materialize(kept.mapInPandas(_alive(one_each, repeated, least), "node long, enough long, shingle long"), "alive")
    # rows of copies that the filter let pass have no node
    alive = common.materialize(alive.join(nodes.select("node", "root"), "node"), "alive-of-groups")
    left = _of_two_groups(alive, "shingles-of-groups").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("enough").alias("enough")).where("n >= enough")
    left = common.materialize(left.select("node").join(nodes.select("node", "hash", "length", "root"), "node"), "left")
    texts = _texts(docs, left.select("node", "hash", "length"))
    every = texts.join(left.select("node", "root"), "node").mapInPandas(_all_shingles(shingle, least), "node long, root long, size long, needed long, shingle long")
    shared = _of_two_groups(common.materialize(every, "all-shingles"), "all-shingles-of-groups")
    of_text = Window.partitionBy("node")
    shared = shared.withColumns({"place": F.row_number().over(of_text.orderBy("n", "shingle")), "n_shared": F.count(F.lit(1)).over(of_text)})
    # onward: shingles at or after this one; those of one group are before all others
    first = shared.where("place <= n_shared - needed + 1").select("node", "root", "size", (F.col("n_shared") - F.col("place") + 1).alias("onward"), "shingle")
    first = common.materialize(first, "first-shingles")
    other = first.select("shingle", *(F.col(c).alias(f"hub_{c}") for c in ("node", "root", "size", "onward")))
    enough = F.least("onward", "hub_onward") >= F.ceil((F.col("size") + F.col("hub_size")) * (least / (1 + least)) - 1e-9)
    meet = first.join(other.hint("merge"), "shingle").where("node > hub_node AND root <> hub_root").where(enough)
    pairs = common.materialize(meet.select("node", F.col("hub_node").alias("hub")).distinct(), "more-candidates")
    return _links(pairs, texts, least, shingle)


def components(rows: DataFrame, docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """hash, length, doc_id (the smallest of this text) and root (the group of near copies) of every distinct text; rows:
    the sketches of docs."""
    nodes = rows.groupBy("hash", "length").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min("row").alias("node"))
    nodes = common.materialize(nodes, "nodes")
    pairs = common.materialize(candidates(nodes.select("node", "fp", "bands")), "candidates")
    moved = pairs.select(F.explode(F.array("node", "hub")).alias("node")).distinct().join(nodes, "node").select("node", "hash", "length")
    links = _links(pairs, _texts(docs, common.materialize(moved, "moved")), least, shingle)
    nodes = common.materialize(_roots(nodes.drop("fp", "bands"), links), "groups")
    more = missed(rows, nodes, docs, shingle, least)
    # groups that the missed links unite
    of = nodes.select("node", "root")
    more = more.join(of, "node").join(of.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub").select(F.col("root").alias("node"), F.col("hub_root").alias("hub")).distinct()
    groups = nodes.select("hash", "length", "doc_id", F.col("root").alias("node"))
    return _roots(groups, common.materialize(more, "group-links")).drop("node")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest doc_id; of rows that tie, one."""
    rows = common.materialize(sketches(docs, shingle, bands, least), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "hash", "length")
    kept = common.materialize(components(rows, docs, shingle, least).groupBy("root").agg(F.min(first).alias("kept")).select("kept.*"), "kept")
    same = (rows["hash"] == kept["hash"]) & (rows["length"] == kept["length"]) & rows["doc_id"].eqNullSafe(kept["doc_id"])
    n = rows.select("hash", "length", "doc_id").join(kept.hint("merge"), same).groupBy(kept["hash"], kept["length"], kept["doc_id"]).agg(F.count(F.lit(1)).alias("n"))
    n = common.materialize(n.select(F.struct("hash", "length").alias("key"), "doc_id", "n"), "kept-rows")
    found = docs.join(n.hint("merge"), (_key(docs["text"]) == n["key"]) & docs["doc_id"].cast("long").eqNullSafe(n["doc_id"]))
    found = found.select(F.struct(*(docs[c] for c in docs.columns)).alias("d"), n["key"].alias("key"), n["n"].alias("n"))
    if n.where("n > 1").isEmpty():
        return found.select("d.*")
    again = found.where("n > 1").groupBy("key").agg(F.first("d").alias("d"))
    return found.where("n = 1").select("d.*").union(again.select("d.*"))
