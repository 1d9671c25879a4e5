"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are compared through ``threshold`` bytes only, most significant digits first, and a suffix leaves as soon as
it is alone with its digits so far; what is left after the last digit in equal groups are exactly the repeated windows.
A table of all suffixes (an entry a byte) does not fit, so the first digit is taken where texts agree to take it:

1. Gram: of every window of ``threshold`` bytes, the least of its 256-byte grams by hash is its anchor. Equal windows
   have the same anchor at the same place, so a window whose anchor's gram is alone in the corpus is alone. Grams are
   counted first, anchors whose gram is repeated made second, so that only these are written. A bit filter of a fixed
   size tells them; what it lets pass wrongly leaves with the next digit.
2. Surroundings: the bytes of all windows of an anchor. Where two anchors agree in these, all windows are repeated.
3. Windows: anchors that share a gram but not all surroundings send, one of each kind, the bytes around the gram once.
   These meet by gram, and the windows' hashes are sorted there; equal neighbours are repeated windows.

Hot grams are those with more than a ten-thousandth of all anchors, so there are at most ten thousand, whatever the
corpus; their list alone is broadcast, and marks the anchors as they are made. All other grams meet in groups of at most
that size, or of common.LEAST_HOT. The anchors of hot grams are dealt by finer digits: by surroundings with partial sums,
then by cores (the windows of an anchor lie in groups of CORE neighbours; a core is what all of a group have in common;
cores that are alone leave), then by windows. Most of them are repeated, so none is sent to its surroundings and back:
those with surroundings of their own come out of the sums, and are taken from their documents' anchors. Cores and windows
that are hot again are joined by a broadcast of at most ten thousand of them. So a passage in any number of documents,
or a group of copies of any size, is no task's burden.

All windows of one anchor overlap in its gram, so an anchor needs only its first and last repeated window, and a
document the union of its anchors' intervals. Digits are compared as two independent 64-bit polynomial hashes. Texts
are shuffled only where a filter of a fixed size says that they may hold something to remove; it saves work while the
corpus is small enough, and decides nothing. No task has more than one Python worker at a time, as an executor's memory
holds the workers of all its tasks, and keeps them between stages.

Rows: a null text is an empty one; texts below the threshold keep all bytes. Repeated rows are documents each, so they
repeat each other. Texts are handled whole; a text of one repeated character is linear, too. A null doc_id is kept.
An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzframe.llm import common

THRESHOLD = 400
GRAM = 256
#: Neighbouring windows that share a core.
CORE = 16
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(m, -1, 1 << 64) for m in _MULTIPLIERS)
ANCHORS = "doc_id long, text_hash long, at int, low int, high int, gram long, around long, hot boolean"
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base or more; a worker keeps the longest run that it needed."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(1 << max(16, n.bit_length()), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base]


@lru_cache(maxsize=2)
def _letters(i: int) -> np.ndarray:
    return np.random.default_rng(20_24 + i).integers(0, 1 << 64, 256, dtype=np.uint64)


class _Prefixes:
    """Hashes of any substrings of one text; i is one of two independent hash functions."""

    def __init__(self, text: bytes):
        self.bytes = np.frombuffer(text, np.uint8)
        self.sums: dict[int, np.ndarray] = {}

    def hashes(self, start: np.ndarray, end: np.ndarray, i: int) -> np.ndarray:
        n = len(self.bytes)
        if i not in self.sums:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_letters(i)[self.bytes] * _powers(_MULTIPLIERS[i], n)[:n], out=sums[1:])
            self.sums[i] = sums
        sums = self.sums[i]
        h = (sums[end] - sums[start]) * _powers(_INVERSES[i], n + 1)[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h


def _rolling(x: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick over every run of width values, by running picks from both sides of blocks of that width."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, fill, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    forth = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], forth[width - 1 : width - 1 + n])


def anchors(prefixes: _Prefixes, threshold: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, their hashes, and how far before it each one's last and first window start. A window's
    anchor is the first of its grams with the least hash, so the windows of an anchor are neighbours."""
    n, width = len(prefixes.bytes), threshold - gram + 1
    starts = np.arange(n - gram + 1)
    h = prefixes.hashes(starts, starts + gram, 0)
    least = _rolling(h, width, np.minimum, (1 << 64) - 1)
    around = np.zeros(len(h) + width - 1, np.uint64)
    around[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(_rolling(around, width, np.maximum, 0)[: len(h)] == h)
    place = np.searchsorted(at, starts[: len(least)])
    while len(wrong := np.flatnonzero(h[at[place]] != least)):
        place[wrong] += 1
    first = np.flatnonzero(np.diff(place, prepend=-1))
    own = at[place[first]]
    last = np.append(first[1:], len(least)) - 1
    return own, h[own], own - last, own - first


def _documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.encode(text, "UTF-8").alias("data"))


def _gram_rows(threshold: int, gram: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams = [anchors(_Prefixes(data), threshold, gram)[1] for data in batch["data"] if len(data) >= threshold]
            if grams:
                found, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pd.DataFrame({"gram": found.view(np.int64), "n": n})

    return rows


def _anchor_rows(threshold: int, gram: int, wanted, hot):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            owner, parts = [], []
            for i, data in enumerate(batch["data"]):
                if len(data) < threshold:
                    continue
                prefixes = _Prefixes(data)
                at, h, low, high = anchors(prefixes, threshold, gram)
                at, h, low, high = (x[common.passes(wanted.value, h.view(np.int64))] for x in (at, h, low, high))
                if len(at):
                    owner.append(np.full(len(at), i))
                    parts.append((at, low, high, h, prefixes.hashes(at - high, at - low + threshold, 1)))
            if owner:
                owners = np.concatenate(owner)
                at, low, high, h, around = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].astype("Int64").array[owners], "text_hash": batch["text_hash"].to_numpy()[owners], "at": at.astype(np.int32), "low": low.astype(np.int32), "high": high.astype(np.int32),
                    "gram": h.view(np.int64), "around": around.view(np.int64), "hot": np.isin(h.view(np.int64), hot.value),
                })

    return rows


def _contexts(threshold: int):
    """The bytes of all windows of the wanted anchors."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(w["anchor"], w["gram"], w["hot"], w["low"], w["high"], data[w["at"] - w["high"] : w["at"] - w["low"] + threshold]) for data, wanted in zip(batch["data"], batch["wanted"], strict=True) for w in wanted]
            yield pd.DataFrame(made, columns=["anchor", "gram", "hot", "low", "high", "context"])

    return rows


def _repeated_windows(threshold: int):
    """Of rows that come gram by gram: the anchors with windows that another anchor has, too, and the nearest and
    farthest start of these."""
    every = lambda row: (x := np.arange(row.low, row.high + 1), -x, -x + threshold)

    def ends(rows: pd.DataFrame) -> pd.DataFrame:
        made = pd.concat([*_digits(iter([rows]), every), pd.DataFrame({c: pd.Series(dtype=np.int64) for c in ("anchor", "number", "digit1", "digit2")})])
        digits = made[["digit1", "digit2", "number"]].to_numpy(np.int64)
        order = np.lexsort(digits.T)
        same = (digits[order][1:] == digits[order][:-1]).all(axis=1)
        repeated = np.zeros(len(made), bool)
        repeated[order[1:][same]] = repeated[order[:-1][same]] = True
        found = made[repeated].groupby("anchor")["number"].agg(["min", "max"])
        return pd.DataFrame({"anchor": found.index.astype(np.int64), "nearest": found["min"].astype(np.int32), "farthest": found["max"].astype(np.int32)})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            for at in range(0, len(batch), 4000):
                part = batch.iloc[at : at + 4000]
                part = part if rest is None else pd.concat([rest, part])
                whole = (part["gram"] != part["gram"].iloc[-1]).to_numpy()
                rest = part[~whole]
                if whole.any():
                    yield ends(part[whole])
        if rest is not None:
            yield ends(rest)

    return rows


def _digits(batches: Iterator[pd.DataFrame], pick) -> Iterator[pd.DataFrame]:
    """pick(row): the groups or offsets of a context, and first and end byte of each, counted from the anchor's place."""
    for batch in batches:
        owner, number, made = [], [], []
        for row in batch.itertuples():
            of, begin, end = pick(row)
            prefixes = _Prefixes(row.context)
            made.append([prefixes.hashes(begin + row.high, end + row.high, k).view(np.int64) for k in (0, 1)])
            owner.append(np.full(len(of), row.anchor))
            number.append(of)
        if made:
            d1, d2 = (np.concatenate(x) for x in zip(*made, strict=True))
            yield pd.DataFrame({"anchor": np.concatenate(owner), "number": np.concatenate(number).astype(np.int32), "digit1": d1, "digit2": d2})


def _cores(threshold: int, core: int):
    def pick(row):
        groups = np.arange(row.low // core, row.high // core + 1)
        return groups, -core * groups, -core * groups - (core - 1) + threshold

    return lambda batches: _digits(batches, pick)


def _windows(threshold: int, core: int):
    def pick(row):
        groups = np.asarray(sorted(row.groups))
        offsets = (groups[:, None] * core + np.arange(core)).ravel()
        offsets = offsets[(offsets >= row.low) & (offsets <= row.high)]
        return offsets, -offsets, -offsets + threshold

    return lambda batches: _digits(batches, pick)


def _without(data: bytes, spans) -> tuple[int, int, int, str, str]:
    """n_bytes, n_removed, n_spans, kept_sha256 and text of one document."""
    left, at, removed, runs = [], 0, 0, 0
    for start, end in sorted((s["start"], s["end"]) for s in ([] if spans is None else spans)):
        if start > at or runs == 0:
            left.append(data[at:start])
            runs += 1
            removed += end - start
            at = end
        elif end > at:
            removed += end - at
            at = end
    kept = b"".join([*left, data[at:]])
    return len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")


def _kept_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.iloc[at : at + 500]
            made = pd.DataFrame(map(_without, part["data"], part["spans"]), columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])
            made.insert(0, "doc_id", part["doc_id"].astype("Int64").array)
            yield made


def _counted(df: DataFrame, digits: list[str], *more, name: str) -> DataFrame:
    return common.materialize(df.groupBy(*digits).agg(F.count(F.lit(1)).alias("n"), *more).where("n > 1"), name)


def _repeated(df: DataFrame, counts: DataFrame, digits: list[str]) -> DataFrame:
    """The rows of df whose digits are in counts (digits, n > 1)."""
    return common.join_counted(df, counts.select(*digits, "n"), digits).drop("n")


def _may_have(found: DataFrame):
    """What a filter says of texts: may they have a row in found."""
    return common.passing(common.bit_filter(found.select(F.xxhash64("of_doc", "of_text").alias("key"))), F.xxhash64("doc_id", "text_hash"))


def _with_spans(texts: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """texts joined with found (of_doc, of_text and others)."""
    same = texts["doc_id"].eqNullSafe(found["of_doc"]) & (texts["text_hash"] == found["of_text"])
    return texts.join(found.hint("merge"), same, how).drop("of_doc", "of_text")


def _whole_rows(texts: DataFrame) -> DataFrame:
    """The result of texts that lose nothing."""
    none = F.lit(0).cast("long")
    return texts.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("data", 256).alias("kept_sha256"), F.col("data").cast("string").alias("text"))


def _hot_kinds(alive: DataFrame, around: list[str]) -> DataFrame:
    """Of anchors of hot grams: one of each kind, n (anchors with equal surroundings) and n_kinds of the gram."""
    kinds = alive.groupBy(*around).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_hash", "at")).alias("chosen"))
    kinds = common.materialize(kinds, "hot-kinds")
    many = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("n_kinds"))  # of the grams of a broadcast list
    return kinds.join(F.broadcast(common.materialize(many, "hot-grams")), "gram").select("chosen.*", "low", "high", "gram", "n", "n_kinds")


def _span(start: Column, end: Column) -> Column:
    """Both in one long, so that sets of spans are told apart by hash."""
    return F.shiftleft(start.cast("long"), 32).bitwiseOR(end.cast("long"))


def _whole_span(threshold: int) -> Column:
    """The bytes of all windows of an anchor. Anchors share no window, so that it is no other one's of the document."""
    return _span(F.col("at") - F.col("high"), F.col("at") - F.col("low") + threshold)


def _hot_ends(contexts: DataFrame, threshold: int, core: int) -> DataFrame:
    """anchor, nearest and farthest repeated window, by cores, then by windows."""
    digits, columns = ["number", "digit1", "digit2"], "anchor long, number int, digit1 long, digit2 long"
    cores = common.materialize(contexts.mapInPandas(_cores(threshold, core), columns), "cores")
    left = _repeated(cores, _counted(cores, digits, name="core-counts"), digits).groupBy("anchor").agg(F.collect_set("number").alias("groups"))
    windows = common.materialize(contexts.join(left, "anchor").mapInPandas(_windows(threshold, core), columns), "windows")
    return _repeated(windows, _counted(windows, digits, name="window-counts"), digits).groupBy("anchor").agg(F.min("number").alias("nearest"), F.max("number").alias("farthest"))


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, core: int = CORE) -> DataFrame:
    """of_doc, of_text (hash) and spans (array of start, end; they may overlap) of documents with repeated bytes."""
    texts = common.ship(_documents(docs))
    n = common.partitions(docs)
    grams = texts.select("data").mapInPandas(_gram_rows(threshold, gram), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    grams = common.materialize(grams, "grams")
    hot = np.array([row["gram"] for row in common.hot_keys(grams, ["gram"])[0].collect()], np.int64)
    hot = docs.sparkSession.sparkContext.broadcast(hot)
    alive = common.materialize(texts.mapInPandas(_anchor_rows(threshold, gram, common.bit_filter(grams.select("gram")), hot), ANCHORS), "anchors")
    # second digit: equal surroundings. Cold grams meet whole; one shuffle serves all windows
    around = ["gram", "low", "high", "around"]
    cold = alive.where("NOT hot").repartition(n, "gram")
    kind, in_order = Window.partitionBy(*around), Window.partitionBy(*around).orderBy("doc_id", "text_hash", "at")
    cold = cold.withColumn("n", F.count(F.lit(1)).over(kind)).withColumn("first", F.row_number().over(in_order) == 1)
    cold = cold.withColumn("n_kinds", F.sum(F.col("first").cast("long")).over(Window.partitionBy("gram"))).drop("around")
    kinds = _hot_kinds(alive.where("hot"), around).withColumn("first", F.lit(True)).withColumn("hot", F.lit(True))
    rows = cold.where("n > 1 OR (first AND n_kinds > 1)").unionByName(kinds.where("n_kinds > 1"))
    rows = common.materialize(rows.withColumn("anchor", F.monotonically_increasing_id()), "repeated")
    owner = F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text")
    # the bytes around one anchor of each kind, where a gram has several kinds
    edges = rows.where("first AND n_kinds > 1")
    wanted = edges.groupBy(*owner).agg(F.collect_list(F.struct("anchor", "gram", "hot", "at", "low", "high")).alias("wanted"))
    wanted = common.materialize(wanted, "wanted")
    with_wanted = _with_spans(texts.where(_may_have(wanted)), wanted, "inner").dropDuplicates(["doc_id", "text_hash"]).select("data", "wanted")
    contexts = common.materialize(with_wanted.mapInPandas(_contexts(threshold), "anchor long, gram long, hot boolean, low int, high int, context binary"), "contexts")
    # last digit: windows
    near = contexts.where("NOT hot").repartition(n, "gram").sortWithinPartitions("gram")
    ends = near.mapInPandas(_repeated_windows(threshold), "anchor long, nearest int, farthest int").unionByName(_hot_ends(contexts.where("hot"), threshold, core))
    ends = common.materialize(ends, "ends")
    # all anchors of hot grams are repeated but those that are alone of their kind
    whole, none = _whole_span(threshold), F.lit(None).cast("long")
    by_around = rows.where("n > 1 AND NOT hot").select(*owner, whole.alias("span"), none.alias("may"), none.alias("alone"))
    by_window = edges.where("n = 1").join(ends, "anchor").select(*owner, _span(F.col("at") - F.col("farthest"), F.col("at") - F.col("nearest") + threshold).alias("span"), none.alias("may"), none.alias("alone"))
    of_hot = alive.where("hot").select(*owner, none.alias("span"), whole.alias("may"), none.alias("alone"))
    alone = rows.where("n = 1 AND hot").select(*owner, none.alias("span"), none.alias("may"), whole.alias("alone"))
    sets = by_around.union(by_window).union(of_hot).union(alone).groupBy("of_doc", "of_text").agg(*(F.collect_set(c).alias(c) for c in ("span", "may", "alone")))
    spans = sets.select("of_doc", "of_text", F.array_union("span", F.array_except("may", "alone")).alias("spans")).where(F.size("spans") > 0)
    ends_of = lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("start"), x.bitwiseAND((1 << 32) - 1).cast("int").alias("end"))
    return spans.withColumn("spans", F.transform("spans", ends_of))


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text (what is left; a character that lost some of its bytes
    is left out) of every row."""
    texts = common.ship(_documents(docs))
    spans = common.materialize(repeated_spans(docs, threshold, gram), "spans")
    # never two Python workers in one task: those that the filter keeps back need none after it
    sent = _may_have(spans)
    cut = _with_spans(texts.where(sent), spans, "left").select("doc_id", "data", "spans").mapInPandas(_kept_rows, KEPT)
    return cut.unionByName(_whole_rows(texts.where(~sent)))
