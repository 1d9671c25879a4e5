"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of two partial scores, over the first and the second half of the components. Vectors lie in full
blocks, numbered without gaps whatever the input's files, and each half of a block is a row of its own. A list is the
partial scores of one half; a task holds the lists of a block of queries over one half of a block of candidates.

1. Every task gathers, for each query, the k best entries of its list; these are merged to the k best of each whole
   list. The whole scores of these 2 k entries are resolved, and the k-th best is a safe cutoff: k candidates reach it.
2. The cutoffs go to all tasks. A candidate at or above the cutoff has a partial score of at least cutoff / 2, so the
   entries from there on suffice: they are sent, all others stay where they are.
3. Entries that both lists have sent are summed. Those that one has sent are resolved exactly, from the vectors of that
   query and candidate only. What reaches the cutoff is ranked, of a block's ties the k best only.

A block with a query block is one task's input whatever the table's size; tasks spread over the cluster. Entries travel
packed, a row for a list.

Rows: vectors that are null, or hold null or non-finite components, take no part. Shorter vectors count as padded with
zeros. A null vec_id is no query and ranks last among ties. Repeated rows are candidates each; only the query's own
row is left out. A query without candidates gives no rows; so does an empty table. Scores beyond a long count as its
limits. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzframe.llm import common

K = 20
SCALE = 64
PARTS = 2
BLOCK, QUERY_BLOCK = 2048, 1024
#: Queries of a task that are scored at once.
CHUNK = 256
#: Gathered lists that are merged in one step.
FAN_IN = 64
_NO_ID = _LEAST = -(1 << 63)
_MOST = (1 << 63) - 1


def scaled(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null if the vector takes no part."""
    usable = embedding.isNotNull() & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(usable, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _exact(data: np.ndarray) -> np.ndarray:
    """As doubles if every inner product of such values is exact in doubles, else as Python integers."""
    most = int(np.abs(data.astype(np.float64)).max(initial=0)) + 1
    return data.astype(np.float64) if most * most * max(1, data.shape[1]) < 1 << 52 else data.astype(object)


def _saturated(scores: np.ndarray) -> np.ndarray:
    """Scores beyond a long count as its limits; only Python integers can be."""
    return scores if scores.dtype != object else np.minimum(np.maximum(scores, _LEAST), _MOST)


def _below(score) -> float:
    """score as a double that is not above it."""
    return float(score) if isinstance(score, float) else math.nextafter(float(score), -math.inf)


def _numbered(rows: DataFrame, size: int) -> DataFrame:
    """rows with block and at: places without gaps, in full blocks. Only counts of partitions meet."""
    kept = common.materialize(rows.withColumn("part", F.spark_partition_id()).withColumn("local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    counts = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = common.materialize(counts.select("part", before.alias("before")), "offsets")  # a row for a task
    place = F.col("before") + F.col("local")
    return kept.join(offsets, "part").select("*", F.call_function("div", place, F.lit(size).cast("long")).alias("block"), (place % size).cast("int").alias("at")).drop("part", "local", "before")


def _packed(data: np.ndarray) -> tuple[str, bytes]:
    most = int(max(abs(int(data.max(initial=0))), abs(int(data.min(initial=0)))))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind, data.astype(kind).tobytes()


def _blocks(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """block, part, ids (of the vectors), rows (of the table), kind and data: a row for each half of each block. rows:
    vec_id, row_id, v."""

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("at")
        data = np.zeros((len(batch), dim), np.int64)
        for row, v in zip(data, batch["v"], strict=True):
            row[: len(v)] = v
        ids = batch["vec_id"].fillna(_NO_ID).astype(np.int64).to_numpy().tobytes()
        halves = [_packed(h) for h in (data[:, : dim // PARTS], data[:, dim // PARTS :])]
        return pd.DataFrame([(batch["block"].iloc[0], i, ids, batch["row_id"].to_numpy(np.int64).tobytes(), *h) for i, h in enumerate(halves)], columns=["block", "part", "ids", "rows", "kind", "data"])

    return common.ship(_numbered(rows, size)).groupBy("block").applyInPandas(pack, "block long, part int, ids binary, rows binary, kind string, data binary")


def _half(kind: str, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, -1).astype(np.int64)


class _Lists:
    """Partial scores of one half: a block of queries over a block of candidates."""

    def __init__(self, row):
        self.row = row
        self.q_rows, self.rows = np.frombuffer(row.q_rows, np.int64), np.frombuffer(row.rows, np.int64)
        both = _exact(np.concatenate([_half(row.q_kind, row.q_data, len(self.q_rows)), _half(row.kind, row.data, len(self.rows))]))
        self.q, self.v = both[: len(self.q_rows)], both[len(self.q_rows) :]
        self.low = -np.inf if both.dtype != object else -(1 << 200)
        order = np.argsort(self.rows)
        place = np.minimum(np.searchsorted(self.rows[order], self.q_rows), len(order) - 1)
        self.own = np.where(self.rows[order][place] == self.q_rows, order[place], -1)

    def chunks(self):
        """First query and partial scores of its chunk; least at a query's own row."""
        for at in range(0, len(self.q), CHUNK):
            scores = self.q[at : at + CHUNK] @ self.v.T
            own = self.own[at : at + CHUNK]
            scores[np.flatnonzero(own >= 0), own[own >= 0]] = self.low
            yield at, scores


def _gather(k: int):
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                lists = _Lists(row)
                n = min(k, len(lists.rows))
                for first, scores in lists.chunks():
                    top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                    found = [[{"score": _below(float(scores[i, j])), "block": row.block, "at": int(j)} for j in js if scores[i, j] > lists.low] for i, js in enumerate(top)]
                    yield pd.DataFrame({"q_block": row.q_block, "q_at": np.arange(first, first + len(found), dtype=np.int32), "part": row.part, "fan": row.block % FAN_IN, "entries": found})

    return best


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a list sends: the places of its entries from half the cutoff on, and their partial scores if these are exact
    as doubles."""
    for batch in batches:
        for row in batch.itertuples():
            lists, found = _Lists(row), []
            cut = np.full(len(lists.q), -np.inf)
            cut[np.asarray(row.cut_at, np.int64)] = row.cutoffs
            for first, scores in lists.chunks():
                q, v = np.nonzero((scores >= cut[first : first + len(scores), None] / PARTS) & (scores > lists.low))
                found.append((q + first, v, scores[q, v]))
            q, v, partial = (np.concatenate(x) for x in zip(*found, strict=True))
            sums = np.full(len(q), np.nan) if partial.dtype == object else partial
            yield pd.DataFrame({"q_block": [row.q_block], "block": [row.block], "part": [row.part], "q": [q.astype("<i4").tobytes()], "v": [v.astype("<i4").tobytes()], "partial": [sums.astype("<f8").tobytes()]})


def _whole_scores(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, candidates and whole scores of the entries of a block (sent: one or two lists of them)."""
    sent = [(np.frombuffer(x["q"], "<i4"), np.frombuffer(x["v"], "<i4"), np.frombuffer(x["partial"], "<f8")) for x in row.sent]
    n_q, n = len(row.q_ids) // 8, len(row.ids) // 8
    key = np.concatenate([q.astype(np.int64) * n + v for q, v, _ in sent])
    partial = np.concatenate([p for _, _, p in sent])
    pair, at, count = np.unique(key, return_inverse=True, return_counts=True)
    total = np.bincount(at, partial, minlength=len(pair))
    q, v = pair // n, pair % n
    open_ = np.flatnonzero((count < PARTS) | np.isnan(total))
    if not len(open_):
        return q, v, total
    qs, vs = (np.concatenate([_half(x["kind"], x["data"], m) for x in sorted(halves, key=lambda x: x["part"])], axis=1) for halves, m in ((row.q_halves, n_q), (row.halves, n)))
    both = _exact(np.concatenate([qs, vs]))
    qs, vs = both[:n_q], both[n_q:]
    total = total.astype(both.dtype)
    for a in range(0, len(open_), 65536):
        some = open_[a : a + 65536]
        total[some] = (qs[q[some]] * vs[v[some]]).sum(axis=1)
    return q, v, _saturated(total)


def _resolve(k: int, ranked: bool):
    """Whole scores of sent entries. Of ties at a block's k-th place the k best by vec_id are enough."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                q, v, total = _whole_scores(row)
                if not ranked:
                    yield pd.DataFrame({"q_block": row.q_block, "q_at": q.astype(np.int32), "score": [_below(x) for x in total.tolist()]})
                    continue
                cut = np.full(len(row.q_ids) // 8, -np.inf)
                cut[np.asarray(row.cut_at, np.int64)] = row.cutoffs
                keep = np.flatnonzero(total >= cut[q])
                q, total, ids = q[keep], total[keep], np.frombuffer(row.ids, np.int64)[v[keep]]
                order = np.lexsort((ids, ids == _NO_ID, -total, q))
                q, total, ids = q[order], total[order], ids[order]
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                q, total, ids = q[nth < k], total[nth < k], ids[nth < k]
                vec = pd.array(ids, dtype="Int64")
                vec[ids == _NO_ID] = pd.NA
                yield pd.DataFrame({"q_block": row.q_block, "q_at": q.astype(np.int32), "query_id": np.frombuffer(row.q_ids, np.int64)[q], "vec_id": vec, "score": np.array(list(map(int, total)), np.int64)})

    return rows


def top_k(vectors: DataFrame, k: int = K, divisor: int = 20, scale: int = SCALE) -> DataFrame:
    """vectors: vec_id, embedding. query_id, rank, vec_id and score of the k best candidates of each row whose vec_id is
    divisible by divisor."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v")).where(F.col("v").isNotNull())
    rows = common.materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "vectors")
    dim = max(PARTS, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    blocks = common.materialize(_blocks(rows, dim, BLOCK), "vector-blocks")
    queries = common.materialize(_blocks(rows.where(F.col("vec_id") % divisor == 0), dim, QUERY_BLOCK), "query-blocks")
    lists = _cells(blocks, queries)
    # 1: the best entries of each list, their whole scores, a safe cutoff
    entry = "array<struct<score:double,block:long,at:int>>"
    sent = lists.mapInPandas(_gather(k), f"q_block long, q_at int, part int, fan long, entries {entry}")
    merged = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c)), asc=False), 1, k)
    best = sent.groupBy("q_block", "q_at", "part", "fan").agg(merged("entries").alias("entries")).groupBy("q_block", "q_at", "part").agg(merged("entries").alias("entries"))
    best = best.select("q_block", "q_at", F.explode("entries").alias("e")).select("q_block", "q_at", "e.block", "e.at").distinct()
    pairs = common.ship(best).groupBy("q_block", "block").applyInPandas(_pack_places, "q_block long, block long, q binary, v binary, partial binary")
    scores = _with_vectors(pairs, blocks, queries).mapInPandas(_resolve(k, False), "q_block long, q_at int, score double")
    kth = scores.groupBy("q_block", "q_at").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("cutoff"))  # of 2 k scores
    cutoffs = kth.where("cutoff IS NOT NULL").groupBy(F.col("q_block").alias("of")).agg(F.collect_list(F.struct("q_at", "cutoff")).alias("c"))
    cutoffs = common.materialize(cutoffs.select("of", F.col("c.q_at").alias("cut_at"), F.col("c.cutoff").alias("cutoffs")), "cutoffs")
    # 2: entries from half the cutoff on
    with_cutoffs = lambda df: df.join(cutoffs, F.col("q_block") == F.col("of"), "left").withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in (("cut_at", "array<int>"), ("cutoffs", "array<double>"))}).drop("of")
    enough = common.materialize(with_cutoffs(lists).mapInPandas(_entries, "q_block long, block long, part int, q binary, v binary, partial binary"), "entries")
    # 3: whole scores
    found = with_cutoffs(_with_vectors(enough.where(F.length("q") > 0), blocks, queries)).mapInPandas(_resolve(k, True), "q_block long, q_at int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q_block", "q_at").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pack_places(batch: pd.DataFrame) -> pd.DataFrame:
    """The places of one pair of blocks as one row of entries without partial scores."""
    none = np.full(len(batch), np.nan).astype("<f8").tobytes()
    return pd.DataFrame({"q_block": batch["q_block"].iloc[:1], "block": batch["block"].iloc[:1], "q": [batch["q_at"].to_numpy("<i4").tobytes()], "v": [batch["at"].to_numpy("<i4").tobytes()], "partial": [none]})


def _with_vectors(entries: DataFrame, blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """A row for each pair of blocks with entries: the lists sent, ids and both halves of both sides."""
    sent = entries.groupBy("q_block", "block").agg(F.collect_list(F.struct("q", "v", "partial")).alias("sent"))
    halves = lambda df, name: df.groupBy("block").agg(F.first("ids").alias("ids"), F.collect_list(F.struct("part", "kind", "data")).alias(name))
    of_queries = halves(queries, "q_halves").select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), "q_halves")
    return sent.join(halves(blocks, "halves").hint("merge"), "block").join(of_queries.hint("merge"), "q_block")


def _cells(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query block with every candidate block, half by half: a stated query set against all rows, in blocks. Both
    sides are repeated for the other's numbers, and meet by the pair."""
    count = lambda df: df.agg(F.max("block")).first()[0]
    n, n_q = (0 if (m := count(df)) is None else m + 1 for df in (blocks, queries))
    up_to = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")) if m else F.array().cast("array<long>"))
    left = queries.select(F.col("block").alias("q_block"), "part", F.col("rows").alias("q_rows"), F.col("kind").alias("q_kind"), F.col("data").alias("q_data"), up_to(n).alias("block"))
    right = blocks.select("block", "part", "rows", "kind", "data", up_to(n_q).alias("q_block"))
    return left.join(right.hint("merge"), ["q_block", "block", "part"])
