"""Quality classifier by co-training of two views.

The content view sees the words (hashed words, word beginnings, how much repeats); the metadata view sees what is noted
of a page without reading its words (source, language, length, lines and their lengths, shares of classes of
characters). No figure is in both. Without the shares of characters the metadata view would not suffice by itself, as
co-training needs: on the test tables its balanced accuracy is 0.53 then, and what it hands over spoils the content
view. Both are logistic regressions. In each round both views score every unlabelled document of the corpus on the executors, and each hands
``handed`` of its confident good and as many of its confident bad ones, with these labels, to the other. The handed ones
are the first in hash order of all that a view is sure of, so they stand for the whole corpus; what is handed in one
round stays for the next. Both are then calibrated on labelled rows that were held out, and a regression on the two
calibrated scores combines them. The content view's most telling word for the toxic labels scores toxicity.

Fitting takes at most ``labelled`` labelled rows of existing documents, the first in hash order of doc_id, and
4 * ``handed`` pseudo-labelled rows a round; so its cost and what reaches the driver are bounded, and reruns agree.
Scoring takes every document whole, without a shuffle of texts; the models have a fixed size.

Rows: a null text is an empty one, null source and language are values of their own, a null doc_id is scored but not
handed. Labels that are null or contradict each other for one doc_id are not used. Of rows that share a doc_id any one
is fitted to; repeated rows are scored each. Texts are read whole, whatever their length. Without labels of both kinds a
view knows only the share of good rows (one half without any), and nothing is toxic. An empty table gives no rows.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzframe.llm import common

LABELLED = 6000
ROUNDS = 2
#: Good and bad pseudo-labels that a view hands over in a round at most, and how sure it must be.
HANDED = 400
SURE = 0.9
HELD_OUT = 0.25
#: Bits of a word feature's id, and of those the first that the regression tells apart.
FEATURE_BITS = 22
SPARSE_BITS = 18
STEPS = 150
#: Log odds below which a feature tells nothing.
FLOOR = -4.0
#: Bytes of word beginnings that are features.
BEGINNINGS = (4, 5, 6)
SCORES = "doc_id long, content_score double, metadata_score double, score double, toxic_score double, kept boolean"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_CLASSES = ((65, 91), (97, 123), (48, 58), (128, 256))
_MARKS = tuple(b".,!?;:'\"|#*$%&<>-()")


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(1 << max(16, n.bit_length()), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    return (h * np.uint64(0xBF58476D1CE4E5B9)) ^ (h >> np.uint64(29))


def features(text: str, source: str | None, lang: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse ids (distinct, sorted) and dense figures of the content view, and the figures of the metadata view."""
    data = np.frombuffer(text.encode(), np.uint8)
    n = len(data)
    counts = np.bincount(data, minlength=256)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    words = len(start)
    if words:
        low = np.where((data >= 65) & (data < 91), data + 32, data).astype(np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((low + np.uint64(0x51)) * _powers(_BASE, n), out=sums[1:])
        back = _powers(_INVERSE, n)[start]
        of = lambda stop: _mixed((sums[stop] - sums[start]) * back)
        whole = of(end)
        bare = of(np.maximum(start + 1, end - np.isin(data[end - 1], _MARKS)))
        parts = [bare, *(of(np.minimum(end, start + b)) + np.uint64(b) for b in BEGINNINGS)]
        sparse = np.unique((np.concatenate(parts) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32))
        distinct = len(np.unique(whole)) / words
        beside = float((whole[1:] == whole[:-1]).mean()) if words > 1 else 0.0
        length = float((end - start).mean())
    else:
        sparse, distinct, beside, length = np.zeros(0, np.int32), 1.0, 0.0, 0.0
    log_words = np.log1p(words)
    size = max(1, n)
    shares = [counts[a:b].sum() / size for a, b in _CLASSES] + [min(1.0, 10 * counts[m] / size) for m in _MARKS]
    content = [1.0, distinct, distinct * log_words, beside, float(beside > 0.2), log_words, length / 10, float(words < 5)]
    breaks = np.flatnonzero(data == 10)
    line_sizes = np.diff(breaks, prepend=-1, append=n) - 1
    lines = len(line_sizes)
    one_hot = np.zeros(48)
    one_hot[hash_of(f"source {source}") % 32] = 1
    one_hot[32 + hash_of(f"lang {lang}") % 16] = 1
    metadata = [1.0, np.log1p(n) / 5, np.log1p(n) ** 2 / 25, np.log1p(lines), np.log1p(n / lines) / 5, np.log1p(line_sizes.max()) / 5, float((line_sizes == 0).mean()), float(line_sizes.std() / (1 + line_sizes.mean())), float(n < 100), *shares, *np.sqrt(shares)]
    return sparse, np.array(content), np.concatenate([metadata, one_hot])


def hash_of(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode(), 8)


@dataclass
class Rows:
    """Feature rows of one view: sparse ids with the row they belong to, dense figures."""

    sparse: list[np.ndarray]
    dense: np.ndarray

    @cached_property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sparse)), [len(x) for x in self.sparse])

    @cached_property
    def fine(self) -> np.ndarray:
        return np.concatenate([*self.sparse, np.zeros(0, np.int32)])

    @cached_property
    def ids(self) -> np.ndarray:
        return (self.fine >> (FEATURE_BITS - SPARSE_BITS)).astype(np.int64)

    def take(self, at: np.ndarray) -> Rows:
        return Rows([self.sparse[i] for i in at], self.dense[at])


@dataclass
class Model:
    """Logistic regression, with its calibration."""

    sparse: np.ndarray
    dense: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, rows: Rows) -> np.ndarray:
        z = ((rows.dense - self.mean) / self.scale) @ self.dense
        if len(rows.ids) and len(self.sparse) > 1:  # of one value if it was fitted to no words
            z = z + np.bincount(rows.row, self.sparse[rows.ids], minlength=len(z))
        return z

    def logit(self, rows: Rows) -> np.ndarray:
        return np.clip(self.slope * self.raw(rows) + self.offset, -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(gradient, start: list[np.ndarray], steps: int, rate: float) -> list[np.ndarray]:
    values = [x.copy() for x in start]
    first, second = [np.zeros_like(x) for x in start], [np.zeros_like(x) for x in start]
    for t in range(1, steps + 1):
        for x, m, v, g in zip(values, first, second, gradient(*values), strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return values


def fit(rows: Rows, y: np.ndarray, steps: int = STEPS, decay: float = 1e-4) -> Model:
    """Both classes weigh the same in sum."""
    mean, scale = (rows.dense.mean(axis=0), rows.dense.std(axis=0)) if len(y) else (np.zeros(rows.dense.shape[1]), np.ones(rows.dense.shape[1]))
    constant = scale < 1e-9
    mean, scale = np.where(constant, 0.0, mean), np.where(constant, 1.0, scale)
    size = 1 << SPARSE_BITS if len(rows.ids) else 1
    empty = Model(np.zeros(size), np.zeros(rows.dense.shape[1]), mean, scale)
    good = y.sum()
    if not 0 < good < len(y):
        share = (good + 1) / (len(y) + 2)
        return Model(empty.sparse, empty.dense, mean, scale, 0.0, float(np.log(share / (1 - share))))
    weight = np.where(y == 1, 0.5 / good, 0.5 / (len(y) - good))
    x = (rows.dense - mean) / scale

    def gradient(sparse, dense):
        z = x @ dense
        if len(rows.ids):
            z = z + np.bincount(rows.row, sparse[rows.ids], minlength=len(z))
        error = weight * (sigmoid(z) - y)
        by_id = np.bincount(rows.ids, error[rows.row], minlength=size) if len(rows.ids) else np.zeros(size)
        return by_id + decay * sparse, x.T @ error + decay * dense

    sparse, dense = _adam(gradient, [empty.sparse, empty.dense], steps, 0.05)
    return Model(sparse, dense, mean, scale)


def calibrate(model, rows: Rows, y: np.ndarray):
    """Platt scaling on held-out rows; left as it is if these are of one class."""
    if 0 < y.sum() < len(y) and model.slope:
        z = model.raw(rows)
        soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        spread = max(1e-6, float(np.abs(z).mean()))
        gradient = lambda s: [np.array([((sigmoid(s[0] * z / spread + s[1]) - soft) * z / spread).mean(), (sigmoid(s[0] * z / spread + s[1]) - soft).mean()])]
        (s,) = _adam(gradient, [np.array([1.0, 0.0])], 500, 0.05)
        model.slope, model.offset = max(1e-3, float(s[0])) / spread, float(s[1])
    return model


@dataclass
class Worst:
    """The most telling feature of a row decides: its log odds, less two standard errors, for the label."""

    odds: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, rows: Rows) -> np.ndarray:
        worst = np.full(len(rows.sparse), FLOOR)
        np.maximum.at(worst, rows.row, self.odds[rows.fine])
        return worst

    def logit(self, rows: Rows) -> np.ndarray:
        return np.clip(self.slope * self.raw(rows) + self.offset, -30, 30)


def fit_worst(rows: Rows, y: np.ndarray) -> Worst:
    size = 1 << FEATURE_BITS
    if not 0 < y.sum() < len(y):
        return Worst(np.full(size, FLOOR), 0.0, -30.0)
    have = np.bincount(rows.fine, y[rows.row], minlength=size) + 0.5
    lack = np.bincount(rows.fine, 1 - y[rows.row], minlength=size) + 0.5
    odds = np.log(have / lack) - 2 * np.sqrt(1 / have + 1 / lack)
    return Worst(np.maximum(odds, FLOOR).astype(np.float32))


@dataclass
class Classifier:
    content: Model
    metadata: Model
    toxic: Worst
    weights: np.ndarray


@dataclass
class Sample:
    """Fitted-to rows: both views, and what is known of them (nan where it is not)."""

    ids: np.ndarray
    content: Rows
    metadata: Rows
    quality: np.ndarray
    toxic: np.ndarray

    @property
    def views(self) -> list[Rows]:
        return [self.content, self.metadata]


def joined(a: Rows, b: Rows) -> Rows:
    return Rows([*a.sparse, *b.sparse], np.concatenate([a.dense, b.dense]))


def fit_views(known: Sample, handed: list[tuple[Rows, np.ndarray]]) -> list[Model]:
    """One model a view, of the known rows and those that the other view has handed to it."""
    at = np.flatnonzero(~np.isnan(known.quality))
    return [fit(joined(v.take(at), more), np.concatenate([known.quality[at], y])) for v, (more, y) in zip(known.views, handed, strict=True)]


def finish(models: list[Model], fitted: Sample, held: Sample) -> Classifier:
    """Calibration, combination and the toxic head; held: rows that no model was fitted to."""
    check = np.flatnonzero(~np.isnan(held.quality))
    y = held.quality[check]
    models = [calibrate(m, v.take(check), y) for m, v in zip(models, held.views, strict=True)]
    weights = np.array([0.5, 0.5, 0.0])
    if 0 < y.sum() < len(y):
        z = np.stack([m.logit(v.take(check)) for m, v in zip(models, held.views, strict=True)] + [np.ones(len(check))], axis=1)
        (weights,) = _adam(lambda w: [z.T @ (sigmoid(z @ w) - y) / len(y) + 1e-2 * (w - [0.5, 0.5, 0])], [weights], 300, 0.02)
        weights[:2] = np.maximum(weights[:2], 0.05)
    of_toxic, seen = np.flatnonzero(~np.isnan(fitted.toxic)), np.flatnonzero(~np.isnan(held.toxic))
    head = fit_worst(fitted.content.take(of_toxic), fitted.toxic[of_toxic])
    head = calibrate(head, held.content.take(seen), held.toxic[seen])
    return Classifier(models[0], models[1], head, weights)


def _columns(docs: DataFrame) -> DataFrame:
    get = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), get("source").alias("source"), get("lang").alias("lang"))


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [features(*x) for x in zip(batch["text"], batch["source"], batch["lang"], strict=True)]
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "quality": batch["quality"], "toxic": batch["toxic"], "sparse": [s.tobytes() for s, _, _ in made], "content": [c.tobytes() for _, c, _ in made], "metadata": [m.tobytes() for _, _, m in made]})


FEATURES = "doc_id long, quality double, toxic double, sparse binary, content binary, metadata binary"


def _sample(rows: DataFrame, wanted: DataFrame) -> Sample:
    """The features of the documents of wanted (label_id, quality, toxic), a bounded table."""
    taken = rows.join(F.broadcast(wanted), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "source", "lang", "quality", "toxic").dropDuplicates(["doc_id"])
    got = taken.mapInPandas(_feature_rows, FEATURES).toPandas().sort_values("doc_id", ignore_index=True)
    _, c0, m0 = features("", None, None)
    dense = lambda c, like: np.stack([np.frombuffer(x) for x in got[c]]) if len(got) else np.zeros((0, len(like)))
    quality, toxic = (np.where(got[c].isin([0.0, 1.0]), got[c], np.nan).astype(float) for c in ("quality", "toxic"))
    return Sample(got["doc_id"].to_numpy(), Rows([np.frombuffer(x, np.int32) for x in got["sparse"]], dense("content", c0)), Rows([np.zeros(0, np.int32)] * len(got), dense("metadata", m0)), quality, toxic)


def _part(sample: Sample, at: np.ndarray) -> Sample:
    return Sample(sample.ids[at], sample.content.take(at), sample.metadata.take(at), sample.quality[at], sample.toxic[at])


def _logits(batch: pd.DataFrame, models: list[Model]) -> tuple[Rows, list[np.ndarray]]:
    made = [features(*x) for x in zip(batch["text"], batch["source"], batch["lang"], strict=True)]
    content, metadata = Rows([s for s, _, _ in made], np.stack([c for _, c, _ in made])), Rows([np.zeros(0, np.int32)] * len(made), np.stack([m for _, _, m in made]))
    return content, [m.logit(v) for m, v in zip(models, (content, metadata), strict=True)]


def confident(rows: DataFrame, models: list[Model], without: DataFrame, handed: int, seed: int) -> DataFrame:
    """label_id, view (0 or 1, which is sure) and quality: of all documents that are not in without (label_id), the first
    in hash order that a view is sure of, handed for each view and kind."""
    shared = rows.sparkSession.sparkContext.broadcast(models)  # of a fixed size

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                _, (c, m) = _logits(part, shared.value)
                yield pd.DataFrame({"label_id": part["doc_id"], "c": c, "m": m})

    sure = float(np.log(SURE / (1 - SURE)))
    found = rows.where(F.col("doc_id").isNotNull()).mapInPandas(scored, "label_id long, c double, m double")
    found = common.materialize(found.where((F.abs("c") >= sure) | (F.abs("m") >= sure)), "confident").join(without, "label_id", "left_anti")
    order = [F.xxhash64("label_id", F.lit(seed)), F.col("label_id")]
    picks = None
    for view, logit in enumerate("cm"):
        for good in (0, 1):
            some = found.where(F.col(logit) >= sure if good else F.col(logit) <= -sure).select("label_id").distinct().orderBy(*order).limit(handed)
            some = some.select("label_id", F.lit(view).alias("view"), F.lit(float(good)).alias("quality"))
            picks = some if picks is None else picks.union(some)
    return common.materialize(picks, "handed")


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, handed: int = HANDED, rounds: int = ROUNDS) -> Classifier:
    """docs: doc_id, text, source, lang; labels: doc_id, quality, toxic (0 or 1)."""
    rows = common.ship(_columns(docs))
    value = lambda c: F.when(F.min(c) == F.max(c), F.max(c)).cast("double").alias(c)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(value("quality"), value("toxic"))
    known = known.where(F.col("quality").isin(0, 1) | F.col("toxic").isin(0, 1)).join(rows.select(F.col("doc_id").alias("label_id")), "label_id", "left_semi")
    known = common.materialize(known, "known-labels")
    chosen = common.materialize(known.orderBy(F.xxhash64("label_id"), "label_id").limit(labelled), "sample")
    sample = _sample(rows, chosen)
    is_held = np.array([hash_of(f"held {i}") % 1000 < 1000 * HELD_OUT for i in sample.ids], bool)
    fitted, held = _part(sample, np.flatnonzero(~is_held)), _part(sample, np.flatnonzero(is_held))
    none = _part(sample, np.zeros(0, int))
    pseudo = [(v, np.zeros(0)) for v in none.views]
    models = fit_views(fitted, pseudo)
    used = known.select("label_id")
    for turn in range(rounds if (~np.isnan(fitted.quality)).any() else 0):
        picks = confident(rows, models, used, handed, turn)
        used = used.union(picks.select("label_id"))
        for view in (0, 1):  # what one view is sure of goes to the other
            more = _sample(rows, picks.where(F.col("view") == 1 - view).groupBy("label_id").agg(F.max("quality").alias("quality"), F.lit(None).cast("double").alias("toxic")))
            pseudo[view] = (joined(pseudo[view][0], more.views[view]), np.concatenate([pseudo[view][1], more.quality]))
        models = fit_views(fitted, pseudo)
    return finish(models, fitted, held)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, content_score, metadata_score, score (probability of good quality), toxic_score and kept of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                content, (c, m) = _logits(part, [known.content, known.metadata])
                both = known.weights[0] * c + known.weights[1] * m + known.weights[2]
                toxic = sigmoid(known.toxic.logit(content))
                good = sigmoid(both)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "content_score": sigmoid(c), "metadata_score": sigmoid(m), "score": good, "toxic_score": toxic, "kept": (good >= 0.5) & (toxic < 0.5)})

    return common.ship(_columns(docs)).mapInPandas(scored, SCORES)


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, handed: int = HANDED, rounds: int = ROUNDS) -> DataFrame:
    return score(docs, train(docs, labels, labelled, handed, rounds))
