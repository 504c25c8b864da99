"""Toxicity of texts by a convolutional classifier, trained in numpy.

Words, without letter case and punctuation, are hashed into embedding rows: one for the word, two for its first four and
six bytes, so that an unseen form of a seen stem is known; the three are added. Filters over one, two and three words
slide over the whole text; the maximum of each filter is a feature of a logistic layer. Training is by AdaGrad; the
gradient of a maximum concerns one window, so a text costs one pass. The first embedding column starts at the shrunk
log-odds of the word, which lets rare words be learned from few examples. Only the weights come from a bounded sample: on
all other labelled rows that may be learned from, counted by bins of their logits, the score is calibrated (Platt) and, by
language, a threshold is chosen. Language is no input of the score; its thresholds are a column beside it.

For scoring, filters are multiplied into the embedding table once, so that a window is a sum of parts of table rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import WHITE_SPACE_AND_PUNCTUATION, hashed_words, read_table

BUCKETS, DIMENSIONS, FILTERS, WIDTHS, STEMS = 1 << 15, 12, 8, (1, 2, 3), (4, 6)
#: Labelled rows that the weights are fitted on at most, of each class, and the characters of their texts together.
SAMPLE = {1: 3000, 0: 5000}
SAMPLE_CHARS = 40_000_000
#: Bins of a logit, for each unit of it, and the limit of what is told apart.
BINS, FAR = 128, 30
EPOCHS = 4
THRESHOLD = 0.3


def rows_of(texts: list[str | None]) -> list[np.ndarray]:
    """For each text, the rows of its words: the word's and its stems'; row 0, which stays zero, for a stem that a word is too
    short for, and at the end for the last windows."""
    bodies = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    h, counts = hashed_words(bodies, WHITE_SPACE_AND_PUNCTUATION, STEMS)
    ids = np.where(h > 0, h % np.uint64(BUCKETS - 1) + np.uint64(1), np.uint64(0)).astype(np.int32)
    pad = np.zeros((max(WIDTHS) - 1, ids.shape[1]), np.int32)
    return [np.concatenate((x, pad)) for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """table: for each embedding row, what it adds to each filter from each place of a window; the filters of width 1 first."""

    table: np.ndarray | None = None
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    constant: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def logit(self, ids: np.ndarray) -> float:
        if self.table is None:
            return self.constant
        step, over = 16_384, max(WIDTHS) - 1
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        for at in range(0, len(ids) - over, step):
            some = ids[at : at + step + over]
            acc = self.table[some[:, 0]]
            for j in range(1, some.shape[1]):
                acc += self.table[some[:, j]]
            tops, column = [], 0
            for k in WIDTHS:
                n = len(some) - k + 1
                conv = acc[:n, column : column + FILTERS].copy()
                for o in range(1, k):
                    conv += acc[o : o + n, column + o * FILTERS : column + (o + 1) * FILTERS]
                tops.append(conv.max(axis=0))
                column += k * FILTERS
            best = np.maximum(best, np.concatenate(tops))
        if not len(ids) - over:
            return self.constant
        return float(np.maximum(best + self.bias, 0) @ self.weights + self.constant)

    def score(self, ids: np.ndarray) -> float:
        return float(_sigmoid(self.scale[0] * self.logit(ids) + self.scale[1]))


def _platt(logits: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset by damped Newton steps, with a weak pull to the identity; n: how many rows each one stands for."""
    w = np.array([1.0, 0.0])
    x = np.stack([logits, np.ones(len(logits))], axis=1)
    for _ in range(50):
        p = _sigmoid(x @ w)
        g = x.T @ (n * (p - y)) + (w - [1, 0])
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step / max(1, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def fit(train: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, seed: int = 0) -> Model:
    """train: (word ids, label). Without both labels the model is constant. Its score isn't calibrated yet."""
    positive, negative = sum(y for _, y in train), sum(1 - y for _, y in train)
    if not positive or not negative:
        return Model(constant=-30.0 if not positive else 30.0)
    rng = np.random.default_rng(seed)
    seen = np.zeros((2, BUCKETS))
    for ids, y in train:
        seen[y, np.unique(ids)] += 1
    odds = np.log((seen[1] + 0.5) / (positive + 1)) - np.log((seen[0] + 0.5) / (negative + 1))
    n = seen.sum(axis=0)
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    emb[:, 0] = np.clip(odds * n / (n + 5), -3, 3)
    emb[0] = 0
    filters = {k: rng.normal(0, 0.1, (k, DIMENSIONS, FILTERS)).astype(np.float32) for k in WIDTHS}
    for k, f in filters.items():
        f[:, 0, : FILTERS // 2] += 1 / k
    bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    weights = rng.normal(0.1, 0.05, len(bias)).astype(np.float32)
    constant = float(np.log(positive / negative))
    rate = 0.05
    sq = {"emb": np.full(emb.shape, 1e-2, np.float32), "bias": np.full(bias.shape, 1e-2), "weights": np.full(weights.shape, 1e-2), "constant": 1e-2} | {k: np.full(f.shape, 1e-2, np.float32) for k, f in filters.items()}
    for _ in range(epochs):
        for at in rng.permutation(len(train)):
            ids, y = train[at]
            if len(ids) < max(WIDTHS):
                continue
            x, tops, where = emb[ids].sum(axis=1), [], []
            for k, f in filters.items():
                m = len(ids) - k + 1
                conv = x[:m] @ f[0]
                for o in range(1, k):
                    conv += x[o : o + m] @ f[o]
                top = conv.argmax(axis=0)
                where.append(top)
                tops.append(conv[top, np.arange(FILTERS)])
            raw = np.concatenate(tops) + bias
            out = np.maximum(raw, 0)
            d = float(_sigmoid(out @ weights + constant)) - y
            if abs(d) < 1e-3:
                continue
            dout = (d * weights * (raw > 0)).astype(np.float32)
            dw = d * out
            sq["weights"] += dw * dw
            weights -= (rate * dw / np.sqrt(sq["weights"])).astype(np.float32)
            sq["bias"] += dout * dout
            bias -= (rate * dout / np.sqrt(sq["bias"])).astype(np.float32)
            sq["constant"] += d * d
            constant -= rate * d / np.sqrt(sq["constant"])
            words, grads = [], []
            for k, top, part in zip(WIDTHS, where, np.split(dout, len(WIDTHS)), strict=True):
                f = filters[k]
                for o in range(k):
                    words.append(ids[top + o].ravel())
                    grads.append(np.repeat(part[:, None] * f[o].T, ids.shape[1], axis=0))
                    df = x[top + o].T * part
                    sq[k][o] += df * df
                    f[o] -= rate * df / np.sqrt(sq[k][o])
            words_, grads_ = np.concatenate(words), np.concatenate(grads)
            uniq, back = np.unique(words_, return_inverse=True)
            g = np.zeros((len(uniq), DIMENSIONS), np.float32)
            np.add.at(g, back, grads_)
            sq["emb"][uniq] += g * g
            emb[uniq] -= rate * g / np.sqrt(sq["emb"][uniq])
            emb[0] = 0
    return Model(np.concatenate([emb @ filters[k][o] for k in WIDTHS for o in range(k)], axis=1).astype(np.float32), bias, weights, constant)


def calibrate(model: Model, cells: list[tuple[int, str | None, int, int]], fitted: dict[int, int]) -> None:
    """Set the scale and the thresholds from cells (label, language, bin, rows) of the rows outside the fit.

    fitted: the rows of each label in the fit. The sample takes different shares of the labels, so the rows left are weighed
    to the share that each label has among all."""
    if model.table is None or not cells:
        return
    y, n = np.array([c[0] for c in cells]), np.array([c[3] for c in cells], float)
    logits = (np.array([c[2] for c in cells]) + 0.5) / BINS
    left = {k: n[y == k].sum() for k in (0, 1)}
    everything = sum(left.values()) + sum(fitted.values())
    weight = {k: (left[k] + fitted.get(k, 0)) / everything * n.sum() / left[k] if left[k] else 1.0 for k in left}
    weighed = n * np.where(y == 1, weight[1], weight[0])
    model.scale = _platt(logits, y, weighed)
    scores = _sigmoid(model.scale[0] * logits + model.scale[1])
    for lang in sorted({c[1] for c in cells if c[1] is not None}):
        own = np.array([c[1] == lang for c in cells])
        model.thresholds[lang] = _threshold(scores[own], y[own], n[own], weighed[own])


def _threshold(scores: np.ndarray, y: np.ndarray, n: np.ndarray, weighed: np.ndarray) -> float:
    """Of the best F1, in the middle of the gap below it, not far from the general one; that one with few positives."""
    if n[y == 1].sum() < 20:
        return THRESHOLD
    s, back = np.unique(-scores, return_inverse=True)
    s, hit, taken = -s, np.cumsum(np.bincount(back, weighed * y)), np.cumsum(np.bincount(back, weighed))
    f1 = 2 * hit / (taken + hit[-1])
    k = int(f1.argmax())
    return float(np.clip((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2, 0.15, 0.5))


def may_learn(doc_id: Column) -> Column:
    """Rows that a fit may use."""
    return F.crc32(doc_id.cast("string")) % 4 != 2


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit the weights on a bounded sample of the labelled rows that may be learned from, the same at every run; calibrate on all
    others of them.

    A fifth of the rows is kept out of the sample, however few there are. Of the others, those of each class least by a hash of
    doc_id are taken, as far as their texts fit into sample_chars; of several texts of one doc_id the one of the least hash. Null
    labels, labels other than 0 and 1 and labels without a document are ignored; a doc_id with several rows counts for each outside
    the sample. An empty table, or one class alone, gives a constant model."""
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & may_learn(F.col("doc_id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(may_learn(F.col("doc_id")))
    chosen = None
    for label, most in sample.items():
        some = usable.where((F.col("toxic") == label) & (F.pmod(F.xxhash64("doc_id", F.lit("hold")), F.lit(5)) != 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = some if chosen is None else chosen.union(some)
    # at most sum(sample.values()) rows of a few numbers, here and in what is taken
    chosen = F.broadcast(chosen.withColumn("place", F.xxhash64("doc_id")))
    which = F.min(F.struct(F.xxhash64("text").alias("h"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))).alias("least")
    listed = texts.join(chosen, "doc_id").groupBy("place", "doc_id", "toxic").agg(which).select("place", "doc_id", "toxic", "least.*").collect()
    taken, room = [], sample_chars
    for r in sorted(listed):
        if r.chars <= room:
            taken.append((r.doc_id, r.toxic, r.h))
            room -= r.chars
    fitted = F.broadcast(spark.createDataFrame(taken, "doc_id long, toxic int, h long"))
    rows = texts.withColumn("h", F.xxhash64("text")).join(fitted, ["doc_id", "h"]).dropDuplicates(["doc_id", "toxic"]).select("doc_id", "toxic", word_ids(F.col("text")).alias("ids")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.toxic, bytes(r.ids)))
    model = fit([(np.frombuffer(r.ids, "<i4").reshape(-1, 1 + len(STEMS)), r.toxic) for r in rows])
    if model.table is not None:
        calibrate(model, outside(texts.join(fitted.select("doc_id").distinct(), "doc_id", "left_anti"), usable, model), Counter(r.toxic for r in rows))
    return model


def outside(texts: DataFrame, usable: DataFrame, model: Model) -> list[tuple[int, str | None, int, int]]:
    """Counts (toxic, lang, bin of the logit, rows) of the labelled texts; as many as there are bins, however many texts.

    Texts are scored before the join, so that it moves three numbers a row. Both sides grow with the documents, so neither is
    ever broadcast."""
    logit = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), logits(texts.sparkSession, model, F.col("text"))))
    binned = texts.select("doc_id", "lang", F.floor(logit * BINS).cast("long").alias("bin"))
    return [tuple(r) for r in binned.join(usable.hint("merge"), "doc_id").groupBy("toxic", "lang", "bin").count().orderBy("toxic", "lang", "bin").collect()]


def word_ids(text: Column) -> Column:
    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        tokens.release()
        return pa.array([x.astype("<i4").tobytes() for k in range(0, len(texts), 256) for x in rows_of(texts.slice(k, 256).to_pylist())], pa.binary())

    return ids(text)


def scored(spark: SparkSession, model: Model, text: Column) -> Column:
    """Column of scores; a null text is scored as an empty one."""
    return _each(spark, model, Model.score, text)


def logits(spark: SparkSession, model: Model, text: Column) -> Column:
    """Column of what scores are before they are calibrated."""
    return _each(spark, model, Model.logit, text)


def _each(spark: SparkSession, model: Model, what: Callable[[Model, np.ndarray], float], text: Column) -> Column:
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def each(texts: pa.Array) -> pa.Array:
        tokens.release()
        return pa.array([what(held.value, x) for k in range(0, len(texts), 256) for x in rows_of(texts.slice(k, 256).to_pylist())], pa.float64())

    return each(text)


def threshold_of(model: Model, lang: Column) -> Column:
    """The threshold of a language; the general one for a null language or one without its own."""
    found = F.lit(THRESHOLD)
    for name, value in sorted(model.thresholds.items()):
        found = F.when(lang == name, F.lit(value)).otherwise(found)
    return found


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, lang_threshold, rejected (score >= that threshold).

    Null and empty texts get the score of no words. Long texts are scored whole. A null doc_id isn't held out. Other
    columns are ignored. An empty table gives no rows; without labels of both classes every score is that of the one."""
    s = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scored(docs.sparkSession, model, F.col("text")).alias("score"), threshold_of(model, F.col("lang")).alias("lang_threshold"))
    return s.select("doc_id", F.coalesce(~may_learn(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "lang_threshold", (F.col("score") >= F.col("lang_threshold")).alias("rejected"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold of their language; repeated rows alike."""
    return docs.where(scored(docs.sparkSession, model, F.col("text")) < threshold_of(model, F.col("lang")))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, read_table(spark, sf_dir, "labels")))
