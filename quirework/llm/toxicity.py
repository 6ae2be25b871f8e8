"""Toxicity by a chain of linear classifiers.

Each category has a logistic model on the words that a document holds and on
the probabilities of the categories before it in the chain. Models later in the
chain are trained on out-of-fold probabilities of the earlier ones, so they see
them as they will be on new documents.

Words are lower-cased runs of bytes other than ASCII punctuation and white
space, told apart by a 64-bit hash. Training takes at most SAMPLE labelled
documents, the first by a hash of their id, and the WORDS words that most of
them hold, of which a model uses at most TELLING; those are bounds of the model,
and scoring reads every document whole. Words are counted in Spark, so the driver
gets at most WORDS counts and, for each document of the sample, the places of its
words among them.

Defined cases: a null or empty text has no words and gets the probability that
the model's constant gives; a category whose sample lacks positive or negative
labels has its smoothed base rate everywhere; an unlabelled or null id is
scored like any other; repeated labels of an id count by their largest value, of
repeated rows of a labelled id the text of the smallest hash is trained on; a
text of any length is read a few MB at a time; an empty table gives no rows. Columns of the documents other than the two named
are carried through, except those named like an output column, which give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.bytetext import Words, slices, text_array
from quirework.llm.workspace import Workspace

#: Labelled documents that training may take, words that a model may use, and documents that a word must be in.
SAMPLE, WORDS, LEAST_DOCUMENTS = 8000, 40_000, 3
#: Words that one model may use, and the standard errors by which they must tell.
TELLING, LEAST_Z = 400, 3.5
FOLDS, STEPS, PENALTY = 4, 300, 1e-4


@dataclass(frozen=True)
class Model:
    """One category: weights of the known words, of the categories before it, and the constant."""

    weights: np.ndarray
    earlier: np.ndarray
    constant: float

    def margin(self, rows: np.ndarray, cols: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        return np.bincount(rows, self.weights[cols], n) + before @ self.earlier + self.constant


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    words: np.ndarray
    models: tuple[Model, ...]
    limits: tuple[float, ...]

    def probabilities(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, 0))
        for model in self.models:
            p = 1 / (1 + np.exp(-np.clip(model.margin(rows, cols, n, out), -40, 40)))
            out = np.column_stack((out, p))
        return out


def _distinct(words: Words, offsets: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) pairs without repeats; with known words, their places among those."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(words.rows))
    hashes = words.hashes
    if known is not None:
        at = np.searchsorted(known, hashes)
        at[at == len(known)] = 0
        hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
        pair = np.unique(rows[hit] * max(1, len(known)) + at[hit])
        return pair // max(1, len(known)), pair % max(1, len(known))
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in slices(text_array(batch.column(1))):
            rows, hashes = _distinct(Words(data, offsets, lower=True, letters=True), offsets, None)
            n = len(offsets) - 1
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), lists], names=["id", "words"])


def telling(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, use: np.ndarray, width: int) -> np.ndarray:
    """The words whose share of positive documents differs most from that of negative ones, in standard errors."""
    positive, negative = (y & use).sum(), (~y & use).sum()
    inside = use[rows]
    up, down = (np.bincount(cols[inside & k], minlength=width) for k in (y[rows], ~y[rows]))
    p, q = (up + 0.5) / (positive + 1), (down + 0.5) / (negative + 1)
    pooled = (up + down + 1) / (positive + negative + 2)
    z = np.abs(p - q) / np.sqrt(pooled * (1 - pooled) * (1 / positive + 1 / negative))
    best = np.argsort(-z, kind="stable")[:TELLING]
    return best[z[best] >= LEAST_Z]


def fit(rows: np.ndarray, cols: np.ndarray, before: np.ndarray, y: np.ndarray, use: np.ndarray, width: int) -> Model:
    """Logistic regression on the telling words, classes of equal total weight, by accelerated gradient steps."""
    n = len(y)
    positive, negative = int((y & use).sum()), int((~y & use).sum())
    if not positive or not negative:
        rate = (positive + 1) / (positive + negative + 2)
        return Model(np.zeros(width), np.zeros(before.shape[1]), float(np.log(rate / (1 - rate))))
    best = telling(rows, cols, y, use, width)
    place = np.full(width, -1)
    place[best] = np.arange(len(best))
    inside = place[cols] >= 0
    r_, c_ = rows[inside], place[cols[inside]]
    weight = np.where(y, 0.5 / positive, 0.5 / negative) * use
    # row sums bound the curvature of each coordinate
    length = np.bincount(r_, minlength=n) + before.shape[1] + 1
    step_w = 4 / (np.bincount(c_, (weight * length)[r_], len(best)) + 1e-9)
    step_e = 4 / ((weight * length) @ before**2 + 1e-9) if before.shape[1] else np.zeros(0)
    step_c = 4 / float(weight @ length)
    state = now = (np.zeros(len(best)), np.zeros(before.shape[1]), 0.0)
    momentum, target = 1.0, y.astype(float)
    for _ in range(STEPS):
        w, e, c = now
        m = np.bincount(r_, w[c_], n) + before @ e + c
        r = (1 / (1 + np.exp(-np.clip(m, -40, 40))) - target) * weight
        new = (w - step_w * (np.bincount(c_, r[r_], len(best)) + PENALTY * w) / (1 + step_w * PENALTY), e - step_e * (r @ before), c - step_c * r.sum())
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        now = tuple(a + (momentum - 1) / following * (a - b) for a, b in zip(new, state, strict=True))
        state, momentum = new, following
    weights = np.zeros(width)
    weights[best] = state[0]
    return Model(weights, np.asarray(state[1]), float(state[2]))


def limit(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that parts the labels best out of fold; a clean document flagged counts as two missed ones by share.

    Within the best gap it is the middle on the logit scale. One kind of label only: nothing reaches the limit.
    """
    if not y.any() or y.all():
        return 2.0
    order = np.argsort(p, kind="stable")
    q, truth = np.clip(p[order], 1e-9, 1 - 1e-9), y[order]
    gain = 2 * np.cumsum(~truth) / (~truth).sum() - np.cumsum(truth) / truth.sum()  # below the limit so far
    gain[:-1][q[:-1] == q[1:]] = -1
    k = int(np.argmax(gain))
    if k == len(q) - 1:
        return 2.0
    logit = np.log(q[[k, k + 1]] / (1 - q[[k, k + 1]])).mean()
    return float(1 / (1 + np.exp(-logit)))


def _places(words: np.ndarray):
    """id, hashes of words -> id, places of those that are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            hashes = np.asarray(lists.flatten()).view(np.uint64)
            ends = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.list_value_length(lists)))))
            at = np.searchsorted(words, hashes)
            at[at == len(words)] = 0
            hit = words[at] == hashes if len(words) else np.zeros(len(hashes), bool)
            kept = np.concatenate(([0], np.cumsum(hit)))[ends.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(at[hit].astype(np.int32)))], names=["id", "places"])

    return run


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, work: Workspace | None = None) -> Chain:
    """A chain fitted on at most `sample` labelled documents. labels: the id, and a 0/1 column for each category."""
    own = work or Workspace(docs.sparkSession)
    asked = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(c) for c in categories])
    taken = own.save(asked.orderBy(F.xxhash64("id"), "id").limit(sample), "taken")
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(taken.select("id")), "id", "left_semi")  # at most `sample` ids
    chosen = chosen.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    lists = own.save(chosen.mapInArrow(_word_lists, f"id {kind}, words array<bigint>"), "word-lists")
    common = lists.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("held")).where(F.col("held") >= LEAST_DOCUMENTS)
    common = common.orderBy(F.desc("held"), "word").limit(WORDS).select("word").toArrow()["word"]
    common = np.sort(np.asarray(common).view(np.uint64))
    got = lists.mapInArrow(_places(common), f"id {kind}, places array<int>").join(F.broadcast(taken), "id").toArrow().sort_by("id")  # at most `sample` documents
    if work is None:
        own.clear()
    n = got.num_rows
    column = got["places"].combine_chunks() if n else pa.array([], pa.list_(pa.int32()))
    cols = np.asarray(column.flatten()).astype(np.int64)
    rows = np.repeat(np.arange(n), np.asarray(pa.compute.list_value_length(column))) if n else np.zeros(0, np.int64)
    fold = np.arange(n) % FOLDS
    before, models, limits = np.zeros((n, 0)), [], []
    for i, category in enumerate(categories):
        y = np.asarray(got[category]).astype(bool) if n else np.zeros(0, bool)
        models.append(fit(rows, cols, before, y, np.ones(n, bool), len(common)))
        p = np.zeros(n)
        for k in range(FOLDS):
            part = fit(rows, cols, before, y, fold != k, len(common))
            m = part.margin(rows, cols, n, before)
            p[fold == k] = 1 / (1 + np.exp(-np.clip(m[fold == k], -40, 40)))
        before = np.column_stack((before, p))
        limits.append(limit(p, y))
    return Chain(tuple(categories), common, tuple(models), tuple(limits))


def score(docs: DataFrame, chain: Chain, *, text_col: str = "text") -> DataFrame:
    """docs with p_<category> for each category of the chain."""
    names = [f"p_{c}" for c in chain.categories]
    fields = [f for f in docs.schema.fields if f.name not in names]
    place = [f.name for f in fields].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(text_array(batch.column(place))):
                n = len(offsets) - 1
                at = _distinct(Words(data, offsets, lower=True, letters=True), offsets, chain.words)
                p = chain.probabilities(*at, n)
                own = batch.slice(row, n)
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(p[:, i]) for i in range(len(names)))], names=[*own.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"`{x}` double" for x in names)])
    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, *, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """docs with p_low_quality, p_toxic and kept. labels: the id, quality, toxic.

    kept: p_toxic is below the threshold, by default the one that parts the
    training labels best out of fold.
    """
    known = labels.select(id_col, (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = train(docs, known, ("low_quality", "toxic"), id_col=id_col, text_col=text_col, work=work)
    out = score(docs.drop("kept"), chain, text_col=text_col)
    return out.withColumn("kept", F.col("p_toxic") < (chain.limits[-1] if threshold is None else threshold))


def accepted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """The rows of docs that `judge` keeps, with all their columns, also those named like an output."""
    own = docs.select(*[F.col(f"`{c}`").alias(f"__doc_{c}") for c in docs.columns])
    known = labels.withColumnRenamed(id_col, f"__doc_{id_col}")
    out = judge(own, known, id_col=f"__doc_{id_col}", text_col=f"__doc_{text_col}", work=work).where("kept")
    return out.select(*[F.col(f"`__doc_{c}`").alias(c) for c in docs.columns])
