"""Toxicity by multiple-instance learning: sentence scores, learned from labels of documents.

A document is toxic if one of its sentences is, or for no reason that its words show: its
probability is the noisy-or ``1 - (1 - leak) * prod(1 - q)``. ``q`` is a logistic function of the
hashed words and word beginnings in a sentence; a sentence without any known feature has ``q = 0``,
so a long text is not toxic for its length. The gradient of the document's loss spreads over the
sentences by how much each contributes, so the model also tells which sentences offend.

Which features are known is decided by their false discovery rate among the features that are as
common, so the same rule holds for ten and for thousands of toxic documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.arrays import U64, range_hashes, runs_of, steps, utf8
from sievework.llm.stored import materialize

#: Labelled documents used for the fit, at most; those with the smallest seeded hash.
TRAIN_ROWS = 8_000
BITS = 22
#: A known feature's false discovery rate is below the first, its log odds above the second.
MOST_FALSE, LEAST_ODDS = 0.2, 2.0
#: Bytes of a word's beginning that are a feature of their own; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6)


class Model(NamedTuple):
    """Known features with their weights, the sentences' intercept, and the documents' leak."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float
    leak: float

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[10, 33, 46, 63]] = True


def sentences(data: np.ndarray, starts: np.ndarray):
    """Features (words x kinds), the sentence of each word, and the sentences' rows and spans."""
    inside = ~_BREAK[data]
    first, last = runs_of(inside, starts)
    row = np.searchsorted(starts, first, side="right") - 1
    begin, end = runs_of(_LETTER[data], starts)
    lower = _LOWER[data]
    feats = np.zeros((len(begin), len(BEGINNINGS)), dtype=np.int64)
    for k, size in enumerate(BEGINNINGS):
        stop = np.minimum(begin + size, end) if size else end
        h = range_hashes(lower, begin, stop) if len(begin) else np.zeros(0, U64)
        feats[:, k] = ((h ^ (U64(k) << U64(62))) * U64(0x9E3779B97F4A7C15) >> U64(64 - BITS)).astype(np.int64)
    return feats, np.searchsorted(first, begin, side="right") - 1, row, first, last


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: in how many toxic and in how many other documents each feature occurs."""
    for batch in batches:
        data, starts = utf8(batch.column(0))
        toxic = np.asarray(batch.column(1)) > 0
        for a, b in steps(starts):
            feats, of, row, _, _ = sentences(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
            held = np.unique((row[of][:, None] << BITS | feats).ravel())
            kinds, place = np.unique(held & (1 << BITS) - 1, return_inverse=True)
            bad = np.bincount(place, toxic[a:b][held >> BITS], len(kinds)).astype(np.int32)
            columns = [kinds.astype(np.int32), bad, np.bincount(place, minlength=len(kinds)).astype(np.int32) - bad]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["feature", "toxic", "other"])


def _bags(features: np.ndarray):
    """Per document: its known features, and which of the sentences that have any holds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.full(1 << BITS, -1, dtype=np.int32)
        index[features] = np.arange(len(features))
        for batch in batches:
            data, starts = utf8(batch.column(0))
            label = np.asarray(batch.column(1))
            for a, b in steps(starts):
                feats, of, row, _, _ = sentences(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                near = index[feats]
                word, kind = np.nonzero(near >= 0)
                at = of[word]
                cuts = np.searchsorted(row[at], np.arange(b - a + 1))
                rows = [(near[word[i:j], kind[i:j]], at[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]
                places = [np.unique(x, return_inverse=True)[1].astype(np.int32) for _, x in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x for x, _ in rows], pa.list_(pa.int32())),
                        pa.array(places, pa.list_(pa.int32())),
                        pa.array(label[a:b], pa.float64()),
                    ],
                    names=["feats", "places", "y"],
                )

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, rounds: int = 400, rate: float = 0.2) -> Model:
    """The model of ``docs`` (``doc_id``, ``text``) with ``labels`` (``doc_id``, ``y``).

    Rows without text or label are left out. At most ``rows`` labels are used. Features are counted
    by Spark; the driver gets the counts of features of toxic documents (at most ``2 ** BITS``), and
    of each document the places of its known features, not its text. Without labels of both kinds
    no feature is known, and the leak follows the labels there are.
    """
    chosen = labels.filter("y is not null").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(rows)
    chosen = F.broadcast(chosen.select("doc_id", F.col("y").cast("double").alias("y")))
    sample = docs.filter("text is not null").select("doc_id", "text").join(chosen, "doc_id").select("text", "y")
    sample = materialize(sample, "toxicity-sample")
    n1, n0 = sample.agg(F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)).first()
    none = np.zeros(0)
    if not n1 or not n0:
        return Model(none.astype(np.int64), none, 0.0, (n1 + 0.05) / (n1 + n0 + 1))
    tally = sample.mapInArrow(_tally, "feature int, toxic int, other int").groupBy("feature")
    tally = tally.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    tally = materialize(tally, "toxicity-tally")
    held = tally.filter("toxic > 0").toArrow()
    often = tally.groupBy((F.col("toxic") + F.col("other")).alias("n")).agg(F.count("*").alias("m")).toArrow()
    features, weights = _known(
        *(np.asarray(held.column(c).combine_chunks()) for c in ("feature", "toxic", "other")),
        *(np.asarray(often.column(c).combine_chunks()) for c in ("n", "m")),
        (n1, n0),
    )
    got = sample.mapInArrow(_bags(features), "feats array<int>, places array<int>, y double").toArrow()
    y = np.asarray(got.column("y").combine_chunks())
    near = np.asarray(got.column("feats").combine_chunks().flatten())
    lists = got.column("places").combine_chunks()
    words = np.asarray(lists.value_lengths()).astype(np.int64)
    places = np.asarray(lists.flatten()).astype(np.int64)
    # Documents without known features are toxic by the leak alone.
    bare = words == 0
    leak = (float(y[bare].sum()) + 0.05) / (int(bare.sum()) + 1)
    count = np.zeros(len(y), dtype=np.int64)
    np.maximum.at(count, np.repeat(np.arange(len(y)), words), places + 1)
    base = np.concatenate([[0], np.cumsum(count)])
    of = places + np.repeat(base[:-1], words)
    doc = np.repeat(np.arange(len(y)), count)
    weights = np.append(weights, -4.0)
    squares = np.ones(len(weights))
    for _ in range(rounds if len(near) else 0):
        z = np.clip(np.bincount(of, weights[near], base[-1]) + weights[-1], -30, 30)
        total = np.maximum(np.bincount(doc, np.logaddexp(0, z), len(y)) - np.log1p(-leak), 1e-12)
        slope = np.where(y > 0, -1 / np.expm1(np.minimum(total, 50)), 1.0)
        per = slope[doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(near, per[of], len(features)), per.sum())
        squares += grad * grad
        weights -= rate * grad / np.sqrt(squares)
    return Model(features, weights[:-1], float(weights[-1]), leak)


def _known(
    feature: np.ndarray, toxic: np.ndarray, other: np.ndarray, n: np.ndarray, m: np.ndarray, docs: tuple[int, int]
) -> tuple[np.ndarray, np.ndarray]:
    """Features that speak for toxic documents, and their shrunk log odds as first weights.

    Were a feature of ``c`` documents indifferent, ``toxic`` of them or more would be toxic with a
    probability below Chernoff's bound. Within a band of features that are as common, the bound times
    their number over the feature's rank is the rate of false discoveries; the odds shrink by it.
    ``m`` features in all occur in ``n`` documents.
    """

    def band(count):
        return np.where(count < 8, count, 5 + np.floor(np.log2(np.maximum(count, 1)))).astype(np.int64)

    n1, n0 = docs
    share, c = n1 / (n1 + n0), (toxic + other).astype(float)
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((other + 0.5) / (n0 + 1))
    gain = toxic * np.log(toxic / (c * share)) + other * np.log(np.maximum(other, 1e-9) / (c * (1 - share)))
    chance = np.where(toxic > c * share, np.exp(-gain), 1.0)
    false = np.ones(len(feature))
    bands = band(c)
    sizes = np.bincount(band(n), m)
    for b in np.unique(bands):
        mine = np.flatnonzero(bands == b)
        mine = mine[np.argsort(chance[mine], kind="stable")]
        rate = chance[mine] * sizes[b] / np.arange(1, len(mine) + 1)
        false[mine] = np.minimum.accumulate(rate[::-1])[::-1]
    use = np.flatnonzero((false < MOST_FALSE) & (odds > LEAST_ODDS))
    use = use[np.argsort(feature[use])]
    return feature[use].astype(np.int64), (np.minimum(odds, 4.0) * (1 - false))[use]


def _score(model: Model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slopes, known = np.zeros(1 << BITS), np.zeros(1 << BITS, dtype=bool)
        slopes[model.features] = model.weights
        known[model.features] = True
        for batch in batches:
            data, starts = utf8(batch.column(1))
            for a, b in steps(starts):
                feats, of, row, first, last = sentences(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                z = np.bincount(of, slopes[feats].sum(axis=1), len(row)) + model.intercept
                z = np.where(np.bincount(of, known[feats].any(axis=1), len(row)) > 0, np.clip(z, -30, 30), -np.inf)
                q = 1 / (1 + np.exp(-z))
                total = np.bincount(row, np.logaddexp(0, z), b - a) - np.log1p(-model.leak)
                inner = starts[a : b + 1] - starts[a]
                spans: list[list[dict]] = [[] for _ in range(b - a)]
                for k in np.flatnonzero(q >= least):
                    r = row[k]
                    spans[r].append({"start": int(first[k] - inner[r]), "end": int(last[k] - inner[r]), "score": float(q[k])})
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
                columns = [batch.column(0).slice(a, b - a), pa.array(-np.expm1(-total)), pa.array(spans, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "offending"])

    return run


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``(doc_id, score, offending)``: the probability of each document and its bad sentences.

    ``docs`` needs ``doc_id`` and ``text``; null is an empty text, which scores the leak, as does
    any text without known features. Sentences end at full stops, question and exclamation marks and
    line breaks; ``offending`` gives those whose own probability is at least ``least``, as byte places in the text. Every row is scored by
    itself: repeated rows and rows with a null id stay, other columns play no part.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>"
    return texts.mapInArrow(_score(model, least), kind)
