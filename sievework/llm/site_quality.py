"""Document quality, with posteriors of hosts and paths by hierarchical empirical Bayes.

A logistic classifier on surface features gives every document its evidence. Grouped sums of it
give each host, and each path of a host, an expected share of good documents, shrunk towards the
level above: hosts towards the corpus, paths towards their host. How strongly a level shrinks is
estimated from how much the shares vary between its groups (method of moments). The document's
posterior is its evidence with the path's share as the prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.arrays import range_hashes, runs_of, steps, utf8
from sievework.llm.stored import all_columns, materialize

#: Labelled documents used for the fit, at most; those with the smallest seeded hash.
TRAIN_ROWS = 20_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 44, 46, 58, 59, 63]] = True
FEATURES = 13


def features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Surface features of each row; all zero for rows without words."""
    rows = len(starts) - 1
    out = np.zeros((rows, FEATURES))

    def per_row(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[starts]).astype(float)

    size = np.maximum(np.diff(starts), 1).astype(float)
    space, letter, digit, stop = _SPACE[data], _LETTER[data], _DIGIT[data], _STOP[data]
    begin, end = runs_of(~space, starts)
    words = range_hashes(data, begin, end) if len(begin) else np.zeros(0, np.uint64)
    first = np.searchsorted(begin, starts)
    n = np.diff(first).astype(float)
    some = np.maximum(n, 1)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = words[1:] == words[:-1]
    again[first[:-1][np.diff(first) > 0]] = False
    sums = np.concatenate([[0], np.cumsum(end - begin)])[first]
    lone = np.concatenate([[0], np.cumsum(~letter[begin] & (end - begin == 1))])[first] if len(begin) else np.zeros(rows + 1)
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(first[:-1], first[1:])], dtype=float)
    out[:, 0] = per_row(letter) / size
    out[:, 1] = per_row(digit) / size
    out[:, 2] = per_row(stop) / some
    out[:, 3] = per_row(~(space | letter | digit | stop)) / some
    out[:, 4] = np.log1p(n)
    out[:, 5] = np.log1p(np.diff(sums) / some)
    out[:, 6] = distinct / some
    out[:, 7] = np.diff(np.concatenate([[0], np.cumsum(again)])[first]) / some
    out[:, 8] = np.diff(lone) / some
    out[:, 9] = per_row(data == 10) / some
    out[:, 10] = per_row((data >= 65) & (data <= 90)) / some
    out[:, 11] = out[:, 3] > 0.25
    out[:, 12] = (distinct / some) * np.log1p(n)
    out[n == 0] = 0.0
    return out


def _map_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = utf8(batch.column(0))
        for a, b in steps(starts):
            x = features(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
            ends = pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1).slice(a, b - a)], names=["x", "y"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, rounds: int = 25, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the classifier: mean and scale of the features, then intercept and slopes.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` needs ``doc_id`` and ``y``; rows without
    text or label are left out. At most ``rows`` labels are used, those with the smallest hash of
    the id. Without labels of both kinds all slopes are zero.
    """
    chosen = labels.filter("y is not null").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows)
    chosen = F.broadcast(chosen.select("doc_id", F.col("y").cast("double").alias("y")))
    sample = docs.filter("text is not null").select("doc_id", "text").join(chosen, "doc_id").select("text", "y")
    got = sample.mapInArrow(_map_features, "x array<double>, y double").toArrow()
    if got.num_rows == 0 or len(set(got.column("y").to_pylist())) < 2:
        share = (sum(got.column("y").to_pylist()) + 1) / (got.num_rows + 2)
        return np.concatenate([np.zeros(FEATURES), np.ones(FEATURES), [np.log(share / (1 - share))], np.zeros(FEATURES)])
    x = np.array(got.column("x").to_pylist())
    y = np.array(got.column("y").to_pylist())
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * len(y) * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + (ridge * len(y) + 1e-6) * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return np.concatenate([mean, scale, w])


def _score(weights: np.ndarray):
    mean, scale, w = weights[:FEATURES], weights[FEATURES : 2 * FEATURES], weights[2 * FEATURES :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column(1))
            parts = [np.zeros(0)]
            for a, b in steps(starts):
                x = features(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                parts.append(np.clip(w[0] + (x - mean) / scale @ w[1:], -20, 20))
            out = [batch.column(0), pa.array(np.concatenate(parts)), batch.column(2), batch.column(3)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "evidence", "host", "path"])

    return run


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _shrunk(kappa: float) -> Column:
    """A group's share, drawn towards the level above as by ``kappa`` more documents."""
    return (F.col("s") + kappa * F.col("above")) / (F.col("n") + kappa)


def _strength(groups: DataFrame) -> float:
    """How many documents the prior ``above`` is worth for groups of ``n`` documents, ``s`` good.

    By moments: the variance of the groups' shares beyond what single documents' variance
    explains; groups weigh by their size. Few or equal groups shrink fully, up to a bound.
    """
    spread = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("above"), 2))
    within = F.sum(F.col("n") * F.col("above") * (1 - F.col("above")))
    got = groups.agg(spread, within, F.sum("n"), F.count("*")).first()
    if not got[3]:
        return 1e4
    noise, size = got[1] / got[2], got[2] / got[3]
    excess = max(got[0] / got[2] - noise / size, noise * 1e-4)
    return min(max(noise / excess - 1, 1.0), 1e4)


def posteriors(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, evidence, host_share, path_share, score)`` of every document.

    ``docs`` needs ``doc_id``, ``text`` and the columns named by ``host`` and ``path``; null names
    are a group of their own, null texts have no words. ``labels`` is as for ``fit``.
    """
    weights = fit(docs, labels, rows)
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.to_json(F.struct(F.col(host))).alias("host"),
        F.to_json(F.struct(F.col(host), F.col(path))).alias("path"),
    )
    scored = named.mapInArrow(_score(weights), "doc_id long, evidence double, host string, path string")
    scored = materialize(scored, "evidence")
    prob = 1 / (1 + F.exp(-F.col("evidence")))
    paths = materialize(
        scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(prob).alias("s")), "paths"
    )
    total = paths.agg(F.sum("s"), F.sum("n")).first()
    corpus = min(max(((total[0] or 0) + 0.5) / ((total[1] or 0) + 1), 0.001), 0.999)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    hosts = materialize(hosts.withColumn("above", F.lit(corpus)), "hosts")
    hosts = hosts.select("host", _shrunk(_strength(hosts)).alias("above"))
    below = materialize(paths.join(hosts, "host"), "below")
    below = below.select("path", F.col("above").alias("host_share"), _shrunk(_strength(below)).alias("path_share"))
    below = materialize(below, "shares").withColumn("corpus", F.lit(corpus))
    odds = F.col("evidence") + _logit(F.col("path_share")) - _logit(F.col("corpus"))
    return scored.join(below, "path").select(
        "doc_id", "evidence", "host_share", "path_share", (1 / (1 + F.exp(-odds))).alias("score")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose posterior is at least ``threshold``, in the columns of ``docs``.

    What is rejected grows with the table, so it is always removed by a shuffle join.
    """
    bad = posteriors(docs, labels).filter(F.col("score") < threshold).select("doc_id")
    return docs.join(materialize(bad, "rejected").hint("merge"), "doc_id", "left_anti").select(*all_columns(docs))
