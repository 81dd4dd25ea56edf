"""Feed-forward networks with several outputs, trained on all rows of a table.

One set of hidden layers serves all targets. A row takes part with the labels it has: a missing
one adds nothing to the loss. Every round is one job: tasks add up the gradients of their rows, the
sums meet by piece of the weight vector, and the driver, whose state has the size of the weights
whatever the number of rows, takes one step. All runs (folds, settings) of a table share the jobs,
so one more fold costs arithmetic and no further pass.

Nothing depends on how rows are dealt out but the order of floating-point sums: dropped units are
chosen by a hash of row, run and round. A task that is run again gives the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.history import early_stop
from sievework.session import materialize

#: Weights in a row of summed gradients.
PIECE = 8192
#: Numbers in a block of training rows.
BLOCK = 1 << 20
BLOCKS = "n int, width int, bits boolean, x binary, row array<bigint>, y array<double>, w array<double>, parts array<int>"
TRAIN, VALIDATE = 1, 2
HISTORY = "run string, epoch bigint, loss double, val_loss double, val_accuracy double"


@dataclass(frozen=True)
class Settings:
    """What a run is trained with.

    The learning rate of round t is ``rate / (1 + decay * t)``. ``dropout`` is the share of the
    first hidden layer's units that a row leaves out; layer i > 0 leaves out ``dropout / (2 i)``.
    ``patience`` and ``min_delta`` are those of ``early_stop``.
    """

    hidden: tuple[int, ...] = (32,)
    activation: str = "relu"
    optimizer: str = "adam"
    rate: float = 0.02
    decay: float = 0.0
    l2: float = 0.0
    dropout: float = 0.0
    loss: str = "bce"
    rounds: int = 50
    patience: int = 10
    min_delta: float = 0.0001
    seed: int = 42


def halving(width: int) -> tuple[int, ...]:
    """Hidden layers that halve in width, ``int(log2(width) / 2 - 1)`` of them, one at least."""
    return tuple(width // 2 ** (i + 1) for i in range(max(int(math.log2(width) / 2 - 1), 1)))


def _relu(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(z, 0), (z > 0).astype(float)


def _tanh(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = np.tanh(z)
    return a, 1 - a * a


def _selu(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # The two constants that keep mean and variance.
    scale, alpha = 1.0507009873554805, 1.6732632423543772
    below = alpha * np.exp(np.minimum(z, 0))
    return scale * np.where(z > 0, z, below - alpha), scale * np.where(z > 0, 1.0, below)


ACTIVATIONS: dict[str, Callable] = {"relu": _relu, "tanh": _tanh, "selu": _selu}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _bce(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))), _sigmoid(z) - y


def _mse(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = _sigmoid(z)
    return (p - y) ** 2, 2 * (p - y) * p * (1 - p)


def _focal(z: np.ndarray, y: np.ndarray, gamma: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    s = 2 * y - 1
    miss = _sigmoid(-s * z)
    cost = np.maximum(-s * z, 0) + np.log1p(np.exp(-np.abs(z)))
    return miss**gamma * cost, -s * miss**gamma * (gamma * (1 - miss) * cost + miss)


#: Loss of a logit against a label, and its slope.
LOSSES: dict[str, Callable] = {"bce": _bce, "mse": _mse, "focal": _focal}


def start_weights(sizes: Sequence[int], seed: int) -> np.ndarray:
    """All weights in one vector, layer by layer, each matrix and then its offsets."""
    rng, parts = np.random.default_rng(seed), []
    for a, b in zip(sizes, sizes[1:]):
        bound = math.sqrt(6 / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), np.zeros(b)]
    return np.concatenate(parts)


def _layers(weights: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += (a + 1) * b
    return out


def _kept(rows: np.ndarray, layer: int, width: int, share: float, salt: int) -> np.ndarray:
    """Which units each row keeps, scaled so that the expected sum stays; by hash, so repeatable."""
    step = np.uint64(0x9E3779B97F4A7C15)
    unit = (np.arange(width, dtype=np.uint64) + np.uint64(layer * 1_000_003 + 1)) * step
    h = (rows.astype(np.uint64) ^ np.uint64(salt % (1 << 64)))[:, None] + unit[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h >> np.uint64(11)) / 2.0**53 >= share) / (1 - share)


def forward(weights: np.ndarray, sizes: Sequence[int], x: np.ndarray, settings: Settings) -> np.ndarray:
    """Logits of every target."""
    *hidden, last = _layers(weights, sizes)
    for w, b in hidden:
        x = ACTIVATIONS[settings.activation](x @ w + b)[0]
    return x @ last[0] + last[1]


def gradient(
    weights: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray, row_weight: np.ndarray,
    settings: Settings, rows: np.ndarray | None = None, salt: int = 0,
) -> tuple[np.ndarray, float, float]:
    """Summed gradient, summed loss and the weight of the labels that are there.

    ``y`` is NaN where a label is missing. ``rows`` are hashes of the rows, for dropout.
    """
    layers = _layers(weights, sizes)
    inputs, slopes = [x], []
    for i, (w, b) in enumerate(layers[:-1]):
        a, slope = ACTIVATIONS[settings.activation](inputs[-1] @ w + b)
        if settings.dropout and rows is not None:
            kept = _kept(rows, i, len(b), settings.dropout / (2 * i or 1), salt)
            a, slope = a * kept, slope * kept
        inputs.append(a)
        slopes.append(slope)
    there = ~np.isnan(y)
    share = there * row_weight[:, None]
    cost, delta = LOSSES[settings.loss](inputs[-1] @ layers[-1][0] + layers[-1][1], np.where(there, y, 0))
    delta = delta * share
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        parts = [(inputs[i].T @ delta).ravel(), delta.sum(axis=0), *parts]
        if i:
            delta = (delta @ layers[i][0].T) * slopes[i - 1]
    return np.concatenate(parts), float((cost * share).sum()), float(share.sum())


@dataclass
class _Run:
    """The driver's state of one run: weights, moments, history and the best weights so far."""

    name: str
    settings: Settings
    sizes: tuple[int, ...]
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    best: np.ndarray
    best_loss: float = math.inf
    waited: int = 0
    stopped: bool = False
    history: list[tuple] = field(default_factory=list)

    def step(self, epoch: int, total: np.ndarray) -> None:
        """One round's sums: gradient, then loss and label weight of both parts, then right ones."""
        s, n = self.settings, len(self.weights)
        loss, weight, val_loss, val_weight, right = total[n : n + 5].tolist()
        square = sum(float((w * w).sum()) for w, _ in _layers(self.weights, self.sizes))
        loss = loss / weight + s.l2 * square if weight else math.nan
        val = val_loss / val_weight if val_weight else math.nan
        self.history.append((self.name, epoch, loss, val, right / val_weight if val_weight else math.nan))
        # The rule of early_stop, on the same numbers.
        watched = val if val_weight else loss
        if watched < self.best_loss - s.min_delta or (self.best_loss == math.inf and not math.isnan(watched)):
            self.best, self.best_loss, self.waited = self.weights.copy(), watched, 0
        else:
            self.waited += 1
        self.stopped = self.waited >= s.patience or epoch + 1 >= s.rounds or not weight
        if self.stopped:
            return
        g = total[:n] / weight
        for (gw, _), (w, _) in zip(_layers(g, self.sizes), _layers(self.weights, self.sizes)):
            gw += 2 * s.l2 * w
        rate = s.rate / (1 + s.decay * epoch)
        if s.optimizer == "adam":
            self.first = 0.9 * self.first + 0.1 * g
            self.second = 0.999 * self.second + 0.001 * g * g
            a, b = self.first / (1 - 0.9 ** (epoch + 1)), self.second / (1 - 0.999 ** (epoch + 1))
            self.weights = self.weights - rate * a / (np.sqrt(b) + 1e-7)
        elif s.optimizer == "sgd":
            self.first = 0.9 * self.first - rate * g
            self.weights = self.weights + self.first
        else:
            raise ValueError(f"unknown optimizer {s.optimizer!r}")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values.reshape(len(column), width)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows gathered in blocks, which a round reads many times faster than rows of long arrays.
    Columns: row, x, y, w, parts. Features that are all 0 or 1 are kept as bits."""
    names = [part.split()[0] for part in BLOCKS.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(1).value_lengths().to_numpy()
        width = int(lengths[0])
        if (lengths != width).any():
            raise ValueError(f"features of {lengths.min()} to {lengths.max()} entries")
        size = max(BLOCK // max(width, 1), 1)
        for at in range(0, batch.num_rows, size):
            row, x, y, w, parts = batch.slice(at, size).columns
            values = _matrix(x, width)
            bits = bool(np.isin(values, (0.0, 1.0)).all()) and not np.signbit(values).any()
            data = np.packbits(values.astype(bool)).tobytes() if bits else values.tobytes()
            flat = lambda c, kind: pa.array([c], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([
                pa.array([len(row)], pa.int32()), pa.array([width], pa.int32()), pa.array([bits]), pa.array([data], pa.binary()),
                flat(row.to_numpy(), pa.int64()), flat(_matrix(y, -1).ravel(), pa.float64()),
                flat(w.to_numpy(), pa.float64()), flat(parts.flatten().to_numpy(), pa.int32()),
            ], names=names)


def _block(batch: pa.RecordBatch, i: int, width: int) -> tuple[np.ndarray, ...]:
    """A block's ``row, x, y, w, parts`` again."""
    n, found, bits, data, *lists = (batch.column(c)[i] for c in range(batch.num_columns))
    n, found, data = n.as_py(), found.as_py(), np.frombuffer(data.as_buffer(), np.uint8)
    if found != width:
        raise ValueError(f"features of {found} and of {width} entries")
    x = np.unpackbits(data, count=n * width).astype(np.float64) if bits.as_py() else data.view(np.float64)
    row, y, w, parts = (values.values.to_numpy() for values in lists)
    return row, x.reshape(n, width), y.reshape(n, -1), w, parts.reshape(n, -1)


def _summing(runs: list[tuple], epoch: int):
    """Sums of one round over a task's blocks of rows, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(weights) + 5) for _, _, _, weights in runs]
        for batch, i in ((batch, i) for batch in batches for i in range(batch.num_rows)):
            rows, x, y, weight, parts = _block(batch, i, runs[0][2][0])
            for k, (number, settings, sizes, weights) in enumerate(runs):
                train, val = parts[:, number] == TRAIN, parts[:, number] == VALIDATE
                salt = settings.seed * 1_000_003 + epoch * 7919 + number
                sums = gradient(weights, sizes, x[train], y[train], weight[train], settings, rows[train], salt)
                total[k][: len(weights)] += sums[0]
                total[k][len(weights) : len(weights) + 2] += sums[1:]
                if val.any():
                    z, there = forward(weights, sizes, x[val], settings), ~np.isnan(y[val])
                    share = there * weight[val][:, None]
                    cost, _ = LOSSES[settings.loss](z, np.where(there, y[val], 0))
                    right = (z >= 0) == (y[val] >= 0.5)
                    total[k][-3:] += [(cost * share).sum(), share.sum(), (right * share).sum()]
        for (number, *_), sums in zip(runs, total):
            for at in range(0, len(sums), PIECE):
                yield _piece(number, at, sums[at : at + PIECE])

    return run


def _piece(number: int, at: int, values: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([at], pa.int32()), lists], names=["run", "at", "sums"])


def _adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for number, at, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            values = sums.values.to_numpy()
            found[number, at] = found[number, at] + values if (number, at) in found else values
    for (number, at), values in found.items():
        yield _piece(number, at, values)


@dataclass(frozen=True)
class Fitted:
    """Trained runs: the weights of each run's best round, and the history of all rounds."""

    targets: list[str]
    runs: dict[str, tuple[Settings, tuple[int, ...], np.ndarray]]
    history: DataFrame
    stops: DataFrame


def fit(
    df: DataFrame, key: str, feature: str, targets: Sequence[str], runs: dict[str, Settings], weight: str | None = None
) -> Fitted:
    """Train all ``runs`` on ``df`` at once and restore the best round of each.

    A column named like the run says which part a row is of: ``train``, ``val`` or another that
    the run does not look at. ``feature`` is an array of one length; rows without it, or without
    ``key``, are left out. Targets are 0/1 or null. ``weight`` names row weights; null is 1.

    Every round's loss, before its step, is recorded: of the training rows (with dropout and
    penalty) and of the validation rows. A run ends as ``early_stop`` would end it, by the
    validation loss, or by the training loss where there are no validation rows. ``stops`` is
    ``early_stop`` over the stored history; the round it names best is the one restored.
    """
    targets, names = list(targets), list(runs)
    number = lambda c: F.col(f"`{c}`").cast("double")
    part = lambda c: F.when(F.col(f"`{c}`") == "train", TRAIN).when(F.col(f"`{c}`") == "val", VALIDATE).otherwise(0)
    rows = df.filter(F.col(feature).isNotNull() & F.col(key).isNotNull()).select(
        F.xxhash64(F.col(key).cast("string")).alias("row"),
        F.col(feature).cast("array<double>").alias("x"),
        F.array(*[F.coalesce(number(t), F.lit(float("nan"))) for t in targets]).alias("y"),
        (F.coalesce(number(weight), F.lit(1.0)) if weight else F.lit(1.0)).alias("w"),
        F.array(*[part(c) for c in names]).alias("parts"),
    )
    # Read once a round.
    rows = materialize(rows.mapInArrow(_blocks, BLOCKS), "training-rows")
    first = rows.select(F.col("width").alias("n")).first()
    states = []
    for name, settings in runs.items():
        sizes = (first.n if first else 0, *settings.hidden, len(targets))
        weights = start_weights(sizes, settings.seed)
        states.append(_Run(name, settings, sizes, weights, np.zeros_like(weights), np.zeros_like(weights), weights))
    epoch = 0
    while first and (open_ := [k for k, s in enumerate(states) if not s.stopped]):
        now = [(k, states[k].settings, states[k].sizes, states[k].weights) for k in open_]
        sums = rows.mapInArrow(_summing(now, epoch), "run int, at int, sums array<double>")
        pieces = sum(-(-(len(w) + 5) // PIECE) for *_, w in now)
        sums = sums.repartition(min(pieces, 200), "run", "at").mapInArrow(_adding, sums.schema)
        total = {k: np.zeros(len(states[k].weights) + 5) for k in open_}
        for r in sums.toArrow().to_pylist():
            total[r["run"]][r["at"] : r["at"] + len(r["sums"])] = r["sums"]
        for k in open_:
            states[k].step(epoch, total[k])
        epoch += 1
    history = df.sparkSession.createDataFrame([h for s in states for h in s.history], HISTORY)
    history = materialize(history, "history")
    fitted = {s.name: (s.settings, s.sizes, s.best) for s in states}
    return Fitted(targets, fitted, history, stops(history, runs))


def stops(history: DataFrame, runs: dict[str, Settings]) -> DataFrame:
    """``early_stop`` of a stored history, every run by its own settings."""
    watched = F.when(F.isnan("val_loss"), F.col("loss")).otherwise(F.col("val_loss"))
    long = history.select("run", "epoch", watched.alias("watched"))
    rules: dict[tuple[int, float], list[str]] = {}
    for name, s in runs.items():
        rules.setdefault((s.patience, s.min_delta), []).append(name)
    parts = [early_stop(long.filter(F.col("run").isin(*names)), "run", "epoch", "watched", *rule) for rule, names in rules.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _scorer(runs: list[tuple], targets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), runs[0][1][0])
                scores = np.hstack([_sigmoid(forward(weights, sizes, x, settings)) for settings, sizes, weights in runs])
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * scores.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(scores.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["r", "scores"])

    return run


def score(df: DataFrame, key: str, feature: str, fitted: Fitted, part: str = "test") -> DataFrame:
    """Scored rows ``(id, target, run, y_true, score)`` of every run's ``part``; map-only.

    Rows without feature have none; rows without label keep a null ``y_true``.
    """
    names, targets = list(fitted.runs), fitted.targets
    row = F.struct(
        F.col(key).alias("id"),
        F.array(*[F.col(f"`{t}`").cast("int") for t in targets]).alias("y"),
        F.array(*[F.col(f"`{c}`") == part for c in names]).alias("parts"),
    )
    rows = df.filter(F.col(feature).isNotNull()).select(row.alias("r"), F.col(feature).cast("array<double>").alias("x"))
    kind = rows.schema["r"].dataType.simpleString()
    scored = rows.mapInArrow(_scorer(list(fitted.runs.values()), len(targets)), f"r {kind}, scores array<double>")
    cells = [
        F.struct(
            F.lit(t).alias("target"), F.lit(name).alias("run"), F.get("r.parts", F.lit(i)).alias("wanted"),
            F.get("r.y", F.lit(j)).alias("y_true"), F.get("scores", F.lit(i * len(targets) + j)).alias("score"),
        )
        for i, name in enumerate(names)
        for j, t in enumerate(targets)
    ]
    long = scored.select("r.id", F.explode(F.array(*cells)).alias("c")).select("id", "c.*")
    return long.filter("wanted").drop("wanted")


def fold_runs(placed: DataFrame, fold: str, folds: int, key: str, settings: Settings, val: float = 0.2) -> tuple[DataFrame, dict[str, Settings]]:
    """A run per fold: rows of the fold are its test part, and of the others a share that a hash
    of the key picks is its validation part, the same in every layout of the table."""
    picked = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(1000)) < int(val * 1000)
    runs, columns = {}, []
    for k in range(1, folds + 1):
        runs[f"fold_{k}"] = settings
        columns.append(F.when(F.col(fold) == k, "test").when(picked, "val").otherwise("train").alias(f"fold_{k}"))
    return placed.select("*", *columns), runs


def successive_halving(
    df: DataFrame, key: str, feature: str, targets: Sequence[str], settings: dict[str, Settings],
    fold: str, folds: int, budgets: Sequence[int] = (4, 8, 16), weight: str | None = None,
) -> DataFrame:
    """Scores ``(rung, setting, fold, rounds, score)`` of all settings, the worse half of which
    drops out after every rung while the number of rounds grows.

    ``fold`` is a column of fold numbers from 1. All settings and folds of a rung are trained in
    the same jobs. The score is the least validation loss on the fold that is left out; settings
    are compared by their mean, in case of a tie by name. A setting's own number of rounds is
    replaced by the rung's.
    """
    left, parts = dict(settings), []
    for rung, rounds in enumerate(budgets):
        placed, runs = df, {}
        for k in range(1, folds + 1):
            cut = F.when(F.col(fold) == k, "val").otherwise("train")
            for name, s in left.items():
                run = f"{name}|{k}"
                runs[run] = replace(s, rounds=rounds, patience=rounds + 1)
                placed = placed.withColumn(run, cut)
        found = fit(placed, key, feature, targets, runs, weight).history
        name, number = F.regexp_extract("run", r"^(.*)\|(\d+)$", 1), F.regexp_extract("run", r"^(.*)\|(\d+)$", 2)
        scores = found.groupBy(name.alias("setting"), number.cast("int").alias("fold")).agg(F.min("val_loss").alias("score"))
        parts.append(materialize(scores.select(F.lit(rung).alias("rung"), "setting", "fold", F.lit(rounds).alias("rounds"), "score"), "scores"))
        # One row per setting.
        means = parts[-1].groupBy("setting").agg(F.avg("score").alias("mean")).orderBy("mean", "setting").collect()
        left = {r.setting: left[r.setting] for r in means[: -(-len(means) // 2)]}
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def halving_ranks(scores: DataFrame) -> DataFrame:
    """``(setting, rung, mean, rank)``: settings that got further first, then by mean score."""
    means = scores.groupBy("setting", "rung").agg(F.avg("score").alias("mean"))
    last = means.groupBy("setting").agg(F.max_by(F.struct("rung", "mean"), "rung").alias("r")).select("setting", "r.*")
    # One row per setting, so one task will do.
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("rung"), "mean", "setting")
    return last.withColumn("rank", F.row_number().over(order))
