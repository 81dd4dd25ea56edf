"""Repeated byte strings, by a logarithmic family of sparse suffix arrays.

Texts arrive in batches in the order of their ids. From every ``length`` consecutive bytes one
suffix is sampled: the one whose first ``GRAM`` bytes hash lowest, so equal strings sample the
same place. A sampled suffix stands for the run of windows that chose it and is known by
fingerprints of its first bytes (gram) and of all bytes of its windows (context). The array of a
batch is sorted by (gram, context), which puts equal prefixes next to each other.

A batch is merge-scanned with the arrays of all existing levels in one sorted pass:

* an equal context that starts earlier: all its windows are repeats;
* an equal gram in other contexts: the windows may be repeats in part, and are set aside;
* contexts that are new go into the batch's own array, a level of size one. Levels of equal size
  are merged in the same pass, so there are at most log2(batches) levels.

Windows set aside are compared in the end, in blocks of eight that begin one byte apart: they
share a core, and only blocks whose core occurs again are compared window by window, by the core
and the few bytes around it. All but the first of equal windows are repeats. In every sorted pass
equal rows of a task are folded before they are shuffled, and of keys with very many different
rows only a few go through the pass, so no key gathers its rows in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.arrays import U64, mix, utf8
from sievework.llm.stored import materialize, shuffles_freed
from sievework.session import shared_path

#: Bytes that name a suffix.
GRAM = 32
#: Bytes that are scanned at once; longer texts are cut, with overlaps, between windows.
SCAN_BYTES = 1 << 20
#: Contexts of one gram in one task beyond which further ones are set aside unsorted.
MANY = 16
BATCHES = 4
#: Kinds of rows: sampled, repeated throughout, to be looked at window by window.
SAMPLE, REPEAT, ASIDE = 0, 1, 2
#: Windows of a block.
BLOCK = 8

_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_C = [U64(0xC2B2AE3D27D4EB4F), U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)]
_NAMES = ["kind", "gram", "context", "doc_id", "pos", "before", "span"]
SAMPLES = "kind int, gram long, context long, doc_id long, pos long, before int, span int"


def _doubled(x: np.ndarray, shift: int) -> np.ndarray:
    """Fingerprints of twice the length, from those of neighbours ``shift`` apart."""
    z = x[:-shift] * _C[0]
    z += x[shift:]
    z ^= z >> U64(32)
    return z


def prints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the 32 and of the 64 bytes from each place on."""
    h = _TABLE[data]
    for shift in (1, 2, 4, 8, 16):
        h = _doubled(h, shift) if len(h) > shift else h[:0]
    return h, (_doubled(h, 32) if len(h) > 32 else h[:0])


def _pieces(starts: np.ndarray, length: int) -> Iterator[tuple[list[tuple[int, int, int]], int, int]]:
    """Byte ranges to scan, each with its (row, begin, end) parts; parts of a row overlap."""
    parts, low = [], 0
    for row in range(len(starts) - 1):
        s, e = int(starts[row]), int(starts[row + 1])
        if e - s < length:
            continue
        if parts and e - low > SCAN_BYTES:
            yield parts, low, parts[-1][2]
            parts = []
        if not parts:
            low = s
        while e - s > SCAN_BYTES:
            yield [(row, s, s + SCAN_BYTES)], s, s + SCAN_BYTES
            s += SCAN_BYTES - length + 1
            low = s
        parts.append((row, s, e))
    if parts:
        yield parts, low, parts[-1][2]


def _sampled(data: np.ndarray, parts: list[tuple[int, int, int]], low: int, high: int, length: int):
    """(row, pos, before, span, gram, context) of the suffixes sampled in ``data[low:high]``."""
    part = data[low:high]
    h32, h64 = prints(part)
    grams = mix(h32)
    least = (grams & ~U64(SCAN_BYTES * 4 - 1)) | np.arange(len(grams), dtype=U64)
    width, have = length - GRAM + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    place = (least & U64(SCAN_BYTES * 4 - 1)).astype(np.int64)
    row, begin, end = (np.array(x, dtype=np.int64) for x in zip(*parts))
    edge = np.zeros(len(place) + 1, dtype=np.int32)
    np.add.at(edge, begin - low, 1)
    np.add.at(edge, end - low - length + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    new = np.ones(len(place), dtype=bool)
    # The windows before the first of a text reach into it and may have chosen the same place.
    new[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    first = np.flatnonzero(valid & new)
    stop = np.append(np.flatnonzero(new)[1:], len(place))
    last = stop[np.searchsorted(stop, first, side="right")] - 1
    ends = (end - low - length)[np.searchsorted(begin - low, first, side="right") - 1]
    last = np.minimum(last, ends)
    pos, span = place[first], last - first
    mid = first + (span + length - 64) // 2
    context = h64[first] * _C[1] + h64[mid] * _C[2] + h64[last + length - 64] * _C[3]
    context = mix(context + (pos - first).astype(U64) * _C[4] + (span.astype(U64) << U64(48)))
    which = np.searchsorted(begin - low, first, side="right") - 1
    return row[which], pos + low, pos - first, span, grams[pos], context


def _sample(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column(1))
            ids = np.asarray(batch.column(0))
            got = [_sampled(data, *x, length) for x in _pieces(starts, length)]
            if not got:
                continue
            row, pos, before, span, gram, context = (np.concatenate(x) for x in zip(*got))
            doc, pos = ids[row], pos - starts[row]
            order = np.lexsort((pos, doc, context, gram))
            doc, pos, before, span, gram, context = (x[order] for x in (doc, pos, before, span, gram, context))
            new_gram = np.ones(len(gram), dtype=bool)
            new_gram[1:] = gram[1:] != gram[:-1]
            new = new_gram.copy()
            new[1:] |= context[1:] != context[:-1]
            # How many contexts the gram has had so far.
            number = np.cumsum(new)
            number -= np.maximum.accumulate(np.where(new_gram, number, 0))
            kind = np.where(~new, REPEAT, np.where(number >= MANY, ASIDE, SAMPLE)).astype(np.int32)
            for at in range(0, len(kind), 50_000):
                cut = slice(at, at + 50_000)
                columns = [kind[cut], gram[cut].view(np.int64), context[cut].view(np.int64), doc[cut], pos[cut]]
                columns += [before[cut].astype(np.int32), span[cut].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_NAMES)

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over rows sorted by (gram, context, place); ``old`` rows are from earlier batches.

    Gives ``out`` 0 for rows of the array, 1 for repeats and 2 for rows to look at by window. Only
    the last row is carried from one batch to the next.
    """
    held: tuple | None = None
    for batch in batches:
        table = {c: np.asarray(batch.column(c)) for c in batch.schema.names}
        if batch.num_rows == 0:
            continue
        plain = table["kind"] == SAMPLE
        gram, context = table["gram"], table["context"]
        n = len(gram)
        same_gram = np.zeros(n, dtype=bool)
        same_gram[1:] = (gram[1:] == gram[:-1]) & plain[1:] & plain[:-1]
        same = same_gram.copy()
        same[1:] &= context[1:] == context[:-1]
        several = False
        if held is not None and plain[0]:
            same_gram[0] = held[0] == gram[0]
            same[0] = same_gram[0] and held[1] == context[0]
            several = bool(same_gram[0] and held[2])
        # Whether another context of the gram stands before or behind the row.
        group = np.cumsum(~same_gram)
        fresh = np.flatnonzero(same_gram & ~same)
        mixed = np.zeros(int(group[-1]) + 1, dtype=bool)
        mixed[group[fresh]] = True
        if same_gram[0] and several:
            mixed[group[0]] = True
        many = mixed[group]
        new = ~table["old"]
        out = [(0, plain & ~same & table["write"]), (0, (table["kind"] == ASIDE) & table["write"])]
        out += [(1, new & ((plain & same) | (table["kind"] == REPEAT)))]
        out += [(2, (plain & ~same & many) | (table["kind"] == ASIDE))]
        rows = [(k, batch.filter(pa.array(m))) for k, m in out if m.any()]
        if held is not None and same_gram[0] and mixed[group[0]] and not held[2]:
            # The group's first row came with the batch before and now turns out not to be alone.
            rows.append((2, held[3]))
        for k, b in rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, k, np.int32))] + [b.column(c) for c in _NAMES], names=["out", *_NAMES])
        if plain[-1]:
            tail_first = int(np.flatnonzero(group == group[-1])[0])
            alone = held[3] if held is not None and same_gram[0] and group[-1] == group[0] else batch.slice(tail_first, 1)
            held = (gram[-1], context[-1], bool(many[-1]), alone)
        else:
            held = None


def _packed(data: np.ndarray, at: np.ndarray, step: int, low: int, high: int) -> np.ndarray:
    """The bytes at ``at``, ``at + step``, ... of a block's edge in one number, the first lowest."""
    out = np.zeros(len(at), dtype=U64)
    for k in range(BLOCK - 1):
        place = at + k * step
        byte = np.where((place >= low) & (place < high), data[np.clip(place, 0, len(data) - 1)], 0)
        out |= byte.astype(U64) << U64(8 * k)
    return out


def _numbered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by the keys: whether each equals the one before, by all keys and the first two."""
    same = np.zeros(len(keys[0]), dtype=bool)
    same[1:] = (keys[0][1:] == keys[0][:-1]) & (keys[1][1:] == keys[1][:-1])
    equal = same.copy()
    for k in keys[2:]:
        equal[1:] &= k[1:] == k[:-1]
    return equal, same


def _blocks(length: int):
    """Blocks of the windows set aside: (kind, gram, core, before, behind, doc_id, at, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in range(0, whole.num_rows, 1000):
                batch = whole.slice(part, 1000)
                data, starts = utf8(batch.column("text"))
                got = []
                for row, doc in enumerate(batch.column("doc_id").to_pylist()):
                    cells = batch.column("aside")[row].values
                    gram, pos, before, span = (np.asarray(cells.field(c)).astype(np.int64) for c in range(4))
                    begin, end = int(starts[row]), int(starts[row + 1])
                    for piece in range(0, end - begin, SCAN_BYTES):
                        mine = (pos >= piece) & (pos < piece + SCAN_BYTES)
                        if mine.any():
                            cut = (max(begin + piece - length, begin), min(begin + piece + SCAN_BYTES + length, end))
                            x = (gram[mine], pos[mine] + begin - cut[0], before[mine], span[mine])
                            got.append(_blocks_of(data[cut[0] : cut[1]], *x, doc, cut[0] - begin, length))
                if not got:
                    continue
                gram, core, left, right, doc, at, low, high = (np.concatenate(x) for x in zip(*got))
                order = np.lexsort((at, doc, high, low, right, left, core, gram))
                gram, core, left, right, doc, at, low, high = (x[order] for x in (gram, core, left, right, doc, at, low, high))
                equal, same = _numbered(gram, core, left, right, low, high)
                number = np.cumsum(~equal)
                number -= np.maximum.accumulate(np.where(same, 0, number))
                kind = np.where(equal, REPEAT, np.where(number >= MANY, ASIDE, SAMPLE)).astype(np.int32)
                for cut in range(0, len(kind), 50_000):
                    c = slice(cut, cut + 50_000)
                    longs = [x[c].view(np.int64) for x in (gram, core, left, right, doc, at)]
                    rest = [x[c].astype(np.int32) for x in (low, high)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kind[c], *longs, *rest)], names=_BLOCK_NAMES)

    return run


_BLOCK_NAMES = ["kind", "gram", "core", "before", "behind", "doc_id", "at", "low", "high"]
BLOCKS = "kind int, gram long, core long, before long, behind long, doc_id long, at long, low int, high int"


def _blocks_of(data, gram, pos, before, span, doc, shift, length):
    """Blocks of one text; ``pos`` are places in ``data``, which begins at ``shift`` of the text."""
    _, h64 = prints(data)
    one, two = (before - span) // BLOCK, before // BLOCK
    count = two - one + 1
    j = np.repeat(one, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    gram, pos, before, span = (np.repeat(x, count) for x in (gram, pos, before, span))
    low = np.maximum(before - span - j * BLOCK, 0)
    high = np.minimum(before - j * BLOCK, BLOCK - 1)
    at = pos - j * BLOCK
    inner = length - BLOCK + 1
    core = mix(h64[at] * _C[1] + h64[at + inner - 64] * _C[2] + j.astype(U64) * _C[3])
    left = _packed(data, at - 1, -1, 0, len(data))
    right = _packed(data, at + inner, 1, 0, len(data))
    return gram.view(U64), core, left, right, np.full(len(at), doc), at + shift, low, high


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the blocks whose core occurs again, from rows sorted by (gram, core).

    ``kind`` is REPEAT where an equal window of the task starts earlier. Only the last row is
    carried on.
    """
    held: tuple | None = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held[0], batch])
        if not batch.num_rows:
            continue
        kind, gram, core = (np.asarray(batch.column(c)) for c in ("kind", "gram", "core"))
        plain = kind == SAMPLE
        same = np.zeros(len(gram), dtype=bool)
        same[1:] = (gram[1:] == gram[:-1]) & (core[1:] == core[:-1]) & plain[1:] & plain[:-1]
        use = same.copy()
        use[:-1] |= same[1:]
        if held is not None:
            use[0] = (use[0] or held[1]) and not held[2]
        use |= (kind == ASIDE) | (kind == REPEAT)
        if held is not None and held[2]:
            use[0] = False
        held = (batch.slice(batch.num_rows - 1), bool(same[-1]), bool(use[-1]) or (len(gram) == 1 and held is not None and held[2]))
        yield from _exploded(batch.filter(pa.array(use)))


def _exploded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    kind, gram, core, left, right, doc, at, low, high = (np.asarray(batch.column(c)) for c in _BLOCK_NAMES)
    found: list[list[np.ndarray]] = []
    for k in range(BLOCK):
        here = (low <= k) & (k <= high)
        # A window takes the last k bytes before the core and the first ones behind it.
        a = left[here].view(U64) & U64((1 << 8 * k) - 1)
        b = right[here].view(U64) & U64((1 << 8 * (BLOCK - 1 - k)) - 1)
        key = mix(mix(a + _C[k % 5]) * _C[2] + b + U64(k))
        key = mix(key + core[here].view(U64) * _C[3] + gram[here].view(U64))
        found.append([kind[here], core[here], key.view(np.int64), doc[here], at[here] - k])
    kind, core, key, doc, start = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((start, doc, kind == REPEAT, key, core))
    kind, core, key, doc, start = (x[order] for x in (kind, core, key, doc, start))
    same = np.zeros(len(core), dtype=bool)
    same[1:] = (core[1:] == core[:-1]) & (key[1:] == key[:-1])
    again = same | (kind == REPEAT)
    for cut in range(0, len(core), 50_000):
        c = slice(cut, cut + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(x[c]) for x in (core, key, doc, start, again)], names=["core", "print", "doc_id", "start", "again"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (again, core, print, place), all but the first of each; folded rows as well."""
    held = None
    for batch in batches:
        c, w, again = (np.asarray(batch.column(x)) for x in ("core", "print", "again"))
        if not len(c):
            continue
        same = np.zeros(len(c), dtype=bool)
        same[1:] = (c[1:] == c[:-1]) & (w[1:] == w[:-1])
        same[0] = held == (c[0], w[0])
        held = (c[-1], w[-1])
        yield batch.select(["doc_id", "start"]).filter(pa.array(same | again))


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                data, starts = utf8(batch.column("text"))
                kept, spans = [], []
                for row, found in enumerate(batch.column("found").to_pylist()):
                    text = data[starts[row] : starts[row + 1]]
                    if not found:
                        kept.append(text.tobytes())
                        spans.append([])
                        continue
                    edge = np.zeros(len(text) + 1, dtype=np.int64)
                    first, last = np.array([(x["first"], x["last"]) for x in found], dtype=np.int64).T
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept.append(text[~gone].tobytes())
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    spans.append([{"start": s, "end": e} for s, e in turns.reshape(-1, 2).tolist()])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                columns = [batch.column("doc_id"), pa.array(np.diff(starts)), pa.array(kept, pa.binary()), pa.array(spans, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "kept", "spans"])

    return run


class SuffixIndex:
    """The levels, and what the batches added so far have found."""

    def __init__(self, spark: SparkSession, length: int = 100):
        if not 63 + BLOCK <= length <= 128:
            raise ValueError(f"length must be from {63 + BLOCK} to 128 bytes")
        self.spark, self.length = spark, length
        self.levels: list[tuple[int, DataFrame, str]] = []
        self.found: list[DataFrame] = []

    def add(self, docs: DataFrame, keep: bool = True) -> None:
        """Scan a batch (``doc_id`` and ``text``) whose ids are all above those added before.

        With ``keep`` False the levels stay as they are, as for the last batch of all.
        """
        texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        merged, size = 0, 1
        while keep and merged < len(self.levels) and self.levels[-1 - merged][0] == size:
            merged, size = merged + 1, 2 * size
        rows = texts.mapInArrow(_sample(self.length), SAMPLES)
        rows = rows.withColumn("old", F.lit(False)).withColumn("write", F.lit(keep))
        for k, (_, level, _) in enumerate(reversed(self.levels)):
            rows = rows.unionByName(level.withColumn("old", F.lit(True)).withColumn("write", F.lit(k < merged)))
        key = F.when(F.col("kind") == SAMPLE, F.col("gram")).otherwise(F.xxhash64("doc_id", "pos"))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(parts, key).sortWithinPartitions("kind", "gram", "context", F.desc("old"), "doc_id", "pos")
        with shuffles_freed(self.spark):
            scanned = rows.mapInArrow(_scan, f"out int, {SAMPLES}")
            path = shared_path(self.spark, "level")
            scanned.write.partitionBy("out").parquet(path)
        out = self.spark.read.schema(f"{SAMPLES}, out int").parquet(path)
        gone = self.levels[len(self.levels) - merged :]
        if keep:
            level = (size, out.filter("out = 0").drop("out"), path)
            self.levels = [*self.levels[: len(self.levels) - merged], level]
            self._empty(gone)
        self.found.append(out.filter("out > 0"))

    def _empty(self, levels: list[tuple[int, DataFrame, str]]) -> None:
        """Give back the space of levels that are merged into another, or no longer needed."""
        for _, _, path in levels:
            self.spark.createDataFrame([], SAMPLES).write.mode("overwrite").parquet(f"{path}/out=0")

    def close(self) -> None:
        """Drop all levels; what was found stays."""
        self._empty(self.levels)
        self.levels = []

    def removals(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, first, last)``: runs of window starts in ``docs`` that are repeats.

        ``docs`` holds all texts added so far.
        """
        found = self.found[0]
        for more in self.found[1:]:
            found = found.unionByName(more)
        whole = found.filter(f"out = {REPEAT}").select(
            "doc_id", (F.col("pos") - F.col("before")).alias("first"), (F.col("pos") - F.col("before") + F.col("span")).alias("last")
        )
        aside = found.filter(f"out = {ASIDE}").select("doc_id", F.struct("gram", "pos", "before", "span").alias("x"))
        # Levels give the same row in several scans.
        aside = aside.groupBy("doc_id").agg(F.collect_set("x").alias("aside"))
        with shuffles_freed(self.spark):
            aside = materialize(aside, "aside")
            texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(aside, "doc_id")
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            key = F.when(F.col("kind") == SAMPLE, F.xxhash64("gram", "core")).otherwise(F.xxhash64("doc_id", "at"))
            blocks = texts.mapInArrow(_blocks(self.length), BLOCKS).repartition(parts, key)
            blocks = blocks.sortWithinPartitions("kind", "gram", "core", "doc_id", "at")
            windows = blocks.mapInArrow(_explode, "core long, print long, doc_id long, start long, again boolean")
            key = F.when(F.col("again"), F.xxhash64("doc_id", "start")).otherwise(F.col("print"))
            windows = windows.repartition(parts, key).sortWithinPartitions("again", "core", "print", "doc_id", "start")
            later = materialize(windows.mapInArrow(_later, "doc_id long, start long"), "later")
        return whole.unionByName(later.select("doc_id", F.col("start").alias("first"), F.col("start").alias("last")))


def batches_of(docs: DataFrame, batches: int) -> list[DataFrame]:
    """The rows in ``batches`` ranges of ids of about equal size."""
    at = [k / batches for k in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), at, 10_000).alias("c")).first()["c"] if at else []
    cuts = sorted(set(cuts or []))
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges[:-1], edges[1:]):
        part = docs
        if low is not None:
            part = part.filter(F.col("doc_id") > low)
        if high is not None:
            part = part.filter(F.col("doc_id") <= high)
        out.append(part)
    return out


def remove_repeats(docs: DataFrame, length: int = 100, batches: int = BATCHES) -> DataFrame:
    """``(doc_id, n_bytes, kept, spans)``: each text without bytes of repeated strings.

    ``docs`` needs ``doc_id`` (unique, not null) and ``text``; other columns are ignored, null is
    an empty text; a row without id stays whole and is compared with nothing. A byte goes if a string of ``length`` bytes of the input that covers it also
    starts earlier: in a smaller doc_id, or before in the same text. ``kept`` are the remaining
    bytes, ``spans`` the maximal removed runs.
    """
    index = SuffixIndex(docs.sparkSession, length)
    parts = batches_of(docs, batches)
    for k, part in enumerate(parts):
        index.add(part, keep=k + 1 < len(parts))
    index.close()
    runs = index.removals(docs).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(runs, "doc_id", "left")
    return texts.mapInArrow(
        _cut(length), "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>"
    )
