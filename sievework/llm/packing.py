"""Packing of tokenized documents into sequences of a fixed length.

Bounded-space online best fit: a task keeps a fixed number of open sequences. A bitset has bit
``f`` set while some open sequence has ``f`` places free, so the tightest fit is the lowest set
bit from the piece's length on. When all are open and none fits, the fullest is closed. What is
still open at a task's end is packed once more, longest piece first. A task holds its open
sequences only; nothing is shuffled, and a lost task is repeated from its input alone.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.arrays import steps, utf8, word_hashes

#: Open sequences of a task.
OPEN = 1024
#: Distinct words whose ids a worker remembers.
REMEMBERED = 250_000
#: Code points up to here are cut into words by table; texts with others go to the tokenizer.
_KNOWN = 0x250
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
PACKED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


def _kind(code: int) -> int:
    if code in (0x85, 0xA0, 0x20) or 0x09 <= code <= 0x0D:
        return _SPACE
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(code))[0], _OTHER)


_KINDS = np.array([*map(_kind, range(_KNOWN)), 0], dtype=np.uint8)


class Encoder:
    """Token ids of many texts at once, the same as the tokenizer gives one by one.

    Texts of Latin letters are cut into words for all at once; ids are made once per distinct
    word. All other texts, and those with apostrophes or a special token, go to the tokenizer.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
        self.words = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known: dict[int, tuple[int, ...]] = {}

    def encode(self, data: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        text = data.tobytes().decode("utf-8", "replace")
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[starts]
        kinds = _KINDS[np.minimum(codes, _KNOWN)]
        odd = np.flatnonzero((kinds == 0) | (codes == 39))
        slow = np.zeros(len(starts) - 1, dtype=bool)
        slow[np.searchsorted(at, odd, side="right") - 1] = True
        for token in self.special:
            k = text.find(token)
            while k >= 0:
                slow[np.searchsorted(at, k, side="right") - 1] = True
                k = text.find(token, k + 1)

        begin = _word_starts(codes, kinds, at)
        end = np.append(begin[1:], len(codes))
        distinct, first, which = np.unique(word_hashes(codes, begin, end), return_index=True, return_inverse=True)
        ids = self._ids(distinct, first, begin, end, text)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        pool = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        where = np.concatenate([[0], np.cumsum(size)])[:-1] if len(ids) else size
        sizes = size[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = pool[np.repeat(where[which] - ends[:-1], sizes) + np.arange(ends[-1])]
        cut = ends[np.searchsorted(begin, at)]
        again = iter(self.whole.encode_batch([text[at[r] : at[r + 1]] for r in np.flatnonzero(slow)], add_special_tokens=False))
        for r in range(len(starts) - 1):
            yield np.array(next(again).ids, dtype=np.uint32) if slow[r] else flat[cut[r] : cut[r + 1]]

    def _ids(self, distinct, first, begin, end, text) -> list[tuple[int, ...]]:
        found = list(map(self.known.get, distinct.tolist()))
        if len(self.known) > REMEMBERED:
            self.known = {}
        for k, have in enumerate(found):
            if have is None:
                word = text[begin[first[k]] : end[first[k]]]
                found[k] = self.known[int(distinct[k])] = tuple(self.words.encode_ordinary(word))
        return found


def _word_starts(codes: np.ndarray, kinds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where words begin: runs of one kind, of which one blank joins the word that follows it."""
    n = len(codes)
    flag = np.ones(n + 1, dtype=bool)
    flag[1:n] = kinds[1:] != kinds[:-1]
    rows = np.zeros(n + 1, dtype=bool)
    rows[at] = True
    flag |= rows
    edges = np.flatnonzero(flag)
    a, b = edges[:-1], edges[1:]
    space = (kinds[a] == _SPACE) & ~rows[b]
    a, b = a[space], b[space]
    flag[b - 1] = True
    flag[b[codes[b - 1] == 32]] = False
    return np.flatnonzero(flag[:n])


class OpenBins:
    """Best fit over a bounded number of open bins."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.open = 0, 0
        self.by_free: list[list[list]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        taken = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return taken

    def place(self, length: int, item) -> list[list]:
        """Put an item into a bin; returns the bins that this closes."""
        closed = []
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.limit:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, bin_ = self.capacity, []
        bin_.append((length, item))
        free -= length
        if free:
            self.by_free[free].append(bin_)
            self.bits |= 1 << free
            self.open += 1
        else:
            closed.append(bin_)
        return closed

    def drain(self) -> list[list]:
        """All open bins, with their items packed once more from the longest to the shortest."""
        items = sorted((x for bins in self.by_free for b in bins for x in b), key=lambda x: -x[0])
        self.by_free, self.bits, self.open = [[] for _ in range(self.capacity + 1)], 0, 0
        self.limit = len(items) + 1
        closed = [b for length, item in items for b in self.place(length, item)]
        return closed + [b for bins in self.by_free for b in bins]


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but perhaps the first."""
    head = (length - 1) % capacity + 1
    return [(0, head)] + [(s, capacity) for s in range(head, length, capacity)]


@lru_cache(maxsize=1)
def _encoder(json_path: str, ranks_path: str) -> Encoder:
    return Encoder(json_path, ranks_path)


def _packer(json_path: str, ranks_path: str, end_id: int, capacity: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(json_path, ranks_path)
        bins, rows = OpenBins(capacity, limit), []
        number = TaskContext.get().partitionId() << 40

        def close(closed: list[list]) -> None:
            nonlocal number
            for bin_ in closed:
                offset = 0
                for length, (doc, piece, start, ids) in bin_:
                    rows.append((doc, piece, start, length, ids, number, offset))
                    offset += length
                number += 1

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PACKED.split(", ")])

        for batch in batches:
            data, starts = utf8(batch.column(1))
            docs = batch.column(0).to_pylist()
            for a, b in steps(starts, 1 << 20):
                part = encoder.encode(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                for doc, ids in zip(docs[a:b], part):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for piece, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                        item = (doc, piece, start, ids[start : start + length].tobytes())
                        close(bins.place(length, item))
                if len(rows) >= 1000:
                    yield flush()
        close(bins.drain())
        if rows:
            yield flush()

    return run


def pack(
    docs: DataFrame, json_path: str, ranks_path: str, end_id: int = 0, capacity: int = 2048, open_bins: int = OPEN
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    ``docs`` needs ``doc_id`` and ``text``; null is an empty text, other columns are ignored,
    repeated rows are packed as often as they occur. A document is its token ids and ``end_id``;
    only longer ones are cut, into full pieces but for the first. Returns a row per piece:
    doc_id, piece, start (ids before it), length, ids (little-endian unsigned 32-bit),
    sequence_id and offset (its place in the sequence; places are gapless from 0).
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_packer(json_path, ranks_path, end_id, capacity, open_bins), PACKED)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, doc_ids)``: the packed sequences themselves, bounded by their capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return whole.select("sequence_id", F.concat_ws("", F.transform("parts", lambda p: F.hex(p.ids))).alias("ids"), F.col("parts.doc_id").alias("doc_ids")).withColumn("ids", F.unhex("ids"))
