"""Exact token counts of every prefix of every text.

Byte-pair encoding can be decided locally: a row of tokens is the encoding of its bytes exactly
if no merge would cross any border between neighbours. So a prefix ends in the one token that
fits behind the last token of the shorter prefix in front of it, and a dynamic program over the
prefixes gives every count from an earlier one. It runs once per distinct word; texts add up
their words' counts. Whatever is asked about a stored index, truncation to a length or the
longest prefix within a budget, is then read off and nothing is encoded again.

Counts are made where the texts are read, without a shuffle, and stored in blocks of bounded
length, so that a very long text is many small rows.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.arrays import steps, utf8

#: Prefixes in a row of the index.
BLOCK = 1 << 16
#: Distinct words, pairs of tokens, and counts that a worker remembers; more start afresh.
REMEMBERED = 500_000
REMEMBERED_PAIRS = 2_000_000
REMEMBERED_COUNTS = 1 << 25
INDEX = "doc_id long, start long, counts array<int>, n_chars long, n_bytes long, within array<long>, last boolean"

# The words of byte-level encodings, and the endings that are words of their own.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENDINGS = ("'re", "'ve", "'ll")
_WORDS = regex.compile(WORDS)
#: Bits of a token's id where two ids make one key.
_SHIFT = 24
# Below this the two libraries' tables of letters agree; other texts are cut by the tokenizer.
_FOREIGN = regex.compile(r"[^\x00-ԯ]")


def _byte_names() -> dict[str, int]:
    """The printable stand-ins that vocabulary files write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Known(dict):
    """Values that are made on first sight, up to a number of them."""

    def __init__(self, make, most: float = float("inf")):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


class PrefixCounter:
    """Token counts of all prefixes by the vocabulary of a byte-level ``.json`` tokenizer."""

    def __init__(self, json_path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(json_path)
        self.cut = tokenizer.pre_tokenizer.pre_tokenize_str
        names = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        with open(json_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_names()
        ids, self.parts, self.rank = model["vocab"], {}, {}
        tokens = {i for t, i in ids.items() if t in byte}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            token = ids[left + right]
            self.rank[ids[left], ids[right]] = rank
            self.parts.setdefault(token, (ids[left], ids[right], rank))
            tokens.add(token)
        self.ends = ahocorasick.Automaton()
        for text, i in ids.items():
            if i in tokens:
                data = "".join(chr(byte[c]) for c in text)
                self.ends.add_word(data, (i, len(data)))
        self.ends.make_automaton()
        self.pairs = _Known(lambda pair: self._holds(pair >> _SHIFT, pair & ((1 << _SHIFT) - 1)), REMEMBERED_PAIRS)
        self._forget()

    def _forget(self) -> None:
        self.known = _Known(self._learn)
        self.counts, self.place, self.size, self.total = array("i"), array("q"), array("q"), array("q")
        self.blank, self.opens = array("b"), array("b")

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that form at one end of ``token``, each with the rank of the next merge."""
        above, out = float("inf"), []
        while token in self.parts:
            out.append((token, above))
            above = self.parts[token][2]
            token = self.parts[token][side]
        return [*out, (token, above)][::-1]

    def _holds(self, a: int, b: int) -> bool:
        """Whether the bytes of both, encoded together, are these two tokens.

        The tokens at the border grow in the order of their merges; the border falls if a merge
        across it comes before the next one on either side. Of equal merges the left one is first.
        """
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            (x, x_next), (y, y_next) = left[i], right[j]
            across = self.rank.get((x, y))
            if across is not None and across < x_next and across <= y_next:
                return False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if x_next <= y_next:
                i += 1
            else:
                j += 1

    def word(self, word: str) -> list[int]:
        """Counts of the word's prefixes of 1, 2, ... code points, each encoded as one word."""
        data = word.encode("utf-8")
        last: list[int] = []
        counts, pairs, n = [0], self.pairs, 0
        for end, (token, size) in self.ends.iter(word if word.isascii() else data.decode("latin-1")):
            # One token only ends each prefix; the others that end there come first or are skipped.
            if end == n:
                start = n + 1 - size
                if start == 0 or pairs[last[start - 1] | token]:
                    last.append(token << _SHIFT)
                    counts.append(counts[start] + 1)
                    n += 1
        if len(data) == len(word):
            return counts[1:]
        # A code point ends where the next byte does not continue one.
        return [counts[k] for k in range(1, len(data) + 1) if k == len(data) or data[k] & 0xC0 != 0x80]

    def _learn(self, word: str) -> int:
        counts = self.word(word)
        if word in ENDINGS:
            # One letter less, and the apostrophe and the letter are two words.
            counts[1] = counts[0] + self.word(word[1])[0]
        self.place.append(len(self.counts))
        self.counts.extend(counts)
        self.size.append(len(counts))
        self.total.append(counts[-1])
        self.blank.append(word.isspace())
        self.opens.append(word[0].isspace())
        return len(self.size) - 1

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Counts of all prefixes of texts without special tokens, the empty prefix first."""
        if len(self.known) > REMEMBERED or len(self.counts) > REMEMBERED_COUNTS:
            self._forget()
        words, ends = [], [0]
        for text in texts:
            if _FOREIGN.search(text):
                words += [text[a:b] for _, (a, b) in self.cut(text)]
            else:
                words += _WORDS.findall(text)
            ends.append(len(words))
        known = self.known
        which = np.array([known[w] for w in words], dtype=np.int64)
        # A run of blanks gives its last one to the next word, but a prefix that ends there does not.
        blank, opens = np.frombuffer(self.blank, np.int8)[which], np.frombuffer(self.opens, np.int8)[which]
        inner = np.ones(len(which), dtype=bool)
        inner[np.array(ends[1:], dtype=np.int64)[np.diff(ends) > 0] - 1] = False
        split = np.flatnonzero(inner[:-1] & (blank[:-1] > 0) & (opens[1:] > 0)) if len(which) else np.zeros(0, np.int64)
        runs = np.array([known[words[k] + words[k + 1][0]] for k in split], dtype=np.int64)

        place, size = np.array(self.place, np.int64)[which], np.array(self.size, np.int64)[which]
        total = np.array(self.total, np.int64)
        before = np.concatenate([[0], np.cumsum(total[which])])
        first = np.concatenate([[0], np.cumsum(size)])
        ends_at = np.array(ends, dtype=np.int64)
        base = before[:-1] - np.repeat(before[ends_at[:-1]], np.diff(ends_at))
        flat = np.array(self.counts, np.int32)[np.repeat(place - first[:-1], size) + np.arange(first[-1])]
        flat += np.repeat(base, size).astype(np.int32)
        flat[first[split + 1]] = base[split] + total[runs]
        return [np.concatenate([[0], flat[first[a] : first[b]]]).astype(np.int32) for a, b in zip(ends, ends[1:])]

    def prefixes(self, texts: list[str]) -> list[np.ndarray]:
        """For every text the counts of its prefixes of 0, 1, 2, ... code points."""
        found = [[*self.special.finditer(t)] if self.special else [] for t in texts]
        parts: list[str] = []
        for text, hits in zip(texts, found):
            at = 0
            for hit in hits:
                # Cut short, a special token is ordinary text behind the text in front of it.
                parts.append(text[at : hit.end() - 1])
                at = hit.end()
            parts.append(text[at:])
        counts, out = iter(self._plain(parts)), []
        for hits in found:
            pieces, base, at = [], 0, 0
            for hit in hits:
                part = next(counts)
                pieces.append(part + base)
                base += int(part[hit.start() - at]) + 1
                at = hit.end()
            pieces.append(next(counts) + base)
            out.append(np.concatenate(pieces) if hits else pieces[0])
        return out


@lru_cache(maxsize=1)
def _counter(json_path: str) -> PrefixCounter:
    return PrefixCounter(json_path)


def _indexer(json_path: str, budgets: tuple[int, ...], block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(json_path)
        schema = pa.schema(
            [("doc_id", pa.int64()), ("start", pa.int64()), ("counts", pa.list_(pa.int32())), ("n_chars", pa.int64()),
             ("n_bytes", pa.int64()), ("within", pa.list_(pa.int64())), ("last", pa.bool_())]
        )
        for batch in batches:
            data, starts = utf8(batch.column(1))
            docs = batch.column(0).to_pylist()
            for a, b in steps(starts, 1 << 20):
                texts = [data[starts[k] : starts[k + 1]].tobytes().decode("utf-8", "replace") for k in range(a, b)]
                rows, values = [], []
                for k, counts in enumerate(counter.prefixes(texts), a):
                    within = [int(np.flatnonzero(counts <= budget)[-1]) for budget in budgets]
                    for start in range(0, len(counts), block):
                        part = counts[start : start + block]
                        values.append(part)
                        last = start + len(part) == len(counts)
                        rows.append((docs[k], start, len(counts) - 1, int(starts[k + 1] - starts[k]), within, last))
                offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
                doc, start, chars, size, within, last = zip(*rows)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))
                columns = [doc, start, lists, chars, size, within, last]
                arrays = [c if c is lists else pa.array(c, f.type) for c, f in zip(columns, schema)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def prefix_counts(docs: DataFrame, json_path: str, budgets: tuple[int, ...] = (), block: int = BLOCK) -> DataFrame:
    """The index: token counts of every prefix of every text, in code points.

    ``docs`` needs ``doc_id`` and ``text``; a null text is empty, other columns are ignored,
    repeated rows are indexed as often as they occur and rows without id keep none. A row holds
    ``counts`` of the prefixes of ``start``, ``start + 1``, ... code points; the empty prefix has
    0 tokens, so an empty text has one row. All rows of a text carry ``n_chars``, ``n_bytes``
    (UTF-8) and ``within``, the longest prefix with no more tokens than each of ``budgets``
    (at least 0); ``last`` marks the row whose last count is that of the whole text.

    ``json_path`` names a byte-level tokenizer that cuts words without normalising, on all
    executors; special tokens in a text count as one. Counts may fall where a longer prefix
    merges better.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_indexer(json_path, tuple(budgets), block), INDEX)


def totals(index: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, n_bytes, n_tokens, within)`` of every text, without a shuffle."""
    whole = F.element_at("counts", -1).cast("long").alias("n_tokens")
    return index.filter("last").select("doc_id", "n_chars", "n_bytes", whole, "within")


def counts_at(index: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """``lengths`` (``doc_id``, ``n_chars``) with ``n_tokens`` of the text cut to that length.

    Lengths beyond the text's give the whole text; negative or null ones, and unknown or null
    ids, give null. Ids of the index must be unique; other columns of ``lengths`` are kept, but
    for one that is already named ``n_tokens``.
    """
    blocks = index.select("doc_id", (F.col("start") / block).cast("long").alias("block"), "counts", "n_chars")
    sizes = blocks.filter("block = 0").select("doc_id", F.col("n_chars").alias("size"))
    asked = lengths.drop("n_tokens")
    asked = asked.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("n_chars").cast("long").alias("at"))
    asked = asked.join(sizes, "doc_id", "left").withColumn("at", F.when(F.col("at") >= 0, F.least("at", "size")))
    asked = asked.withColumn("block", F.floor(F.col("at") / block))
    found = asked.join(blocks.drop("n_chars"), ["doc_id", "block"], "left")
    count = F.get("counts", F.pmod(F.col("at"), F.lit(block)).cast("int")).cast("long")
    return found.select("row.*", count.alias("n_tokens"))


def longest_within(index: DataFrame, budget: int) -> DataFrame:
    """``(doc_id, n_chars)``: the longest prefix of every text with at most ``budget`` tokens."""
    back = F.reverse(F.transform("counts", lambda c: c <= budget))
    found = F.array_position(back, F.lit(True))
    end = F.when(found > 0, F.col("start") + F.size("counts") - found)
    return index.select("doc_id", end.alias("end")).groupBy("doc_id").agg(F.max("end").alias("n_chars"))
