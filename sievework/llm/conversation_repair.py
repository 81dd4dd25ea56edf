"""Cheapest repair of conversations whose turns were damaged.

A conversation is a row of symbols: the initial of each role, and whether the row must go, is cut
short, or is sound. Edits turn it into an optional system row and pairs of user and assistant.
The cost to go from each of the four states of that pattern is a small vector; whatever follows,
its entries differ by a few units only, so with the least one subtracted a few dozen vectors
exist. For every such vector and every block of ``BLOCK`` symbols the vector in front of the block
and what it costs are looked up in a table that is made once (the method of the Four Russians).

Blocks are looked up from the last to the first, and traced from the first to the last: a block is
expanded with the vector that was found behind it, and of the edits that keep the cost least the
first in ASCII order is taken. State and place follow from the edits so far, so this choice gives
the least audit of all.

Only a byte a row is brought together for a conversation, by way of pieces of sorted partitions
that a long conversation shares among many tasks. The audit that comes out is as long. Texts meet
their audit in order, in a stream that keeps no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.stored import materialize

# What edits cost, what is blank, and which neighbours are legal.
DELETE, INSERT, REROLE, CUT_SHORT = 4, 3, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
SYSTEM, USER, ASSISTANT, OTHER = range(4)
ROLES = ("system", "user", "assistant")
LEGAL = ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))

#: States of the pattern: nothing yet, after system, after user, after assistant.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
#: The state behind the one role that may be inserted or assigned in each state.
NEXT = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
#: The state behind a row that is kept, by state and role.
KEPT = {
    (START, SYSTEM): AFTER_SYSTEM, (START, USER): AFTER_USER, (AFTER_SYSTEM, USER): AFTER_USER,
    (AFTER_USER, ASSISTANT): AFTER_ASSISTANT, (AFTER_ASSISTANT, USER): AFTER_USER,
}
#: Costs to go behind the last row: a user alone needs an assistant, a system needs both.
AT_END = (0, 2 * INSERT, INSERT, 0)

#: What is wrong with a row; a symbol is ``4 * role + fault``, written as a letter.
SOUND, SHORT, BLANK, DUPLICATE = range(4)
#: Symbols that edits can tell apart: a role that may stay, sound or short, and what must go.
GOES = 8
#: Symbols of a block.
BLOCK = 4
SEGMENT = "conv_id long, piece long, symbols string"
AUDIT = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
ROW = "conv_id long, position long, edit string, role string, text string"
DIGEST = "conv_id long, repaired_sha256 string"


def _step(behind: tuple[int, ...], kind: int) -> list[int]:
    """Costs to go in front of a row from those behind it."""
    cost = [DELETE + c for c in behind]
    if kind != GOES:
        role, short = divmod(kind, 2)
        for state in range(4):
            stay = REROLE + behind[NEXT[state]]
            if (state, role) in KEPT:
                stay = min(stay, behind[KEPT[state, role]])
            cost[state] = min(cost[state], stay + CUT_SHORT * short)
    for _ in range(4):
        cost = [min(c, INSERT + cost[NEXT[state]]) for state, c in enumerate(cost)]
    return cost


class Tables:
    """Normalised cost vectors, and what every symbol and every block makes of each of them."""

    def __init__(self, block: int = BLOCK):
        self.block, self.kinds = block, GOES + 1
        self.vectors, number, after, added = [AT_END], {AT_END: 0}, [], []
        for vector in self.vectors:
            for kind in range(self.kinds):
                cost = _step(vector, kind)
                least = min(cost)
                normal = tuple(c - least for c in cost)
                if normal not in number:
                    number[normal] = len(self.vectors)
                    self.vectors.append(normal)
                after.append(number[normal])
                added.append(least)
        one, cost = np.array(after).reshape(-1, self.kinds), np.array(added).reshape(-1, self.kinds)
        many, sums = np.arange(len(one))[:, None], np.zeros((len(one), 1), dtype=np.int64)
        for _ in range(block):
            # The symbol in front is the highest digit of a block's number.
            sums = np.concatenate([sums + cost[many, k] for k in range(self.kinds)], axis=1)
            many = np.concatenate([one[many, k] for k in range(self.kinds)], axis=1)
        self.after, self.added = one.ravel().tolist(), cost.ravel().tolist()
        self.blocks = many.shape[1]
        self.block_after, self.block_added = many.ravel().tolist(), sums.ravel().tolist()
        self.traced: dict[tuple[int, int, int], tuple[str, int]] = {}

    def _trace(self, kinds: list[int], behind: int, state: int) -> tuple[str, int]:
        """The least edits of a few rows, and the state behind them."""
        costs, base = [self.vectors[behind]], 0
        for kind in reversed(kinds):
            at = behind * self.kinds + kind
            behind, base = self.after[at], base + self.added[at]
            costs.append(tuple(base + c for c in self.vectors[behind]))
        costs.reverse()
        edits = []
        for kind, here, then in zip(kinds, costs, costs[1:]):
            role, short = divmod(kind, 2)
            while True:
                if here[state] == DELETE + then[state]:
                    edits.append("D")
                    break
                if here[state] == INSERT + here[NEXT[state]]:
                    edits.append("I")
                    state = NEXT[state]
                    continue
                kept = KEPT.get((state, role))
                if kept is not None and here[state] == CUT_SHORT * short + then[kept]:
                    edits.append("K")
                    state = kept
                else:
                    edits.append("R")
                    state = NEXT[state]
                break
        return "".join(edits), state

    def repair(self, kinds: np.ndarray) -> tuple[int, str]:
        """Least cost of a conversation, and the first audit in ASCII order that has it."""
        head = len(kinds) % self.block
        digits = self.kinds ** np.arange(self.block - 1, -1, -1)
        codes = (kinds[head:].reshape(-1, self.block) @ digits).tolist()
        vector, cost, behind = 0, 0, []
        for code in reversed(codes):
            behind.append(vector)
            at = vector * self.blocks + code
            vector, cost = self.block_after[at], cost + self.block_added[at]
        first, front = kinds[:head].tolist(), vector
        for kind in reversed(first):
            at = front * self.kinds + kind
            front, cost = self.after[at], cost + self.added[at]
        cost += self.vectors[front][START]
        text, state = self._trace(first, vector, START)
        audit = [text]
        for k, code in enumerate(codes):
            key = (code, behind[len(codes) - 1 - k], state)
            found = self.traced.get(key)
            if found is None:
                at = head + k * self.block
                found = self.traced[key] = self._trace(kinds[at : at + self.block].tolist(), key[1], state)
            audit.append(found[0])
            state = found[1]
        audit.append("I" * (AT_END[state] // INSERT))
        return cost, "".join(audit)


@lru_cache(maxsize=1)
def _tables() -> Tables:
    return Tables()


def _ordered(rows: DataFrame) -> list[Column]:
    """Order of rows in a conversation."""
    return [rows["conv_id"].asc_nulls_first(), rows["turn"].asc_nulls_first(), rows["role"].asc(), rows["digest"].asc()]


def _named(conversations: DataFrame) -> DataFrame:
    """The columns that count, without nulls in role and text, and a digest of both."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("digest", F.unhex(F.md5(whole)))


def faults(conversations: DataFrame) -> DataFrame:
    """Equal rows of a conversation and turn, with their number and the fault of the first.

    Columns: conv_id, turn, role (of four), fault, copies, and the order's ``role`` and ``digest``.
    """
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(end == "", BLANK).when(end.isin(*STOPS), SOUND).otherwise(SHORT)
    thin = _named(conversations).select("conv_id", "turn", "role", "digest", kind.alias("kind"), fault.alias("fault"))
    thin = thin.groupBy("conv_id", "turn", "role", "digest", "kind", "fault").agg(F.count("*").alias("copies"))
    thin = materialize(thin, "turns")
    order = F.struct(F.col("turn").isNotNull().alias("later"), "turn")
    known = thin.filter(F.col("fault") != BLANK).groupBy("conv_id", "digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    known = known.filter("n > 1").select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    again = (F.col("fault") != BLANK) & F.coalesce(order > F.col("first"), F.lit(False))
    out = thin.join(known, same, "left").withColumn("fault", F.when(again, DUPLICATE).otherwise(F.col("fault")))
    return out.select("conv_id", "turn", "role", "digest", "kind", "fault", "copies")


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    piece = TaskContext.get().partitionId() << 32
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, kind, fault, copies = (batch.column(k) for k in range(4))
        fault, copies = np.asarray(fault), np.asarray(copies)
        code = 65 + 4 * np.asarray(kind)
        # Copies of a row are blank like it, or repeat it.
        pairs = np.stack([code + fault, code + np.where(fault == BLANK, BLANK, DUPLICATE)], axis=1).ravel()
        letters = np.repeat(pairs, np.stack([np.ones_like(copies), copies - 1], axis=1).ravel()).astype(np.uint8)
        ids, none = np.asarray(conv.fill_null(0)), np.asarray(conv.is_null())
        cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (none[1:] != none[:-1])) + 1
        begin = np.concatenate([[0], cuts])
        ends = np.cumsum(copies)[np.append(begin[1:], len(ids)) - 1]
        text = letters.tobytes().decode("ascii")
        strings = [text[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        numbers = pa.array(np.arange(piece, piece + len(begin)))
        piece += len(begin)
        yield pa.RecordBatch.from_arrays([conv.take(pa.array(begin)), numbers, pa.array(strings)], names=["conv_id", "piece", "symbols"])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = _tables()
    legal = np.zeros(16, dtype=bool)
    legal[[4 * a + b for a, b in LEGAL]] = True
    # By symbol: what edits can tell apart.
    kinds = np.array([GOES if fault >= BLANK else 2 * role + fault for role in range(4) for fault in range(4)])
    for batch in batches:
        rows = []
        for symbols in batch.column(1).to_pylist():
            code = np.frombuffer(symbols.encode("ascii"), dtype=np.uint8).astype(np.int64) - 65
            number = np.bincount(code % 4, minlength=4)
            role = code // 4
            illegal = int((~legal[4 * role[:-1] + role[1:]]).sum())
            rows.append((int(number[BLANK]), int(number[DUPLICATE]), int(number[SHORT]), illegal, *tables.repair(kinds[code])))
        if rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.string()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[x.split()[0] for x in AUDIT.split(", ")])


def audits(conversations: DataFrame) -> DataFrame:
    """What is wrong with every conversation, and its cheapest repair.

    ``conversations`` needs ``conv_id``, ``turn``, ``role`` and ``text``; other columns are ignored.
    Null roles and texts are one space, rows without ``conv_id`` are one conversation more, and
    rows without ``turn`` come first. Rows of one turn are taken by role and by a digest of role
    and text, so equal rows are neighbours. Roles are known by their first letter; one that begins
    with neither s, u nor a can be deleted or changed only.

    Returns conv_id, gaps (numbers missing between the turns; null beyond a long), the numbers of
    blank, duplicate and truncated rows by their first fault, of illegal neighbours, the least
    cost, and its audit: D(elete), I(nsert), K(eep) and R(ole changed) in order.
    """
    rows = materialize(faults(conversations), "faults")
    sorted_ = rows.repartitionByRange(*_ordered(rows)).sortWithinPartitions(*_ordered(rows))
    pieces = sorted_.select("conv_id", "kind", "fault", "copies").mapInArrow(_symbols, SEGMENT)
    parts = F.array_sort(F.collect_list(F.struct("piece", "symbols")))
    whole = pieces.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p.symbols), "").alias("symbols"))
    found = whole.mapInArrow(_audits, AUDIT)
    turns = rows.select("conv_id", "turn").distinct().groupBy("conv_id")
    turns = turns.agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.count("turn").alias("n"))
    gaps = F.when(F.col("n") == 0, F.lit(0)).otherwise(F.try_subtract(F.try_subtract("most", "least"), F.col("n") - 1))
    turns = turns.select(F.col("conv_id").alias("_conv"), gaps.cast("long").alias("gaps"))
    joined = found.join(turns, found["conv_id"].eqNullSafe(turns["_conv"]), "left")
    return joined.select("conv_id", "gaps", *[c.split()[0] for c in AUDIT.split(", ")[1:]])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, edit, role, text) of every edit in order; a null edit begins a conversation.

    Rows come sorted, each conversation's audit before its texts. Only the audit is kept.
    """

    def missing(state: int) -> Iterator[tuple]:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            state = NEXT[state]
            yield conv, "I", ROLES[state - 1], "", state

    conv, audit, at, state = None, "", 0, START
    for batch in batches:
        for key, line, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if line is not None:
                for *out, state in missing(state):
                    yield tuple(out)
                conv, audit, at, state = key, line, 0, START
                yield conv, None, None, None
                continue
            for *out, state in missing(state):
                yield tuple(out)
            edit = audit[at]
            at += 1
            if edit == "R":
                state = NEXT[state]
                role = ROLES[state - 1]
            elif edit == "K":
                state = KEPT[state, "sua".index(role[0])]
            yield conv, edit, role, text
    for *out, state in missing(state):
        yield tuple(out)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, position, size = [], 0, 0
    for conv, edit, role, text in _streamed(batches):
        if edit is None:
            position = 0
        elif edit != "D":
            rows.append((conv, position, edit, role, text))
            position, size = position + 1, size + len(text)
            if len(rows) == 5000 or size > 1 << 22:
                yield _batch(rows, ROW)
                rows, size = [], 0
    if rows:
        yield _batch(rows, ROW)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, digest, first = [], None, True
    for conv, edit, role, text in _streamed(batches):
        if edit is None:
            if digest is not None:
                rows[-1] += (digest.hexdigest(),)
            if len(rows) == 5000:
                yield _batch(rows, DIGEST)
                rows = []
            rows.append((conv,))
            digest, first = hashlib.sha256(), True
        elif edit != "D":
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "replace"))
            first = False
    if rows:
        rows[-1] += (digest.hexdigest(),)
        yield _batch(rows, DIGEST)


def _edited(conversations: DataFrame, audit: DataFrame, function, schema: str) -> DataFrame:
    rows = _named(conversations).withColumn("audit", F.lit(None).cast("string"))
    heads = audit.select("conv_id", "audit")
    both = heads.unionByName(rows, allowMissingColumns=True)
    # An audit has no role; nulls come first, so it stands before its conversation's rows.
    order = [both["conv_id"].asc_nulls_first(), both["audit"].isNull(), both["turn"].asc_nulls_first(), both["role"].asc(), both["digest"].asc()]
    stream = both.repartition("conv_id").sortWithinPartitions(*order)
    return stream.select("conv_id", "audit", "role", "text").mapInArrow(function, schema)


def repaired(conversations: DataFrame, audit: DataFrame) -> DataFrame:
    """The rows that ``audits`` leaves or inserts: conv_id, position, edit, role, text."""
    return _edited(conversations, audit, _rows, ROW)


def digests(conversations: DataFrame, audit: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` over the repaired ``role:text``, joined by line breaks.

    The digest of one conversation is a chain by definition: its texts pass one task in order,
    in a stream that is sorted on disk and keeps no text.
    """
    return _edited(conversations, audit, _digests, DIGEST)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with one of five damages, or none, by a checksum of conversation and turn.

    Of twenty remainders 0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and
    question marks, 3 repeats it, 4 makes it a user's. Nulls count as one space, but for the
    columns ``conv_id`` and ``turn`` themselves, which keep them.
    """
    name = [F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20).cast("int").alias("damage"),
    ).filter("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", "".join(STOPS), "")).otherwise(F.col("text"))
    times = F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times))
    return rows.drop("col")
