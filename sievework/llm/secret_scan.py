"""Credentials in texts, told apart by how many owners hold the same value.

Patterns find candidates. Their values are hashed, and the distinct owners and repositories of
each hash are counted over the whole corpus: a value that several owners hold is an example that
was copied; a value of one owner that looks random is reported as live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.stored import materialize

# The patterns of the kinds, in the order in which kinds are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "live"]
#: Least lengths: of an assignment's value, of an access key, of a hexadecimal run.
VALUE, KEY, RUN = 12, 18, 16
#: Bits a character that a value needs to look random.
ENTROPY = 2.5

# Runs that are too short fail as a whole, so the least length can be part of these patterns.
_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(f"{ACCESS[:-1]}{{{KEY - 4},}}")
_HEX = re.compile(f"{HEX[:-1]}{{{RUN},}}")
_SPAN = "array<struct<start:long,kind:int,end:long,value:string,random:boolean>>"


def candidates(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the base kinds, by start and kind."""
    out = []
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= VALUE:
            out.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    for kind, pattern in ((1, _ACCESS), (2, _HEX)):
        out += [(m.start(), kind, m.end(), m.start(), m.end()) for m in pattern.finditer(text)]
    return sorted(out)


def looks_random(value: str) -> bool:
    """Letters and digits together, and many different characters."""
    if not (re.search("[A-Za-z]", value) and re.search("[0-9]", value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= ENTROPY


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            keep, spans = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                found = candidates(text) if text else []
                if found:
                    keep.append(k)
                    spans.append(
                        [
                            {"start": s, "kind": kind, "end": e, "value": hashlib.sha256(text[a:b].encode("utf-8", "replace")).hexdigest(), "random": looks_random(text[a:b])}
                            for s, kind, e, a, b in found
                        ]
                    )
            if keep:
                rest = [batch.column(c).take(pa.array(keep)) for c in ("doc_id", "owner", "repository")]
                struct = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string()), ("random", pa.bool_())])
                yield pa.RecordBatch.from_arrays([*rest, pa.array(spans, pa.list_(struct))], names=["doc_id", "owner", "repository", "spans"])


def scan(docs: DataFrame, owner: str = "source", repository: str = "lang", max_owners: int = 1) -> DataFrame:
    """``(doc_id, spans)`` of every document: ``(start, kind, end, owners, repositories)`` each.

    ``docs`` needs ``doc_id`` (unique), ``text`` and the named columns; a repository is known by
    its owner and its name, null names are one more name, null is an empty text. Places are code
    points, the end is exclusive; ``kind`` is an index into ``KINDS``. A span of kind ``live`` has
    the place of a base span whose value at most ``max_owners`` owners hold and that looks random.
    """
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.to_json(F.struct(F.col(owner))).alias("owner"),
        F.to_json(F.struct(F.col(repository))).alias("repository"),
    )
    found = named.mapInArrow(_find, f"doc_id long, owner string, repository string, spans {_SPAN}")
    found = materialize(found, "candidates")
    rows = found.select("doc_id", "owner", "repository", F.explode("spans").alias("s"))
    rows = rows.select("doc_id", "owner", "repository", "s.*")
    held = rows.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    held = held.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    held = held.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    rows = rows.join(held, "value")
    live = F.col("random") & (F.col("owners") <= max_owners)
    kinds = F.when(live, F.array("kind", F.lit(KINDS.index("live")))).otherwise(F.array("kind"))
    rows = rows.withColumn("kind", F.explode(kinds))
    span = F.struct("start", "kind", "end", "owners", "repositories")
    spans = rows.groupBy("doc_id").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    none = F.array().cast("array<struct<start:long,kind:int,end:long,owners:long,repositories:long>>")
    out = named.select("doc_id").join(spans, "doc_id", "left")
    return out.select("doc_id", F.coalesce("spans", none).alias("spans"))
