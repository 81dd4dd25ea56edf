"""Repeated runs of lines, by a suffix array over line ids.

Only DataFrame operations. Non-blank lines of a document form a sequence; the suffixes of all
sequences are ranked by prefix doubling: the rank of a suffix by its first ``2 h`` lines is the
rank of the pair (rank by ``h`` lines here, rank by ``h`` lines ``h`` places on). Equal ranks are
one LCP interval of that depth. A suffix whose prefix is unique is done and leaves the rounds, so
a round handles only what is still repeated, and rounds end after log2 of the longest repeat.
Ranks keep the order of the pairs: they are row numbers of a range-partitioned sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.stored import all_columns, materialize

#: A line counts as blank if it holds nothing but these.
NOT_BLANK = r"[^ \t\r\x0B\f]"


def line_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, i, p, chars, key)``: non-blank lines, their number, place and identity."""
    lines = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, p: F.struct(p.alias("p"), x.alias("line"))
    )
    kept = F.filter(lines, lambda x: x.line.rlike(NOT_BLANK))
    rows = docs.filter("doc_id is not null").select("doc_id", F.posexplode(kept).alias("i", "x"))
    return rows.select(
        "doc_id", "i", F.col("x.p").alias("p"), F.length("x.line").alias("chars"), F.unhex(F.md5("x.line")).alias("key")
    )


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows whose keys occur more than once, with their rank and the first place of it."""
    place = F.struct("doc_id", "i")
    classes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    classes = classes.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()).drop("n")
    classes = materialize(classes, f"{name}-ranks")
    return materialize(rows.join(classes, keys).drop(*keys), name)


def suffix_intervals(docs: DataFrame, min_lines: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Line rows, later copies of ``min_lines`` lines, and later copies at every doubled depth.

    The second and third are ``(doc_id, i, depth, first)``: a suffix whose ``depth`` first lines
    also start earlier, at ``first`` (smaller doc_id, or same document and smaller number).
    """
    rows = materialize(line_rows(docs), "line-rows")
    level = _ranked(rows, ["key"], "lines")
    singles = level
    later = F.struct("doc_id", "i") != F.col("first")
    depth, levels, decisive = 1, [], None
    while True:
        found = level.filter(later).select("doc_id", "i", F.lit(depth).alias("depth"), "first")
        levels.append(found)
        if decisive is None and 2 * depth > min_lines:
            decisive = found if depth == min_lines else _step(level, min_lines - depth, "decisive").filter(later).select(
                "doc_id", "i", F.lit(min_lines).alias("depth"), "first"
            )
        if level.isEmpty():
            # Nothing repeats at this depth, nor at any greater one.
            decisive = found.filter("false") if decisive is None else decisive
            break
        level, depth = _step(level, depth, f"depth{2 * depth}"), 2 * depth
    deep = levels[0]
    for more in levels[1:]:
        deep = deep.unionByName(more)
    return singles, decisive, deep


def _step(level: DataFrame, shift: int, name: str) -> DataFrame:
    """Ranks by the pair of a suffix's rank and the rank ``shift`` lines on."""
    ahead = level.select("doc_id", (F.col("i") - shift).alias("i"), F.col("rank").alias("b"))
    pairs = level.select("doc_id", "i", F.col("rank").alias("a")).join(ahead, ["doc_id", "i"])
    return _ranked(pairs, ["a", "b"], name)


def repeated_runs(docs: DataFrame, min_lines: int = 2, min_chars: int = 20) -> DataFrame:
    """``(doc_id, runs)``: for documents with later copies, the maximal runs of them in order.

    A run of at least ``min_lines`` non-blank lines that also starts earlier is a later copy, and
    so is a single line of at least ``min_chars`` characters. Overlapping and adjoining copies
    form one run: ``start`` and ``end`` are places among all lines (blank ones between included),
    ``lines`` counts non-blank lines, and ``depth``, ``source`` tell how many first lines of the
    run at least are a copy, and of what place.
    """
    singles, decisive, deep = suffix_intervals(docs, min_lines)
    later = F.struct("doc_id", "i") != F.col("first")
    long_lines = singles.filter(later & (F.col("chars") >= min_chars)).select("doc_id", "i")
    covered = decisive.select("doc_id", F.explode(F.sequence("i", F.col("i") + (min_lines - 1))).alias("i"))
    covered = covered.unionByName(long_lines).distinct()
    covered = covered.join(singles.select("doc_id", "i", "p"), ["doc_id", "i"])
    by_line = Window.partitionBy("doc_id").orderBy("i")
    islands = covered.withColumn("island", F.col("i") - F.row_number().over(by_line))
    islands = islands.groupBy("doc_id", "island").agg(
        F.min("i").alias("i"), F.min("p").alias("start"), F.max("p").alias("end"), F.count("*").alias("lines")
    )
    origin = deep.groupBy("doc_id", "i").agg(F.max(F.struct("depth", "first")).alias("o"))
    islands = islands.join(origin, ["doc_id", "i"], "left")
    run = F.struct("start", "end", "lines", F.col("o.depth").alias("depth"), F.col("o.first").alias("source"))
    return islands.groupBy("doc_id").agg(F.array_sort(F.collect_list(run)).alias("runs"))


def without_runs(docs: DataFrame, min_lines: int = 2, min_chars: int = 20) -> DataFrame:
    """``(doc_id, row, kept_text, n_lines, n_removed, runs)`` of every document.

    ``docs`` needs ``doc_id`` (unique) and ``text``; ``row`` holds all its columns, whatever their
    names. ``n_lines`` counts non-blank lines. Null and empty texts, texts without repeats and
    rows without id stay as they are. Of repeated lines the copy with the smallest
    (doc_id, line) stays.
    """
    runs = materialize(repeated_runs(docs, min_lines, min_chars), "runs")
    out = docs.select("doc_id", "text", F.struct(*all_columns(docs)).alias("row")).join(runs, "doc_id", "left")
    lines = F.split("text", "\n")
    some = F.size("runs")
    # What is kept lies between the end of one run and the start of the next.
    kept = F.transform(
        F.sequence(F.lit(0), some),
        lambda k: F.struct(
            F.when(k == 0, F.lit(0)).otherwise(F.get(F.col("runs.end"), k - 1) + 1).alias("s"),
            F.when(k == some, F.size(lines)).otherwise(F.get(F.col("runs.start"), k)).alias("e"),
        ),
    )
    kept = F.filter(kept, lambda x: x.e > x.s)
    text = F.array_join(F.transform(kept, lambda x: F.array_join(F.slice(lines, x.s + 1, x.e - x.s), "\n")), "\n")
    full = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(NOT_BLANK))
    removed = F.aggregate(F.col("runs.lines"), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(
        "doc_id",
        "row",
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(text).alias("kept_text"),
        F.size(full).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"),
        "runs",
    )


def deduplicate(docs: DataFrame, min_lines: int = 2, min_chars: int = 20) -> DataFrame:
    """The documents without later copies of line runs, in the columns of ``docs``.

    A document all of whose lines were such copies is left out; ``n_chars``, where there is such
    a column, is counted anew for changed texts.
    """
    out = without_runs(docs, min_lines, min_chars).filter("n_removed = 0 or n_removed < n_lines")
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        count = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("n_removed") > 0, count).otherwise(F.col("row")["n_chars"])
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
