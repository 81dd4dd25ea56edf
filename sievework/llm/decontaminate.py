"""Benchmark passages in training texts, by a positional inverted index of the training tokens.

Only DataFrame operations. The index stores a posting (term, doc_id, pos) for every training
token that is a term of the test set; other tokens cannot match. Rarity is counted over the whole
index. Each window of a test item is looked up by its rarest terms: their postings, shifted back
by the term's place in the item, must meet on one diagonal (doc_id, item, doc position - item
position). Diagonals on which all rarest terms of some window meet are compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.stored import materialize

#: Words: runs of ASCII letters and digits and of all characters beyond ASCII.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables of at most so many rows (a few dozen bytes each) are broadcast; larger ones are joined
#: by shuffling.
SMALL_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    # A-Z are lower-cased before the split, so the class of breaks may name them.
    return F.array_remove(F.split(lowered, BREAKS), "")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcasting if its counted size allows it."""
    return F.broadcast(df) if df.count() <= rows else df


def windows_of(items: DataFrame, length: int) -> DataFrame:
    """``(item, tokens, first, width)``: windows of an item; a shorter item is one window."""
    width = F.least(F.lit(length), F.size("tokens"))
    starts = F.sequence(F.lit(0), F.size("tokens") - width)
    return items.select("item", "tokens", width.alias("width"), F.explode(starts).alias("first"))


def named_texts(items: DataFrame) -> DataFrame:
    """``(item, item_id, tokens)``: items with words; ``item`` is a 128-bit digest of the words.

    Ids may be shared by several texts, or null, so texts are known by their words alone.
    """
    found = items.select("item_id", words(F.col("text")).alias("tokens")).filter("size(tokens) > 0")
    # No word holds a blank, so the joined words tell all lists of words apart.
    key = F.unhex(F.md5(F.array_join("tokens", " ").cast("binary")))
    return found.select(key.alias("item"), "item_id", "tokens")


def matches(
    docs: DataFrame, items: DataFrame, length: int = 10, rarest: int = 2, slack: int = 0, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """``(doc_id, item, doc_start, item_start, width, exact)``: windows of items found in documents.

    ``docs`` needs ``doc_id`` and ``text``, ``items`` needs ``item_id`` and ``text``; null texts
    have no words, other columns are ignored. Texts under one id are found one by one, and so are
    ids of one text; ``item`` is the id, which may be null. Rows with ``exact`` are word-by-word
    occurrences. With ``slack`` above 0 there are also proximity matches: the rarest terms of a
    window occur at distances that differ from the window's by at most ``slack`` words;
    ``doc_start`` is then where the first of them puts the window.
    """
    named = materialize(named_texts(items), "items")
    found = _found(docs, named, length, rarest, slack, small_rows)
    return found.join(named.select("item", "item_id").distinct(), "item").select(
        "doc_id", F.col("item_id").alias("item"), "doc_start", "item_start", "width", "exact"
    ).distinct()


def _found(docs: DataFrame, named: DataFrame, length: int, rarest: int, slack: int, small_rows: int) -> DataFrame:
    """``matches`` with the digests of ``named`` as items."""
    items = named.groupBy("item").agg(F.first("tokens").alias("tokens"))
    windows = materialize(windows_of(items, length), "windows")
    terms = windows.select(F.explode("tokens").alias("term")).distinct()
    terms = _small(materialize(terms, "terms"), small_rows)

    tokens = docs.select(F.col("doc_id"), F.posexplode(words(F.col("text"))).alias("pos", "term"))
    postings = materialize(tokens.join(terms, "term").select("term", "doc_id", "pos"), "postings")
    counts = materialize(postings.groupBy("term").count(), "counts")

    # The rarest terms of each window; a window with a term that never occurs is not looked up.
    places = windows.select(
        "item", "first", "width", F.posexplode(F.slice("tokens", F.col("first") + 1, F.col("width"))).alias("j", "term")
    )
    places = places.join(counts, "term", "left")
    ranked = places.groupBy("item", "first", "width").agg(
        F.array_sort(F.collect_list(F.struct("count", "j", "term"))).alias("rank"),
        F.min(F.coalesce("count", F.lit(0))).alias("least"),
    )
    chosen = F.slice("rank", 1, rarest)
    ranked = ranked.filter("least > 0").select(
        "item", "first", "width", F.transform(chosen, lambda x: F.struct((F.col("first") + x.j).alias("at"), x.term.alias("term"))).alias("anchors")
    )
    ranked = materialize(ranked, "ranked")
    anchors = ranked.select("item", F.explode("anchors").alias("x")).select("item", "x.at", "x.term").distinct()
    # One row per term, so that a posting is joined once and then dealt to its places in items.
    anchors = anchors.groupBy("term").agg(F.collect_list(F.struct("item", "at")).alias("places"))
    anchors = _small(materialize(anchors, "anchors"), small_rows)
    hits = postings.join(anchors, "term").select("doc_id", "pos", F.explode("places").alias("x"))
    hits = hits.select("doc_id", F.col("x.item").alias("item"), F.col("x.at").alias("at"), (F.col("pos") - F.col("x.at")).alias("diagonal"))

    wanted = ranked.groupBy("item").agg(
        F.collect_list(F.struct("first", "width", F.col("anchors.at").alias("at"))).alias("wins")
    )
    wanted = wanted.join(windows.groupBy("item").agg(F.first("tokens").alias("tokens")), "item")
    wanted = _small(materialize(wanted, "wanted"), small_rows)
    meeting = hits.groupBy("doc_id", "item", "diagonal").agg(F.collect_set("at").alias("seen"))
    meeting = meeting.join(wanted, "item")
    meeting = meeting.withColumn(
        "wins", F.filter("wins", lambda w: F.size(F.array_except(w.at, F.col("seen"))) == 0)
    )
    meeting = materialize(
        meeting.filter("size(wins) > 0").select("doc_id", "item", "diagonal", "wins"), "diagonals"
    )

    # Whole comparison on the diagonals, one row per document.
    by_doc = meeting.groupBy("doc_id").agg(F.collect_list(F.struct("item", "diagonal", "wins")).alias("found"))
    by_doc = _small(materialize(by_doc, "by_doc"), small_rows // 10)
    texts = docs.select("doc_id", "text").join(by_doc, "doc_id")
    texts = texts.select("doc_id", words(F.col("text")).alias("doc"), F.explode("found").alias("x"))
    texts = texts.select("doc_id", "doc", "x.item", "x.diagonal", "x.wins").join(
        wanted.select("item", F.col("tokens")), "item"
    )
    texts = texts.withColumn("w", F.explode("wins"))
    start = F.col("diagonal") + F.col("w.first")
    inside = (start >= 0) & (start + F.col("w.width") <= F.size("doc"))
    same = F.slice("doc", F.greatest(start, F.lit(0)) + 1, F.col("w.width")) == F.slice("tokens", F.col("w.first") + 1, F.col("w.width"))
    exact = texts.filter(inside & same).select(
        "doc_id", "item", start.alias("doc_start"), F.col("w.first").alias("item_start"), F.col("w.width").alias("width"), F.lit(True).alias("exact")
    )
    if slack <= 0:
        return exact
    return exact.unionByName(_near(hits, ranked, slack, exact))


def _near(hits: DataFrame, ranked: DataFrame, slack: int, exact: DataFrame) -> DataFrame:
    """Windows whose rarest terms occur near each other without an exact occurrence there."""
    cell = slack + 1
    lead = ranked.select("item", "first", "width", F.col("anchors")[0]["at"].alias("lead"), F.col("anchors.at").alias("all"))
    near = hits.withColumn("cell", F.floor(F.col("diagonal") / cell))
    first = lead.join(hits.select("doc_id", "item", F.col("at").alias("lead"), F.col("diagonal").alias("base")), ["item", "lead"])
    first = first.withColumn("cell", F.explode(F.array(*[F.floor(F.col("base") / cell) + k for k in (-1, 0, 1)])))
    met = first.join(near, ["doc_id", "item", "cell"])
    met = met.filter(F.array_contains("all", F.col("at")) & (F.abs(F.col("diagonal") - F.col("base")) <= slack))
    met = met.groupBy("doc_id", "item", "first", "width", "base", "all").agg(F.collect_set("at").alias("seen"))
    met = met.filter(F.size(F.array_except("all", "seen")) == 0).select(
        "doc_id", "item", (F.col("base") + F.col("first")).alias("doc_start"), F.col("first").alias("item_start"), "width"
    )
    met = met.join(exact.drop("exact", "width"), ["doc_id", "item", "doc_start", "item_start"], "left_anti")
    return met.withColumn("exact", F.lit(False)).select("doc_id", "item", "doc_start", "item_start", "width", "exact")


def contamination(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """One row per document: ``n_words``, ``n_hit`` words inside occurrences, and the items met.

    ``(doc_id, n_words, n_hit, n_items, items)``; ``items`` is sorted as strings, a null id
    is one more item and comes last. Documents without words, and all documents if there are no
    items, have no hits. ``doc_id`` is to be unique: rows that share one are taken as parts of one
    document, and each shows the hits of all; rows without id have none.
    """
    named = materialize(named_texts(items), "items")
    found = materialize(_found(docs, named, length, rarest=2, slack=0, small_rows=SMALL_ROWS), "found")
    # Ids are looked up once per document and text; a struct keeps the null id in the set.
    ids = named.select("item", F.struct(F.col("item_id").cast("string").alias("id")).alias("id")).distinct()
    ids = _small(materialize(ids, "ids"), SMALL_ROWS)
    met = found.select("doc_id", "item").distinct().join(ids, "item")
    met = met.groupBy("doc_id").agg(F.array_sort(F.transform(F.collect_set("id"), lambda x: x.id)).alias("items"))
    spans = found.groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct(F.col("doc_start").cast("long").alias("s"), (F.col("doc_start") + F.col("width")).cast("long").alias("e")))).alias("spans"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate(
        "spans",
        start,
        lambda acc, x: F.struct(
            (acc.n + F.greatest(x.e - F.greatest(x.s, acc.end), F.lit(0).cast("long"))).alias("n"),
            F.greatest(acc.end, x.e).alias("end"),
        ),
        lambda acc: acc.n,
    )
    spans = materialize(spans.select("doc_id", covered.alias("n_hit")).join(met, "doc_id"), "spans")
    sizes = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return sizes.join(spans, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size(F.coalesce("items", none)), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
    )


def clean(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """The documents in which no window of an item occurs."""
    bad = contamination(docs, items, length).filter("n_hit > 0").select("doc_id")
    return docs.join(bad, "doc_id", "left_anti")
