"""Queries over the corpus tables that apply each operator with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.hashing import stable_hash
from sievework.llm import (
    conversation_repair,
    decontaminate,
    line_dedup,
    metric_join,
    packing,
    secret_scan,
    setsketch,
    site_quality,
    suffix_index,
    token_counts,
    toxicity,
    url_lists,
    whitening,
)
from sievework.llm.stored import materialize
from sievework.plans.registry import hash32, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def token_files() -> tuple[str, str]:
    """Places of the vocabulary, as the tokenizer's file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def labels_of(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """``(doc_id, y)`` of the documents that have the label."""
    return table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("y")).filter("y is not null")


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens."""
    packed = packing.pack(table(spark, sf_dir, "documents"), *token_files())
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


LINES_SQL = """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as p
  from documents),
n as (select *, row_number() over (partition by doc_id order by p) - 1 as i
  from l where regexp_matches(line, '[^ \\t\\r\\x0B\\f]')),
m as (select *, lead(line) over (partition by doc_id order by i) as next from n),
k as (select *, row_number() over (partition by line order by doc_id, i) as one,
    case when next is not null then row_number() over (partition by line, next order by doc_id, i) end as two
  from m),
c as (select *, (one > 1 and length(line) >= 20) or coalesce(two > 1, false)
    or coalesce(lag(two) over (partition by doc_id order by i) > 1, false) as copied from k),
g as (select *, i - row_number() over (partition by doc_id order by i) as island from c where copied),
r as (select doc_id, island, min(p) as s, max(p) as e, count(*) as lines from g group by all),
t as (select l.doc_id, string_agg(line, chr(10) order by p) as kept
  from l left join r on l.doc_id = r.doc_id and l.p between r.s and r.e where r.doc_id is null group by l.doc_id),
z as (select doc_id, count(*) as n_lines from n group by doc_id),
y as (select doc_id, sum(lines)::BIGINT as n_removed, count(*) as n_runs from r group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed,
  coalesce(n_runs, 0)::INTEGER as n_runs, md5(coalesce(kept, '')) as kept_md5
from documents d left join z on d.doc_id = z.doc_id left join y on d.doc_id = y.doc_id
  left join t on d.doc_id = t.doc_id"""


@query("op2_line_dedup", LINES_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without runs of lines that also start earlier."""
    out = line_dedup.without_runs(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.greatest(F.coalesce(F.size("runs"), F.lit(0)), F.lit(0)).alias("n_runs"),
        F.md5(F.coalesce("kept_text", F.lit(""))).alias("kept_md5"),
    )


@query("op4_suffix_array_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without bytes of 100-byte strings that also start earlier."""
    out = suffix_index.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op7_minhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies on 4-word shingles at a similarity of 0.8."""
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


@query("op8_benchmark_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact benchmark passages of ten words in every document."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",", "null"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior of good quality of every document, within its source and language."""
    docs = table(spark, sf_dir, "documents")
    out = site_quality.posteriors(docs, labels_of(spark, sf_dir, "quality"))
    return out.withColumn("kept", F.col("score") >= 0.5)


@query("op10_embedding_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors linked by a cosine of at least 0.9."""
    return metric_join.range_links(table(spark, sf_dir, "embeddings"), 0.9)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(docs, labels_of(spark, sf_dir, "toxic").filter(~held_out))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending"
    )


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; those held by one source only are live."""
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, secret_scan.KINDS))

    def joined(spans):
        text = F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.kind), x.start, x.end))
        return F.array_join(text, ",")

    def number(k):
        return F.size(F.filter("spans", lambda x: x.kind == k)).cast("long")

    live = secret_scan.KINDS.index("live")
    return out.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda x: x.kind < live)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        number(live).alias("n_live"),
        F.coalesce(F.array_max(F.col("spans.owners")), F.lit(0)).cast("long").alias("most_owners"),
        F.coalesce(F.array_max(F.col("spans.repositories")), F.lit(0)).cast("long").alias("most_repositories"),
    )


CAPTURES_SQL = f"""(select page_id, url, ({hash32("page_id::varchar")} % 730)::BIGINT as day,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) as host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+)', 1) as first from pages)"""

URL_SQL = f"""
with c as {CAPTURES_SQL},
names as (select distinct host as pattern from c where host <> '' union
  select distinct host || first from c where host <> '' and first <> '' union
  select distinct regexp_replace(host, '^[^.]+[.]', '') from c where host <> ''),
e as (select pattern, (({hash32("pattern || '|' || k")}) % 730)::BIGINT as day,
    {hash32("pattern || '|' || k", 9)} % 2 = 0 as blocked
  from names, (select unnest(['0', '1', '2', '3', '4']) as k)
  where {hash32("pattern", 17)} % 3 > 0),
d as (select pattern, day, max(blocked) as blocked from e group by all),
i as (select pattern, day as since, lead(day) over (partition by pattern order by day) as until, blocked from d),
labels as (select *, string_split(host, '.') as l from c where host <> ''),
p as (select distinct page_id, day, pattern from (
  select page_id, day, unnest(list_transform(range(1, len(l) + 1), lambda k: array_to_string(l[k:], '.'))) as pattern from labels
  union all select page_id, day, host || first from labels where first <> '')),
m as (select page_id, p.pattern, blocked, row_number() over (partition by page_id order by length(p.pattern) desc, p.pattern desc) as r
  from p join i on p.pattern = i.pattern and since <= day and (until is null or day < until))
select c.page_id, m.pattern, coalesce(m.blocked, false) as blocked
from c left join m on c.page_id = m.page_id and r = 1"""


@query("op3_url_filters", URL_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page was on the list when it was fetched.

    The tables have no dates: fetch days and the dated entries of hosts, first path parts and
    parent domains come from hashes of the pages' own keys and URLs.
    """
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.pmod(stable_hash(F.col("page_id")), F.lit(730)).cast("long").alias("day"))
    host = url_lists.host_of(F.col("url"))
    first = F.regexp_extract(F.coalesce("url", F.lit("")), url_lists.FIRST, 1)
    known = F.array_compact(
        F.array(host, F.when(first != "", F.concat(host, first)), F.regexp_replace(host, "^[^.]+[.]", ""))
    )
    names = pages.filter(host != "").select(F.explode(known).alias("pattern")).distinct()
    names = names.filter(F.pmod(stable_hash(F.col("pattern"), 17), F.lit(3)) > 0)
    entries = names.withColumn("k", F.explode(F.array(*[F.lit(str(k)) for k in range(5)])))
    seed = F.concat_ws("|", "pattern", "k")
    entries = entries.select(
        "pattern",
        F.pmod(stable_hash(seed), F.lit(730)).cast("long").alias("day"),
        (F.pmod(stable_hash(seed, 9), F.lit(2)) == 0).alias("blocked"),
    )
    # The SQL knows these shapes of entries only.
    return url_lists.as_of(captures, entries, short=True)


#: Tokens beyond which a document is over the limit of ``op11_token_counts``.
TOKEN_LIMIT = 512


@query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, and how many characters of it fit the limit."""
    index = token_counts.prefix_counts(table(spark, sf_dir, "documents"), token_files()[0], (TOKEN_LIMIT,))
    return token_counts.totals(index).select(
        "doc_id",
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
        F.element_at("within", 1).alias("fitting_chars"),
    )


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in their 32 first principal components, each with variance one."""
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors, components=32)
    shares = model.explained.tolist() if model else []
    error = whitening.identity_error(vectors, model) if model else 0.0
    out = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after a fixed damage."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = conversation_repair.damaged(conversations)
    found = materialize(conversation_repair.audits(rows), "audits")
    digests = conversation_repair.digests(rows, found).withColumnRenamed("conv_id", "hashed")
    names = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    keys = found.withColumnRenamed("conv_id", "audited")
    out = names.join(keys, names["conv_id"].eqNullSafe(keys["audited"]), "left")
    out = out.join(digests, out["conv_id"].eqNullSafe(digests["hashed"]), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        "conv_id",
        *numbers,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
