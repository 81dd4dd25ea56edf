"""Queries over fingerprints, similarity and reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import features as ft
from sievework.operators import reduce as rd
from sievework.operators import similarity, sketch
from sievework.plans.registry import hash32, query, table, texts
from sievework.session import materialize

# Patterns of the key fingerprint used on documents.
PATTERNS = [r"\d{4}", r"https?://", r"[A-Z]{3}", r"\(", r";", r"\w+@\w+", r"(?i)copyright", r"###"]


def text_bits_sql(n_bits: int, n: int = 3, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Rows (key, bit) of distinct folded word n-grams."""
    words = f"string_split(trim(regexp_replace(lower({text}), '[^\\p{{L}}]+', ' ', 'g')), ' ')"
    parts = ", ".join(["t", *[f"lead(t, {i}) over w" for i in range(1, n)]])
    return f"""(select distinct {key}, ({hash32('gram')} % {n_bits})::INTEGER as bit from (
      select {key}, i, len, concat_ws(' ', {parts}) as gram from (
        select {key}, unnest(ws) as t, unnest(range(1, len + 1)) as i, len from (
          select {key}, ws, len(ws) as len from (select {key}, {words} as ws from {source})))
      where t <> '' window w as (partition by {key} order by i)) where i = 1 or i <= len - {n - 1})"""


@query(
    "f3_pattern_fingerprint",
    "select doc_id, bit from (select doc_id, unnest(list_filter(["
    + ", ".join(f"case when regexp_matches(text, '{p}') then {i} end" for i, p in enumerate(PATTERNS))
    + "], lambda b: b is not null))::INTEGER as bit from documents)",
)
def f3(spark, d):
    docs = texts(spark, d)
    fp = docs.select("doc_id", ft.pattern_fingerprint(F.col("text"), PATTERNS).alias("fp"))
    return rd.set_bits(fp, "doc_id", "fp")


@query(
    "f6_bit_text",
    """select vec_id, array_to_string(list_transform(embedding, lambda v: case when v > 0 then '1' else '0' end), '') as fp,
         list_count(list_filter(embedding, lambda v: v > 0))::INTEGER as ones from embeddings""",
)
def f6(spark, d):
    df = table(spark, d, "embeddings")
    text = ft.to_bit_text(F.transform("embedding", lambda v: v > 0))
    back = ft.to_sparse(ft.from_bit_text(F.col("fp")))
    return df.select("vec_id", text.alias("fp")).select("vec_id", "fp", F.size(back).alias("ones"))


@query(
    "f7_array_to_rows_and_columns",
    """select vec_id, generate_subscripts(embedding, 1)::INTEGER - 1 as pos, unnest(embedding)::DOUBLE as x,
         embedding[1]::DOUBLE as x0, embedding[2]::DOUBLE as x1 from embeddings""",
)
def f7(spark, d):
    df = table(spark, d, "embeddings")
    wide = rd.spread_columns(df.select("vec_id", "embedding"), "embedding", 2)
    rows = rd.positions(df, "vec_id", "embedding")
    return rows.join(wide, "vec_id").select(
        "vec_id", "pos", *[F.col(c).cast("double").alias(c) for c in ("x", "x0", "x1")]
    )


@query(
    "f7_array_to_all_columns",
    f"select vec_id, {', '.join(f'embedding[{i + 1}]::DOUBLE as x{i}' for i in range(64))} from embeddings",
)
def f7_all(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    wide = rd.spread_columns(vectors, "embedding", 64)
    return wide.select("vec_id", *[F.col(f"x{i}").cast("double").alias(f"x{i}") for i in range(64)])


@query("f8_text_fingerprint", f"select doc_id, bit from {text_bits_sql(2048)}")
def f8(spark, d):
    docs = texts(spark, d)
    fp = docs.select("doc_id", ft.text_fingerprint(F.col("text"), 3, 2048).alias("fp"))
    return rd.set_bits(fp, "doc_id", "fp")


@query(
    "f9_invalid_to_null",
    f"""select d.doc_id, b.n as bits from documents d left join (
          select doc_id, count(*) as n from {text_bits_sql(512, 1)} group by doc_id) b
        on b.doc_id = d.doc_id and regexp_matches(d.text, '^[\\p{{L}}]')""",
)
def f9(spark, d):
    text = F.col("text")
    fp = ft.valid_or_null(text.rlike(r"^[\p{L}]"), ft.text_fingerprint(text, 1, 512))
    return texts(spark, d).select("doc_id", F.size(fp).cast("bigint").alias("bits")).withColumn(
        "bits", F.when(F.col("bits") >= 0, F.col("bits"))
    )


@query(
    "f10_exact_weight",
    """select p_partkey, case when p_type = 'ECONOMY' then null else round((p_size + 1) * 12.0::DOUBLE
         + (2 * p_size + 4) * 1.00782503223::DOUBLE + 14.00307400443::DOUBLE
         + (p_partkey % 3 + 2) * 15.99491461957::DOUBLE + 34.968852682::DOUBLE, 6) end as weight from part""",
)
def f10(spark, d):
    # A formula per part; one type of parts gets a charge layer, which cannot be weighed.
    size, key = F.col("p_size"), F.col("p_partkey")
    formula = F.concat(
        F.lit("InChI=1S/C"), size + 1, F.lit("ClH"), 2 * size + 4, F.lit("NO"), F.pmod(key, F.lit(3)) + 2,
        F.lit("/c1-2"), F.when(F.col("p_type") == "ECONOMY", "/q+1").otherwise("/h1H"),
    )
    return table(spark, d, "part").select("p_partkey", F.round(ft.exact_weight(formula), 6).alias("weight"))


@query("f13_pca_compression")
def f13(spark, d):
    df = table(spark, d, "embeddings")
    model = rd.fit_compressor(df, "embedding", 16)
    out = rd.compress(df, model, "embedding")
    return out.select("vec_id", "label", "fpcompressed")


@query("f13_sketch_compression")
def f13_sketch(spark, d):
    """2**20 text bits to 64 columns by frequent directions."""
    bits = ft.text_fingerprint(F.col("text"), 2, 1 << 20)
    docs = materialize(texts(spark, d).select("doc_id", bits.alias("fp")), "bits")
    model = sketch.fit(docs, "fp", 1 << 20, columns=64)
    out = sketch.compress(docs, "fp", model)
    return out.select("doc_id", F.transform("fpcompressed", lambda x: F.round(x, 6)).alias("fpcompressed"))


PROJECTION = """
  select vec_id, j as pos, round(sum(x * case when ('0x' || substr(md5('7|' || i::varchar || '|' || j::varchar), 1, 1))::BIGINT % 2 = 1
    then 1 else -1 end) / sqrt(16.0::DOUBLE), 5) as x
  from (select vec_id, unnest(embedding)::DOUBLE as x, generate_subscripts(embedding, 1) - 1 as i from embeddings),
    (select unnest(range(16))::INTEGER as j) group by vec_id, j"""


@query("f13_sign_projection", PROJECTION)
def f13b(spark, d):
    project = rd.sign_projection(64, 16, seed=7)
    df = table(spark, d, "embeddings").select("vec_id", project(F.col("embedding")).alias("c"))
    return rd.positions(df, "vec_id", "c").withColumn("x", F.round("x", 5))


@query(
    "f14_label_log_odds",
    """select 'quality' as target, round(ln(count(*) filter (quality = 1) / nullif(count(*) filter (quality = 0), 0)::DOUBLE), 6) as bias from labels
       union all select 'toxic', round(ln(count(*) filter (toxic = 1) / nullif(count(*) filter (toxic = 0), 0)::DOUBLE), 6) from labels""",
)
def f14(spark, d):
    long = table(spark, d, "labels").unpivot(["doc_id"], ["quality", "toxic"], "target", "y")
    return rd.log_odds(long, "y", ["target"]).withColumn("bias", F.round("bias", 6))


@query(
    "f14_bit_log_odds",
    """select round(ln(sum(ones)::DOUBLE / (count(*) * 64 - sum(ones))), 6) as bias from (
         select list_count(list_filter(embedding, lambda v: v > 0)) as ones from embeddings)""",
)
def f14b(spark, d):
    df = table(spark, d, "embeddings").select(ft.sign_bits(F.col("embedding")).alias("fp"))
    return rd.bit_log_odds(df, "fp", 64).withColumn("bias", F.round("bias", 6))


@query(
    "f15_standardize",
    """with x as (select vec_id, unnest(embedding)::DOUBLE as x, generate_subscripts(embedding, 1)::INTEGER - 1 as pos from embeddings)
       select vec_id, pos, round((x - avg(x) over (partition by pos)) / stddev_samp(x) over (partition by pos), 5) as x from x""",
)
def f15(spark, d):
    out = rd.standardize(table(spark, d, "embeddings"), "embedding")
    return rd.positions(out, "vec_id", "scaled").withColumn("x", F.round("x", 5))


WIDE = 2**31 - 1


@query(
    "j5_similar_pairs",
    f"""with bits as materialized {text_bits_sql(WIDE)},
          sets as (select doc_id, md5(string_agg(bit::varchar, ',' order by bit)) as s, count(*) as n from bits group by doc_id),
          reps as (select min(doc_id) as k, any_value(n) as n from sets group by s),
          kept as materialized (select k, n, bit from reps join bits on bits.doc_id = k),
          common as (select a.k as a, b.k as b, a.n as an, b.n as bn, count(*) as c
                     from kept a join kept b on a.bit = b.bit and a.k < b.k group by all)
        select a, b, round(c / (an + bn - c)::DOUBLE, 6) as tanimoto from common where c / (an + bn - c)::DOUBLE >= 0.5""",
)
def j5(spark, d):
    docs = texts(spark, d).select(
        "doc_id", ft.text_fingerprint(F.col("text"), 3, WIDE).alias("fp")
    )
    pairs = similarity.similar_pairs(docs, "doc_id", "fp", 0.5)
    return pairs.withColumn("tanimoto", F.round("tanimoto", 6))


def sampled_sql() -> str:
    """Common table expressions up to ``met``: the pairs that share a bucket of some table."""
    tables = similarity.table_count(0.5, 0.99, 3)
    seeds = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(similarity.orders(3 * tables)))
    return f"""with bits as materialized {text_bits_sql(WIDE)},
          sets as (select doc_id, md5(string_agg(bit::varchar, ',' order by bit)) as s, count(*) as n from bits group by doc_id),
          reps as (select min(doc_id) as k, any_value(n) as n from sets group by s),
          kept as materialized (select k, n, bit from reps join bits on bits.doc_id = k),
          seeds(s, a, b) as (values {seeds}),
          firsts as (select k, s, min((bit::BIGINT * seeds.a::BIGINT + seeds.b::BIGINT) % {similarity.PRIME}) as v
                     from kept, seeds group by all),
          places as (select k, s // 3 as i, string_agg(v::varchar, ',' order by s) as v from firsts group by all),
          met as (select distinct x.k as a, y.k as b from places x join places y on x.i = y.i and x.v = y.v and x.k < y.k)"""


@query(
    "j5_similar_pairs_sampled",
    f"""{sampled_sql()},
        common as (select a, b, p.n as an, q.n as bn, count(*) as c
                   from met join kept p on p.k = a join kept q on q.k = b and q.bit = p.bit group by all)
        select a, b, round(c / (an + bn - c)::DOUBLE, 6) as tanimoto from common where c / (an + bn - c)::DOUBLE >= 0.5""",
)
def j5_sampled(spark, d):
    """Similar pairs through tables of three sampled bits, 99 % of those at 0.5."""
    fp = ft.text_fingerprint(F.col("text"), 3, WIDE).alias("fp")
    pairs = similarity.similar_pairs_sampled(texts(spark, d).select("doc_id", fp), "doc_id", "fp", 0.5)
    return pairs.withColumn("tanimoto", F.round("tanimoto", 6))


@query(
    "j5_sampled_recall",
    f"""{sampled_sql()},
        common as (select a.k as a, b.k as b, a.n as an, b.n as bn, count(*) as c
                   from kept a join kept b on a.bit = b.bit and a.k < b.k group by all),
        pairs as (select a, b, c / (an + bn - c)::DOUBLE as t from common where c / (an + bn - c)::DOUBLE >= 0.5),
        marked as (select floor(t * 10 + 1e-9)::INTEGER as tenth, met.a is not null as hit
                   from pairs left join met on met.a = pairs.a and met.b = pairs.b)
        select tenth, count(*) as pairs, count(*) filter (hit) as found,
          count(*) filter (hit) / count(*)::DOUBLE as recall, 0.5::DOUBLE as least
        from marked group by rollup (tenth)""",
)
def j5_recall(spark, d):
    """What share of the exact join's pairs the sampled index finds, by similarity."""
    docs = texts(spark, d).select("doc_id", ft.text_fingerprint(F.col("text"), 3, WIDE).alias("fp"))
    # Both joins read the same sets, which are made and kept once.
    sets = similarity.fold_sets(docs, "doc_id", "fp")
    exact = similarity.similar_pairs(docs, "doc_id", "fp", 0.5, sets=sets)
    found = similarity.similar_pairs_sampled(docs, "doc_id", "fp", 0.5, sets=sets)
    return similarity.recall_by_similarity(exact, found, 0.5)
