"""Queries on search: full text, vectors, fusion, expansion, prompts and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.operators import index, prompt, search
from clausemill.plans.clauses import live
from clausemill.plans.sql import LIVE
from clausemill.session import materialise, read, scratch, width
from clausemill.streaming import watch

#: A stated set of text queries.
TEXTS = ((1, "limitation of liability"), (2, "deposit and security deposit"), (3, "Governing law, venue!"), (4, "pays within forty days"), (5, "timber bonds cancelled"), (6, "?!"))
MODEL = "clausenc-v2@64"


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEXTS), "query_id long, query string")


def _tables(spark, d, *columns):
    c = materialise(live(spark, d, "source", "heading", "body", *columns))  # the index's clause table: deduplicated once, read by each branch
    return c, index.postings(c), index.sizes(c)


def postings_stats(spark, d):
    """Per source: rows, mean length and distinct words of the index."""
    _, post, sizes = _tables(spark, d)
    a = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("len"), 9).alias("avg_len"))
    b = post.groupBy("source", "token").agg(F.count(F.lit(1)).alias("df")).groupBy("source").agg(F.count(F.lit(1)).alias("words"), F.max("df").alias("max_df"))
    return a.join(b, "source")


_TOK = lambda x: rf"list_filter(regexp_split_to_array(strip_accents(lower({x})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
POST = rf"""
{LIVE}, tk as (select source, clause_id, {_TOK("coalesce(heading, '')")} as a, {_TOK("coalesce(body, '')")} as b from live),
ex as (select source, clause_id, len(a) + len(b) as len, unnest(list_concat(list_transform(a, lambda x: {{'t': x, 'h': 1}}), list_transform(b, lambda x: {{'t': x, 'h': 0}}))) as s from tk),
post as (select source, clause_id, s.t as token, sum(s.h) as tf_heading, sum(1 - s.h) as tf_body, any_value(len) as len from ex group by 1, 2, 3),
sizes as (select source, clause_id, any_value(len) as len from post group by 1, 2)
"""
STATS = f"""
with {POST}, a as (select source, count(*) as n_rows, round(avg(len), 9) as avg_len from sizes group by 1),
b as (select source, count(*) as words, max(df) as max_df from (select source, token, count(*) as df from post group by 1, 2) group by 1)
select source, n_rows, avg_len, words, max_df from a join b using (source)
"""


def bm25_topk(spark, d):
    """The ten best clauses of each text query and source by BM25."""
    _, post, sizes = _tables(spark, d)
    scored = search.bm25(post, search.query_tokens(_queries(spark)), sizes).withColumn("score", F.round("score", 12))
    return search.cut(scored, [F.desc("score")], 10).select("query_id", "source", "clause_id", "rank", F.round("score", 9).alias("score"))


_QS = ", ".join(f"({i}, '{q}')" for i, q in TEXTS)
_BM25 = rf"""
qt as (select query_id, token, count(*) as weight from (select query_id, unnest({_TOK('query')}) as token from qs) group by 1, 2),
hit as (select post.* from post where token in (select token from qt)),
df as (select source, token, count(*) as df from hit group by 1, 2), st as (select source, count(*) as rows, avg(len) as avg_len from sizes group by 1),
sc as (select query_id, hit.source, clause_id, weight, tf_heading * 2.0 + tf_body * 1.0 as f, len, avg_len, case when ln((rows - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((rows - df + 0.5) / (df + 0.5)) end as idf from hit join df using (source, token) join st using (source) join qt using (token)),
bm as (select query_id, source, clause_id, round(sum(weight * idf * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 12) as score from sc group by 1, 2, 3)
"""
BM25 = f"""
with {POST}, qs as (select * from (values {_QS}) v(query_id, query)), {_BM25}
select cast(query_id as bigint) as query_id, source, clause_id, cast(rank as int) as rank, round(score, 9) as score from (select *, row_number() over (partition by query_id, source order by score desc, clause_id) as rank from bm) where rank <= 10
"""


def vector_knn(spark, d):
    """The ten nearest of all embeddings to each whose id is divisible by 50, by squared L2."""
    e = read(spark, d, "embeddings").select(F.lit("all").alias("source"), "vec_id", "embedding")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = search.knn(e, q, "vec_id").withColumn("distance", F.round("distance", 9))
    return search.cut(near, [F.asc("distance")], 10, "vec_id").select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


KNN = """
with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 50 = 0),
x as (select query_id, vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda s: (cast(s[1] as double) - cast(s[2] as double)) * (cast(s[1] as double) - cast(s[2] as double)))), 9) as distance from embeddings, q)
select query_id, vec_id, cast(rank as int) as rank, round(distance, 6) as distance from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from x) where rank <= 10
"""


def _seeds(spark, d, c):
    """Seed clauses (id divisible by 50) as queries: their heading or term, and their vector."""
    v = read(spark, d, "clause_vec").where((F.col("embed_model") == MODEL) & F.col("embedding").isNotNull()).dropDuplicates(["clause_id"]).select("clause_id", "embedding")
    q = c.where("clause_id % 50 = 0").join(v, "clause_id").select(F.col("clause_id").alias("query_id"), F.coalesce("heading", "term", F.lit("")).alias("query"), "embedding")
    return v.join(c.select("clause_id", "source"), "clause_id"), q


def _hybrid(spark, d, where=None, limit=10):
    c, _, sizes = _tables(spark, d, "doc_id", "rel_path", "kind", "term", "approved")
    # One shuffle of the texts by row serves the postings and the sums over them.
    post = index.postings(c.repartition(width(spark), "source", "clause_id"))
    vectors, queries = _seeds(spark, d, c)
    queries = materialise(queries)
    return search.hybrid(queries, post, sizes, vectors, c, read(spark, d, "documents"), limit, where)


def hybrid_search(spark, d):
    """BM25 and vectors fused by reciprocal rank over all sources, for the seed clauses."""
    return _hybrid(spark, d).select("query_id", "place", "source", "clause_id", F.round("score", 9).alias("score"))


def approved_boost_filter(spark, d):
    """The same for operative, approved clauses: the filter comes after the cut."""
    where = search.filters(exclude_kinds=search.OPERATIVE, approved_only=True)
    return _hybrid(spark, d, where).select("query_id", "place", "source", "clause_id", F.round("score", 9).alias("score"))


_FUSED = rf"""
qs as (select clause_id as query_id, coalesce(heading, term, '') as query, v.embedding as q from live join (select clause_id, any_value(embedding) as embedding from clause_vec where embed_model = '{MODEL}' and embedding is not null group by 1) v using (clause_id) where clause_id % 50 = 0), {_BM25},
vx as (select clause_id, any_value(embedding) as e from clause_vec where embed_model = '{MODEL}' and embedding is not null group by 1),
kn as (select query_id, live.source, clause_id, round(list_sum(list_transform(list_zip(e, q), lambda s: (cast(s[1] as double) - cast(s[2] as double)) * (cast(s[1] as double) - cast(s[2] as double)))), 9) as distance from vx join live using (clause_id), qs),
rk as (select query_id, source, clause_id, row_number() over (partition by query_id, source order by score desc, clause_id) as r from bm union all select query_id, source, clause_id, row_number() over (partition by query_id, source order by distance, clause_id) from kn),
fu as (select query_id, source, clause_id, sum(1.0 / (60 + r)) as score from rk where r <= 30 group by 1, 2, 3),
cu as (select * from (select *, row_number() over (partition by query_id, source order by score desc, clause_id) as r from fu) where r <= 30),
hi as (select cu.query_id, live.source, clause_id, live.kind, approved, heading, term, body, live.rel_path, case when approved then score * 1.5 else score end as score from cu join live using (clause_id) join documents using (doc_id) where not deleted)
"""
HYBRID = f"with {POST}, {_FUSED} select query_id, cast(place as int) as place, source, clause_id, round(score, 9) as score from (select *, row_number() over (partition by query_id order by score desc, source, clause_id) as place from hi) where place <= 10"
BOOST = f"with {POST}, {_FUSED} select query_id, cast(place as int) as place, source, clause_id, round(score, 9) as score from (select *, row_number() over (partition by query_id order by score desc, source, clause_id) as place from hi where kind not in ('definition', 'schedule', 'recital', 'execution') and coalesce(approved, false)) where place <= 10"


def expand_one_hop(spark, d):
    """The first five neighbours, one edge away, of each clause whose id is divisible by 50, each a query of its own."""
    c = live(spark, d, "doc_id", "source")
    hits = c.where("clause_id % 50 = 0").select(F.col("clause_id").alias("query_id"), "clause_id")
    return search.expand(hits, read(spark, d, "edges"), c, read(spark, d, "documents"), 5).select("query_id", "place", "clause_id", "doc_id", "score")


EXPAND = f"""
with {LIVE}, n as (select distinct src_clause as query_id, clause_id, doc_id from edges join live on clause_id = dst_clause join documents using (doc_id)
where src_clause % 50 = 0 and src_clause in (select clause_id from live) and clause_id <> src_clause and not deleted)
select query_id, cast(place as int) as place, clause_id, doc_id, cast(0.0 as double) as score from (select *, row_number() over (partition by query_id order by clause_id) as place from n) where place <= 5
"""


def prompt_extracts(spark, d):
    """The hits of each seed as numbered extracts for a prompt."""
    return prompt.extracts(_hybrid(spark, d, limit=8))


PROMPTS = f"""
with {POST}, {_FUSED.replace('r <= 30', 'r <= 24')}, pl as (select *, row_number() over (partition by query_id order by score desc, source, clause_id) as place from hi)
select query_id, string_agg('[' || place || '] ' || coalesce(term, heading, '(untitled)') || ' — source: ' || source || ' / ' || rel_path || chr(10) || regexp_replace(coalesce(body, ''), '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10), '' order by place) as context from pl where place <= 8 group by 1
"""


def hash_embedding(spark, d):
    """Hashed 256-dimensional embedding of every clause."""
    from clausemill.operators.segment import embedding_text

    c = live(spark, d, "heading", "term", "body").select("clause_id", embedding_text(F.col("heading"), F.col("term"), F.col("body")).alias("t"))
    return index.embed(c, "clause_id", "t")


def stream_ingest(spark, d):
    """The documents table streamed to its end through the tokeniser into a table: words per document."""
    from clausemill.functions.text import tokens

    schema = read(spark, d, "documents").schema
    table = f"{d}/[d]ocuments.parquet"  # a pattern, so that it may be a file or a folder
    at = scratch(spark, "stream")
    count = lambda df: df.select("doc_id", "source", F.size(tokens(F.coalesce("text", F.lit("")))).alias("words"))
    watch.ingest_stream(spark, table, schema, f"{at}/out", f"{at}/state", count).awaitTermination()
    return spark.read.parquet(f"{at}/out")


STREAM = f"select doc_id, source, cast(len({_TOK(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) as int) as words from documents"

QUERIES = {f.__name__: f for f in (postings_stats, bm25_topk, vector_knn, hybrid_search, approved_boost_filter, expand_one_hop, prompt_extracts, hash_embedding, stream_ingest)}
SQL = {"postings_stats": STATS, "bm25_topk": BM25, "vector_knn": KNN, "hybrid_search": HYBRID, "approved_boost_filter": BOOST, "expand_one_hop": EXPAND, "prompt_extracts": PROMPTS, "stream_ingest": STREAM}
