"""Hybrid search: BM25 and vectors, fused by reciprocal rank, for a batch of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from clausemill.functions.text import tokens
from clausemill.session import materialise, width

RRF_K = 60
BOOST = 1.5
K1, B = 1.2, 0.75
WEIGHTS = {"tf_heading": 2.0, "tf_body": 1.0}
FLOOR = 1e-6
HIT_COLUMNS = ("clause_id", "doc_id", "source", "rel_path", "kind", "number", "seq", "depth", "heading", "term", "body", "clause_type", "contract_type", "jurisdiction", "approved")


def per_source(limit: int) -> int:
    """Rows kept of each list and source: three times the limit, at least 20."""
    return max(3 * limit, 20)


def query_tokens(queries: DataFrame, text: str = "query") -> DataFrame:
    """(query_id, token, weight): words of each query; a repeated word counts repeatedly. Marks alone give none."""
    return queries.select("query_id", F.explode(tokens(F.col(text))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("weight"))


def bm25(postings: DataFrame, terms: DataFrame, sizes: DataFrame, key: str = "clause_id") -> DataFrame:
    """(query_id, source, ``key``, score): BM25 with weighted columns, statistics per source.

    ``sizes`` is (source, key, len) of all rows of the index. Only postings of the
    queries' words are read on; the words are few and broadcast by the planner.
    """
    stats = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.avg("len").alias("avg_len"))
    hit = materialise(postings.join(F.broadcast(terms.select("token").distinct()), "token", "left_semi"))  # read twice, made once
    spread = hit.groupBy("source", "token").agg(F.count(F.lit(1)).alias("df"))
    # Only the queries' words are broadcast: postings that lie together by row are multiplied and summed where they are.
    x = hit.join(F.broadcast(spread.join(stats, "source").join(terms, "token")), ["source", "token"])
    idf = F.log((F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, FLOOR).otherwise(idf)
    f = F.col("tf_heading") * WEIGHTS["tf_heading"] + F.col("tf_body") * WEIGHTS["tf_body"]
    score = F.col("weight") * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return x.groupBy("query_id", "source", key).agg(F.sum(score).alias("score"))


def impacts(postings: DataFrame, terms: DataFrame, sizes: DataFrame, key: str = "clause_id") -> DataFrame:
    """(source, ``key``, token, impact): what each posting of the queries' words adds to BM25, once for all queries."""
    stats = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.avg("len").alias("avg_len"))
    hit = materialise(postings.join(terms.select("token").distinct(), "token", "left_semi"))  # read twice, made once
    spread = hit.groupBy("source", "token").agg(F.count(F.lit(1)).alias("df"))
    x = hit.join(spread.join(F.broadcast(stats), "source"), ["source", "token"])
    idf = F.log((F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    f = F.col("tf_heading") * WEIGHTS["tf_heading"] + F.col("tf_body") * WEIGHTS["tf_body"]
    part = F.when(idf <= 0, FLOOR).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return x.select("source", key, "token", part.alias("impact"))


def _shard_search(shared, key: str, most: int):
    """The search of one shard: impacts (source, ``key``, token, impact) against the broadcast (query_id, token, weight)."""

    def search(table: pa.Table) -> pa.Table:
        ids, words, weight = shared.value
        source = table.column("source")[0].as_py()
        token = table.column("token").combine_chunks().dictionary_encode()
        row = table.column(key).combine_chunks().dictionary_encode()
        order = np.argsort(token.indices.to_numpy(), kind="stable")
        at, row_of, impact = token.indices.to_numpy()[order], row.indices.to_numpy()[order], table.column("impact").to_numpy()[order]
        names = np.argsort(np.argsort(row.dictionary.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")  # ties go to the lesser key
        where = pc.index_in(words, token.dictionary)
        mine = np.flatnonzero(where.is_valid().to_numpy(zero_copy_only=False))
        word, w = where.take(pa.array(mine)).to_numpy(), weight.to_numpy()[mine].astype(np.float64)
        query = ids.take(pa.array(mine)).dictionary_encode()
        by = np.argsort(query.indices.to_numpy(), kind="stable")
        word, w, q = word[by], w[by], query.indices.to_numpy()[by]
        start, end = np.searchsorted(at, np.arange(len(token.dictionary))), np.searchsorted(at, np.arange(len(token.dictionary)), "right")
        edge = np.searchsorted(q, np.arange(len(query.dictionary) + 1))
        found = []
        for i in range(len(query.dictionary)):
            some = range(edge[i], edge[i + 1])
            rows = np.concatenate([row_of[start[word[j]] : end[word[j]]] for j in some])
            score = np.bincount(rows, np.concatenate([w[j] * impact[start[word[j]] : end[word[j]]] for j in some]), minlength=len(names))
            hit = np.flatnonzero(score > 0)
            value = np.round(score[hit], 12)
            if len(hit) > most:
                near = np.flatnonzero(value >= np.partition(value, len(value) - most)[len(value) - most])
                hit, value = hit[near], value[near]
                best = np.lexsort((names[hit], -value))[:most]
                hit, value = hit[best], value[best]
            found.append((np.full(len(hit), i), hit, value))
        i, hit, value = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([query.dictionary.take(pa.array(i)), pa.array([source] * len(i), type=pa.string()), row.dictionary.take(pa.array(hit)), pa.array(value)], names=["query_id", "source", key, "score"])

    return search


def best_texts(postings: DataFrame, terms: DataFrame, sizes: DataFrame, most: int, key: str = "clause_id", block: int = 20_000, shard: int = 200_000) -> DataFrame:
    """(query_id, source, ``key``, score): of bm25()'s rows, scores rounded to 12 digits, at least the ``most`` best of each query and source.

    Rows lie in shards of a source, about ``shard`` rows each; a shard adds the impacts of
    each query's words and gives its ``most`` best (the higher score, then the lesser
    key), so that the scores of all pairs are never written anywhere. ``block`` queries
    are broadcast at a time, one pass over the impacts each. Exact.
    """
    spark = postings.sparkSession
    kinds = [terms.schema["query_id"], postings.schema["source"], postings.schema[key]]
    schema = StructType([*(StructField(n, f.dataType) for n, f in zip(("query_id", "source", key), kinds, strict=True)), StructField("score", DoubleType())])
    parts = materialise(impacts(postings, terms, sizes, key))
    salts = F.lit(1 + sizes.count() // shard)
    parts = parts.withColumn("salt", F.pmod(F.xxhash64(key), salts)).repartition(width(spark), "source", "salt")
    n_queries = terms.select("query_id").distinct().count()
    blocks = max(1, -(-n_queries // block))
    result = None
    for k in range(blocks):
        t = (terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)).select("query_id", "token", "weight").toArrow()
        shared = spark.sparkContext.broadcast((t.column(0).combine_chunks(), t.column(1).combine_chunks(), t.column(2).combine_chunks()))

        now = parts.groupBy("source", "salt").applyInArrow(_shard_search(shared, key, most), schema)
        result = now if result is None else result.unionByName(now)
    return result


def knn(vectors: DataFrame, queries: DataFrame, key: str = "clause_id") -> DataFrame:
    """(query_id, source, ``key``, distance): squared L2 of each row to each query.

    The queries are a stated set and broadcast; rows of another dimension are left out.
    """
    v = vectors.select("source", key, F.col("embedding").alias("v"))
    q = queries.select("query_id", F.col("embedding").alias("q"))
    d = F.aggregate(F.zip_with("v", "q", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return v.join(F.broadcast(q), F.size("v") == F.size("q")).select("query_id", "source", key, d.alias("distance"))


def nearest(vectors: DataFrame, queries: DataFrame, most: int, key: str = "clause_id", block: int = 20_000) -> DataFrame:
    """(query_id, source, ``key``, distance): of knn()'s rows at least the ``most`` nearest of each query and source.

    Exact: a matrix product finds the rows that may be among them, with slack for its
    rounding and for ties at nine digits; their distances are then summed by differences.
    ``block`` queries are broadcast at a time, one pass over the vectors each.
    """
    spark = vectors.sparkSession
    kinds = [queries.schema["query_id"], vectors.schema["source"], vectors.schema[key]]
    schema = StructType([*(StructField(n, f.dataType) for n, f in zip(("query_id", "source", key), kinds, strict=True)), StructField("distance", DoubleType())])
    v = materialise(vectors.where("embedding is not null").select("source", key, F.col("embedding").cast("array<double>").alias("v")))
    q = materialise(queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("q")))
    # A source's rows together, so that little more than ``most`` of each leaves the workers; large sources are split.
    v = v.repartition(width(spark), "source", F.pmod(F.xxhash64(key), F.lit(1 + v.count() // 1_000_000))).sortWithinPartitions("source")
    blocks = max(1, -(-q.count() // block))
    result = None
    for k in range(blocks):
        t = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)).toArrow()
        sets: dict[int, tuple[list, list]] = {}
        for i, x in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
            ids, rows = sets.setdefault(len(x), ([], []))
            ids.append(i)
            rows.append(x)
        of_ids = t.column(0).type
        shared = spark.sparkContext.broadcast({d: (pa.array(ids, type=of_ids), np.array(rows, dtype=np.float64)) for d, (ids, rows) in sets.items()})

        def run(batches, shared=shared):
            names = ["query_id", "source", key, "distance"]

            def search(t):
                t = t.combine_chunks()
                for source in t.column(0).unique():
                    of = t.filter(pc.equal(t.column(0), source)) if source.is_valid else t.filter(pc.is_null(t.column(0)))
                    ids, lists = of.column(1).combine_chunks(), of.column(2).combine_chunks()
                    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                    for d in set(sizes.tolist()) & shared.value.keys():
                        at = np.flatnonzero(sizes == d)
                        x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                        qids, y = shared.value[d]
                        xx, yy = (x * x).sum(1), (y * y).sum(1)
                        for b in range(0, len(y), 256):
                            near = xx - 2.0 * (y[b : b + 256] @ x.T) + yy[b : b + 256, None]
                            near[np.isnan(near)] = np.inf  # a vector with a null or NaN is the farthest
                            if len(at) > most:
                                edge = np.partition(near, most - 1, axis=1)[:, most - 1 : most]
                                i, j = np.nonzero(near <= edge + 2e-9 + 1e-12 * (xx[np.isfinite(xx)].max(initial=0.0) + yy[b : b + 256, None]))
                            else:
                                i, j = (z.ravel() for z in np.indices(near.shape))
                            far = ((x[j] - y[b + i]) ** 2).sum(1)
                            yield pa.RecordBatch.from_arrays([qids.take(pa.array(b + i)), pa.array([source.as_py()] * len(i), type=pa.string()), ids.take(pa.array(at[j])), pa.array(far)], names=names)

            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= 50_000:
                    yield from search(pa.Table.from_batches(held))
                    held, n = [], 0
            if n:
                yield from search(pa.Table.from_batches(held))

        now = v.mapInArrow(run, schema)
        result = now if result is None else result.unionByName(now)
    return result


def cut(scored: DataFrame, order: list[Column], most: int, key: str = "clause_id", rank: str = "rank") -> DataFrame:
    """The first ``most`` rows of each query and source, with their rank from 1 (cut before the shuffle by the group limit)."""
    w = W.partitionBy("query_id", "source").orderBy(*order, key)
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= most)


def fuse(lists: list[DataFrame], key: str = "clause_id") -> DataFrame:
    """(query_id, source, ``key``, score): sum of 1 / (60 + rank) over the ranked lists."""
    out = None
    for ranked in lists:
        r = ranked.select("query_id", "source", key, "rank")
        out = r if out is None else out.unionByName(r)
    return out.groupBy("query_id", "source", key).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"))


def filters(kind: str | None = None, exclude_kinds=(), approved_only: bool = False, clause_type: str | None = None, contract_type: str | None = None) -> Column:
    """Metadata filter; a null fails each test that is asked."""
    out = F.lit(True)
    if kind:
        out = out & (F.col("kind") == kind)
    if exclude_kinds:
        out = out & ~F.col("kind").isin(*exclude_kinds)
    if approved_only:
        out = out & F.coalesce("approved", F.lit(False))
    for name, want in (("clause_type", clause_type), ("contract_type", contract_type)):
        if want:
            out = out & F.coalesce(F.lower(name) == want.lower(), F.lit(False))
    return out


KINDS = ("clause", "definition", "recital", "schedule", "execution", "other")


def kind_of(text: str) -> str:
    """A kind as it is typed; an unknown one is 'other'."""
    return text.strip().lower() if text.strip().lower() in KINDS else "other"


#: Operative clauses: all but these kinds ('other' stays).
OPERATIVE = ("definition", "schedule", "recital", "execution")


def hydrate(ranked: DataFrame, clauses: DataFrame, documents: DataFrame, key: str = "clause_id") -> DataFrame:
    """Hits with the columns of their clause, of live documents."""
    live = documents.where(~F.coalesce("deleted", F.lit(False))).select("doc_id")
    return ranked.join(clauses.drop("source") if "source" in ranked.columns else clauses, key).join(live, "doc_id", "left_semi")


def rank_hits(fused: DataFrame, clauses: DataFrame, documents: DataFrame, limit: int, where: Column | None = None, key: str = "clause_id") -> DataFrame:
    """Cut per source, boost approved rows, filter after the cut, merge sources, cut to ``limit``."""
    top = cut(fused, [F.desc("score")], per_source(limit), key, "fused_rank").drop("fused_rank")
    hits = hydrate(top, clauses, documents, key)
    hits = hits.withColumn("score", F.when(F.coalesce("approved", F.lit(False)), F.col("score") * BOOST).otherwise(F.col("score")))
    if where is not None:
        hits = hits.where(where)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "source", key)
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def hybrid(queries: DataFrame, post: DataFrame, sizes: DataFrame, vectors: DataFrame, clauses: DataFrame, documents: DataFrame, limit: int = 10, where: Column | None = None, key: str = "clause_id") -> DataFrame:
    """Ranked hits of a batch of queries (query_id, query, embedding); an empty batch has none."""
    n = per_source(limit)
    # Queries of the same words have the same scores: each bag of words is scored once, for its least id.
    words = queries.select("query_id", F.array_sort(tokens(F.col("query"))).alias("words"))
    bags = words.groupBy("words").agg(F.min("query_id").alias("bag"))
    terms = bags.select(F.col("bag").alias("query_id"), F.explode("words").alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("weight"))
    text = cut(best_texts(post, materialise(terms), materialise(sizes), n, key), [F.desc("score")], n, key).withColumnRenamed("query_id", "bag")
    text = text.join(words.join(bags, "words").select("query_id", "bag"), "bag").drop("bag")
    near = cut(nearest(vectors, queries, n, key), [F.asc(F.round("distance", 9))], n, key)
    return rank_hits(fuse([text, near], key), clauses, documents, limit, where, key)


def expand(hits: DataFrame, edges: DataFrame, clauses: DataFrame, documents: DataFrame, limit: int, key: str = "clause_id") -> DataFrame:
    """Neighbours one edge away of the hits, that aren't hits themselves, once each, score 0, at most ``limit`` a query.

    Where hits have a source, their neighbours are looked for in it alone.
    """
    own = ["source"] if "source" in hits.columns else []
    near = hits.select("query_id", *own, F.col(key).alias("src_clause")).join(edges.select("src_clause", "dst_clause"), "src_clause").select("query_id", *own, F.col("dst_clause").alias(key)).distinct()
    if own:
        near = near.join(clauses.select(key, "source"), [key, "source"], "left_semi").drop("source").distinct()
    new = near.join(hits.select("query_id", key), ["query_id", key], "left_anti")
    full = hydrate(new, clauses, documents, key)
    w = W.partitionBy("query_id").orderBy(key)
    return full.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).withColumn("score", F.lit(0.0))
