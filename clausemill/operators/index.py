"""Index tables: postings, hashed vectors, edges, and what a scan changes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausemill.functions.text import tokens
from clausemill.session import width


def latest(rows: DataFrame, key: str, by: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per key, the last by ``by``; max_by aggregates before the shuffle.

    Only ``columns`` (all if none are named) are read and shuffled: a plan can't prune a struct by itself.
    What follows is dear a row (patterns over texts), so adaptive execution mustn't join the parts by their bytes.
    """
    others = [c for c in columns or rows.columns if c != key]
    rows = rows.select(key, *dict.fromkeys([*others, by])).repartition(width(rows.sparkSession), key)
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(by)).alias("r")).select(key, "r.*")


def postings(rows: DataFrame, key: str = "clause_id", source: str = "source", first: str = "heading", second: str = "body") -> DataFrame:
    """(``source``, ``key``, token, tf_heading, tf_body, len): one row a text and token; len counts all tokens of the row."""
    t = rows.select(source, key, tokens(F.coalesce(F.col(first), F.lit(""))).alias("a"), tokens(F.coalesce(F.col(second), F.lit(""))).alias("b"))
    t = t.withColumn("len", F.size("a") + F.size("b"))
    both = F.concat(F.transform("a", lambda x: F.struct(x.alias("token"), F.lit(1).alias("h"))), F.transform("b", lambda x: F.struct(x.alias("token"), F.lit(0).alias("h"))))
    e = t.select(source, key, "len", F.inline(both))
    return e.groupBy(source, key, "token").agg(F.sum("h").alias("tf_heading"), F.sum(1 - F.col("h")).alias("tf_body"), F.first("len").alias("len"))


def sizes(rows: DataFrame, key: str = "clause_id", source: str = "source", first: str = "heading", second: str = "body") -> DataFrame:
    """(``source``, ``key``, len): tokens of each row that has any; no shuffle."""
    n = F.size(tokens(F.coalesce(F.col(first), F.lit("")))) + F.size(tokens(F.coalesce(F.col(second), F.lit(""))))
    return rows.select(source, key, n.alias("len")).where("len > 0")


FNV_START, FNV_PRIME = np.uint64(14695981039346656037), np.uint64(1099511628211)


def _fnv(words: list[bytes]) -> np.ndarray:
    """FNV-1a of many words, one column of bytes at a time."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    start = np.cumsum(size) - size
    h = np.full(len(words), FNV_START, dtype=np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        live = np.flatnonzero(size > k)
        h[live] = (h[live] ^ flat[start[live] + k]) * FNV_PRIME
    return h


def hash_embed(texts: list[str | None], dims: int = 256) -> np.ndarray:
    """Unit vectors of hashed words (weight 1) and letter trigrams of words over three letters (weight 0.5)."""
    out = np.zeros((len(texts), dims), dtype=np.float64)
    known: dict[str, int] = {}
    rows, cols, weights = [], [], []
    for i, t in enumerate(texts):
        for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split():
            rows.append(i)
            cols.append(known.setdefault(w, len(known)))
            weights.append(1.0)
            if len(w) > 3:
                for k in range(len(w) - 2):
                    rows.append(i)
                    cols.append(known.setdefault(w[k : k + 3], len(known)))
                    weights.append(0.5)
    if known:
        h = _fnv([w.encode() for w in known])
        bucket, sign = (h % np.uint64(dims)).astype(np.int64), np.where((h >> np.uint64(32)) & np.uint64(1), -1.0, 1.0)
        c = np.array(cols)
        np.add.at(out, (np.array(rows), bucket[c]), np.array(weights) * sign[c])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)


def embed(rows: DataFrame, key: str, text: str, dims: int = 256, make=None) -> DataFrame:
    """(``key``, embedding): embedding of each text by ``make`` (the hashed one if none is given: zeros for a null or empty text)."""
    make = make or (lambda texts: hash_embed(texts, dims))

    def run(batches):
        for batch in batches:
            v = make(batch.column(1).to_pylist()).astype(np.float32)
            offsets = np.arange(0, (len(v) + 1) * dims, dims, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.ravel()))], names=[key, "embedding"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, embedding array<float>")


def uses_term(clauses: DataFrame) -> DataFrame:
    """(src_clause, relation, dst_clause): a body holds a term (three bytes or more) defined in the same document."""
    body = clauses.where("kind != 'definition'").select("doc_id", F.col("clause_id").alias("src_clause"), "body")
    term = clauses.where("kind = 'definition' and octet_length(term) >= 3").select("doc_id", F.col("clause_id").alias("dst_clause"), "term")
    hit = body.join(term, "doc_id").where(F.col("body").contains(F.col("term")) & (F.col("src_clause") != F.col("dst_clause")))
    return hit.select("src_clause", F.lit("uses_term").alias("relation"), "dst_clause").dropDuplicates()


def scan_diff(listing: DataFrame, index: DataFrame, keys=("source", "rel_path"), digest: str = "content_hash") -> DataFrame:
    """(keys, outcome): new, changed, unchanged or removed, of a listing against the live index."""
    a, b = listing.select(*keys, F.col(digest).alias("now")).withColumn("here", F.lit(True)), index.select(*keys, F.col(digest).alias("then")).withColumn("there", F.lit(True))
    outcome = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "removed").when(F.col("now").eqNullSafe(F.col("then")), "unchanged").otherwise("changed")
    return a.join(b, list(keys), "full_outer").select(*keys, outcome.alias("outcome"))


def upsert(index: DataFrame, rows: DataFrame, keys=("source", "rel_path")) -> DataFrame:
    """The index with the rows of the same keys replaced (semi-joined, never collected)."""
    return index.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows)


def tombstone(index: DataFrame, gone: DataFrame, keys=("source", "rel_path")) -> DataFrame:
    """The index with ``deleted`` set where the keys are gone."""
    mark = gone.select(*keys).distinct().withColumn("__gone", F.lit(True))
    return index.join(mark, list(keys), "left").withColumn("deleted", F.coalesce("__gone", "deleted")).drop("__gone").select(*index.columns)


def drop_edges(edges: DataFrame, clauses: DataFrame) -> DataFrame:
    """Edges neither end of which is one of ``clauses``."""
    ids = clauses.select("clause_id").distinct()
    return edges.join(ids.withColumnRenamed("clause_id", "src_clause"), "src_clause", "left_anti").join(ids.withColumnRenamed("clause_id", "dst_clause"), "dst_clause", "left_anti").select(*edges.columns)


def order_in(rows: DataFrame, by: list, *order) -> DataFrame:
    return rows.withColumn("ord", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)
