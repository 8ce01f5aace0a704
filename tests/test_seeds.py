"""Searches over every seed, and the sharded searches against the plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from clausemill import catalogue
from clausemill.operators import index, search


@pytest.mark.parametrize("name", ["hybrid_search", "approved_boost_filter", "prompt_extracts"])
def test_seeds_give_rows(spark, data, name):
    assert "clause_id % 50 = 0" in catalogue.oracle_sql()[name]
    assert catalogue.queries()[name](spark, data).count() > 0


def test_best_texts_equals_bm25(spark):
    rng = random.Random(5)
    words = "rent lease timber the of deposit notice liability".split()
    rows = [(f"s{i % 2}", i, rng.choice([None, "", "Lease of timber", "Deposit"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(90)]
    rows += [(f"s{i % 2}", i, "Lease", "rent the rent") for i in range(200, 240)]  # ties
    c = spark.createDataFrame(rows, "source string, clause_id long, heading string, body string")
    q = spark.createDataFrame([(1, "rent"), (2, "the lease of timber"), (3, "deposit deposit notice"), (4, "?!"), (5, "unknown")], "query_id long, query string")
    post, sizes, terms = index.postings(c), index.sizes(c), search.query_tokens(q)
    first = lambda df: sorted((r.query_id, r.source, r.clause_id, r.rank, round(r.score, 9)) for r in search.cut(df, [F.desc("score")], 4).collect())
    want = first(search.bm25(post, terms, sizes).withColumn("score", F.round("score", 12)))
    assert want
    for shard, block in ((200_000, 20_000), (10, 2)):
        assert first(search.best_texts(post, terms, sizes, 4, shard=shard, block=block)) == want
    assert search.best_texts(post, terms.limit(0), sizes, 4).count() == 0 and search.best_texts(post.limit(0), terms, sizes.limit(0), 4).count() == 0


def test_nearest_equals_knn(spark):
    rows = [(f"s{i % 2}", i, [float(i // 3 % 7), float(i % 5)]) for i in range(120)] + [("s0", 900, [1.0]), ("s1", 901, None)]
    v = spark.createDataFrame(rows, "source string, clause_id long, embedding array<float>")
    q = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(9)] + [(50, [3.0]), (51, None)], "query_id long, embedding array<float>")
    first = lambda df: sorted(tuple(r) for r in search.cut(df, ["distance"], 4).select("query_id", "source", "clause_id", "distance", "rank").collect())
    want = first(search.knn(v, q))
    assert len(want) == 9 * 2 * 4 + 1
    for block in (3, 1000):
        assert first(search.nearest(v, q, 4, block=block)) == want
    assert search.nearest(v, q.limit(0), 4).count() == 0
