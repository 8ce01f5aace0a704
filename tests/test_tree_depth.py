"""Numbers of trees deeper than four levels."""

import random

from pyspark.sql import functions as F

from clausemill.operators import assemble, tree


def test_deep_trees(spark):
    rng = random.Random(2)
    depths = [list(range(12)) + [5, 4, 9], *([rng.randint(0, 9) for _ in range(40)] for _ in range(20))]
    df = spark.createDataFrame([(d, i, i, x) for d, xs in enumerate(depths) for i, x in enumerate(xs)], "doc_id long, seq int, ord int, depth int")
    got = {}
    for r in tree.numbered(tree.effective_depth(df)).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.new_number)
    for d, xs in enumerate(depths):
        stack, want = [], []
        for x in xs:
            e = min(x, len(stack))
            stack = [*stack[:e], stack[e] + 1] if len(stack) > e else [*stack, 1]
            want.append(".".join(map(str, stack)))
        assert got[d] == want
    assert tree.numbered(tree.effective_depth(df.limit(0))).count() == 0


def test_deep_references(spark):
    c = spark.createDataFrame([(i, 1, i, i, "clause", n, "see clause 1.1.1.1.1 and clause 1.1.1.2") for i, n in enumerate(["1", "1.1", "1.1.1", "1.1.1.1", "1.1.1.1.1", "1.1.1.2"])], "clause_id long, doc_id long, seq int, n int, kind string, number string, body string")
    c = c.withColumn("depth", F.size(F.split("number", r"\.")) - 1).withColumn("heading", F.lit(None).cast("string"))
    rows = assemble.draft_rows(c, F.create_map().cast("map<string,string>")).orderBy("pos").collect()
    assert [r.new_number for r in rows] == [r.number for r in rows]
    assert {r.new_body for r in rows} == {"see clause 1.1.1.1.1 and clause 1.1.1.2"}
