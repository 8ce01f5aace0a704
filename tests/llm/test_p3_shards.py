"""p3 gives the same however the list is divided."""

from clausemill.llm import p3_canonical as p3


def test_shards_change_nothing(spark):
    names = ["Sale and Lease", "Lease and Sale", "Power of Attorney", "Point of Access", "Confidential Information", "Confidence Information", "Governing Law", "Notice Period", "Sale, Lease"]
    canon = spark.createDataFrame([(i + 1, "clause_type", n, None) for i, n in enumerate(names)], "label_id int, kind string, label string, aliases string")
    values = ["Lease / Sale", "sale lease", "P.O.A.", "POA", "Conf. Inf.", "Confid. Info.", "Gov. Law", "Goverming Law", "Period Notice", "Notice Perod", "zzzzzz", "G.L."]
    v = spark.createDataFrame([("clause_type", x) for x in values] + [("other", "x")], "kind string, value string")
    rows = lambda **k: {(r.kind, r.value): (r.label_id, r.step, r.edits) for r in p3.resolve(v, canon, **k).collect()}
    want = rows()
    assert len(want) == 13 and want["clause_type", "POA"][1] not in (1, 2, 3)
    for shard in (1, 2, 4):
        assert rows(shard=shard) == want
