"""p1 gives the same beyond the bound of its broadcasts."""

from clausemill.llm import p1_scan_noise as p1


def test_bound_changes_nothing(spark, data):
    rec = p1.records_of(spark, data)
    rows = lambda df: sorted((r.rec_table, r.rec_id, sorted(r.noise), r.text or "") for r in df.collect())
    want = rows(p1.clean(rec))
    assert any(r[2] for r in want)
    assert rows(p1.clean(rec, most=40)) == want
    assert rows(p1.clean(rec, most=40, texts=False)) == [(a, b, n, "") for a, b, n, _ in want if n]
