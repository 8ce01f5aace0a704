"""Text functions and labels on single values."""

from pyspark.sql import functions as F

from clausemill.functions import text as X
from clausemill.operators import index, label


def one(spark, expr, **values):
    cols = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], cols).select(expr.alias("x")).first().x


def test_clause_types(spark):
    f = lambda h, b="": one(spark, label.clause_type(F.col("h"), F.col("b")), h=h, b=b)
    assert f("12. TERMINATION") == "Termination"
    assert f("Non-Disclosure and Secrecy") == "Confidentiality"
    assert f("Duration", "may be terminated on notice") == "Duration"
    assert f("OFF-HIRE AND BUNKERS") == "Off-Hire and Bunkers"
    assert f("", "This agreement is governed by the laws of X") == "Governing Law"
    assert f(None, None) is None
    assert f("  ", "nothing of note") is None


def test_contract_types(spark):
    f = lambda n, t="": one(spark, label.contract_type(F.col("n"), F.col("t")), n=n, t=t)
    assert f("NDA Agreement.txt") == "Non-Disclosure Agreement"
    assert f("x.docx", "TIME CHARTERPARTY\nbetween A and B") == "Time Charterparty"
    assert f("agenda.docx", "Minutes") is None
    assert f("service_agreement_v2.docx") == "Service Agreement"


def test_phrase_bounds(spark):
    f = lambda h, n: one(spark, X.contains_phrase(X.phrase_norm(F.col("h")), n), h=h)
    assert f("Agenda of the meeting", "nda") is False
    assert f("the NDA, signed", "nda") is True
    assert f("indemnification", "indemnif") is True


def test_references(spark):
    m = F.create_map(F.lit("3"), F.lit("7"), F.lit("3.1"), F.lit("7.2"))
    assert one(spark, X.rewrite_refs(F.col("t"), m), t="see clause 3.1, clauses 3 and 9, Clause 9") == "see clause 7.2, clauses 7 and 9, Clause 9"
    assert one(spark, X.cross_refs(F.col("t")), t="clause 9; clause 10; clause 9") == ["10", "9"]
    assert one(spark, X.rewrite_refs(F.col("t"), m), t=None) is None


def test_variables(spark):
    m = F.create_map(F.lit("fee"), F.lit("R5"))
    assert one(spark, X.substitute(F.col("t"), m), t="{{fee}} or {{fee|Fee}} or {{other}}") == "R5 or R5 or {{other}}"
    assert one(spark, X.placeholders(F.col("t")), t="{{ a | b }} {{}} {{x y}}") == ["a", "x y"]


def test_title_similarity(spark):
    f = lambda a, b: one(spark, X.title_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert f("Service Level Agreement", "Service Agreement") == 1.0
    assert f("Lease Agreement", "Service Agreement") == 0.5
    assert f(None, "x") == 0.0


def test_small_helpers(spark):
    assert one(spark, X.squash(F.col("t")), t=" a \t b\n") == "a b"
    assert one(spark, X.slug(F.col("t"), "party-1"), t="Alpha & Beta (Pty) Ltd") == "alpha-beta-pty-ltd"
    assert one(spark, X.slug(F.col("t"), "party-1"), t="!!") == "party-1"
    assert one(spark, X.snippet_bytes(F.col("t"), 4), t="aéé") == "aé…"
    assert one(spark, X.strip_fences(F.col("t")), t="```json\n[1]\n```") == "[1]"
    assert one(spark, X.xml_escape(F.col("t")), t='<a> & "b"') == "&lt;a&gt; &amp; &quot;b&quot;"
    assert one(spark, X.tokens(F.col("t")), t="Café 12, X") == ["cafe", "12", "x"]


def test_hash_matches_bytes(spark):
    for word in ("notice", "é", ""):
        h = 14695981039346656037
        for b in word.encode():
            h = (h ^ b) * 1099511628211 % 2**64
        assert int(one(spark, X.fnv1a64(F.col("t")), t=word)) == h
        assert int(index._fnv([word.encode()])[0]) == h


def test_embedding(spark):
    v = index.hash_embed(["termination of the contract", "terminating contracts", "bananas and pears", "", None])
    assert abs((v[0] ** 2).sum() - 1) < 1e-5 and v[0] @ v[1] > v[0] @ v[2] and not v[3].any() and not v[4].any()
