"""Segmentation, trees, index, assembly, validation, rendering, prompts and streaming on small fixtures."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from clausemill.operators import assemble, index, paragraphs, prompt, registry, render, search, segment, tree, validate
from clausemill.sources import readers
from clausemill.streaming import watch


def paras(spark, *rows):
    return spark.createDataFrame([(1, i, t, h) for i, (t, h) in enumerate(rows)], "doc_id long, para_no int, text string, heading_level int")


def test_paragraphs(spark):
    f = lambda t: [r.text for r in paragraphs.from_text(spark.createDataFrame([(1, t)], "doc_id long, text string")).orderBy("para_no").collect()]
    assert f("1. One\n2. Two") == ["1. One", "2. Two"]
    assert f("A line that\nwraps on.\nNext") == ["A line that wraps on.", "Next"]
    assert f("HEADING\nbody of it") == ["HEADING", "body of it"]
    assert f("a\n\nb") == ["a", "b"]
    assert f(None) == [] and f("") == [] and f(" \n ") == []


def test_paragraphs_keep_every_line(spark):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choice(["the", "SHALL", "1.", "Schedule", "x;", '"q', ""]) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    out = paragraphs.from_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_no", "text"))), lambda x: x["text"]), " ").alias("t"))
    got = {r.doc_id: r.t.split() for r in out.collect()}
    for i, t in enumerate(texts):
        assert got.get(i, []) == t.split()


def test_html(spark):
    h = "<html><head><title>no</title></head><body><h2 class='x'>A &amp; B</h2><p>one<br>two</p><script>bad()</script>x&nbsp;y</body></html>"
    rows = paragraphs.from_html(spark.createDataFrame([(1, h)], "doc_id long, html string"), "doc_id", "html").orderBy("para_no").collect()
    assert [(r.text, r.heading_level) for r in rows] == [("A & B", 2), ("one", None), ("two", None), ("x y", None)]


def test_segmentation(spark):
    p = paras(spark, ("Service Agreement", None), ("between A and B", None), ("2. CONFIDENTIALITY OBLIGATIONS", None), ("Each party keeps it.", None), ("2.1 The receiver shall keep all of the information secret at all times.", None), ("SIGNATURE", None), ("Signed at X", None), ("Schedule 1", None), ("Prices", None))
    rows = segment.nodes(p).orderBy("seq").collect()
    assert [(r.kind, r.number, r.depth, r.heading) for r in rows] == [("recital", None, 0, None), ("clause", "2", 0, "CONFIDENTIALITY OBLIGATIONS"), ("clause", "2.1", 1, None), ("execution", None, 0, "SIGNATURE"), ("schedule", None, 0, "Schedule 1")]
    assert rows[1].body == "Each party keeps it." and rows[4].body == "Prices"


def _nodes_by_hand(rows):
    """A plain loop over the paragraphs."""
    import re

    out, sch, seen, section = [], False, False, "recital"
    for t, level in rows:
        n = re.match(r"^([0-9]{1,3}(?:\.[0-9]{1,3})*)[.)]?\s+(.+)$", t)
        is_s = bool(re.match(r"(?i)^(schedule|annexure|annex|appendix|exhibit)\b", t)) and len(t.encode()) <= 80
        n = None if is_s else n
        caps = len(t.encode()) <= 60 and any(c.isalpha() for c in t) and not any(c.isalpha() and not c.isupper() for c in t)
        is_u = not is_s and not n and ((level is not None and len(t.encode()) <= 120) or caps)
        sch, seen = sch or is_s, seen or bool(n)
        like = n and len(n[2].encode()) <= 90 and n[2][-1] not in ".;:," and len(n[2].split()) <= 10
        h = t if is_s or is_u else n[2] if like else None
        low = (h or "").lower()
        nk = "schedule" if sch else "execution" if any(w in low for w in ("signature", "signed", "execution")) else "recital" if any(w in low for w in ("recital", "preamble", "introduction", "whereas", "background")) or not seen else "clause"
        d = n[1].count(".") if n else 0
        if is_s:
            section = "schedule"
        elif is_u or (n and (h is not None or d == 0)):
            section = nk
        if is_s or n or is_u:
            out.append([section, n[1] if n else None, d, h, [n[2]] if n and h is None else []])
        else:
            if not out:
                out.append(["recital", None, 0, None, []])
            out[-1][4].append(t)
    return [(k, n, d, h, "\n".join(b)) for k, n, d, h, b in out if h is not None or "\n".join(b).strip()]


def test_segmentation_random(spark):
    rng = random.Random(5)
    pool = ["1. Term", "1.1 The tenant shall pay the rent in advance.", "2 Payment;", "BACKGROUND", "SIGNATURE", "Schedule A", "plain words here", "10.2.3 Deep", "WHEREAS it is so", "Annexure about a thing"]
    docs = [[(rng.choice(pool), rng.choice([None, None, None, 1])) for _ in range(rng.randint(1, 12))] for _ in range(80)]
    df = spark.createDataFrame([(d, i, t, h) for d, rows in enumerate(docs) for i, (t, h) in enumerate(rows)], "doc_id long, para_no int, text string, heading_level int")
    got = {}
    for r in segment.nodes(df).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.number, r.depth, r.heading, r.body))
    for d, rows in enumerate(docs):
        assert got.get(d, []) == _nodes_by_hand(rows)


def test_definitions_and_titles(spark):
    p = paras(spark, ("x", None), ("LEASE AGREEMENT", None), ("1. Definitions", None), ('“Effective Date” means the day. "Fee" shall mean money.', None))
    rows = segment.objects(p).where("kind = 'definition'").orderBy("ord").collect()
    assert [r.term for r in rows] == ["Effective Date", "Fee"] and rows[0].body.startswith("“Effective Date” means")
    assert segment.titles(p).first().title == "Lease Agreement"


def test_tree(spark):
    rng = random.Random(1)
    depths = [[rng.randint(0, 3) for _ in range(rng.randint(1, 15))] for _ in range(60)]
    df = spark.createDataFrame([(d, i, i, x, str(x)) for d, xs in enumerate(depths) for i, x in enumerate(xs)], "doc_id long, seq int, ord int, depth int, number string")
    got = {}
    for r in tree.numbered(tree.effective_depth(df)).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.new_number)
    for d, xs in enumerate(depths):
        stack, want = [], []
        for x in xs:
            e = min(x, len(stack))
            stack = stack[: e + 1]
            stack = [*stack[:e], stack[e] + 1] if len(stack) > e else [*stack, 1]
            want.append(".".join(map(str, stack)))
        assert got[d] == want


def test_edges_and_diff(spark):
    c = spark.createDataFrame([(1, 1, "clause", "the Services shall", None), (2, 1, "definition", '"Service" means', "Service"), (3, 2, "clause", "the Service", None), (4, 1, "clause", None, None), (5, 1, "definition", "x", "ab")], "clause_id long, doc_id long, kind string, body string, term string")
    assert [(r.src_clause, r.dst_clause) for r in index.uses_term(c).collect()] == [(1, 2)]
    a = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2"), ("s", "c", None)], "source string, rel_path string, content_hash string")
    b = spark.createDataFrame([("s", "b", "9"), ("s", "c", None), ("s", "d", "4")], a.schema)
    assert {(r.rel_path, r.outcome) for r in index.scan_diff(a, b).collect()} == {("a", "new"), ("b", "changed"), ("c", "unchanged"), ("d", "removed")}
    assert index.scan_diff(a.limit(0), b.limit(0)).count() == 0


def test_search_round_trip(spark):
    c = spark.createDataFrame([(i, i, "s", "p", "clause", str(i), i, 0, h, None, b, None, None, None, i == 3) for i, (h, b) in enumerate([("Termination", "either party may terminate"), ("Payment", "fees are due"), (None, "governing law of the place"), ("Payment", "payment of fees")])], "clause_id long, doc_id long, source string, rel_path string, kind string, number string, seq int, depth int, heading string, term string, body string, clause_type string, contract_type string, jurisdiction string, approved boolean")
    docs = c.select("doc_id", F.lit(False).alias("deleted"))
    post = index.postings(c)
    sizes = index.sizes(c)
    q = spark.createDataFrame([(1, "payment fees"), (2, "!?")], "query_id long, query string")
    top = search.cut(search.bm25(post, search.query_tokens(q), sizes), [F.desc("score")], 2).collect()
    assert {r.query_id for r in top} == {1} and {r.clause_id for r in top} == {1, 3}
    vec = index.embed(c.select("clause_id", "body"), "clause_id", "body").join(c.select("clause_id", "source"), "clause_id")
    qv = q.join(index.embed(q, "query_id", "query"), "query_id")
    hits = search.hybrid(qv, post, sizes, vec, c, docs, 2).where("query_id = 1").orderBy("place").collect()
    assert hits[0].clause_id == 3
    assert search.hybrid(qv, post, sizes, vec, c, docs, 2, search.filters(clause_type="Payment")).count() == 0
    edges = spark.createDataFrame([(3, "uses_term", 2), (3, "uses_term", 1)], "src_clause long, relation string, dst_clause long")
    assert [r.clause_id for r in search.expand(spark.createDataFrame([(1, 3), (1, 1)], "query_id long, clause_id long"), edges, c, docs, 5).collect()] == [2]


def test_rules():
    assert assemble.required("non-disclosure agreement")[0] == "Definitions" and assemble.required("Charter") == []
    assert assemble.order_index("Charter", "Payment") == 1 and assemble.order_index("Charter", "Hats") == 18
    assert assemble.insert_gaps(["Definitions", "Notices"], ["Breach", "Payment"], "Lease Agreement") == [("Breach", 1), ("Payment", 1)]
    assert assemble.conflicts(["Payment", "Notices"]) == []
    s = assemble.Spec.from_json('{"contract_type": "Lease", "parties": [{"name": "A", "role": "Lessor"}, {"name": "B", "role": "Lessee"}], "language": null}')
    assert s.language == "English" and assemble.synthetic_recital(s).startswith('This Lease is entered into between **A** (the "Lessor") and **B**')


def test_draft_and_findings(spark):
    cols = "clause_id long, doc_id long, kind string, number string, seq int, depth int, heading string, term string, body string, clause_type string"
    c = spark.createDataFrame(
        [(1, 1, "clause", "4", 0, 0, "PAYMENT", None, "Fee of {{fee}} under clause 9 and clause 5.", None), (2, 1, "clause", "5", 1, 0, None, None, "Beta Inc pays {{who}}.", None), (3, 1, "clause", "5.1", 2, 1, "X", None, "", None), (4, 1, "definition", None, 3, 0, None, "Fee", "m", None), (5, 1, "definition", None, 3, 0, None, "Idle", "m", None)], cols
    )
    rows = assemble.draft_rows(c, F.create_map(F.lit("fee"), F.lit("R5")))
    got = {r.clause_id: (r.new_number, r.new_heading, r.new_body) for r in rows.collect()}
    assert got == {1: ("1", "Payment", "Fee of R5 under clause 9 and clause 2."), 2: ("2", "", "Beta Inc pays {{who}}."), 3: ("2.1", "X", "")}
    v = rows.withColumn("body", F.col("new_body"))
    assert {r.detail for r in validate.unresolved(v).collect()} == {"who"}
    assert {r.detail for r in validate.dangling(v).collect()} == {"9"}
    assert validate.empty_clauses(v).count() == 1 and validate.numbering(v).count() == 3
    used, unused = validate.terms(v, c.where("kind = 'definition'"))
    assert {r.term for r in used.collect()} == {"Fee"} and unused.count() == 1
    texts = c.select("doc_id", F.col("seq").alias("place"), F.lit("l").alias("location"), F.col("body").alias("text"))
    names = lambda p: {r.detail for r in validate.foreign_parties(texts, spark.createDataFrame([(1, p)], "doc_id long, name string")).collect()}
    assert names("Alpha Ltd") == {"Beta Inc"} and names("beta inc (2)") == set()
    docs = spark.createDataFrame([(1, None, "Lease", "Here")], "doc_id long, title string, contract_type string, jurisdiction string")
    md = render.markdown(rows, docs)
    text = md.first().markdown
    assert text.startswith("# Lease\n\n## 1. Payment\n\nFee of R5") and "2 Beta Inc pays {{who}}." in text and text.endswith("_Governing law: Here._\n")
    data = bytes(render.docx(md).first().docx)
    assert [p[0] for p in readers.docx_paragraphs(data)][0] == "Lease"
    assert render.Donor.from_docx(data).usable is False


def test_xml():
    p = '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="7"/></w:numPr></w:pPr><w:hyperlink r:id="1"><w:r><w:t>clause 3</w:t></w:r></w:hyperlink><w:r><w:fldChar/></w:r><w:drawing>x</w:drawing></w:p>'
    out = render.sanitise(p)
    assert "numPr" not in out and "hyperlink" not in out and "fldChar" not in out and "drawing" not in out and "clause 3" in out
    assert "numPr" in render.sanitise(p, {"7"})
    assert "<w:t>clause 8</w:t>" in render.rewrite_ooxml(p, {"3": "8"})
    assert readers.docx_paragraphs(b"no zip") is None


def test_schedules(spark):
    s = spark.createDataFrame([(1, 1, "schedule", 0, "Schedule A", "x"), (2, 1, "schedule", 1, None, "y"), (3, 2, "schedule", 0, None, None)], "clause_id long, doc_id long, kind string, seq int, heading string, body string")
    assert {(r.doc_id, r.title, r.body) for r in tree.fold_schedules(s).collect()} == {(1, "Schedule A", "x\ny"), (2, "Schedule 1", "")}


def test_registry(spark):
    s = spark.createDataFrame([("B", True), ("A", False)], "name string, attached boolean")
    assert [r.name for r in registry.attached(registry.set_attached(s, "A", True)).collect()] == ["A", "B"]
    assert [r.name for r in registry.attached(s, ["b"]).collect()] == ["B"]
    with pytest.raises(ValueError):
        registry.add_source(s, s.limit(1))
    k = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert {tuple(r) for r in registry.put_settings(k, spark.createDataFrame([("b", "3")], k.schema)).collect()} == {("a", "1"), ("b", "3")}


def test_prompts():
    r = prompt.Echo('```json\n{"body": [{"type": "paragraph", "runs": [{"text": "hi"}]}]}\n```').complete(prompt.ask("q", "[1] x"))
    assert prompt.plain_text(prompt.parse_blocks(r.text)[0]) == "hi"
    for bad in ("prose", "[]", '[{"type": "paragraph", "runs": [{"text": " "}]}]', '[{"type": "variable", "name": ""}]', '[{"type": "x"}]'):
        with pytest.raises(ValueError):
            prompt.parse_blocks(bad)
    assert "Keep" in prompt.adapt("h", "b", "i", [], ["Keep"]).messages[1]["content"] and prompt.explain("h", "b").max_tokens == 1024


def test_folder_and_watch(spark, tmp_path):
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    (src / "a b.txt").write_text("TITLE\nBody here.")
    (src / "sub" / "p.HTML").write_text("<h1>H</h1><p>x</p>")
    (src / "n.bin").write_bytes(b"\x00")
    with zipfile.ZipFile(src / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:body><w:p><w:pPr><w:pStyle w:val="Heading 2"/></w:pPr><w:r><w:t>Word</w:t></w:r></w:p></w:body></w:document>')
    files = readers.scan(spark, str(src), "S")
    assert {r.rel_path for r in files.collect()} == {"a b.txt", "sub/p.HTML", "d.docx"}
    rows = {(r.rel_path, r.text, r.heading_level) for r in readers.parse(files).collect()}
    assert rows == {("a b.txt", "TITLE", None), ("a b.txt", "Body here.", None), ("sub/p.HTML", "H", 1), ("sub/p.HTML", "x", None), ("d.docx", "Word", 2)}
    seen = []
    q = watch.watch(spark, str(src), str(tmp_path / "state"), lambda df, n: seen.extend(r.path for r in df.collect()), once=True)
    q.awaitTermination()
    assert len(seen) == 4
    live = files.select("source", "rel_path", "content_hash", F.lit(False).alias("deleted")).where("rel_path != 'd.docx'")
    assert {r.outcome for r in watch.rescan(spark, str(src), "S", live).collect()} == {"unchanged", "new"}
