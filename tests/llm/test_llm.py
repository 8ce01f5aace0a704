"""The training-data operators on small fixtures, against brute force."""

import random
import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill import llm
from clausemill.llm import p1_scan_noise as p1
from clausemill.llm import p2_near_records as p2
from clausemill.llm import p3_canonical as p3
from clausemill.llm import p4_history as p4
from clausemill.llm import p5_neighbours as p5
from clausemill.llm import p6_tokens as p6
from clausemill.llm import p7_leaks as p7
from clausemill.llm import p8_truncation as p8
from clausemill.llm import shingles

WORDS = "the vendor shall keep pay deliver timber steel boxes within forty days of notice and audit every second lease unless renewed".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_every_query_runs(spark, data, name):
    df = llm.queries()[name](spark, data)
    rows = df.collect()
    assert len(rows) == len({str(r) for r in rows})  # no row twice


def test_queries_match_sql(spark, data):
    from compare import same

    for name, sql in llm.oracle_sql().items():
        same(spark, llm.queries()[name], sql, data)


# --- shingles ---------------------------------------------------------------------------------


def test_shingle_sets():
    rng = random.Random(1)
    texts = [text(rng, rng.randint(0, 30)) for _ in range(50)] + ["", "É x", "a\0b c-d  9", "x" * 5000]
    s, where, n = shingles.shingle_sets(texts, 3)
    for i, t in enumerate(texts):
        w = re.findall("[a-z0-9]+", t.lower())
        assert n[i] == len(w) and (where == i).sum() == len({tuple(w[k : k + 3]) for k in range(len(w) - 2)})
    assert [x for x in shingles.slices(["aa"] * 5, 6, 9)] == [(0, 2), (2, 4), (4, 5)]


# --- p1 ---------------------------------------------------------------------------------------


def records(spark, rows):
    return spark.createDataFrame([("paragraph", i, *r) for i, r in enumerate(rows)], "rec_table string, rec_id long, doc_id long, name string, para_no int, text string")


def test_scan_noise(spark):
    name = "x/Alpha Timber and Beta Foods - Office Lease 2010-01-01.pdf"
    body = "The vendor shall keep the timber within forty days of request."
    rows = [(9, "other.pdf", i + 1, body) for i in range(60)]
    rows += [
        (1, name, 0, "Office Lease for Alpha Timber and Beta Foods"),
        (1, name, 1, "The vendor shall kccp the tim-\nber\nOffice Lease — Alpha Timber\n- 3 -\nwithin forty days of requ- est."),
        (1, name, 2, "Office Lease — A1pha Timber    p. 1 of 4"),
        (1, name, 3, "12"),
        (1, name, 4, "in long- or short-term storage within\nforty days"),
        (1, name, 5, None),
        (1, name, 6, ""),
        (1, name, 7, "3. TERM AND RENEWAL"),
    ]
    got = {r.rec_id - 60: (set(r.noise), r.text) for r in p1.clean(records(spark, rows)).where("rec_id >= 60").collect()}
    assert got[0] == (set(), "Office Lease for Alpha Timber and Beta Foods")
    assert got[1] == ({"glyph", "hyphen", "header", "pageno"}, body)
    assert got[2] == ({"header", "pageno", "glyph"}, "") and got[3] == ({"pageno"}, "")
    assert got[4][0] == set() and got[5] == (set(), None) and got[6] == (set(), "") and got[7][0] == set()
    assert {r.rec_id - 60: set(r.noise) for r in p1.clean(records(spark, rows), texts=False).collect()} == {k: v for k, (v, _) in got.items() if v}
    assert p1.clean(records(spark, rows).limit(0)).count() == 0


def test_headers_learned(spark):
    """What headers carry beside names comes from the lines of many files; nothing of it is given."""
    rows, rng = [], random.Random(3)
    for d in range(8):
        name = f"x/Lease {'Alpha Beta Gamma Delta Omega Sigma Kappa Theta'.split()[d]}town.pdf"
        head = f"{name[2:-4]} zum Gebrauch"  # 'zum Gebrauch' stands in no list
        rows += [(d, name, 0, "A title"), (d, name, 1, f"The vendor shall keep the timber\n{head}\nwithin forty days."), (d, name, 2, head), (d, name, 3, "The vendor pays the\nlease for the term."), (d, name, 4, f"The vendor shall keep {head} the timber.")]
    rows += [(99, "x/none.pdf", 1, "The vendor zum\nlease"), (None, None, 1, "Lease Gebrauch\nand more"), (99, "x/none.pdf", 2, "x" * 9000)]
    rng.shuffle(rows)
    df = records(spark, rows)
    words, small, pairs = p1.furniture(p1.edge_lines(df.withColumn("rec", F.col("rec_id"))))
    assert (words, small, pairs) == (["gebrauch", "zum"], ["zum"], ["zum gebrauch"])
    got = {r.rec_id: r for r in p1.clean(df).collect()}
    for i, (d, _, no, _) in enumerate(rows):
        assert ("header" in got[i].noise) == (d is not None and d < 90 and no in (1, 2, 4)), rows[i]
    assert {got[i].text for i, r in enumerate(rows) if r[0] in range(8) and r[2] == 4} == {"The vendor shall keep the timber."}
    assert p1.furniture(p1.edge_lines(df.limit(0).withColumn("rec", F.col("rec_id")))) == ([], [], [])
    assert re.fullmatch(p1.loose("file copy"), "fi1e  c0py") and not re.fullmatch(p1.loose("file copy"), "film copy")


def test_anagram_hash_is_additive(spark):
    df = spark.createDataFrame([("rnat", "mat"), ("born", "bom")], "a string, b string")
    d = {r.d for r in df.select((p1.anagram_hash(F.col("a")) - p1.anagram_hash(F.col("b"))).alias("d")).collect()}
    assert len(d) == 1
    c = spark.createDataFrame([("kccp", 2), ("keep", 900), ("bom", 3), ("born", 4)], "word string, n long")
    assert [(r.word, r.good) for r in p1.corrections(c).collect()] == [("kccp", "keep")]


# --- p2 ---------------------------------------------------------------------------------------


def brute_pairs(rows, floor, width, least):
    sets = {}
    for i, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if len(w) >= least:
            sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] | sets[b] and len(sets[a] & sets[b]) >= floor * len(sets[a] | sets[b])}


@pytest.mark.parametrize("hot", [50_000, 3, -1])
@pytest.mark.parametrize(("floor", "width"), [(0.6, 3), (0.8, 5)])
def test_near_records(spark, hot, floor, width):
    rng = random.Random(7)
    rows, i = [], 0
    for _ in range(25):
        base = text(rng, rng.randint(6, 60)).split()
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = [rng.choice(WORDS)]
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(300 + k, rows[5][1].upper() + "!") for k in range(7)] + [(320 + k, "one two") for k in range(3)]  # copies
    rows += [(1000, None), (1001, ""), (1002, "one two"), (3, rows[3][1])]  # repeated row
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], "clause_id long, body string, id string")
    got = {(r.a, r.b) for r in p2.alike(df, "clause_id", F.col("body"), floor, width, 5, hot).collect()}
    want = brute_pairs(dict(rows).items(), floor, width, 5)
    assert got == want
    own = {r.id: r for r in p2.classes(df, "clause_id", F.col("body"), floor, width, 5, hot).collect()}
    assert set(own) == {i for i, t in rows if t is not None}
    assert {i: r.links for i, r in own.items()} == {i: sum(i in p for p in want) for i in own}


def test_near_records_empty(spark):
    assert p2.alike(spark.createDataFrame([], "k long, t string"), "k", F.col("t")).count() == 0


def test_bounds_are_exact():
    b = p2.Bounds(0.6)
    for n in range(1, 60):
        for m in range(n, 100):
            c = next(c for c in range(n + m + 1) if 5 * c >= 3 * (n + m - c))
            assert b.common(n + m) == c
    assert b.largest(6) == 10 and b.probe(10) == 5


# --- p3 ---------------------------------------------------------------------------------------


def test_distance_and_tree():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        return row[-1]

    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(120)]
    for _ in range(300):
        a, b = rng.choice(words), rng.choice(words)
        assert p3.distance(a, b) == slow(a, b)
    tree = p3.BKTree(words)
    for q in words[:20]:
        for k in (0, 1, 3):
            assert {w for _, w in tree.within(q, k)} == {w for w in set(words) if p3.distance(q, w) <= k}


def test_canonical(spark):
    canon = spark.createDataFrame([(1, "t", "Term and Renewal", "duration; commencement"), (2, "t", "Limitation of Liability", None), (3, "t", "Anti-Corruption", "bribery"), (None, "t", "x", None), (4, "u", "Software Licence", "EULA")], "label_id int, kind string, label string, aliases string")
    values = {"12.3 TERM AND RENEWAL": 1, "Renewal & Term": 1, "Renewal, Term": 1, "Liability, Limitation of": 2, "Limi. of Liab.": 2, "LIIMTATION OF LIABILLITY": 2, "IV. Durration": 1, "Term and Renewal (see note)": 1, "§ 4 Revised  bribery:": 3, "Lunch Quiz": 0, "n/a": 0, "???": 0, "Anti.": 3, "briebry": 3, "brieyrb": 0, "x" * 5000: 0}
    rows = [("t", v) for v in values] + [("t", None), ("t", "  "), ("u", "eula"), ("t", "eula"), ("none", "Term"), ("t", "n/a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "kind string, value string, label_id int")
    for shard in (100, 1):
        got = {(r.kind, r.value): r.label_id for r in p3.resolve(df, canon, shard).collect()}
        assert {v: got["t", v] for v in values} == values and got["u", "eula"] == 4 and got["t", "eula"] == 0 and got["none", "Term"] == 0
        assert len(got) == len(values) + 3
    assert p3.resolve(df, canon.limit(0)).where("label_id != 0").count() == 0


# --- p4 ---------------------------------------------------------------------------------------


def test_names():
    a = p4.name_parts("x/2012-05-04 Office Lease with Alpha.docx")
    assert a == p4.name_parts("y\\z\\2012-05-04_OFFICE%20LEASE with alpha - Copy (2)_rev B.PDF") == p4.name_parts("Copy of 2012-05-04 Office Lease with Alpha FNAL signed.md")
    assert p4.name_parts(None) == p4.name_parts("") == ("", "", "")
    assert p4.mistyped("pacakging", "packaging") and p4.mistyped("abcdefgh", "bacdfegh") and not p4.mistyped("alpha", "omega", 3)


def test_history(spark):
    rng = random.Random(4)
    t = [text(rng, 60) for _ in range(4)]
    h = "ab" * 16
    rows = [
        (1, 0, "s", "a/Lease 12.pdf", h, t[0]),
        (2, 1, "z", "q/else.pdf", f"SHA-256={h.upper()}", t[1]),  # same hash elsewhere
        (3, 1, "s", "b/lease_12.docx", None, t[0] + " more words"),  # same name and text
        (4, 2, "s", "lease 12 (1).pdf", "00" * 16, t[0]),  # repeats 1; 3 is refused
        (5, 2, "s", "lease 13.pdf", None, t[0]),  # other number
        (6, 2, "r", "lease 12.pdf", None, t[0]),  # other source
        (7, 2, "s", "Lease 12.pdf", None, None),
        (8, 2, "s", "Lease 12.pdf", None, ""),
        (9, 2, None, None, " ", t[2]),
        (10, 0, "s", "Lease 12.pdf", h, t[0]),  # same batch as 1: both accepted
        (10, 0, "s", "Lease 12.pdf", h, t[0]),
        (11, None, "s", "Lease 12.pdf", h, t[0]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, batch_no int, source string, rel_path string, content_hash string, text string, hash string")
    got = {(r.doc_a, r.doc_b) for r in p4.repeats(df).collect()}
    assert got == {(1, 2), (2, 10), (1, 3), (3, 10), (1, 4), (4, 10)}
    assert p4.repeats(df.limit(0)).count() == 0


def test_history_random(spark):
    rng = random.Random(9)
    texts, rows = [text(rng, 50) for _ in range(10)], []
    for i in range(120):
        k = rng.randrange(10)
        name = f"Lease {k} {'Alpha' if rng.random() < 0.7 else 'Alhpa'}{rng.choice(['', ' - Copy', '_rev B'])}.pdf"
        rows.append((i, rng.randrange(5), rng.choice("st"), name, rng.choice([None, f"{k:032x}", f"{i:032x}"]), texts[k] + " " + text(rng, rng.choice([0, 5, 80]))))
    df = spark.createDataFrame(rows, "doc_id long, batch_no int, source string, rel_path string, content_hash string, text string")
    sets = {r[0]: {tuple(r[5].split()[k : k + 3]) for k in range(len(r[5].split()) - 2)} for r in rows}
    accepted, want = [], set()
    for b in range(5):
        now = [r for r in rows if r[1] == b]
        keep = []
        for r in now:
            hits = []
            for o in accepted:
                x, y = sets[r[0]], sets[o[0]]
                pr, po = p4.name_parts(r[3]), p4.name_parts(o[3])
                if (r[4] and r[4] == o[4]) or (r[2] == o[2] and pr[0] == po[0] and p4.mistyped(pr[1], po[1]) and len(x & y) >= 0.5 * len(x | y)):
                    hits.append(o[0])
            want |= {(min(r[0], o), max(r[0], o)) for o in hits}
            if not hits:
                keep.append(r)
        accepted += keep
    assert {(r.doc_a, r.doc_b) for r in p4.repeats(df).collect()} == want


def test_history_goes_on(spark, tmp_path):
    """A history that a later session opens gives what one run over all batches gives; refused rows aren't appended."""
    rng = random.Random(21)
    texts = [text(rng, 50) for _ in range(6)]
    rows = [(i, i % 4, "s" if i % 3 else None, f"Lease {i % 6} Alpha{rng.choice(['', ' - Copy', '_rev B'])}.pdf", rng.choice([None, f"{i % 9:032x}"]), rng.choice([texts[i % 6], None, ""])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, batch_no int, source string, rel_path string, content_hash string, text string")
    want = {(r.doc_a, r.doc_b) for r in p4.repeats(df).collect()}
    at, batch = f"{tmp_path}/h", lambda n: df.where(F.col("batch_no") == n)
    first = p4.History.create(spark, at, p4.describe(batch(0)))
    for n in (0, 1):
        first.append(batch(n), n)
    later = p4.History.open(spark, at)
    assert later.marks == first.marks
    old = later.table("entries", later.ENTRIES).count()
    for n in (2, 3):
        found = later.append(batch(n), n)
        now = later.table("entries", later.ENTRIES).count()
        assert now - old == 15 - found.select("b").distinct().count()
        old = now
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in later.links().collect()} == want and want
    with pytest.raises(ValueError, match="already"):
        later.append(batch(3), 3)
    shutil.rmtree(f"{at}/done/batch=3")  # as if broken off: the batch is taken again, with the same result
    later.append(batch(3), 3)
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in later.links().collect()} == want
    assert later.append(batch(3).limit(0), 9).count() == 0


# --- p5 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [8192, 40])
def test_neighbours(spark, chunk):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 64))
    x = np.concatenate([base, base[:40] + 0.3 * rng.normal(size=(40, 64)), base[:20] * 2.0, np.repeat(base[:1], 9, axis=0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 64), (502, [1.0] * 32), (503, [float("nan")] * 64), (None, x[0].tolist()), (3, x[3].tolist()), (504, [None] * 64)]
    df = spark.createDataFrame(rows, "clause_id long, embedding array<float>")
    got = {}
    for r in p5.neighbours(df, chunk=chunk).collect():
        got.setdefault(r.src, []).append((r.dst, r.cosine))
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    found = total = 0
    for i in range(len(x)):
        best = np.sort(s[i][s[i] >= 0.9])[::-1][:5]
        mine = sorted((c for _, c in got.get(i, [])), reverse=True)
        assert len(mine) <= 5 and all(abs(s[i][d] - c) < 1e-6 for d, c in got.get(i, []))
        total += len(best)
        found += sum(np.isclose(a, b, atol=1e-6) for a, b in zip(best, mine, strict=False))
    assert found >= 0.9 * total and max(got) < 200
    assert p5.neighbours(df.limit(0)).count() == 0


def test_beam_beats_nothing():
    x = np.random.default_rng(1).normal(size=(500, 16)).astype(np.float32)
    books = p5.train(x, 16, 16, 3, 4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    err = [((u - sum(b[c[:, i]] for i, b in enumerate(books))) ** 2).sum(1).mean() for c in (p5.beam_encode(u, books, 1), p5.beam_encode(u, books, 8))]
    assert err[1] <= err[0] < 1


# --- p6 ---------------------------------------------------------------------------------------


def test_tokens(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = p6.load_ranks()
    enc = tiktoken.Encoding("own", pat_str=p6.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(0)
    texts = ["", " ", "a", "aaaaaaa", "a" * 4001, "I'll\x1c\x85don't", "<|endoftext|>", "日本語😀" * 20, "x\n\n  y \t"]
    texts += ["".join(rng.choice("ab c'\n\té9日\x1f .") for _ in range(rng.randint(1, 50))) for _ in range(300)]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(900, None, "z"), (901, "a", "z"), (901, "a", "z")]
    got = p6.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), known_words=50).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id] if r.doc_id < 900 else None if r.doc_id == 900 else "a"
        assert r.ids == (enc.encode_ordinary(t) if t else [])


# --- p7 ---------------------------------------------------------------------------------------


def edit_within(a, text_words, limit):
    row = [0] * (len(text_words) + 1)
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(text_words, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row) <= limit


def test_leaks(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, [rng.choice(vocab) for _ in range(rng.randint(28, 70))]) for i in range(12)]
    docs = []
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(40)]
        i, words = rng.choice(items)
        n = rng.choice([20, 26, 28, 29, 30, 31, 40])
        at = rng.randrange(max(1, len(words) - n))
        part = words[at : at + n]
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(part))
            part[k : k + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 2)
        docs.append((d, " ".join(w[:20] + part + w[20:]).upper().replace(" ", ",\n ")))
    docs += [(100, None), (101, ""), (None, docs[0][1]), (5, docs[5][1])]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(50, None), (51, "short")], "item_id long, text string")
    want = set()
    for d, t in docs:
        if d is not None and t:
            tw = re.findall("[a-z0-9]+", t.lower())
            want |= {(d, i) for i, w in items if len(w) >= 30 and any(edit_within(w[a : a + 30], tw, 2) for a in range(len(w) - 29))}
    for block in (5000, 4):
        rows = [(r.doc_id, r.item_id) for r in p7.leaks(df, it, block=block).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert p7.leaks(df, it.limit(0)).count() == 0 and p7.leaks(df.limit(0), it).count() == 0


# --- p8 ---------------------------------------------------------------------------------------


def test_endings(spark):
    cases = {
        "It ends here.": "whole", "It ends he": "open", "He said “no.”": "whole", "pays 5,000.": "open", "pays 816,705.02.": "whole", "see clause 12.": "open", "see clause 12.4.": "whole",
        "and then…": "open", "and then [...]": "open", "bro�": "open", "x &am": "open", "Text.\n[signature page follows]": "whole", "Text.\n- end of document -": "whole", "Text.\n* * *": "whole", "T.\nE&OE": "whole",
        "T.\nEncl. (3)": "whole", "T.\nEncl. (3": "open", "T.\nSigned at X on 3 May 2010": "whole", "T.\nSigned at X on 3 May": "open", "T.\nAnnexure D": "whole", "T.\n(a) grapes": "either", "T.\n- grapes": "either",
        "T.\nFor A: ______": "either", "T.\nAlpha Timber\nDirector": "whole", "": "none", " \n\t": "none", "Ends. \n\n": "whole", "The Vendor shall": "open",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", p8.ending(F.col("t")).alias("e"))
    got = {r.t: r.e for r in df.collect()}
    assert got.pop(None) == "none" and got == cases


def test_limits_and_flags(spark):
    rng = random.Random(6)
    rows = [(i, "s" if i % 2 else "t", ("x" * rng.randint(20, 400)) + ".") for i in range(600)]
    rows += [(1000 + i, "s", "T.\n- " + "y" * 245) for i in range(40)]  # cut at 250 in a list
    rows += [(2000, "t", "T.\n- " + "y" * 245), (3000, None, None), (3001, None, ""), (3002, None, "open end")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, cut int")
    got = {r.doc_id for r in p8.flag(df).where("cut").collect()}
    assert got == {1000 + i for i in range(40)} | {3002}
    why = {r.doc_id: r.evidence for r in p8.flag(df).collect()}
    assert why[1000] == "limit" and why[3002] == "ending" and why[3000] is None and why[2000] is None
    # Without its neighbours of equal length the same ending isn't a cut: the hazard decides.
    assert p8.flag(df.where("doc_id not between 1001 and 1039")).where("cut and doc_id = 1000").count() == 0
    assert p8.flag(spark.createDataFrame([(1, "s", "broken off…", 2)], df.schema)).first().evidence == "mark"
    assert p8.flag(df).count() == len(rows) and p8.flag(df.limit(0)).count() == 0
