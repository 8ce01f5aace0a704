"""Problem 3: freely typed values mapped to a canonical list.

Entries (labels and aliases) stand in a BK-tree under Levenshtein's distance; triangle
inequality prunes all branches that can't hold an entry within the threshold, and every
entry within it is returned. Writing that isn't mistyping (numbering, qualifiers, another
order, shortened words, initials) is undone first, so that what the tree compares is
spelling. A list larger than one shard is split; each shard's winners merge.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.session import materialise, read

#: Words without weight, and what is put before or behind a value without changing it.
SMALL = {"and", "of", "the", "for", "in", "to", "on"}
BEFORE = r"^(?:(?:revised|standard|draft|new|updated|amended|final|old)\s+)+"
BEHIND = r"(?:\s*(?:\([^()]*\)|\[[^\[\]]*\]|[-–—]\s*(?:short|long|draft|final|standard)(?:\s+form)?|(?:\d+(?:st|nd|rd|th)|first|second|third|new|rev\.?)\s+ed(?:ition|n)?\.?|\bv(?:er(?:sion)?)?\.?\s*\d+(?:\.\d+)*)\s*[.:;,]*)+$"
NUMBER = r"^(?:(?:clause|section|article|art\.|sec\.|cl\.|no\.|§§?)\s*)?(?:\d+(?:\.\d+)*|(?=[ivxlc]+[.)])[ivxlc]+)\s*[.):]?\s*[-–—:]?\s+"


def distance(a: str, b: str) -> int:
    """Levenshtein's distance, bit-parallel."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    pv, mv = full, 0
    for c in b:
        eq = where.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return score


def mistyped(a: str, b: str, limit: int = 3) -> bool:
    """Whether at most ``limit`` letters are changed, dropped, added or swapped with their neighbour."""
    if abs(len(a) - len(b)) > limit or distance(a, b) > 2 * limit:
        return False
    if distance(a, b) <= limit:
        return True
    far = limit + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > far:
            return False
        before, row = row, now
    return row[-1] <= limit


class BKTree:
    def __init__(self, words):
        self.root = None
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = (word, {})
            return
        node = self.root
        while True:
            d = distance(word, node[0])
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = (word, {})
                return
            node = node[1][d]

    def within(self, word: str, limit: int) -> list[tuple[int, str]]:
        """Every entry within ``limit``, nearest first."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            entry, children = todo.pop()
            d = distance(word, entry)
            if d <= limit:
                out.append((d, entry))
            todo += [c for k, c in children.items() if d - limit <= k <= d + limit]
        return sorted(out)


def clean(value: str) -> str:
    """Lower case, without quotes, numbering, qualifiers, marks at the ends and doubled blanks."""
    s = unicodedata.normalize("NFKC", value).lower().replace("_", " ")
    s = re.sub(r"[\"“”„«»`]", "", s)
    s = re.sub(r"[\s\x00-\x1f\x7f-\x9f]+", " ", s).strip()
    for _ in range(3):
        old = s
        s = re.sub(r"^['\s.:;,*•–—-]+|['\s:;,*–—-]+$", "", s)
        s = re.sub(NUMBER, "", s)
        s = re.sub(BEFORE, "", s)
        s = re.sub(BEHIND, "", s)
        if s == old:
            break
    return s.strip()


def spell(s: str) -> str:
    """Joining marks as words, other marks as blanks."""
    s = re.sub(r"\s*[&+/]\s*", " and ", s)
    s = re.sub(r"[^\w\s]+", " ", s)
    return re.sub(r"\s+", " ", s).strip()


def bag(s: str) -> str:
    return " ".join(sorted(t for t in spell(s.replace(",", " ")).split() if t not in SMALL))


def turns(s: str) -> list[str]:
    """The value as it stands and in its other orders."""
    out = [spell(s)]
    if "," in s:
        a, _, b = s.partition(",")
        a, b = spell(a), spell(b)
        out += [f"{b} {a}", f"{a} and {b}", f"{b} and {a}"]
        if b.endswith(" and"):
            out.append(f"{b} {a}")
    parts = re.split(r" and ", spell(s))
    if len(parts) == 2:
        out.append(f"{parts[1]} and {parts[0]}")
    return list(dict.fromkeys(x.strip() for x in out if x.strip()))


def allowed(n: int) -> int:
    """Edits that a value of ``n`` letters may have."""
    return 0 if n <= 3 else 1 if n <= 5 else 2 if n <= 8 else 3 if n <= 12 else 4


def slips(n: int) -> int:
    """Slips of the hand that a value of ``n`` letters may have, where a swap of two letters is one."""
    return 0 if n <= 3 else 1 if n <= 5 else 2


class Canon:
    """One shard of the entries of one kind: [(label_id, label, aliases)]."""

    def __init__(self, entries: list[tuple[int, str, str | None]], alone: bool = True):
        self.alone = alone  # no other shard
        self.exact: dict[str, int] = {}
        self.bags: dict[str, set[int]] = {}
        self.initials: dict[str, set[int]] = {}
        self.words: dict[tuple[int, str], list[tuple[list[str], int]]] = {}  # by number of words and first letter
        for label_id, label, aliases in sorted(entries, key=lambda e: (e[0] is None, e[0])):
            if label_id is None:
                continue
            for i, name in enumerate([label, *(aliases or "").split("; ")]):
                if not name or not name.strip():
                    continue
                c = clean(name) or name.strip().lower()
                for form in {spell(c), spell(c).replace(" ", "")}:
                    self.exact.setdefault(form, label_id)
                self.bags.setdefault(bag(c), set()).add(label_id)
                words = [w for w in c.split() if w not in SMALL]
                if words:
                    self.words.setdefault((len(words), words[0][0]), []).append((words, label_id))
                if i == 0 and len(words) >= 2:
                    for w in ([x for x in c.split() if x not in SMALL], c.split(), spell(c).split()):
                        self.initials.setdefault("".join(x[0] for x in w), set()).add(label_id)
        self.tree = BKTree(sorted(self.exact))

    def shortened(self, c: str) -> set[int]:
        """Entries whose words begin, one by one, with the value's words."""
        given = [w.rstrip(".") for w in re.sub(r"\s*[&+/]\s*", " ", c).split()]
        given = [w for w in given if w and w not in SMALL]
        if not given:
            return set()
        same = self.words.get((len(given), given[0][0]), ())
        return {label_id for words, label_id in same if all(w.startswith(g) for w, g in zip(words, given, strict=True))}

    def candidates(self, value: str) -> list[tuple[int, int, int]]:
        """(step, edits, label_id) of all that a step finds, for each step; a shape of two entries here comes with two.

        Whether a shape is of one entry is seen only over all shards (see resolve); later
        steps are therefore tried unless the value stands as it is.
        """
        c = clean(value)
        if not c:
            return []
        forms = turns(c)
        for place, f in enumerate(forms):
            if f in self.exact:
                return [(0, place, self.exact[f])]
        out = [(1, 0, i) for i in sorted(self.bags.get(bag(c), ()))[:2]]
        letters = re.sub(r"[\s.]", "", c)
        if re.fullmatch(r"(?:\w\.?\s?){2,8}", c) is not None and len(letters) <= 8:
            out += [(2, 0, i) for i in sorted(self.initials.get(letters, ()))[:2]]
        if "." in c:
            out += [(3, 0, i) for i in sorted(self.shortened(c))[:2]]
        if not self.alone or not settled(out):
            best = self.spelling(forms)
            if best:
                out.append((4, *best))
        return out

    def spelling(self, forms: list[str]) -> tuple[int, int] | None:
        """(edits, label_id) of the nearest entry by its spelling."""
        best: tuple[int, int] | None = None
        for f in forms:
            for d, entry in self.tree.within(f, max(allowed(len(f)), 2 * slips(len(f)))):
                n = min(len(f), len(entry))
                if (d <= allowed(n) or mistyped(f, entry, slips(n))) and (best is None or (d, self.exact[entry]) < best):
                    best = (d, self.exact[entry])
        return best

    def find(self, value: str) -> tuple[int, int, int]:
        """(step, edits, label_id); step 9 where nothing is near enough."""
        return choose(self.candidates(value))


def settled(found: list[tuple[int, int, int]]) -> bool:
    """Whether a shape among steps 1 to 3 is of one entry."""
    return any(len({i for s, _, i in found if s == step}) == 1 for step in (1, 2, 3))


def choose(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The first step that decides; a shape of several entries decides nothing."""
    for step in (0, 1, 2, 3, 4):
        of = sorted({(e, i) for s, e, i in found if s == step})
        if of and (step in (0, 4) or len({i for _, i in of}) == 1):
            return step, of[0][0] if step == 4 else 0, of[0][1]
    return 9, 0, 0


TREES = ("trees",)  # no kind is a tuple


def resolve(values: DataFrame, canon: DataFrame, shard: int = 20_000) -> DataFrame:
    """(kind, value, label_id, step, edits) of each distinct (kind, value); label_id 0 where it stands for none.

    Values that are null or blank are left out. Entries with a null id or label are
    ignored; of entries that are equally near the least id wins; a value is taken by its
    shape (another order, initials, shortened words) only where that shape is of one
    entry. An empty list gives 0 for all. Repeated values come once; other columns are
    ignored. The list is broadcast in shards of ``shard`` entries, one pass over the
    distinct values each.
    """
    spark = values.sparkSession
    distinct = values.select("kind", "value").where("kind is not null and value is not null").where(~F.col("value").rlike(r"\A(?U)[\s\p{Cntrl}]*\z")).groupBy("kind", "value").agg(F.lit(1).alias("one")).drop("one")
    entries = canon.where("label_id is not null and label is not null").select("label_id", "kind", "label", "aliases")
    shards = max(1, -(-entries.count() // shard))
    # Few bytes but much work a row: adaptive execution mustn't join these into a task or two.
    distinct = distinct.repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if shards > 1:
        distinct = materialise(distinct)
    result = None
    for n in range(shards):
        part = entries if shards == 1 else entries.where(F.pmod(F.xxhash64("label_id"), F.lit(shards)) == n)
        by: dict[str, list] = {}
        for r in part.collect():
            by.setdefault(r.kind, []).append((r.label_id, r.label, r.aliases))
        lists = spark.sparkContext.broadcast(by)

        def run(batches, lists=lists):
            by = lists.value
            if TREES not in by:  # the broadcast's value stays in the worker: trees are built once there, not for each task
                by[TREES] = {k: Canon(v, shards == 1) for k, v in by.items()}
            trees = by[TREES]
            for batch in batches:
                if shards > 1:
                    got = [(k, v, i, s, e) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s, e, i in [*(trees[k].candidates(v) if k in trees else ()), (9, 0, 0)]]
                    yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], type=t) for j, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()))], names=["kind", "value", "label_id", "step", "edits"])
                    continue
                got = [trees[k].find(v) if k in trees else (9, 0, 0) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([g[i] for g in got], type=pa.int32()) for i in (2, 0, 1))], names=["kind", "value", "label_id", "step", "edits"])

        now = distinct.mapInArrow(run, "kind string, value string, label_id int, step int, edits int")
        result = now if result is None else result.unionByName(now)
    if shards > 1:
        # A shape that two shards know is of two entries: it is decided here, over all of them.
        nearest = F.min(F.struct("edits", "label_id"))
        steps = result.groupBy("kind", "value", "step").agg(nearest.alias("b"), F.min("label_id").alias("lo"), F.max("label_id").alias("hi"))
        steps = steps.where("step not in (1, 2, 3) or lo = hi")
        first = F.struct("step", F.when(F.col("step") == 4, F.col("b.edits")).otherwise(0).alias("edits"), F.col("b.label_id").alias("label_id"))
        result = steps.groupBy("kind", "value").agg(F.min(first).alias("b")).select("kind", "value", "b.label_id", "b.step", "b.edits")
    return result


def typed_fields(clauses: DataFrame) -> DataFrame:
    """(clause_id, field, kind, value): the typed values, one row a clause and field."""
    rows = F.array(
        F.struct(F.lit("heading").alias("field"), F.lit("clause_type").alias("kind"), F.when(F.col("kind") == "clause", F.col("heading")).alias("value")),
        F.struct(F.lit("clause_type").alias("field"), F.lit("clause_type").alias("kind"), F.col("clause_type").alias("value")),
        F.struct(F.lit("contract_type").alias("field"), F.lit("contract_type").alias("kind"), F.col("contract_type").alias("value")),
    )
    return clauses.select("clause_id", F.inline(rows)).where("value is not null")


def map_clauses(clauses: DataFrame, canon: DataFrame, most: int = 200_000) -> DataFrame:
    """(clause_id, field, label_id) of each value that isn't an entry's label as it stands.

    Rows that repeat a clause_id count once. Values meet their labels by a broadcast of
    at most ``most`` distinct values, beyond that by a shuffled join (adaptive execution
    splits a value that holds many rows).
    """
    fields = typed_fields(clauses)
    labels = canon.select("kind", F.col("label").alias("value")).dropDuplicates()
    typed = fields.join(F.broadcast(labels) if labels.count() <= most else labels, ["kind", "value"], "left_anti")
    found = materialise(resolve(typed, canon).select("kind", "value", "label_id"))
    side = F.broadcast(found) if found.count() <= most else found
    return typed.join(side, ["kind", "value"]).select("clause_id", "field", "label_id").dropDuplicates(["clause_id", "field"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses = read(spark, sf_dir, "clauses").select("clause_id", "kind", "heading", "clause_type", "contract_type")
    return map_clauses(clauses, read(spark, sf_dir, "canon_labels"))


def queries() -> dict:
    return {"p3_found": p3_found}


def oracle_sql() -> dict:
    return {}
