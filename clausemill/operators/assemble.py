"""Assembly: the best precedent's structure, gaps filled, renumbered, references rewritten."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausemill.functions import tables as T
from clausemill.functions.text import VARIABLE, cross_refs, normalize_label, rewrite_refs, substitute, terms_used, title_similarity, trim_ws
from clausemill.operators import tree
from clausemill.operators.search import OPERATIVE


@dataclass
class Spec:
    """What to draft; missing fields take these defaults."""

    contract_type: str = ""
    matter_id: str = ""
    title: str = ""
    language: str = "English"
    jurisdiction: str | None = None
    skeleton_precedent: str | None = None
    parties: list[dict] = field(default_factory=list)
    variables: dict[str, str] = field(default_factory=dict)
    source_scope: list[str] = field(default_factory=list)
    include_clause_types: list[str] = field(default_factory=list)
    exclude_clause_types: list[str] = field(default_factory=list)
    approved_only: bool = False

    @classmethod
    def from_json(cls, text: str) -> Spec:
        data = json.loads(text)
        return cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__ and v is not None})


def required(contract_type: str) -> list[str]:
    return list(_rule(contract_type)[0])


def checklist(contract_type: str) -> list[str]:
    a, b = _rule(contract_type)
    return [*a, *b]


def _rule(contract_type: str):
    return next((v for k, v in T.CHECKLISTS.items() if k.lower() == contract_type.lower()), ((), ()))


def order_index(contract_type: str, clause_type: str) -> int:
    """Where a clause type belongs: the checklist's place, then the generic order's, then the end."""
    own = [x.lower() for x in checklist(contract_type)]
    if clause_type.lower() in own:
        return own.index(clause_type.lower())
    generic = [x.lower() for x in T.GENERIC_ORDER]
    return len(own) + (generic.index(clause_type.lower()) if clause_type.lower() in generic else len(generic))


def conflicts(clause_types: list[str]) -> list[tuple[str, str]]:
    have = {x.lower() for x in clause_types}
    return [(a, b) for a, b in T.CONFLICTS if a.lower() in have and b.lower() in have]


def rule_rows(spark) -> DataFrame:
    """(contract_type, clause_type, place, required): the checklists as a small table."""
    rows = [(ct, t, i, i < len(a)) for ct, (a, b) in T.CHECKLISTS.items() for i, t in enumerate([*a, *b])]
    return spark.createDataFrame(rows, "contract_type string, clause_type string, place int, required boolean")


def missing_required(labels: DataFrame, rules: DataFrame, types: DataFrame) -> DataFrame:
    """(doc_id, contract_type, clause_type): required labels that a document hasn't, without regard to case.

    ``types``: (doc_id, contract_type); ``labels``: (doc_id, clause_type). Types without a checklist miss nothing.
    """
    r = rules.where("required").select(F.lower("contract_type").alias("ct"), F.col("clause_type"))
    want = types.select("doc_id", "contract_type", F.lower("contract_type").alias("ct")).join(F.broadcast(r), "ct").drop("ct").withColumn("low", F.lower("clause_type"))
    have = labels.select("doc_id", F.lower("clause_type").alias("low")).distinct()
    return want.join(have, ["doc_id", "low"], "left_anti").select("doc_id", "contract_type", "clause_type")


def clause_counts(documents: DataFrame, clauses: DataFrame) -> DataFrame:
    """Live documents with their number of clauses, 0 where there are none."""
    n = clauses.where("kind = 'clause'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("clause_count"))
    return documents.where(~F.coalesce("deleted", F.lit(False))).join(n, "doc_id", "left").withColumn("clause_count", F.coalesce("clause_count", F.lit(0)))


def skeleton_scores(documents: DataFrame, specs: DataFrame) -> DataFrame:
    """Every document with clauses scored for each spec (spec_id, want_type, want_jurisdiction, want_precedent).

    Specs are a stated, small set and broadcast.
    """
    d = documents.where("clause_count > 0").crossJoin(F.broadcast(specs))
    exact = F.coalesce(F.lower("contract_type") == F.lower("want_type"), F.lit(False))
    want = F.lower("want_precedent")
    forced = F.coalesce(F.lower("rel_path").contains(want) | F.coalesce(F.lower("title").contains(want), F.lit(False)), F.lit(False))
    place = F.coalesce(F.lower("jurisdiction") == F.lower("want_jurisdiction"), F.lit(False))
    score = (
        F.when(forced, 10000.0).otherwise(0.0)
        + F.when(exact, 1000.0).when(F.col("title").isNotNull(), 200.0 * title_similarity(F.col("title"), F.col("want_type"))).otherwise(0.0)
        + F.when(place, 50.0).otherwise(0.0)
        + 10.0 * F.sqrt(F.least(F.col("clause_count"), F.lit(60)).cast("double"))
    )
    return d.withColumn("exact", exact).withColumn("score", score)


def choose_skeleton(documents: DataFrame, specs: DataFrame) -> DataFrame:
    """The best document of each spec; of equal ones the first by source and id (aggregated, not sorted)."""
    s = skeleton_scores(documents, specs)
    best = F.min_by(F.struct("doc_id", "source", "rel_path", "title", "contract_type", "exact", "clause_count", "score"), F.struct((-F.round("score", 9)).alias("s"), "source", "doc_id"))
    return s.groupBy("spec_id").agg(best.alias("b")).select("spec_id", "b.*")


def label_of(clause_type: Column, heading: Column) -> Column:
    return F.coalesce(clause_type, heading, F.lit(""))


def exclude_roots(rows: DataFrame, types: list[str], key: str = "doc_id") -> DataFrame:
    """Rows (with pos, eff) without the trees whose root's label is excluded; deeper labels aren't tested."""
    run = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    bad = F.lower(label_of(F.col("clause_type"), F.col("heading"))).isin(*[t.lower() for t in types]) if types else F.lit(False)
    rows = rows.withColumn("__root_bad", F.last(F.when(F.col("eff") == 0, bad), ignorenulls=True).over(run))
    return rows.where(~F.col("__root_bad")).drop("__root_bad")


def insert_gaps(roots: list[str], wanted: list[str], contract_type: str) -> list[tuple[str, int]]:
    """Positions for wanted labels among root labels: before the first root that belongs later; each sees the earlier ones."""
    now, out = list(roots), []
    for w in wanted:
        mine = order_index(contract_type, w)
        at = next((i for i, r in enumerate(now) if order_index(contract_type, r) > mine), len(now))
        now.insert(at, w)
        out.append((w, at))
    return out


def draft_rows(clauses: DataFrame, variables: Column, exclude: list[str] | None = None) -> DataFrame:
    """Operative clauses of documents as numbered rows with substituted bodies and rewritten references."""
    rows = tree.effective_depth(clauses.where(~F.col("kind").isin(*OPERATIVE)), order=("seq", "clause_id"))
    if exclude:
        rows = exclude_roots(rows, exclude)
        rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("doc_id").orderBy("pos")))
    rows = tree.numbered(rows)
    numbers = tree.number_map(rows)
    body = rewrite_refs(substitute(F.coalesce("body", F.lit("")), variables), F.coalesce("numbers", F.create_map().cast("map<string,string>")))
    rows = rows.join(numbers, "doc_id", "left").withColumn("new_body", body).drop("numbers")
    head = F.when(trim_ws(F.coalesce("heading", F.lit(""))) == "", "").otherwise(normalize_label(F.col("heading")))
    return rows.withColumn("new_heading", head).withColumn("refs", cross_refs(F.col("new_body")))


def substitute_text(text: str, variables: dict[str, str]) -> str:
    """``{{name}}`` and ``{{name|Label}}`` in one text, as functions.text.substitute does in a column."""
    return re.sub(VARIABLE, lambda m: variables.get(m[1], m[0]), text)


def distinct_variables(texts: DataFrame, keys: list[str], order: list[str], text: str = "t") -> DataFrame:
    """(``keys``, name, label, filled): each placeholder of the texts once, with the label of its first place in ``order``."""
    each = texts.select(*keys, *order, F.posexplode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\{\{([A-Za-z0-9_]+(?:\|[^}]*)?)\}\}"), F.lit(1))).alias("place", "x"))
    each = each.withColumn("name", F.split_part("x", F.lit("|"), F.lit(1))).withColumn("label", F.when(F.col("x").contains("|"), F.split("x", r"\|", 2)[1]).otherwise(F.col("name")))
    first = F.min_by("label", F.struct(*order, "place"))
    return each.groupBy(*keys, "name").agg(first.alias("label")).withColumn("filled", F.lit(False))


def recitals(clauses: DataFrame, contract_type: Column | None = None) -> DataFrame:
    """Substantive recitals: labelled as such, or with 'whereas'; blank ones are left out."""
    head = F.lower(F.coalesce("heading", F.lit(""))).rlike("|".join(T.SUBSTANTIVE_RECITAL))
    return clauses.where((F.col("kind") == "recital") & (trim_ws(F.coalesce("body", F.lit(""))) != "") & (head | F.lower("body").contains("whereas")))


def synthetic_recital(spec: Spec) -> str:
    names = [f"**{p['name']}** (the \"{p['role']}\")" for p in spec.parties]
    between = "".join(("" if i == 0 else " and " if i + 1 == len(names) else ", ") + n for i, n in enumerate(names))
    return f"This {spec.contract_type} is entered into between {between}. The parties wish to record the terms and conditions set out below."


def definitions_used(rows: DataFrame, defs: DataFrame) -> DataFrame:
    """Rows with the defined terms that their new body uses."""
    table = defs.where("term is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("__terms"))
    return rows.join(table, "doc_id", "left").withColumn("terms", F.when(F.col("__terms").isNull(), F.array().cast("array<string>")).otherwise(terms_used(F.col("new_body"), F.col("__terms")))).drop("__terms")
