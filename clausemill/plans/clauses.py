"""Queries on clauses: labels, trees, references, assembly and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausemill.functions import tables as T
from clausemill.functions.text import fnv1a64, placeholders, substitute, terms_used, tokens
from clausemill.operators import assemble, index, label, render, segment, tree, validate
from clausemill.operators.search import OPERATIVE
from clausemill.plans.sql import LIVE, NORM, SQUASH, TITLE, TRIM, family
from clausemill.session import materialise, read


def live(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Clauses with each clause_id once, as last taken in; ``columns``: those wanted beside the id (all if none)."""
    return index.latest(read(spark, sf_dir, "clauses"), "clause_id", "ingested_at", columns)


def clause_labels(spark, d):
    return label.with_clause_type(live(spark, d, "heading", "body").select("clause_id", "heading", "body")).select("clause_id", "label")


LABELS = f"""
with {LIVE}, h as (select clause_id, {TRIM("coalesce(heading, '')")} as h, {NORM("coalesce(body, '')[1:300]")} as b from live),
n as (select *, {NORM('h')} as nh, {TITLE('h')} as own from h)
select clause_id, case when h <> '' then coalesce({family('nh', T.CLAUSE_FAMILIES)}, nullif(own, ''), {family('b', T.CLAUSE_FAMILIES)}) else {family('b', T.CLAUSE_FAMILIES)} end as label from n
"""


def definitions_harvest(spark, d):
    return segment.definitions(live(spark, d, "doc_id", "body").where("body is not null"), "clause_id", ("doc_id",)).select("clause_id", "doc_id", "line_no", "term", "body")


HARVEST = rf"""
with {LIVE}, l as (select clause_id, doc_id, unnest(list_zip(range(len(string_split(body, chr(10)))), string_split(body, chr(10)))) as s from live where body is not null),
m as (select clause_id, doc_id, s[1] as line_no, s[2] as line, unnest(regexp_extract_all(s[2], '["“”'']([A-Z][A-Za-z0-9 /\-]{{1,60}}?)["“”''](?:\s+)(?:shall\s+mean|means|shall\s+have\s+the\s+meaning)', 1)) as term from l)
select clause_id, doc_id, cast(line_no as int) as line_no, {TRIM('term')} as term, {TRIM('line')} as body from m
"""


def edges_uses_term(spark, d):
    """Edges over bodies that also name their document's first term (no body of the tables names one as it stands)."""
    c = live(spark, d, "doc_id", "kind", "term", "body")
    first = c.where("kind = 'definition'").groupBy("doc_id").agg(F.min("term").alias("named"))
    said = c.join(first, "doc_id", "left").withColumn("body", F.concat_ws(" the ", "body", "named"))
    return index.uses_term(said.drop("named"))


EDGES = f"""
with {LIVE}, f as (select doc_id, min(term) as named from live where kind = 'definition' group by 1),
said as (select l.* replace (concat_ws(' the ', body, named) as body) from live l left join f using (doc_id))
select distinct b.clause_id as src_clause, 'uses_term' as relation, t.clause_id as dst_clause
from said b join live t on b.doc_id = t.doc_id and b.kind <> 'definition' and t.kind = 'definition' and octet_length(encode(t.term)) >= 3 and contains(b.body, t.term) and b.clause_id <> t.clause_id
"""


def edges_kept(spark, d):
    """Edges left when the clauses of tombstoned documents go."""
    gone = live(spark, d, "doc_id").join(read(spark, d, "documents").where("deleted").select("doc_id"), "doc_id", "left_semi")
    return index.drop_edges(read(spark, d, "edges").distinct(), gone)


KEPT = f"""
with {LIVE}, g as (select clause_id from live join documents using (doc_id) where deleted)
select distinct * from edges where src_clause not in (select clause_id from g) and dst_clause not in (select clause_id from g)
"""


def document_objects(spark, d):
    """The objects of each live document in their order."""
    c = live(spark, d, "doc_id", "seq", "kind", "number", "heading").join(read(spark, d, "documents").where("not deleted").select("doc_id"), "doc_id", "left_semi")
    return index.order_in(c, ["doc_id"], "seq", "clause_id").select("doc_id", "clause_id", "ord", "kind", "number", "heading")


OBJECTS = f"""
with {LIVE} select doc_id, clause_id, cast(row_number() over (partition by doc_id order by seq, clause_id) - 1 as int) as ord, kind, number, heading from live where doc_id in (select doc_id from documents where not deleted)
"""


def _once(spark, d) -> DataFrame:
    """live() as a table: the depth of the trees is read before the trees are numbered."""
    return materialise(live(spark, d, "doc_id", "kind", "number", "seq", "depth", "heading", "term", "body"))


def numbered(c: DataFrame) -> DataFrame:
    ops = c.where(~F.col("kind").isin(*OPERATIVE))
    return tree.numbered(tree.effective_depth(ops, order=("seq", "clause_id")))


def tree_numbers(spark, d):
    return numbered(_once(spark, d)).select("clause_id", "doc_id", "pos", "eff", "new_number")


_LEVELS = 4
_E = f"least(eff, {_LEVELS - 1})"
NUMBERED = f"""
{LIVE}, o as (select *, row_number() over (partition by doc_id order by seq, clause_id) as pos from live where kind not in ('definition', 'schedule', 'recital', 'execution')),
e as (select *, pos + min(case when pos = 1 then 0 else greatest(0, least(coalesce(depth, 0), 255)) end - pos) over (partition by doc_id order by pos) as eff from o),
i as (select *, {', '.join(f'sum(case when {_E} < {n} then 1 else 0 end) over (partition by doc_id order by pos) as i{n}' for n in range(_LEVELS))} from e),
n as (select *, {', '.join(f'sum(case when {_E} = {n} then 1 else 0 end) over (partition by doc_id, i{n} order by pos) as o{n}' for n in range(_LEVELS))} from i),
numbered as (select *, concat_ws('.', {', '.join(f'case when {_E} >= {n} then o{n} end' for n in range(_LEVELS))}) as new_number from n)
"""
TREE = f"with {NUMBERED} select clause_id, doc_id, cast(pos as int) as pos, cast(eff as int) as eff, new_number from numbered"


def cross_references(spark, d):
    """References rewritten by each document's map of old numbers to new."""
    rows = assemble.draft_rows(_once(spark, d), F.create_map().cast("map<string,string>"))
    return rows.select("clause_id", "doc_id", "new_number", "new_body", F.array_join("refs", ",").alias("refs"))


REFS = rf"""
with {NUMBERED}, m as (select doc_id, number, arg_max(new_number, pos) as nn from numbered where number is not null group by 1, 2),
s as (select clause_id, unnest(list_zip(range(1, 1 + len(string_split(x, chr(1)))), string_split(x, chr(1)))) as p from (select clause_id, regexp_replace(coalesce(body, ''), '(?i)(clauses?\s+)(\d+(?:\.\d+)*)', '\1' || chr(1) || '\2' || chr(1), 'g') as x from numbered)),
j as (select s.clause_id, string_agg(case when p[1] % 2 = 0 then coalesce(m.nn, p[2]) else p[2] end, '' order by p[1]) as new_body from s join numbered n on n.clause_id = s.clause_id left join m on m.doc_id = n.doc_id and p[1] % 2 = 0 and m.number = p[2] group by 1)
select clause_id, doc_id, new_number, new_body, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(new_body, '(?i)(clauses?\s+)(\d+(?:\.\d+)*)', 2))), ','), '') as refs from numbered join j using (clause_id)
"""


def definitions_first_wins(spark, d):
    defs = live(spark, d, "doc_id", "source", "kind", "term", "seq", "body").where("kind = 'definition' and term is not null")
    return tree.first_wins(defs, ["source", "term"], "doc_id", "seq", "clause_id").select("source", "term", "clause_id", "body")


FIRST = f"""
with {LIVE} select source, term, clause_id, body from (select *, row_number() over (partition by source, term order by doc_id, seq, clause_id) as k from live where kind = 'definition' and term is not null) where k = 1
"""


def schedules_folded(spark, d):
    return tree.fold_schedules(live(spark, d, "doc_id", "kind", "seq", "heading", "body"))


SCHEDULES = f"""
with {LIVE}, s as (select *, row_number() over (partition by doc_id order by seq, clause_id) = 1 as f from live where kind = 'schedule'),
n as (select *, sum(case when heading is not null or f then 1 else 0 end) over (partition by doc_id order by seq, clause_id) as schedule_no from s),
g as (select doc_id, schedule_no, arg_min(coalesce(heading, chr(1)), (seq, clause_id)) as h, string_agg(coalesce(body, ''), chr(10) order by seq, clause_id) as body from n group by 1, 2)
select doc_id, cast(schedule_no as bigint) as schedule_no, coalesce(nullif(h, chr(1)), 'Schedule ' || cast(schedule_no as bigint)) as title, body from g
"""


def recitals(spark, d):
    return assemble.recitals(live(spark, d, "doc_id", "kind", "heading", "body")).select("clause_id", "doc_id", "body")


RECITALS = f"""
with {LIVE} select clause_id, doc_id, body from live where kind = 'recital' and {TRIM("coalesce(body, '')")} <> '' and (regexp_matches(lower(coalesce(heading, '')), 'recital|preamble|background|introduction') or contains(lower(body), 'whereas'))
"""


def _templates(c: DataFrame) -> DataFrame:
    """Bodies with a known and an unknown placeholder, for the operators on variables."""
    body = F.concat(F.coalesce("body", F.lit("")), F.lit(" {{source}} and {{ "), F.coalesce("number", F.lit("")), F.lit(" | Label}} of {{nobody}}"))
    return c.select("clause_id", "source", body.alias("t"))


def variable_substitution(spark, d):
    t = _templates(live(spark, d, "source", "number", "body"))
    return t.select("clause_id", substitute(F.col("t"), F.create_map(F.lit("source"), F.col("source"))).alias("text"))


def unresolved_variables(spark, d):
    t = _templates(live(spark, d, "source", "number", "body"))
    return t.select("clause_id", F.array_join(placeholders(F.col("t")), "|").alias("names"))


def distinct_variables(spark, d):
    """The placeholders of each document's bodies, once each, with the label of the first place."""
    c = live(spark, d, "doc_id", "seq", "number", "body")
    t = c.select("doc_id", "seq", "clause_id", F.concat(F.coalesce("body", F.lit("")), F.lit(" {{amount|Sum of "), F.coalesce("number", F.lit("-")), F.lit("}} for {{client}} or {{v"), F.col("seq").cast("string"), F.lit("}}")).alias("t"))
    return assemble.distinct_variables(t, ["doc_id"], ["seq", "clause_id"])


VARIABLES = rf"""
with {LIVE}, t as (select doc_id, seq, clause_id, coalesce(body, '') || ' {{{{amount|Sum of ' || coalesce(number, '-') || '}}}} for {{{{client}}}} or {{{{v' || seq || '}}}}' as t from live),
e as (select doc_id, seq, clause_id, regexp_extract_all(t, '\{{\{{([A-Za-z0-9_]+(?:\|[^}}]*)?)\}}\}}', 1) as xs from t),
u as (select doc_id, seq, clause_id, unnest(list_zip(range(len(xs)), xs)) as p from e),
n as (select doc_id, seq, clause_id, p[1] as place, string_split(p[2], '|')[1] as name, case when contains(p[2], '|') then p[2][position('|' in p[2]) + 1:] else p[2] end as label from u)
select doc_id, name, arg_min(label, (seq, clause_id, place)) as label, false as filled from n group by 1, 2
"""


_TPL = "t as (select clause_id, source, coalesce(body, '') || ' {{source}} and {{ ' || coalesce(number, '') || ' | Label}} of {{nobody}}' as t from live)"
SUBST = f"with {LIVE}, {_TPL} select clause_id, replace(t, '{{{{source}}}}', source) as text from t"
UNRES = rf"with {LIVE}, {_TPL} select clause_id, coalesce(array_to_string(list_filter(list_transform(regexp_extract_all(t, '(?s)\{{\{{(.*?)\}}\}}', 1), lambda x: {TRIM("string_split(x, '|')[1]")}), lambda x: x <> ''), '|'), '') as names from t"


def terms_in_clauses(spark, d):
    c = live(spark, d, "doc_id", "kind", "term", "body")
    table = c.where("kind = 'definition' and term is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return c.where("kind != 'definition'").join(table, "doc_id").select("clause_id", F.array_join(terms_used(F.coalesce("body", F.lit("")), F.col("terms")), "|").alias("terms"))


TERMS = f"""
with {LIVE}, t as (select doc_id, list_sort(list_distinct(list(term))) as terms from live where kind = 'definition' and term is not null group by 1)
select clause_id, coalesce(array_to_string(list_filter(terms, lambda x: octet_length(encode(x)) >= 3 and contains(coalesce(body, ''), x)), '|'), '') as terms from live join t using (doc_id) where kind <> 'definition'
"""


def missing_required(spark, d):
    c = label.with_clause_type(live(spark, d, "doc_id", "heading", "body").select("doc_id", "heading", "body"), "clause_type").select("doc_id", "clause_type").where("clause_type is not null")
    types = read(spark, d, "documents").select("doc_id", F.col("contract_type"), label.contract_type(F.coalesce("contract_type", F.lit("")), F.lit("")).alias("t"))
    types = types.select("doc_id", F.coalesce("t", "contract_type").alias("contract_type")).where("contract_type is not null")
    return assemble.missing_required(c, assemble.rule_rows(spark), types)


_RULES = ", ".join(f"('{ct}', '{t}', {i}, {str(i < len(a)).lower()})" for ct, (a, b) in T.CHECKLISTS.items() for i, t in enumerate([*a, *b]))
_INSTR = "|".join(T.INSTRUMENTS)
_INSTR_LIST = ", ".join(f"'{x}'" for x in T.INSTRUMENTS)
MISSING = rf"""
with l as (select l.doc_id, lower(x.label) as low from ({LABELS}) x join (with {LIVE} select clause_id, doc_id from live) l using (clause_id) where x.label is not null),
a as (select doc_id, contract_type as ct, coalesce(contract_type, '') as name from documents),
b as (select *, {TRIM("regexp_split_to_array(regexp_replace(name, '[.][^.]*$', ''), '[-_]')[1]")} as stem from a),
c as (select *, {NORM('name')} as n, {TITLE('stem')} as own from b),
t as (select doc_id, coalesce({family('n', T.CONTRACT_FAMILIES)}, case when regexp_matches(lower(stem), '{_INSTR}') and own <> '' and lower(own) not in ({_INSTR_LIST}) then own end, ct) as contract_type from c),
r as (select * from (values {_RULES}) v(contract_type, clause_type, place, required) where required)
select t.doc_id, t.contract_type, r.clause_type from t join r on lower(r.contract_type) = lower(t.contract_type) where not exists (select 1 from l where l.doc_id = t.doc_id and l.low = lower(r.clause_type))
"""


def checklist_order(spark, d):
    """The place of every canonical clause label in each contract type's order."""
    rows = [(ct, t, assemble.order_index(ct, t)) for ct in [*T.CHECKLISTS, "Something Else"] for t in [*T.GENERIC_ORDER, "Something Else"]]
    places = spark.createDataFrame(rows, "contract_type string, clause_type string, order_index int")
    n = label.with_clause_type(live(spark, d, "heading", "body").select("heading", "body"), "clause_type").groupBy("clause_type").agg(F.count(F.lit(1)).alias("clauses"))
    return places.join(n, "clause_type").select("contract_type", "clause_type", "order_index", "clauses")


_G = {t: i for i, t in enumerate(T.GENERIC_ORDER)}
_ORDER = ", ".join(
    f"('{ct}', '{t}', {own.index(t) if t in own else len(own) + _G.get(t, len(_G))})"
    for ct, own in [*((k, [*a, *b]) for k, (a, b) in T.CHECKLISTS.items()), ("Something Else", [])]
    for t in [*T.GENERIC_ORDER, "Something Else"]
)
ORDER = f"""
with n as (select label as clause_type, count(*) as clauses from ({LABELS}) group by 1)
select v.contract_type, v.clause_type, v.order_index, n.clauses from (values {_ORDER}) v(contract_type, clause_type, order_index) join n using (clause_type)
"""


def skeleton_choice(spark, d):
    """The best precedent for each canonical contract type, in one jurisdiction."""
    specs = read(spark, d, "canon_labels").where("kind = 'contract_type'").select(F.col("label_id").alias("spec_id"), F.col("label").alias("want_type"), F.lit("Veld Territories").alias("want_jurisdiction"), F.lit(None).cast("string").alias("want_precedent"))
    docs = assemble.clause_counts(read(spark, d, "documents"), read(spark, d, "clauses").select("clause_id", "doc_id", "kind").dropDuplicates(["clause_id"]))
    return assemble.choose_skeleton(docs, specs).select("spec_id", "doc_id", "source", "exact", "clause_count", F.round("score", 6).alias("score"))


_TOK = lambda x: rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: octet_length(encode(t)) > 2)"
SKELETON = rf"""
with n as (select doc_id, count(distinct clause_id) as n from clauses where kind = 'clause' group by 1),
d as (select documents.*, n from documents join n using (doc_id) where not deleted),
s as (select label_id as spec_id, label as want from canon_labels where kind = 'contract_type'),
x as (select s.spec_id, d.doc_id, d.source, coalesce(lower(d.contract_type) = lower(s.want), false) as exact, d.n as clause_count, d.jurisdiction, d.title, {_TOK('s.want')} as tb, {_TOK("coalesce(d.title, '')")} as ta from d, s),
y as (select *, case when exact then 1000.0 when title is not null and len(ta) > 0 and len(tb) > 0 then 200.0 * len(list_filter(tb, lambda t: list_contains(ta, t))) / len(tb) else 0.0 end + case when coalesce(lower(jurisdiction) = 'veld territories', false) then 50.0 else 0.0 end + 10.0 * sqrt(least(clause_count, 60)) as score from x)
select spec_id, doc_id, source, exact, clause_count, round(score, 6) as score from (select *, row_number() over (partition by spec_id order by round(score, 9) desc, source, doc_id) as k from y) where k = 1
"""


def excluded_roots(spark, d):
    """What is left when trees with two labels at their root go."""
    rows = tree.effective_depth(live(spark, d, "doc_id", "kind", "seq", "depth", "clause_type", "heading").where(~F.col("kind").isin(*OPERATIVE)), order=("seq", "clause_id"))
    return assemble.exclude_roots(rows, ["Health and Safety", "Early Exit"]).select("clause_id", "doc_id", "eff")


EXCLUDED = f"""
with {NUMBERED}, b as (select *, last_value(case when eff = 0 then lower(coalesce(clause_type, heading, '')) in ('health and safety', 'early exit') end ignore nulls) over (partition by doc_id order by pos) as bad from numbered)
select clause_id, doc_id, cast(eff as int) as eff from b where not bad
"""


def markdown_render(spark, d):
    c = _once(spark, d)
    rows = assemble.draft_rows(c, F.create_map().cast("map<string,string>"))
    return render.markdown(rows, read(spark, d, "documents"), tree.fold_schedules(c))


_BLOCKS = lambda x: rf"(select coalesce(array_to_string(z, chr(10) || chr(10)), '') || case when len(z) > 0 then chr(10) || chr(10) else '' end from (select list_filter(list_transform(string_split({x}, chr(10)), lambda q: {TRIM('q')}), lambda q: q <> '') as z))"
MARKDOWN = rf"""
with r as ({REFS}), {NUMBERED},
c as (select n.doc_id, n.pos, n.eff, n.new_number, case when {TRIM("coalesce(n.heading, '')")} = '' then '' else {TITLE('n.heading')} end as h, {_BLOCKS('r.new_body')} as md from numbered n join r using (clause_id)),
p as (select doc_id, 1 as sec, pos, case when {TRIM('h')} = '' then new_number || ' ' || md || case when md = '' then chr(10) else '' end else repeat('#', cast(least(eff + 2, 6) as bigint)) || ' ' || new_number || '. ' || h || chr(10) || chr(10) || md end || chr(10) as s from c
 union all select doc_id, 2, schedule_no, '## ' || title || chr(10) || chr(10) || {_BLOCKS('body')} || chr(10) from ({SCHEDULES})),
b as (select doc_id, string_agg(s, '' order by sec, pos) as body from p group by 1)
select doc_id, '# ' || coalesce(case when {TRIM("coalesce(title, '')")} <> '' then title end, contract_type, '') || chr(10) || chr(10) || body || coalesce(chr(10) || '_Governing law: ' || jurisdiction || '._' || chr(10), '') as markdown from b join documents using (doc_id)
"""


def docx_render(spark, d):
    made = render.docx(markdown_render(spark, d))
    return made.select("doc_id", F.length("docx").alias("n_bytes"), (F.substring("docx", 1, 2) == F.lit(b"PK")).alias("is_zip"))


def validation_findings(spark, d):
    """Findings of all codes over every document, as if each were a draft with its own clauses."""
    c = _once(spark, d)
    # Numbered clauses ask for a variable too, that no text of the tables has.
    rows = numbered(c.withColumn("body", F.when(F.col("kind") == "clause", F.concat_ws(" ", "body", F.concat(F.lit("{{ v"), "number", F.lit(" | L}}")))).otherwise(F.col("body"))))
    docs = read(spark, d, "documents").select("doc_id", "title", "source")
    defs = c.where("kind = 'definition'").select("doc_id", "term")
    used, unused = validate.terms(c.where(~F.col("kind").isin(*OPERATIVE)), defs)
    parties = docs.where("title is not null").select("doc_id", F.col("title").alias("name"))
    blocks = c.where("kind = 'execution'")
    out = validate.structure(docs, rows, parties, blocks)
    for part in (validate.numbering(rows), validate.empty_clauses(rows), validate.unresolved(rows), validate.dangling(rows), validate.undefined(used, defs), unused):
        out = out.unionByName(part)
    return out


_LOC = lambda n: f"case when {TRIM(chr(99) + 'oalesce(heading, ' + chr(39) * 2 + ')')} = '' then 'clause ' || {n} else 'clause ' || {n} || ' (' || heading || ')' end"
FINDINGS = rf"""
with {NUMBERED.replace('numbered as (', 'plain as (', 1)}, numbered as (select * replace (case when kind = 'clause' then concat_ws(' ', body, '{{{{ v' || number || ' | L}}}}') else body end as body) from plain),
u as (select distinct n.doc_id, t.term from numbered n join live t on t.doc_id = n.doc_id and t.kind = 'definition' and octet_length(encode(t.term)) >= 3 and contains(coalesce(n.body, ''), t.term)),
lf as (select *, coalesce(lead(eff) over (partition by doc_id order by pos) <= eff, true) as leaf from numbered)
select doc_id, 'error' as severity, 'no-parties' as code, 'document' as location, 'the document has no parties' as detail from documents where title is null
union all select doc_id, 'error', 'no-clauses', 'document', 'the document has no clauses' from documents where doc_id not in (select doc_id from numbered)
union all select doc_id, 'error', 'no-execution', 'document', 'the document has no execution' from documents where doc_id not in (select doc_id from live where kind = 'execution')
union all select doc_id, 'error', 'numbering', {_LOC("coalesce(number, '?')")}, 'expected ' || new_number from numbered where number is null or number <> new_number
union all select doc_id, 'error', 'empty-clause', {_LOC('new_number')}, 'clause body is empty' from lf where leaf and {TRIM("coalesce(body, '')")} = ''
union all select doc_id, 'error', 'unresolved-variable', {_LOC('new_number')}, unnest(list_filter(list_transform(regexp_extract_all(coalesce(body, ''), '(?s)\{{\{{(.*?)\}}\}}', 1), lambda x: {TRIM("string_split(x, '|')[1]")}), lambda x: x <> '')) from numbered
union all select n.doc_id, 'error', 'dangling-cross-reference', {_LOC('new_number')}, ref from (select *, unnest(list_distinct(regexp_extract_all(coalesce(body, ''), '(?i)(clauses?\s+)(\d+(?:\.\d+)*)', 2))) as ref from numbered) n where not exists (select 1 from numbered m where m.doc_id = n.doc_id and m.new_number = n.ref)
union all select doc_id, 'warning', 'unused-definition', 'definition "' || term || '"', 'is defined but never used' from (select distinct doc_id, term from live where kind = 'definition' and term is not null) t where not exists (select 1 from u where u.doc_id = t.doc_id and u.term = t.term)
"""


def finding_counts(spark, d):
    return validate.summary(validation_findings(spark, d))


COUNTS = f"select doc_id, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, bool_or(severity = 'error') as has_errors from ({FINDINGS}) group by 1"


def foreign_parties(spark, d):
    """Company-like names in clauses that aren't in the document's title."""
    c = live(spark, d, "doc_id", "seq", "body")
    texts = c.select("doc_id", F.struct("seq", "clause_id").alias("place"), F.concat(F.lit("object "), F.col("clause_id").cast("string")).alias("location"), F.col("body").alias("text"))
    parties = read(spark, d, "documents").where("title is not null").select("doc_id", F.col("title").alias("name"))
    return validate.foreign_parties(texts, parties)


def term_hashes(spark, d):
    """FNV-1a of every distinct word of the headings, with its bucket of 256 and sign."""
    w = live(spark, d, "heading").select(F.explode(tokens(F.coalesce("heading", F.lit("")))).alias("token")).distinct().withColumn("h", fnv1a64(F.col("token")))
    return w.select("token", F.col("h").cast("string").alias("hash"), (F.col("h") % 256).cast("int").alias("bucket"), (F.floor(F.col("h") / F.lit(4294967296).cast("decimal(11,0)")) % 2).cast("int").alias("negative"))


HASHES = rf"""
with {LIVE}, t as (select distinct unnest(list_filter(regexp_split_to_array(strip_accents(lower(coalesce(heading, ''))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) as token from live),
h as (select token, list_reduce(list_prepend(cast('14695981039346656037' as hugeint), list_transform(range(1, len(hex(encode(token))) , 2), lambda i: cast(('0x' || hex(encode(token))[i:i+1]) as hugeint))), lambda a, b: ((a - a % 256 + xor(cast(a % 256 as bigint), cast(b as bigint))) * cast(1099511628211 as hugeint)) % cast('18446744073709551616' as hugeint)) as h from t)
select token, cast(h as varchar) as hash, cast(h % 256 as int) as bucket, cast((h // 4294967296) % 2 as int) as negative from h
"""

QUERIES = {f.__name__: f for f in (clause_labels, definitions_harvest, edges_uses_term, edges_kept, document_objects, tree_numbers, cross_references, definitions_first_wins, schedules_folded, recitals, variable_substitution, unresolved_variables, distinct_variables, terms_in_clauses, missing_required, checklist_order, skeleton_choice, excluded_roots, markdown_render, docx_render, validation_findings, finding_counts, foreign_parties, term_hashes)}
SQL = {
    "clause_labels": LABELS, "definitions_harvest": HARVEST, "edges_uses_term": EDGES, "edges_kept": KEPT, "document_objects": OBJECTS, "tree_numbers": TREE, "cross_references": REFS,
    "definitions_first_wins": FIRST, "schedules_folded": SCHEDULES, "recitals": RECITALS, "variable_substitution": SUBST, "unresolved_variables": UNRES, "distinct_variables": VARIABLES, "terms_in_clauses": TERMS,
    "missing_required": MISSING, "checklist_order": ORDER, "skeleton_choice": SKELETON, "excluded_roots": EXCLUDED, "markdown_render": MARKDOWN, "validation_findings": FINDINGS,
    "finding_counts": COUNTS, "term_hashes": HASHES,
}
