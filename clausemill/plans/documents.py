"""Queries on documents, paragraphs and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausemill.functions import tables as T
from clausemill.functions.text import WS, default_file_name, slug, snippet_chars
from clausemill.operators import assemble, index, label, paragraphs, registry, segment
from clausemill.plans.sql import FAMILY, LABEL, NORM, SQUASH, TITLE, TRIM, family
from clausemill.session import read


def unique_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with each para_id once (repeated rows are identical)."""
    return read(spark, sf_dir, "paragraphs").select("para_id", "doc_id", "para_no", "text", "heading_level").dropDuplicates(["para_id"])


def paragraphs_from_text(spark, d):
    return paragraphs.from_text(read(spark, d, "documents").select("doc_id", "text"))


LINES = rf"""
with l as (select doc_id, u.i as line_no, {TRIM('u.line')} as l from (select doc_id, unnest(list_zip(range(len(string_split(text, chr(10)))), string_split(text, chr(10)))) as s from documents where text is not null) x, lateral (select s[1] as i, s[2] as line) u),
f as (select *, octet_length(encode(l)) <= 80 and regexp_matches(l, '\p{{L}}') and not regexp_matches(l, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]') as caps, regexp_matches(l, '(?i)^(schedule|annexure|annex |appendix|exhibit)') as sch from l),
g as (select *, not regexp_matches(l, '[,;]\z') and (caps or (sch and octet_length(encode(l)) <= 80)) as alone, regexp_matches(l, '^[0-9][0-9.]*(?:{WS}|\))') or caps or sch or regexp_matches(l, '^["“]') as opens from f),
h as (select *, lag(l) over w as before, lag(alone) over w as balone from g window w as (partition by doc_id order by line_no)),
k as (select *, sum(case when before is null or before = '' or balone or regexp_matches(before, '[.;:!?]\z') or opens then 1 else 0 end) over (partition by doc_id order by line_no) as grp from h),
p as (select doc_id, grp, string_agg(l, ' ' order by line_no) as t from k where l <> '' group by 1, 2)
select doc_id, cast(row_number() over (partition by doc_id order by grp) - 1 as int) as para_no, {SQUASH('t')} as text from p
"""


def html_paragraphs(spark, d):
    docs = read(spark, d, "documents")
    html = F.concat(F.lit("<html><head><title>x</title></head><body><h2 class='t'>"), F.coalesce("title", F.lit("")), F.lit("</h2><p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></body></html>"))
    return paragraphs.from_html(docs.where("text is not null").select("doc_id", html.alias("html")), "doc_id", "html").select("doc_id", "para_no", "text", "heading_level")


HTML = rf"""
with h as (select doc_id, '<html><head><title>x</title></head><body><h2 class=''t''>' || coalesce(title, '') || '</h2><p>' || replace(replace(text, '&', '&amp;'), chr(10), '</p><p>') || '</p></body></html>' as x from documents where text is not null),
a as (select doc_id, regexp_replace(regexp_replace(x, '(?is)<(?:script|style|head)[^>]*>.*?</(?:script|style|head)>', '', 'g'), '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', chr(1) || '\1' || chr(2) || '\2' || chr(1), 'g') as x from h),
b as (select doc_id, unnest(list_zip(range(len(string_split(x, chr(1)))), string_split(x, chr(1)))) as s from a),
c as (select doc_id, s[1] as part_no, case when s[1] % 2 = 1 then cast(string_split(s[2], chr(2))[1] as int) end as heading_level, case when s[1] % 2 = 1 then [regexp_replace(string_split(s[2], chr(2))[-1], '<[^>]+>', ' ', 'g')] else string_split(regexp_replace(regexp_replace(s[2], '(?i)</?(?:p|div|br|li|ul|ol|tr|table|section|article|blockquote)[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), chr(10)) end as lines from b),
e as (select doc_id, part_no, heading_level, unnest(list_zip(range(len(lines)), lines)) as s from c),
t as (select doc_id, part_no, heading_level, s[1] as line_no, {SQUASH("replace(replace(replace(replace(replace(replace(replace(s[2], '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', '''')")} as text from e)
select doc_id, cast(row_number() over (partition by doc_id order by part_no, line_no) - 1 as int) as para_no, text, heading_level from t where text <> ''
"""


def segment_nodes(spark, d):
    return segment.nodes(unique_paragraphs(spark, d))


SEGMENT = rf"""
with u as (select distinct para_id, doc_id, para_no, {TRIM('text')} as t, heading_level from paragraphs where text is not null),
a as (select *, regexp_matches(t, '(?i)^(schedule|annexure|annex|appendix|exhibit)\b') and octet_length(encode(t)) <= 80 as is_s,
  regexp_extract(t, '(?s)^([0-9]{{1,3}}(?:\.[0-9]{{1,3}})*)[.)]?{WS}+([^\n]+)\z', 1) as path, regexp_extract(t, '(?s)^([0-9]{{1,3}}(?:\.[0-9]{{1,3}})*)[.)]?{WS}+([^\n]+)\z', 2) as rest from u where t <> ''),
b as (select *, not is_s and path <> '' as is_n from a),
c as (select *, not is_s and not is_n and ((heading_level is not null and octet_length(encode(t)) <= 120) or (octet_length(encode(t)) <= 60 and regexp_matches(t, '\p{{L}}') and not regexp_matches(t, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]'))) as is_u,
  case when is_n then len(path) - len(replace(path, '.', '')) else 0 end as d from b),
e as (select *, case when is_s or is_u then t when is_n and octet_length(encode(rest)) <= 90 and not regexp_matches(rest, '[.;:,]\z') and len(list_filter(regexp_split_to_array(rest, '{WS}+'), lambda x: x <> '')) <= 10 then rest end as h from c),
f as (select *, max(case when is_s then 1 else 0 end) over w as sch, max(case when is_n then 1 else 0 end) over w as seen from e window w as (partition by doc_id order by para_no)),
g as (select *, case when sch = 1 then 'schedule' when regexp_matches(lower(coalesce(h, '')), 'signature|signed|execution') then 'execution' when regexp_matches(lower(coalesce(h, '')), 'recital|preamble|introduction|whereas|background') or seen = 0 then 'recital' else 'clause' end as nk from f),
i as (select *, case when is_s then 'schedule' when is_u then nk when is_n and (h is not null or d = 0) then nk end as own, case when is_s or is_n or is_u then 1 else 0 end as opens from g),
j as (select *, coalesce(last_value(own ignore nulls) over w, 'recital') as kind, sum(opens) over w as node, case when opens = 0 then t when is_n and h is null then rest end as b from i window w as (partition by doc_id order by para_no)),
k as (select doc_id, node, arg_min(kind, para_no) as kind, arg_min(case when is_n then path else '' end, para_no) as number, arg_min(d, para_no) as depth, arg_min(coalesce(h, chr(1)), para_no) as heading, coalesce(string_agg(b, chr(10) order by para_no), '') as body from j group by 1, 2)
select doc_id, cast(row_number() over (partition by doc_id order by node) - 1 as int) as seq, kind, nullif(number, '') as number, cast(depth as int) as depth, nullif(heading, chr(1)) as heading, body from k where heading <> chr(1) or {TRIM('body')} <> ''
"""


def document_titles(spark, d):
    return segment.titles(unique_paragraphs(spark, d))


TITLES = f"""
with p as (select distinct para_id, doc_id, para_no, {TRIM('text')} as t from paragraphs where text is not null),
q as (select doc_id, arg_min(t, para_no) as t from p where octet_length(encode(t)) between 4 and 120 group by 1)
select doc_id, {TITLE('t')} as title from q
"""


def contract_types(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "rel_path", "text")
    name = F.substring_index(F.replace("rel_path", F.lit("\\"), F.lit("/")), "/", -1)
    return label.with_document_labels(docs, name).select("doc_id", "contract_type", "jurisdiction")


_INSTR = "|".join(T.INSTRUMENTS)
_INSTR_LIST = ", ".join(f"'{x}'" for x in T.INSTRUMENTS)
TYPES = rf"""
with d as (select doc_id, coalesce(text, '') as text, string_split(replace(rel_path, '\', '/'), '/')[-1] as name from documents),
l as (select *, list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10))[1:40], lambda x: {TRIM('x')}), lambda x: x <> '' and octet_length(encode(x)) <= 90 and regexp_matches(lower(x), '{_INSTR}') and len(regexp_split_to_array(x, '{WS}+')) <= 10), lambda x: {TITLE('x')}), lambda x: x <> '' and lower(x) not in ({_INSTR_LIST})) as labels, {TRIM("regexp_split_to_array(regexp_replace(name, '[.][^.]*$', ''), '[-_]')[1]")} as stem from d),
n as (select *, {TITLE('stem')} as own, {NORM('name')} as a, {NORM('text[1:2000]')} as b, {NORM('text')} as c from l)
select doc_id, coalesce({family('a', T.CONTRACT_FAMILIES)}, {family('b', T.CONTRACT_FAMILIES)}, labels[1], case when regexp_matches(lower(stem), '{_INSTR}') and own <> '' and lower(own) not in ({_INSTR_LIST}) then own end) as contract_type, {family('c', T.JURISDICTIONS)} as jurisdiction from n
"""


def scan_diff(spark, d):
    docs = read(spark, d, "documents").select("source", "rel_path", "content_hash", "batch_no", "deleted")
    return index.scan_diff(docs.where("batch_no >= 3"), docs.where("batch_no <= 6 and not deleted"))


SCAN = """
select coalesce(a.source, b.source) as source, coalesce(a.rel_path, b.rel_path) as rel_path,
 case when b.source is null then 'new' when a.source is null then 'removed' when a.content_hash is not distinct from b.content_hash then 'unchanged' else 'changed' end as outcome
from (select source, rel_path, content_hash from documents where batch_no >= 3) a
full outer join (select source, rel_path, content_hash from documents where batch_no <= 6 and not deleted) b on a.source = b.source and a.rel_path = b.rel_path
"""


def scan_counters(spark, d):
    return scan_diff(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("files"))


def source_stats(spark, d):
    docs, cl = read(spark, d, "documents"), read(spark, d, "clauses")
    live = docs.where("not deleted")
    n = cl.select("clause_id", "doc_id").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    g = live.join(n, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("live_docs"), F.count("title").alias("titled_docs"), F.sum(F.coalesce("n", F.lit(0))).alias("objects"))
    return g.withColumn("needs_rebuild", (F.col("live_docs") > 0) & (F.col("titled_docs") == 0))


STATS = """
with n as (select doc_id, count(distinct clause_id) as n from clauses group by 1)
select source, count(*) as live_docs, count(title) as titled_docs, cast(sum(coalesce(n, 0)) as bigint) as objects, count(*) > 0 and count(title) = 0 as needs_rebuild
from documents left join n using (doc_id) where not deleted group by 1
"""


def document_list(spark, d):
    cl = read(spark, d, "clauses").select("clause_id", "doc_id", "kind").dropDuplicates(["clause_id"])
    return assemble.clause_counts(read(spark, d, "documents"), cl).select("doc_id", "source", "rel_path", "title", "contract_type", "clause_count")


DOCLIST = """
with n as (select doc_id, count(distinct clause_id) as n from clauses where kind = 'clause' group by 1)
select doc_id, source, rel_path, title, contract_type, coalesce(n, 0) as clause_count from documents left join n using (doc_id) where not deleted
"""


def contract_type_menu(spark, d):
    docs = assemble.clause_counts(read(spark, d, "documents"), read(spark, d, "clauses").select("clause_id", "doc_id", "kind").dropDuplicates(["clause_id"]))
    att = registry.attached(read(spark, d, "sources")).select(F.col("name").alias("source"))
    g = docs.where("clause_count > 0 and contract_type is not null").join(att, "source", "left_semi").groupBy("contract_type").agg(F.count(F.lit(1)).alias("precedents"))
    return g.orderBy(F.desc("precedents"), "contract_type")


MENU = """
select contract_type, count(*) as precedents from documents d where not deleted and contract_type is not null and exists (select 1 from clauses c where c.doc_id = d.doc_id and c.kind = 'clause')
and source in (select name from sources where attached) group by 1 order by 2 desc, 1
"""


def donor_mode(spark, d):
    """The most frequent source of each contract type; of equal ones the first by name."""
    n = read(spark, d, "documents").where("contract_type is not null").groupBy("contract_type", "source").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("contract_type").agg(F.min_by(F.struct("source", "n"), F.struct((-F.col("n")).alias("m"), "source")).alias("b")).select("contract_type", F.col("b.source").alias("source"), F.col("b.n").alias("n"))


DONOR = """
with n as (select contract_type, source, count(*) as n from documents where contract_type is not null group by 1, 2)
select contract_type, source, n from (select *, row_number() over (partition by contract_type order by n desc, source) as r from n) where r = 1
"""


def index_upsert(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", "rel_path", "content_hash", "batch_no", "deleted")
    old, new = docs.where("batch_no <= 6"), docs.where("batch_no >= 5")
    gone = docs.where("batch_no = 2").select("source", "rel_path")
    return index.tombstone(index.upsert(old, new), gone)


UPSERT = """
with o as (select * from documents where batch_no <= 6), n as (select * from documents where batch_no >= 5),
u as (select * from o where not exists (select 1 from n where n.source = o.source and n.rel_path = o.rel_path) union all select * from n)
select doc_id, source, rel_path, content_hash, batch_no, deleted or exists (select 1 from documents g where g.batch_no = 2 and g.source = u.source and g.rel_path = u.rel_path) as deleted from u
"""


def attached_sources(spark, d):
    s = read(spark, d, "sources")
    s = registry.set_attached(registry.set_attached(s, "Ostrel Leases", True), "Marvick Leases", False)
    return registry.remove_source(registry.attached(s), "Rusklow Leases").select("source_id", "name", "attached")


SOURCES = """
select source_id, name, true as attached from sources where case when name = 'Ostrel Leases' then true when name = 'Marvick Leases' then false else attached end and name <> 'Rusklow Leases'
"""


def settings_upsert(spark, d):
    """The last value of each event, over the first ones, as key and value."""
    log = read(spark, d, "audit_log").dropDuplicates(["audit_id"])
    old = log.groupBy(F.col("event").alias("key")).agg(F.min_by("audit_id", F.struct("ts", "audit_id")).cast("string").alias("value"))
    new = log.where("details is not null").groupBy(F.col("event").alias("key")).agg(F.max_by("audit_id", F.struct("ts", "audit_id")).cast("string").alias("value"))
    return registry.put_settings(old, new)


SETTINGS = """
with l as (select distinct * from audit_log),
o as (select event as key, cast(arg_min(audit_id, (ts, audit_id)) as varchar) as value from l group by 1),
n as (select event as key, cast(arg_max(audit_id, (ts, audit_id)) as varchar) as value from l where details is not null group by 1)
select * from n union all select * from o where key not in (select key from n)
"""


def audit_events(spark, d):
    e = registry.event_details(read(spark, d, "audit_log"))
    return e.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.count("parsed").alias("n_json"), F.sum(F.expr("try_variant_get(parsed, '$.hits', 'bigint')")).alias("hits"))


AUDIT = """
select event, count(*) as n, count(*) filter (json_valid(details)) as n_json, cast(sum(try_cast(case when json_valid(details) then json_extract_string(details, '$.hits') end as bigint)) as bigint) as hits from (select distinct * from audit_log) group by 1
"""


def document_cards(spark, d):
    """What a listing shows: name, slug and a snippet."""
    docs = read(spark, d, "documents")
    head = F.coalesce("title", F.substring_index(F.replace("rel_path", F.lit("\\"), F.lit("/")), "/", -1))
    return docs.select("doc_id", head.alias("name"), slug(head, "document").alias("slug"), snippet_chars(F.coalesce("text", F.lit(""))).alias("snippet"), default_file_name(head).alias("file_name"))


CARDS = r"""
with h as (select doc_id, coalesce(title, string_split(replace(rel_path, '\', '/'), '/')[-1]) as name, coalesce(text, '') as text from documents),
s as (select *, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from h)
select doc_id, name, case when slug = '' then 'document' else slug end as slug, case when length(text) <= 320 then text else text[1:320] || '…' end as snippet,
 case when regexp_replace(name, '^\s+|\s+$', '', 'g') = '' then 'draft' else regexp_replace(name, '[^A-Za-z0-9_.-]+', '_', 'g') end as file_name from s
"""

def provenance_files(spark, d):
    """Where each document's file lies, by its source's folder."""
    return registry.provenance(read(spark, d, "documents"), read(spark, d, "sources"))


PROVENANCE = r"select doc_id, d.source, regexp_replace(s.folder, '/+$', '') || '/' || replace(rel_path, chr(92), '/') as file from documents d join sources s on s.name = d.source"

QUERIES = {f.__name__: f for f in (paragraphs_from_text, html_paragraphs, segment_nodes, document_titles, contract_types, scan_diff, scan_counters, source_stats, document_list, contract_type_menu, donor_mode, index_upsert, attached_sources, settings_upsert, audit_events, document_cards, provenance_files)}
SQL = {
    "paragraphs_from_text": LINES, "html_paragraphs": HTML, "segment_nodes": SEGMENT, "document_titles": TITLES, "contract_types": TYPES, "scan_diff": SCAN,
    "scan_counters": f"select outcome, count(*) as files from ({SCAN}) group by 1", "source_stats": STATS, "document_list": DOCLIST, "contract_type_menu": MENU, "donor_mode": DONOR,
    "index_upsert": UPSERT, "attached_sources": SOURCES, "settings_upsert": SETTINGS, "audit_events": AUDIT, "document_cards": CARDS, "provenance_files": PROVENANCE,
}
