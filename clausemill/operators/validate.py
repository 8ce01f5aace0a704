"""Findings of an assembled document, as rows (doc_id, severity, code, location, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausemill.functions import tables as T
from clausemill.functions.text import cross_refs, placeholders, terms_used, trim_ws

COLUMNS = ("doc_id", "severity", "code", "location", "detail")


def location(number: Column, heading: Column) -> Column:
    h = F.coalesce(heading, F.lit(""))
    return F.when(trim_ws(h) == "", F.concat(F.lit("clause "), number)).otherwise(F.concat(F.lit("clause "), number, F.lit(" ("), h, F.lit(")")))


def _out(df: DataFrame, severity: str, code: str, loc: Column, detail: Column) -> DataFrame:
    return df.select("doc_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), loc.alias("location"), detail.alias("detail"))


def structure(docs: DataFrame, clauses: DataFrame, parties: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents without parties, clauses or a signature block."""
    out = None
    for name, rows in (("parties", parties), ("clauses", clauses), ("execution", blocks)):
        miss = _out(docs.select("doc_id").join(rows.select("doc_id"), "doc_id", "left_anti"), "error", f"no-{name}", F.lit("document"), F.lit(f"the document has no {name}"))
        out = miss if out is None else out.unionByName(miss)
    return out


def numbering(clauses: DataFrame) -> DataFrame:
    """Numbers that aren't dense and hierarchical; rows carry ``number`` and the ``new_number`` it should be."""
    bad = clauses.where(~F.coalesce(F.col("number") == F.col("new_number"), F.lit(False)))
    return _out(bad, "error", "numbering", location(F.coalesce("number", F.lit("?")), F.col("heading")), F.concat(F.lit("expected "), F.col("new_number")))


def empty_clauses(clauses: DataFrame) -> DataFrame:
    """Leaves without text: the next row in order isn't deeper."""
    nxt = F.lead("eff").over(W.partitionBy("doc_id").orderBy("pos"))
    c = clauses.withColumn("__leaf", F.coalesce(nxt <= F.col("eff"), F.lit(True)))
    return _out(c.where((trim_ws(F.coalesce("body", F.lit(""))) == "") & F.col("__leaf")), "error", "empty-clause", location(F.col("new_number"), F.col("heading")), F.lit("clause body is empty"))


def unresolved(clauses: DataFrame) -> DataFrame:
    x = clauses.select("doc_id", "new_number", "heading", F.explode(placeholders(F.coalesce("body", F.lit("")))).alias("name"))
    return _out(x, "error", "unresolved-variable", location(F.col("new_number"), F.col("heading")), F.col("name"))


def dangling(clauses: DataFrame) -> DataFrame:
    """References to numbers that the document hasn't."""
    refs = clauses.select("doc_id", "new_number", "heading", F.explode(cross_refs(F.coalesce("body", F.lit("")))).alias("ref"))
    there = clauses.select("doc_id", F.col("new_number").alias("ref")).distinct()
    return _out(refs.join(there, ["doc_id", "ref"], "left_anti"), "error", "dangling-cross-reference", location(F.col("new_number"), F.col("heading")), F.col("ref"))


def terms(clauses: DataFrame, defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(used, unused): (doc_id, term) used by clauses; findings of definitions that no clause uses."""
    table = defs.where("term is not null").groupBy("doc_id").agg(F.collect_set("term").alias("__terms"))
    used = clauses.join(table, "doc_id").select("doc_id", F.explode(terms_used(F.coalesce("body", F.lit("")), F.col("__terms"))).alias("term")).distinct()
    idle = defs.where("term is not null").select("doc_id", "term").distinct().join(used, ["doc_id", "term"], "left_anti")
    return used, _out(idle, "warning", "unused-definition", F.concat(F.lit('definition "'), F.col("term"), F.lit('"')), F.lit("is defined but never used"))


def undefined(used: DataFrame, defs: DataFrame) -> DataFrame:
    miss = used.join(defs.select("doc_id", "term").distinct(), ["doc_id", "term"], "left_anti")
    return _out(miss, "warning", "undefined-term", F.lit("document"), F.col("term"))


def entity_names(text: Column) -> Column:
    """Company-like names: capitalised words before a legal suffix, or before the word behind '(Pty)'; distinct, two words at least."""
    suffix = "|".join(T.ENTITY_SUFFIXES)
    by_suffix = F.regexp_extract_all(text, F.lit(rf"((?:(?<!\S)[^\s\p{{L}}\p{{N}}]*\p{{Lu}}\S*\s+)+[^\s\p{{L}}\p{{N}}]*(?i:{suffix})(?=[\s.,;:)]|\z))"), F.lit(1))
    by_pty = F.regexp_extract_all(text, F.lit(r"((?:(?<!\S)\p{Lu}\S*\s+)+\([Pp][Tt][Yy]\)\S*\s+\S+)"), F.lit(1))
    clean = F.transform(F.concat(by_pty, by_suffix), lambda s: F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"^[,.;:]+|[,.;:]+\z", ""))
    return F.array_distinct(F.filter(clean, lambda s: F.size(F.split(s, " ")) >= 2))


def foreign_parties(texts: DataFrame, parties: DataFrame) -> DataFrame:
    """Names that aren't within a party's name, nor a party's name within them; the first place of each.

    ``texts``: doc_id, place (order), location, text; ``parties``: doc_id, name. Parties
    of a document travel as one bounded array beside its names, not as a cross join.
    """
    names = texts.select("doc_id", "place", "location", F.explode(entity_names(F.coalesce("text", F.lit("")))).alias("name"))
    table = parties.groupBy("doc_id").agg(F.collect_set(F.lower("name")).alias("names"))
    low = F.lower("name")
    known = F.exists("names", lambda p: p.contains(low) | low.contains(p))
    left = names.join(table, "doc_id", "left").where(F.col("names").isNull() | ~known)
    first = left.groupBy("doc_id", low.alias("low")).agg(F.min_by(F.struct("location", "name"), "place").alias("x"))
    return _out(first, "warning", "foreign-party-name", F.col("x.location"), F.col("x.name"))


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.bool_or(F.col("severity") == "error").alias("has_errors"))
