"""Paragraphs into knowledge objects: clauses, definitions, recitals, schedules, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausemill.functions import tables as T
from clausemill.functions.text import WS, all_caps, normalize_label, trim_ws

SCHEDULE = r"(?i)^(schedule|annexure|annex|appendix|exhibit)\b"
NUMBER = rf"^([0-9]{{1,3}}(?:\.[0-9]{{1,3}})*)[.)]?{WS}+(.+)\z"
DEFINITION = r"""["“”'']([A-Z][A-Za-z0-9 /\-]{1,60}?)["“”''](?:\s+)(?:shall\s+mean|means|shall\s+have\s+the\s+meaning)"""


def _heading_like(x: Column) -> Column:
    return (F.octet_length(x) <= 90) & ~x.rlike(r"[.;:,]\z") & (F.size(F.filter(F.split(x, rf"{WS}+"), lambda t: t != "")) <= 10)


def _words(x: Column, words) -> Column:
    return F.lower(x).rlike("|".join(words))


def nodes(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(``key``, seq, kind, number, depth, heading, body): one pass of windows over each document.

    Schedule titles, numbered paragraphs and unnumbered headings open a node, other
    paragraphs join the open one; what stands before the first is a recital. Rows are
    ordered by para_no; null texts are left out. Nodes without heading and body are
    dropped before ``seq`` is given. Where ``paragraphs`` has ``ooxml``, the raw XML of the
    node's paragraphs comes along as an array.
    """
    raw = "ooxml" in paragraphs.columns
    t = trim_ws(F.col("text"))
    p = paragraphs.where("text is not null").select(key, "para_no", F.col("heading_level"), t.alias("t"), *(["ooxml"] if raw else [])).where("t != ''")
    p = p.withColumn("is_s", F.col("t").rlike(SCHEDULE) & (F.octet_length("t") <= 80))
    p = p.withColumn("path", F.regexp_extract("t", NUMBER, 1)).withColumn("rest", F.regexp_extract("t", NUMBER, 2))
    p = p.withColumn("is_n", ~F.col("is_s") & (F.col("path") != ""))
    p = p.withColumn("is_u", ~F.col("is_s") & ~F.col("is_n") & ((F.col("heading_level").isNotNull() & (F.octet_length("t") <= 120)) | all_caps(F.col("t"), 60)))
    p = p.withColumn("d", F.when(F.col("is_n"), F.octet_length("path") - F.octet_length(F.replace("path", F.lit("."), F.lit("")))).otherwise(0))
    p = p.withColumn("h", F.when(F.col("is_s") | F.col("is_u"), F.col("t")).when(F.col("is_n") & _heading_like(F.col("rest")), F.col("rest")))
    w = W.partitionBy(key).orderBy("para_no").rowsBetween(W.unboundedPreceding, 0)
    p = p.withColumn("sch", F.max(F.col("is_s").cast("int")).over(w)).withColumn("seen", F.max(F.col("is_n").cast("int")).over(w))
    kind = (
        F.when(F.col("sch") == 1, "schedule")
        .when(_words(F.coalesce("h", F.lit("")), T.EXECUTION_WORDS), "execution")
        .when(_words(F.coalesce("h", F.lit("")), T.RECITAL_WORDS) | (F.col("seen") == 0), "recital")
        .otherwise("clause")
    )
    own = F.when(F.col("is_s"), "schedule").when(F.col("is_u"), kind).when(F.col("is_n") & (F.col("h").isNotNull() | (F.col("d") == 0)), kind)
    p = p.withColumn("own", own).withColumn("opens", (F.col("is_s") | F.col("is_n") | F.col("is_u")).cast("int"))
    p = p.withColumn("kind", F.coalesce(F.last("own", ignorenulls=True).over(w), F.lit("recital"))).withColumn("node", F.sum("opens").over(w))
    p = p.withColumn("body", F.when(F.col("opens") == 0, F.col("t")).when(F.col("is_n") & F.col("h").isNull(), F.col("rest")))
    first = lambda c: F.min_by(c, "para_no")
    g = p.groupBy(key, "node").agg(
        first("kind").alias("kind"),
        first(F.when(F.col("is_n"), F.col("path")).otherwise("")).alias("number"),
        first("d").alias("depth"),
        first(F.coalesce("h", F.lit("\x00"))).alias("heading"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("para_no", "body")))), lambda x: x["body"]), "\n").alias("body"),
        *([F.transform(F.array_sort(F.collect_list(F.when(F.col("body").isNotNull() & F.col("ooxml").isNotNull(), F.struct("para_no", "ooxml")))), lambda x: x["ooxml"]).alias("ooxml")] if raw else []),
    )
    g = g.withColumn("heading", F.when(F.col("heading") != "\x00", F.col("heading"))).withColumn("number", F.when(F.col("number") != "", F.col("number")))
    kept = g.where((F.col("heading").isNotNull()) | (trim_ws(F.col("body")) != ""))
    seq = F.row_number().over(W.partitionBy(key).orderBy("node")) - 1
    return kept.select(key, seq.alias("seq"), "kind", "number", F.col("depth").cast("int").alias("depth"), "heading", "body", *(["ooxml"] if raw else []))


def definitions(clauses: DataFrame, key: str = "doc_id", keep=("seq",)) -> DataFrame:
    """(``key``, *keep, line_no, term, body): every defined term of every line of a body."""
    lines = clauses.select(key, *keep, F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    found = lines.select(key, *keep, "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(DEFINITION), F.lit(1))).alias("match_no", "term"), trim_ws(F.col("line")).alias("body"))
    return found.withColumn("term", trim_ws(F.col("term")))


def objects(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Nodes with harvested definitions, their order ``ord``, short noise dropped (after seq is given)."""
    n = nodes(paragraphs, key).withColumn("term", F.lit(None).cast("string")).withColumn("o", F.struct(F.lit(0).alias("d"), "seq", F.lit(0).alias("l"), F.lit(0).alias("m")))
    d = definitions(n, key).select(key, "seq", F.lit("definition").alias("kind"), F.lit(None).cast("string").alias("number"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("heading"), "body", "term", F.struct(F.lit(1).alias("d"), "seq", F.col("line_no").alias("l"), F.col("match_no").alias("m")).alias("o"))
    both = n.unionByName(d, allowMissingColumns=True).withColumn("ord", F.row_number().over(W.partitionBy(key).orderBy("o")) - 1).drop("o")
    return both.where((F.octet_length("body") >= 40) | (F.col("kind") == "definition") | F.col("heading").isNotNull())


def titles(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(``key``, title): the first paragraph of 4 to 120 bytes, as a label."""
    t = trim_ws(F.col("text"))
    p = paragraphs.where("text is not null").select(key, "para_no", t.alias("t")).where((F.octet_length("t") >= 4) & (F.octet_length("t") <= 120))
    return p.groupBy(key).agg(F.min_by("t", "para_no").alias("t")).select(key, normalize_label(F.col("t")).alias("title"))


def embedding_text(heading: Column, term: Column, body: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(heading, term), body)
