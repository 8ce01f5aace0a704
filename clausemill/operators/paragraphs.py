"""Text and HTML into paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausemill.functions.text import WS, all_caps, schedule_like, squash, trim_ws

NUMBERED_LINE = rf"^[0-9][0-9.]*(?:{WS}|\))"


def from_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, para_no, text): lines joined into paragraphs (gaps and islands over one window).

    A line begins a paragraph after a blank or standing-alone line, after a sentence's
    end, or where it is numbered, in capitals, like a schedule's title or opens a
    quotation. Null and empty texts have none.
    """
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("l", trim_ws(F.col("line")))
    caps, sch = all_caps(F.col("l"), 80), schedule_like(F.col("l"))
    alone = ~F.col("l").rlike(r"[,;]\z") & (caps | (sch & (F.octet_length("l") <= 80)))
    opens = F.col("l").rlike(NUMBERED_LINE) | caps | sch | F.col("l").rlike('^["“]')
    w = W.partitionBy(key).orderBy("line_no")
    flagged = lines.select(key, "line_no", "l", alone.alias("alone"), opens.alias("opens"))
    before = F.lag("l").over(w)
    start = before.isNull() | (before == "") | F.lag("alone").over(w) | before.rlike(r"[.;:!?]\z") | F.col("opens")
    grouped = flagged.withColumn("grp", F.sum(start.cast("int")).over(w)).where("l != ''")
    paras = grouped.groupBy(key, "grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "l"))), lambda x: x["l"]), " ").alias("text"))
    return paras.select(key, (F.row_number().over(W.partitionBy(key).orderBy("grp")) - 1).alias("para_no"), squash(F.col("text")).alias("text"))


def decode_entities(x: Column) -> Column:
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


BLOCK_TAG = r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|section|article|blockquote)[^>]*>"
HEADING_TAG = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"
DROP_REGION = r"(?is)<(?:script|style|head)[^>]*>.*?</(?:script|style|head)>"


def from_html(df: DataFrame, key: str, html: str) -> DataFrame:
    """(``key``, para_no, text, heading_level): regions dropped, headings lifted, block tags as line ends, other tags as blanks."""
    x = F.regexp_replace(F.col(html), DROP_REGION, "")
    x = F.regexp_replace(x, HEADING_TAG, "\x01$1\x02$2\x01")
    parts = df.select(key, F.posexplode(F.split(x, "\x01")).alias("part_no", "part"))
    head = F.col("part_no") % 2 == 1
    body = F.regexp_replace(F.regexp_replace(F.col("part"), BLOCK_TAG, "\n"), "<[^>]+>", " ")
    title = F.regexp_replace(F.substring_index("part", "\x02", -1), "<[^>]+>", " ")
    level = F.when(head, F.substring_index("part", "\x02", 1).cast("int"))
    lines = parts.select(key, "part_no", level.alias("heading_level"), F.posexplode(F.when(head, F.array(title)).otherwise(F.split(body, "\n"))).alias("line_no", "line"))
    clean = lines.withColumn("text", squash(decode_entities(F.col("line")))).where("text != ''")
    w = W.partitionBy(key).orderBy("part_no", "line_no")
    return clean.select(key, (F.row_number().over(w) - 1).alias("para_no"), "text", "heading_level")


def heading_level(style: Column) -> Column:
    """Level of a paragraph style: 'title' is 1, 'heading N' is N."""
    s = F.replace(F.lower(style), F.lit(" "), F.lit(""))
    n = F.regexp_extract(s, r"^heading([1-9])$", 1)
    return F.when(s == "title", 1).when(n != "", n.cast("int"))
