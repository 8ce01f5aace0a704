"""Problem 8: texts cut by field limits or in transfer.

Lengths at which a source's texts stop far more often than at neighbouring lengths are
found by discrete hazards over window functions, under false-discovery control. An
incomplete ending (open, or one that could be either, such as a list item) at such a
length of its source is a cut by that limit. A transfer may break off anywhere, so that an
open ending at any other length is a cut too, by a mark that it has left or by itself;
``evidence`` says which of the three it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausemill.functions.text import WS
from clausemill.session import read

#: Fixed values. Marks that a transfer leaves: ellipsis, broken character, begun entity or bracket.
MARKS = r"(?:…|\.{3,}|\[(?:…|\.{3})\]?|�|(?:^|[\s\p{L}])&[a-z]{0,7}|\[(?:truncated|cut|more)\]?)\z"
#: A sentence's end, with closing quotes and brackets.
STOP = r"""[.!?。！？]["'”’»)\]]*\z"""
#: A full stop that stands inside a number: grouped thousands without their cents, half a clause number, an ordinal.
INSIDE = r"(?:\d,\d{3}|\b(?:[Cc]lauses?|[Ss]ections?|§§?)\s*\d+|\b(?:zum|am|vom)\s+\d{1,2})\.\z"
#: Lines that end whole without a full stop.
CLOSERS = (
    r"\A\[[^\[\]]{3,60}\]\z",
    r"\A(?:\*\s?){3,}\z",
    r"\A[-–—]\s.{3,60}\s[-–—]\z",
    r"\AE\s?&\s?O\s?E\z",
    r"(?i)\Aencl(?:osures?|s)?\.?\s*\(\d+\)\z",
    r"\A[Ss]igned (?:at|in) \S.* on \d{1,2}(?:st|nd|rd|th)? \p{L}+ \d{4}\z",
    r"\A(?:THUS )?(?:DONE AND )?SIGNED (?:AT|IN) [\p{Lu} -]+\z",
    r"(?i)\A(?:annexure|annex|schedule|appendix|exhibit)\s+[A-Z0-9]{1,3}\z",
)
#: Lines that may be whole or cut; the source's limits decide.
EITHER = (r"\A(?:\([a-z0-9]{1,3}\)|[-*•–]|\d+[.)]|[a-z]\))\s+\S", r"_{3,}\z", r"(?i)\Acc:\s*\S")
BLANK_END = WS[:-1] + r"\p{Cc}\x{200B}\x{FEFF}]+\z"  # one class: an alternation costs far more on every blank
#: A word on a line of its own below a name, as under a signature.
ROLE, SIGNED = r"\A\p{Lu}\p{Ll}+\z", r"\A\p{Lu}[^.,;:]{2,60}\z"


def _any(line: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | line.rlike(p)
    return out


def ending(text: Column) -> Column:
    """'none' (null, empty or blank), 'open', 'whole' or 'either'."""
    tail = F.regexp_replace(text, BLANK_END, "")
    line = F.regexp_replace(F.substring_index(tail, "\n", -1), rf"^{WS}+", "")
    before = F.regexp_replace(F.substring_index(F.substring_index(tail, "\n", -2), "\n", 1), rf"^{WS}+|{WS}+\z", "")
    role = line.rlike(ROLE) & (F.size(F.split(tail, "\n")) > 1) & before.rlike(SIGNED)
    return (
        F.when(text.isNull() | (tail == ""), "none")
        .when(tail.rlike(MARKS), "open")
        .when(_any(line, CLOSERS), "whole")
        .when(line.rlike(STOP), F.when(line.rlike(INSIDE), "open").otherwise("whole"))
        .when(_any(line, EITHER), "either")
        .when(role, "whole")
        .otherwise("open")
    )


def limits(lengths: DataFrame, keys: list[str], length: str, near: int = 20, rate: float = 0.001, least: int = 5) -> DataFrame:
    """Lengths of each group at which texts stop too often: ``keys``, ``length``, n, at_risk, hazard, expected.

    The hazard of a length is the share of the texts of at least that length that have
    exactly it. It is held against the pooled hazard of the ``near`` lengths on either
    side (with half a text added, so that it is never zero) by Chernoff's bound on the
    Poisson tail, under Benjamini and Hochberg's control of false discoveries at ``rate``
    within each group. Counts are aggregated before any window, so that a window holds
    at most one row per length, however many texts a group has.
    """
    n = lengths.where(F.col(length).isNotNull()).groupBy(*keys, length).agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy(*keys)
    around = by.orderBy(F.col(length).cast("long"))
    n = n.withColumn("at_risk", F.sum("n").over(around.rangeBetween(0, W.unboundedFollowing)))
    close = around.rangeBetween(-near, near)
    # Each length in the window exposes all that are at least as long; that is at most what the shortest exposes.
    n = n.withColumn("others", F.sum("n").over(close) - F.col("n")).withColumn("expected", (F.col("others") + 0.5) / (2.0 * near))
    x, m = F.col("n").cast("double"), F.greatest(F.col("expected"), F.lit(1e-9))
    n = n.withColumn("log_p", F.when(x > m, -(x * F.log(x / m) - x + m)).otherwise(0.0))
    ranked = n.withColumn("place", F.row_number().over(by.orderBy("log_p", length))).withColumn("tests", F.count(F.lit(1)).over(by))
    ranked = ranked.withColumn("ok", F.col("log_p") <= F.log(F.lit(rate) * F.col("place") / F.col("tests")))
    passed = F.max(F.when(F.col("ok"), F.col("place"))).over(by)
    return (
        ranked.withColumn("passed", passed)
        .where((F.col("place") <= F.col("passed")) & (F.col("n") >= least))
        .select(*keys, length, "n", "at_risk", (F.col("n") / F.col("at_risk")).alias("hazard"), "expected")
    )


def flag(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with ``ending``, ``cut`` and ``evidence`` ('limit', 'mark' or 'ending' of a cut text, else null).

    Whatever its mark, an incomplete text at a significant length of its source is cut by that limit.
    Null, empty and blank texts are never cut. A null source is a source of its own.
    Repeated rows are flagged alike; a column of ``docs`` with one of the added names is
    replaced. One pass reads the lengths (aggregated before the shuffle); the limits,
    at most some per source, are joined back on source and length.
    """
    # The lengths are taken before the join, so that a plan that drops the text needn't carry it.
    e = docs.withColumn("ending", ending(F.col(text))).withColumn("__n", F.length(text)).withColumn("__o", F.octet_length(text))
    sizes = docs.select(F.col(source).alias("__s"), F.explode(F.array(F.struct(F.lit("chars").alias("m"), F.length(text).alias("l")), F.struct(F.lit("bytes").alias("m"), F.octet_length(text).alias("l")))).alias("x"))
    found = limits(sizes.select("__s", F.col("x.m").alias("__m"), F.col("x.l").alias("__l")), ["__s", "__m"], "__l")
    at = found.groupBy("__s").agg(F.collect_set(F.when(F.col("__m") == "chars", F.col("__l"))).alias("__c"), F.collect_set(F.when(F.col("__m") == "bytes", F.col("__l"))).alias("__b"))
    j = e.join(at, e[source].eqNullSafe(at["__s"]), "left")
    here = F.coalesce(F.array_contains("__c", F.col("__n")) | F.array_contains("__b", F.col("__o")), F.lit(False))
    j = j.withColumn("cut", F.coalesce((F.col("ending") == "open") | ((F.col("ending") == "either") & here), F.lit(False)))
    marked = F.regexp_replace(F.col(text), BLANK_END, "").rlike(MARKS)
    return j.withColumn("evidence", F.when(F.col("cut"), F.when(here, "limit").when(marked, "mark").otherwise("ending"))).drop("__s", "__c", "__b", "__n", "__o")


EVIDENCE = ("limit", "mark", "ending")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return flag(docs).where("cut").select("doc_id", "source").dropDuplicates()


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The character limits that the sources show."""
    docs = read(spark, sf_dir, "documents").select("source", F.length("text").alias("length")).where("length > 0")
    return limits(docs, ["source"], "length").select("source", F.col("length").cast("long").alias("length"), "n", "at_risk", F.round("hazard", 9).alias("hazard"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source's texts are cut, and by which evidence."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    f = flag(docs).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("cut").alias("n_cut"), *(F.count_if(F.col("evidence") == e).alias(f"n_{e}") for e in EVIDENCE))
    return f.withColumn("share", F.round(F.col("n_cut") / F.col("n_docs"), 6))


LIMITS_SQL = """
with n as (select source, length(text) as length, count(*) as n from documents where length(text) > 0 group by 1, 2),
r as (select *, sum(n) over (partition by source order by length range between current row and unbounded following) as at_risk,
  (sum(n) over (partition by source order by length range between 20 preceding and 20 following) - n + 0.5) / 40.0 as expected from n),
p as (select *, case when n > expected then -(n * ln(n / expected) - n + expected) else 0.0 end as log_p from r),
k as (select *, row_number() over (partition by source order by log_p, length) as place, count(*) over (partition by source) as tests from p),
m as (select *, max(case when log_p <= ln(0.001 * place / tests) then place end) over (partition by source) as passed from k)
select source, cast(length as bigint) as length, n, cast(at_risk as bigint) as at_risk, round(n / at_risk, 9) as hazard from m where place <= passed and n >= 5
"""


def _either(x: str, patterns: tuple[str, ...]) -> str:
    return " or ".join(f"regexp_matches({x}, '{p}')" for p in patterns)


_STOP = STOP.replace("'", "''")
FLAG_SQL = rf"""
d as (select doc_id, source, text, regexp_replace(text, '{BLANK_END}', '') as tail, length(text) as chars, octet_length(encode(text)) as bytes from documents),
q as (select *, string_split(tail, chr(10)) as parts, regexp_replace(string_split(tail, chr(10))[-1], '^{WS}+', '') as line, regexp_replace(coalesce(string_split(tail, chr(10))[-2], ''), '^{WS}+|{WS}+\z', '', 'g') as above from d),
e as (select *, regexp_matches(tail, '{MARKS}') as marked, case when tail is null or tail = '' then 'none' when regexp_matches(tail, '{MARKS}') then 'open' when {_either('line', CLOSERS)} then 'whole'
  when regexp_matches(line, '{_STOP}') then case when regexp_matches(line, '{INSIDE}') then 'open' else 'whole' end
  when {_either('line', EITHER)} then 'either' when regexp_matches(line, '{ROLE}') and len(parts) > 1 and regexp_matches(above, '{SIGNED}') then 'whole' else 'open' end as ending from q),
n as (select source, m, l, count(*) as n from (select source, 'c' as m, chars as l from d union all select source, 'b', bytes from d) where l is not null group by 1, 2, 3),
r as (select *, (sum(n) over (partition by source, m order by l range between 20 preceding and 20 following) - n + 0.5) / 40.0 as expected from n),
p as (select *, case when n > expected then -(n * ln(n / expected) - n + expected) else 0.0 end as log_p from r),
k as (select *, row_number() over (partition by source, m order by log_p, l) as place, count(*) over (partition by source, m) as tests from p),
x as (select *, max(case when log_p <= ln(0.001 * place / tests) then place end) over (partition by source, m) as passed from k),
lim as (select source, m, l from x where place <= passed and n >= 5),
h as (select e.*, exists (select 1 from lim where lim.source is not distinct from e.source and (m = 'c' and l = chars or m = 'b' and l = bytes)) as here from e),
flagged as (select doc_id, source, here, marked, ending = 'open' or (ending = 'either' and here) as cut from h)
"""
FOUND_SQL = f"with {FLAG_SQL} select distinct doc_id, source from flagged where cut"
RATES_SQL = f"""
with {FLAG_SQL} select source, count(*) as n_docs, count(*) filter (cut) as n_cut, count(*) filter (cut and here) as n_limit, count(*) filter (cut and not here and marked) as n_mark,
  count(*) filter (cut and not here and not marked) as n_ending, round(count(*) filter (cut) / count(*), 6) as share from flagged group by 1
"""


def queries() -> dict:
    return {"p8_found": p8_found, "p8_limits": p8_limits, "p8_rates": p8_rates}


def oracle_sql() -> dict:
    return {"p8_found": FOUND_SQL, "p8_limits": LIMITS_SQL, "p8_rates": RATES_SQL}
