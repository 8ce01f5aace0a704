"""Clause trees as flat rows: effective depths and hierarchical numbers by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def effective_depth(rows: DataFrame, key: str = "doc_id", order: tuple = ("seq", "ord"), depth: str = "depth") -> DataFrame:
    """``pos`` and ``eff``: a row hangs at most one level below the row before it (running minimum, one window)."""
    w = W.partitionBy(key).orderBy(*order)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    p = rows.withColumn("pos", F.row_number().over(w))
    d = F.when(F.col("pos") == 1, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.coalesce(F.col(depth), F.lit(0)), F.lit(255))))
    return p.withColumn("eff", (F.col("pos") + F.min(d - F.col("pos")).over(run)).cast("int"))


def numbered(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``new_number`` like 2.1.3, for trees of any depth.

    The greatest ``eff`` is read first (one number to the driver). Per level one island
    count and one running sum, all over the same partitioning and order, so one shuffle
    and one sort serve all levels.
    """
    run = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    e = F.col("eff")
    levels = 1 + (rows.agg(F.max("eff")).first()[0] or 0)
    for n in range(levels):
        rows = rows.withColumn(f"__isl{n}", F.sum((e < n).cast("int")).over(run))
    for n in range(levels):
        inner = W.partitionBy(key, f"__isl{n}").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumn(f"__ord{n}", F.sum((e == n).cast("int")).over(inner))
    number = F.concat_ws(".", *(F.when(e >= n, F.col(f"__ord{n}")) for n in range(levels)))
    return rows.withColumn("new_number", number).drop(*(f"__{x}{n}" for n in range(levels) for x in ("isl", "ord")))


def number_map(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(``key``, numbers): old number to new; of an old number that repeats the last in order counts."""
    last = rows.where("number is not null").groupBy(key, "number").agg(F.max_by("new_number", "pos").alias("new_number"))
    return last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("number", "new_number"))).alias("numbers"))


def first_wins(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in order."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def fold_schedules(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(``key``, schedule_no, title, body): a schedule without a heading continues the one before it."""
    w = W.partitionBy(key).orderBy("seq", "clause_id")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    s = rows.where("kind = 'schedule'").withColumn("__first", F.row_number().over(w) == 1)
    s = s.withColumn("schedule_no", F.sum((F.col("heading").isNotNull() | F.col("__first")).cast("int")).over(run))
    parts = F.array_sort(F.collect_list(F.struct("seq", "clause_id", F.coalesce("body", F.lit("")).alias("b"), "heading")))
    g = s.groupBy(key, "schedule_no").agg(parts.alias("p"))
    title = F.coalesce(F.col("p")[0]["heading"], F.concat(F.lit("Schedule "), F.col("schedule_no").cast("string")))
    return g.select(key, "schedule_no", title.alias("title"), F.array_join(F.transform("p", lambda x: x["b"]), "\n").alias("body"))
