"""Sources, settings and the audit log as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_source(sources: DataFrame, row: DataFrame) -> DataFrame:
    """Append a source; a name that exists already is refused."""
    if sources.join(row.select("name"), "name", "left_semi").limit(1).count():
        raise ValueError("a source with this name exists")
    return sources.unionByName(row, allowMissingColumns=True)


def set_attached(sources: DataFrame, name: str, attached: bool) -> DataFrame:
    return sources.withColumn("attached", F.when(F.col("name") == name, F.lit(attached)).otherwise(F.col("attached")))


def remove_source(sources: DataFrame, name: str) -> DataFrame:
    return sources.where(~F.col("name").eqNullSafe(F.lit(name)))


def attached(sources: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Attached sources by name; a scope is matched without regard to case, an empty one is all."""
    out = sources.where("attached")
    if scope:
        out = out.where(F.lower("name").isin(*[s.lower() for s in scope]))
    return out.orderBy("name")


def setting(settings: DataFrame, key: str):
    """The value of a key, read as JSON where it is JSON; null where there is none."""
    row = settings.where(F.col("key") == key).select("value").first()
    if row is None or row.value is None:
        return None
    try:
        return json.loads(row.value)
    except json.JSONDecodeError:
        return row.value


def delete_setting(settings: DataFrame, key: str) -> DataFrame:
    return settings.where(~F.col("key").eqNullSafe(F.lit(key)))


def provenance(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, source, file): where each document's file lies; documents of an unknown source have none."""
    s = sources.select(F.col("name").alias("source"), "folder")
    file = F.concat(F.regexp_replace("folder", r"/+$", ""), F.lit("/"), F.replace("rel_path", F.lit("\\"), F.lit("/")))
    return documents.join(F.broadcast(s), "source").select("doc_id", "source", file.alias("file"))


def put_settings(settings: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of (key, value)."""
    return settings.join(new.select("key"), "key", "left_anti").unionByName(new)


def event_details(log: DataFrame) -> DataFrame:
    """The log once per row, with its JSON details as a map; null and broken JSON give null."""
    return log.dropDuplicates(["audit_id"]).withColumn("parsed", F.try_parse_json("details"))
