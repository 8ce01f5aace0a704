"""Labels of clauses and documents, by keyword families in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions import tables as T
from clausemill.functions.text import WS, first_family, normalize_label, phrase_norm, trim_ws


def clause_type(heading: Column, body: Column) -> Column:
    """The family of the heading, else the heading as a label; the body's start only without a heading."""
    h = trim_ws(F.coalesce(heading, F.lit("")))
    return _clause_type(h, phrase_norm(h), normalize_label(h), phrase_norm(F.substring(F.coalesce(body, F.lit("")), 1, 300)))


def _clause_type(h: Column, normed: Column, own: Column, normed_body: Column) -> Column:
    by_body = first_family(normed_body, T.CLAUSE_FAMILIES)
    return F.when(h != "", F.coalesce(first_family(normed, T.CLAUSE_FAMILIES), F.when(own != "", own), by_body)).otherwise(by_body)


def with_clause_type(df: DataFrame, name: str = "label", heading: str = "heading", body: str = "body") -> DataFrame:
    """``df`` with its clause type; the normed texts are columns of their own, so that each is made once a row."""
    h = trim_ws(F.coalesce(heading, F.lit("")))
    t = df.withColumn("__h", h).withColumn("__b", phrase_norm(F.substring(F.coalesce(body, F.lit("")), 1, 300)))
    t = t.withColumn("__n", phrase_norm(F.col("__h"))).withColumn("__o", normalize_label(F.col("__h")))
    return t.withColumn(name, _clause_type(F.col("__h"), F.col("__n"), F.col("__o"), F.col("__b"))).drop("__h", "__n", "__o", "__b")


def _instrument(x: Column) -> Column:
    return F.lower(x).rlike("|".join(T.INSTRUMENTS))


def _meaningful(x: Column) -> Column:
    return (x != "") & ~F.lower(x).isin(*T.INSTRUMENTS)


def derived_type(file_name: Column, text: Column) -> Column:
    """The first of 40 lines that names an instrument, else the file name's stem."""
    lines = F.slice(F.split(F.coalesce(text, F.lit("")), "\n", 41), 1, 40)
    # The cheap tests come first; what passes is trimmed and labelled.
    likely = F.transform(F.filter(lines, _instrument), trim_ws)
    short = F.filter(likely, lambda l: (l != "") & (F.octet_length(l) <= 90) & (F.size(F.split(l, rf"{WS}+")) <= 10))
    labels = F.filter(F.transform(short, normalize_label), _meaningful)
    stem = trim_ws(F.split(F.regexp_replace(file_name, r"\.[^.]*\z", ""), "[-_]")[0])
    own = normalize_label(stem)
    return F.coalesce(F.get(labels, F.lit(0)), F.when(_instrument(stem) & _meaningful(own), own))


def contract_type(file_name: Column, text: Column) -> Column:
    """Family of the file name, then of the first 2000 characters, then a derived label."""
    return F.coalesce(
        first_family(phrase_norm(file_name), T.CONTRACT_FAMILIES),
        first_family(phrase_norm(F.substring(F.coalesce(text, F.lit("")), 1, 2000)), T.CONTRACT_FAMILIES),
        derived_type(file_name, text),
    )


def with_document_labels(df: DataFrame, file_name: Column, text: str = "text") -> DataFrame:
    """``df`` with ``contract_type`` and ``jurisdiction``; each normed text is a column of its own."""
    t = df.withColumn("__f", file_name).withColumn("__n", phrase_norm(F.col("__f"))).withColumn("__t", phrase_norm(F.coalesce(text, F.lit(""))))
    t = t.withColumn("__h", phrase_norm(F.substring(F.coalesce(text, F.lit("")), 1, 2000)))
    t = t.withColumn("__a", F.coalesce(first_family(F.col("__n"), T.CONTRACT_FAMILIES), first_family(F.col("__h"), T.CONTRACT_FAMILIES)))
    own = F.coalesce("__a", derived_type(F.col("__f"), F.col(text)))
    return t.withColumn("contract_type", own).withColumn("jurisdiction", first_family(F.col("__t"), T.JURISDICTIONS)).drop("__f", "__n", "__t", "__h", "__a")


def jurisdiction(text: Column) -> Column:
    return first_family(phrase_norm(text), T.JURISDICTIONS)


def stamp(objects: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Objects with the labels of their document and their own clause type; language is 'English'."""
    own = F.when(F.col("kind") == "definition", F.lit("Definitions")).otherwise(F.col("clause_type"))
    joined = with_clause_type(objects, "clause_type").join(documents.select(key, "contract_type", "jurisdiction"), key, "left")
    return joined.withColumn("clause_type", own).withColumn("language", F.lit("English"))
