"""Problem 4: each new batch against all accepted history, by a pivot-distance table.

The history is a table that only grows: of each accepted document its bare hash, and of
its file name the distances to a few fixed pivot names. A new row can be within the
radius of an old one only if every pivot distance differs by at most the radius; the
first two distances are cut into ranges that meet by an equi-join with their neighbours,
all prune, and what is left is verified by the true distance and by the texts. Accepted
rows are appended with their distances; a later session opens the history and goes on.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm.p3_canonical import distance, mistyped
from clausemill.llm.shingles import shingle_sets
from clausemill.session import materialise, read, scratch, width

#: Month names, and marks of copies and versions at a file name's ends.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
COPY_BEFORE = r"^(?:copy(?:[\s_-]*\(?\d*\)?)[\s_-]+of[\s_-]+|kopie[\s_-]+von[\s_-]+)+"
COPY_BEHIND = r"(?:[\s_.-]*(?:[\s_-]copy(?:[\s_-]*\d+)?|\(\d{1,3}\)|[\s_.(\[-]+(?:executed|signed|final|draft|clean|scan(?:ned)?|redline|ocr|conformed)[)\]]?|[\s_-]+v\.?\d{1,3}(?:\.\d{1,2})?|[\s_-]+rev(?:ision)?[\s_.-]*[a-z0-9]{1,2}|[\s_-]+version[\s_.-]*\d{1,3})[\s_-]*)+$"
MARKS = ("executed", "signed", "final", "draft", "copy")
MISTYPED = 3  # letters that may be mistyped; a swap of two counts once
RADIUS = 2 * MISTYPED  # in Levenshtein's distance, where a swap counts twice


def name_parts(path: str | None) -> tuple[str, str, str]:
    """(numbers, letters, month) of a path's file name, without folder, case, separators, escapes, extension and marks."""
    if not path:
        return "", "", ""
    name = path
    for _ in range(2):
        name = unquote(name)
    name = name.replace("\\", "/").rstrip("/").rpartition("/")[2].lower().strip()
    name = re.sub(r"\s*\.[a-z][a-z0-9]{1,4}$", "", name)
    for _ in range(4):
        old = name
        name = re.sub(COPY_BEFORE, "", name)
        name = re.sub(COPY_BEHIND, "", name).strip(" _-.")
        head, gap, last = name.rpartition(max(re.findall(r"[\s_.-]", name) or ["\n"], key=name.rfind))
        if gap and len(last) >= 4 and any(distance(last, m) <= 1 for m in MARKS):
            name = head.strip(" _-.(")  # a mistyped mark
        if name == old:
            break
    runs = re.findall(r"[^\W_]+", name)
    numbers = ".".join(r for r in runs if any(c.isdigit() for c in r))
    letters = "".join(r for r in runs if not any(c.isdigit() for c in r))
    month = next((m[:3] for r in runs for m in MONTHS if r == m or (len(r) in (3, 4) and m.startswith(r))), "") if re.search(r"\d", name) else ""
    return numbers, letters, month


def pivots(names: list[str], n: int = 3) -> list[str]:
    """Names far from one another, farthest first; fixed for the life of a history."""
    names = sorted(set(names)) or [""]
    out = [names[0]]
    while len(out) < n:
        out.append(max(names, key=lambda x: (min(distance(x, p) for p in out), x)))
    return out


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, batch_no, source, hash, numbers, letters, month) of each document; no text."""

    def run(batches):
        for batch in batches:
            parts = [name_parts(p) for p in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *(pa.array([p[i] for p in parts], type=pa.string()) for i in range(3))], names=["doc_id", "batch_no", "source", "hash", "numbers", "letters", "month"])

    bare = F.regexp_extract(F.lower(F.regexp_replace("content_hash", r"\s", "")), r"(?:^|[^0-9a-f])([0-9a-f]{16,})$", 1)
    rows = docs.select("doc_id", "batch_no", "source", F.when(bare != "", bare).alias("hash"), "rel_path").where("doc_id is not null and batch_no is not null")
    return rows.mapInArrow(run, "doc_id long, batch_no int, source string, hash string, numbers string, letters string, month string")


def overlapping(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs (a, b, ta, tb) whose texts overlap by ``least`` at least."""

    def run(batches):
        for batch in batches:
            texts = [t for pair in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True) for t in pair]
            ok = []
            for x in range(0, len(texts), 512):  # both texts of a pair together
                part = [t or "" for t in texts[x : x + 512]]
                s, text, _ = shingle_sets(part, 3)
                ends = np.searchsorted(text, np.arange(len(part) + 1))
                for k in range(0, len(part), 2):
                    p, q = s[ends[k] : ends[k + 1]], s[ends[k + 1] : ends[k + 2]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if both and both >= least * (len(p) + len(q) - both):
                        ok.append((x + k) // 2)
            take = pa.array(ok, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], names=["a", "b"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_names(pairs: DataFrame) -> DataFrame:
    """(a, b, bucket) of the pairs (a, b, bucket, la, lb, ma, mb) whose names differ by mistyped letters at most."""

    def run(batches):
        for batch in batches:
            col = {n: batch.column(n).to_pylist() for n in ("la", "lb", "ma", "mb")}
            ok = [i for i in range(batch.num_rows) if not (col["ma"][i] and col["mb"][i] and col["ma"][i] != col["mb"][i]) and mistyped(col["la"][i], col["lb"][i], MISTYPED)]
            take = pa.array(ok, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(n).take(take) for n in ("a", "b", "bucket")], names=["a", "b", "bucket"])

    return pairs.select("a", "b", "bucket", "la", "lb", "ma", "mb").mapInArrow(run, "a long, b long, bucket int")


class History:
    """The accepted documents, in a folder that outlives the session: what a new batch is held against.

    ``pivots`` and ``meta`` are written once. ``entries`` grows by the accepted rows of each batch: the bare
    hash, the parts of the file name, its distances to the pivots, and the ranges of the first two, by which
    rows are joined. ``texts`` grows by their texts, in files that lie by ``bucket`` (of source and numbers), so
    that a batch reads the buckets of its near names only. ``links`` holds what each batch's check found.
    Every folder holds one subfolder a batch; ``done`` names the batches appended whole. What a batch that was
    broken off has left is deleted when it is appended again.
    """

    ENTRIES = "doc_id long, source string, hash string, numbers string, letters string, month string, d0 int, d1 int, d2 int, r0 int, r1 int, bucket int"
    BUCKETS = 1024
    PIVOTS = 3

    def __init__(self, spark: SparkSession, at: str, marks: list[str], least: float, most_bytes: int = 64 << 20):
        self.spark, self.at, self.marks, self.least, self.most_bytes = spark, at, marks, least, most_bytes

    @classmethod
    def create(cls, spark: SparkSession, at: str, first: DataFrame, least: float = 0.5, sample: int = 256) -> History:
        """A new history in ``at``; its pivots come from at most ``sample`` names of ``first`` (describe()'s rows of a batch)."""
        some = first.select("letters").where("letters != ''").orderBy(F.xxhash64("letters"), "letters").limit(sample)
        marks = pivots([r.letters for r in some.collect()], cls.PIVOTS)
        spark.createDataFrame(list(enumerate(marks)), "place int, letters string").coalesce(1).write.parquet(f"{at}/pivots")
        spark.createDataFrame([(least,)], "least double").write.parquet(f"{at}/meta")
        return cls(spark, at, marks, least)

    @classmethod
    def open(cls, spark: SparkSession, at: str) -> History:
        """The history in ``at``, of this or an earlier session."""
        marks = [r.letters for r in spark.read.parquet(f"{at}/pivots").orderBy("place").collect()]
        return cls(spark, at, marks, spark.read.parquet(f"{at}/meta").first().least)

    def _folder(self, name: str, what: str = "mkdirs") -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return files.delete(path, True) if what == "delete" else getattr(files, what)(path)

    def table(self, name: str, schema: str) -> DataFrame:
        """The rows of all batches so far."""
        if not self._folder(name, "exists"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.at}/{name}")

    def links(self) -> DataFrame:
        """(a, b): accepted document and refused document, of all batches so far."""
        return self.table("links", "a long, b long")

    def measured(self, rows: DataFrame) -> DataFrame:
        """describe()'s rows with the distances of their letters to the pivots, their ranges and bucket."""
        for i, p in enumerate(self.marks):
            rows = rows.withColumn(f"d{i}", F.levenshtein(F.coalesce("letters", F.lit("")), F.lit(p)))
        for i in (0, 1):
            rows = rows.withColumn(f"r{i}", (F.col(f"d{i}") / (RADIUS + 1)).cast("int"))
        return rows.withColumn("bucket", F.pmod(F.xxhash64("source", "numbers"), F.lit(self.BUCKETS)).cast("int"))

    def near(self, batch: DataFrame) -> DataFrame:
        """(a, b, bucket): accepted rows and rows of ``batch`` whose names differ by mistyped letters at most.

        The batch goes into the nine neighbouring ranges of its first two distances, so that the history's rows are
        read as they lie, each once; only ranges that the batch touches are read.
        """
        around = F.array(*(F.struct((F.col("r0") + i).alias("r0"), (F.col("r1") + j).alias("r1")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        named = batch.where("source is not null")
        new = named.select(F.col("doc_id").alias("b"), "source", "numbers", F.inline(around), F.col("letters").alias("lb"), F.col("month").alias("mb"), *(F.col(f"d{i}").alias(f"n{i}") for i in range(self.PIVOTS)))
        ends = named.agg(F.min("r0"), F.max("r0"), F.min("r1"), F.max("r1")).first()
        if ends[0] is None:
            return self.spark.createDataFrame([], "a long, b long, bucket int")
        old = self.table("entries", self.ENTRIES).where(F.col("source").isNotNull() & F.col("r0").between(ends[0] - 1, ends[1] + 1) & F.col("r1").between(ends[2] - 1, ends[3] + 1))
        old = old.select(F.col("doc_id").alias("a"), "source", "numbers", "r0", "r1", "bucket", F.col("letters").alias("la"), F.col("month").alias("ma"), *(f"d{i}" for i in range(self.PIVOTS)))
        near = new.join(old, ["source", "numbers", "r0", "r1"]).where("a != b")
        for i in range(self.PIVOTS):
            near = near.where(F.abs(F.col(f"d{i}") - F.col(f"n{i}")) <= RADIUS)
        return near_names(near)

    def check(self, batch: DataFrame, texts: DataFrame) -> DataFrame:
        """(a, b): the accepted rows that rows of ``batch`` (measured()'s) repeat. ``texts``: (doc_id, text) of the batch."""
        near = materialise(self.near(batch))
        touched, n = near.agg(F.collect_set("bucket"), F.count(F.lit(1))).first()  # at most BUCKETS numbers
        hashes = self.table("entries", self.ENTRIES).where("hash is not null").select(F.col("doc_id").alias("a"), "hash")
        same = batch.where("hash is not null").select(F.col("doc_id").alias("b"), "hash").join(hashes, "hash").where("a != b").select("a", "b")
        if not touched:
            return same.dropDuplicates()
        tb = texts.join(near.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        ta = self.table("texts", "bucket int, doc_id long, text string").where(F.col("bucket").isin(touched)).select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
        pairs = near.select("a", "b")
        # Two numbers a pair, counted before they are broadcast; texts are never broadcast by this.
        side = F.broadcast(pairs) if n * 16 <= self.most_bytes else pairs
        both = ta.join(side, "a").join(tb, "b")
        return same.unionByName(overlapping(both, self.least)).dropDuplicates()

    def append(self, docs: DataFrame, number: int) -> DataFrame:
        """Check a batch of documents and append its accepted rows; returns (a, b) found for it.

        ``docs``: doc_id, source, rel_path, content_hash, text. Nothing that earlier batches brought is described
        or measured again. A batch number that was appended before is refused.
        """
        if self._folder(f"done/batch={number}", "exists"):
            raise ValueError(f"batch {number} is in the history already")
        for name in ("links", "entries", "texts"):
            self._folder(f"{name}/batch={number}", "delete")
        names = docs.withColumn("batch_no", F.lit(number))
        batch = materialise(self.measured(describe(names)).dropDuplicates(["doc_id"]))
        texts = docs.where("text is not null").select("doc_id", "text")
        out = f"{self.at}/%s/batch={number}"
        self.check(batch, texts).write.parquet(out % "links")
        found = self.spark.read.schema("a long, b long").parquet(out % "links")
        kept = batch.join(found.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_anti")
        columns = [c.split()[0] for c in self.ENTRIES.split(", ")]
        kept.select(*columns).sortWithinPartitions("r0", "r1").write.parquet(out % "entries")
        text = texts.join(kept.where("source is not null").select("doc_id", "bucket"), "doc_id").dropDuplicates(["doc_id"])
        text.select("bucket", "doc_id", "text").repartitionById(width(self.spark), (F.col("bucket") * width(self.spark) / self.BUCKETS).cast("int")).sortWithinPartitions("bucket").write.parquet(out % "texts")
        self._folder(f"done/batch={number}")
        return found


def repeats(docs: DataFrame, least: float = 0.5, sample: int = 256, at: str | None = None) -> DataFrame:
    """(doc_a < doc_b): each refused document with each accepted document that it repeats.

    Batches are taken in order of ``batch_no`` and appended to one new History (in ``at``, a scratch folder by
    default); documents of one batch aren't held against one another; refused documents don't serve as history. A
    null id or batch is left out; a null or unreadable hash equals none; null and empty texts overlap none; a null
    source is no source; repeated rows count once. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "batch_no", "source", "rel_path", "content_hash", "text").where("doc_id is not null and batch_no is not null")
    numbers = sorted(r.batch_no for r in docs.select("batch_no").distinct().collect())
    if not numbers:
        return spark.createDataFrame([], "doc_a long, doc_b long")
    history = History.create(spark, at or scratch(spark, "history"), describe(docs.where(F.col("batch_no") == numbers[0])), least, sample)
    for n in numbers:
        history.append(docs.where(F.col("batch_no") == n), n)
    return history.links().select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).dropDuplicates()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read(spark, sf_dir, "documents").select("doc_id", "batch_no", "source", "rel_path", "content_hash", "text"))


def queries() -> dict:
    return {"p4_found": p4_found}


def oracle_sql() -> dict:
    return {}
