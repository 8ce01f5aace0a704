"""The whole as one object: sources, ingest, search, drafting, asking; tables are Parquet below one folder.

    lib = Library(spark, "/data/library")
    lib.add_source("Leases", "/packs/leases")
    lib.ingest("Leases")
    lib.search("limitation of liability", k=10).show()
    draft = lib.assemble(Spec(contract_type="Lease Agreement", parties=[...]))
    lib.render(draft, "/out/lease.md")

Sources, settings and the audit log are small tables with a folder a version. What a source
brings lies in a folder of its own, one version of all its tables together (documents,
clauses, postings, sizes, vectors, edges): a scan writes the next version whole and then marks
it as done, so that a reader never sees half of one, a lost executor costs a retry, other
sources aren't touched, and a search opens the folders of attached sources only.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausemill.functions.text import rewrite_refs
from clausemill.operators import assemble as A
from clausemill.operators import embed as E
from clausemill.operators import index as I
from clausemill.operators import label as L
from clausemill.operators import prompt, registry, render, search, segment, tree, validate
from clausemill.session import materialise, width
from clausemill.sources import readers
from clausemill.streaming import watch

#: Tables of the whole library.
SMALL = {
    "sources": "name string, folder string, attached boolean, created_at timestamp, embedder string",
    "settings": "key string, value string",
    "audit": "ts timestamp, event string, details string",
}
#: Tables of one source.
BUNDLE = {
    "documents": "doc_id long, source string, rel_path string, content_hash string, indexed_at timestamp, deleted boolean, contract_type string, jurisdiction string, title string",
    "clauses": "clause_id long, doc_id long, source string, rel_path string, kind string, number string, seq int, depth int, heading string, term string, body string, clause_type string, contract_type string, jurisdiction string, approved boolean, ooxml array<string>",
    "postings": "source string, clause_id long, token string, tf_heading long, tf_body long, len int",
    "sizes": "source string, clause_id long, len int",
    "vectors": "source string, clause_id long, embedding array<float>",
    "edges": "src_clause long, relation string, dst_clause long",
}
SCHEMAS = SMALL | BUNDLE
IR_CLAUSES = "doc_id long, clause_id long, pos int, eff int, number string, new_number string, new_heading string, new_body string, clause_type string, source string, rel_path string, terms array<string>, refs array<string>, ooxml array<string>, adapted boolean"


@dataclass
class Draft:
    """An assembled document: numbered rows, definitions, schedules, recitals, and what was chosen and noted."""

    spec: A.Spec
    skeleton: dict
    clauses: DataFrame
    definitions: DataFrame
    schedules: DataFrame
    recitals: list[str]
    missing: list[str] = field(default_factory=list)
    filled: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    numbers: dict[str, str] = field(default_factory=dict)

    def variables(self) -> DataFrame:
        """(name, label, filled): placeholders left in the draft, once each, in clauses, definitions, recitals, schedules."""
        spark = self.clauses.sparkSession
        front = spark.createDataFrame(list(enumerate(self.recitals)), "n long, t string").select(F.lit(2).alias("part"), "n", "t")
        texts = self.clauses.select(F.lit(0).alias("part"), F.col("pos").cast("long").alias("n"), F.col("new_body").alias("t"))
        texts = texts.unionByName(self.definitions.select(F.lit(1).alias("part"), F.col("seq").cast("long").alias("n"), F.col("body").alias("t"))).unionByName(front)
        return A.distinct_variables(texts.unionByName(self.schedules.select(F.lit(3).alias("part"), F.col("schedule_no").cast("long").alias("n"), F.col("body").alias("t"))), [], ["part", "n"])

    def to_json(self) -> str:
        """The draft as JSON: one document, so it may come to the driver."""
        rows = lambda df: [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
        clauses = with_columns(self.clauses, IR_CLAUSES).orderBy("pos")
        return json.dumps({"spec": asdict(self.spec), "skeleton": {k: v for k, v in self.skeleton.items()}, "clauses": rows(clauses), "definitions": rows(with_columns(self.definitions, IR_DEFINITIONS).orderBy("seq")), "schedules": rows(with_columns(self.schedules, IR_SCHEDULES).orderBy("schedule_no")), "recitals": self.recitals, "missing": self.missing, "filled": self.filled, "notes": self.notes, "numbers": self.numbers}, indent=2, default=str)

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> Draft:
        """The draft that to_json() wrote."""
        data = json.loads(text)
        frame = lambda name, schema: spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in data[name]], schema)
        return cls(A.Spec(**data["spec"]), data["skeleton"], frame("clauses", IR_CLAUSES), frame("definitions", IR_DEFINITIONS), frame("schedules", IR_SCHEDULES), data["recitals"], data["missing"], data["filled"], data["notes"], data["numbers"])


IR_DEFINITIONS = "doc_id long, clause_id long, seq int, term string, body string"
IR_SCHEDULES = "doc_id long, schedule_no long, title string, body string"


def with_columns(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns of a schema, null where it hasn't them."""
    want = [c.split() for c in schema.split(", ")]
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in want))


class Library:
    def __init__(self, spark: SparkSession, root: str, embedder: E.Embedder | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.embedder = embedder or E.HashEmbedder()
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- tables ---------------------------------------------------------------------------

    def _version(self, name: str) -> int:
        at = self._path(f"{self.root}/{name}")
        if not self._fs.exists(at):
            return 0
        done = [int(s.getPath().getName()[1:]) for s in self._fs.listStatus(at) if s.getPath().getName().startswith("v") and self._fs.exists(self._path(f"{s.getPath()}/_SUCCESS"))]
        return max(done, default=0)

    def _bundles(self, sources: list[str] | None = None) -> list[str]:
        """The folders of the last whole version of each source that has one."""
        at = self._path(f"{self.root}/bundles")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        keep = None if sources is None else {_folder(x) for x in sources}
        out = []
        for n in sorted(names):
            v = self._version(f"bundles/{n}")
            if v and (keep is None or n in keep):
                out.append(f"{self.root}/bundles/{n}/v{v}")
        return out

    def table(self, name: str, sources: list[str] | None = None) -> DataFrame:
        """The current rows of a table; of ``sources`` only, if they are named."""
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        if name in SMALL:
            v = self._version(name)
            paths = [f"{self.root}/{name}/v{v}"] if v else []
        else:
            paths = [f"{b}/{name}" for b in self._bundles(sources)]
        if not paths:
            return empty
        return self.spark.read.schema(empty.schema).parquet(*paths)

    def _put(self, name: str, df: DataFrame) -> None:
        v = self._version(name) + 1
        df.select(*self.spark.createDataFrame([], SMALL[name]).columns).write.mode("overwrite").parquet(f"{self.root}/{name}/v{v}")
        if v > 2:  # the version before is kept for readers that have begun
            self._fs.delete(self._path(f"{self.root}/{name}/v{v - 2}"), True)

    def _put_bundle(self, source: str, tables: dict[str, DataFrame]) -> None:
        """The next version of a source: all its tables, then the mark that makes them current."""
        at = f"{self.root}/bundles/{_folder(source)}"
        v = self._version(f"bundles/{_folder(source)}") + 1
        self._fs.delete(self._path(f"{at}/v{v}"), True)  # what a broken-off scan has left
        for name, df in tables.items():
            df = df.select(*self.spark.createDataFrame([], BUNDLE[name]).columns)
            # Postings lie by token, so that a search skips the row groups without its words.
            df = df.repartitionByRange(width(self.spark), "token").sortWithinPartitions("token", "clause_id") if name == "postings" else df
            df.write.parquet(f"{at}/v{v}/{name}")
        self._fs.create(self._path(f"{at}/v{v}/_SUCCESS")).close()
        if v > 2:
            self._fs.delete(self._path(f"{at}/v{v - 2}"), True)

    def log(self, event: str, **details) -> None:
        row = self.spark.createDataFrame([(event, json.dumps(details))], "event string, details string").select(F.current_timestamp().alias("ts"), "event", "details")
        row.write.mode("append").parquet(f"{self.root}/audit/v1")

    # --- sources --------------------------------------------------------------------------

    def add_source(self, name: str, folder: str) -> None:
        row = self.spark.createDataFrame([(name, folder, True, self.embedder.id)], "name string, folder string, attached boolean, embedder string").withColumn("created_at", F.current_timestamp())
        self._put("sources", registry.add_source(self.table("sources"), row))
        self.log("source_attached", source=name)

    def list_sources(self) -> DataFrame:
        return self.table("sources").orderBy("name")

    def _set(self, name: str, attached: bool, event: str) -> bool:
        """Whether there is such a source."""
        there = self.table("sources").where(F.col("name") == name).limit(1).count() > 0
        if there:
            self._put("sources", registry.set_attached(self.table("sources"), name, attached))
            self.log(event, source=name)
        return there

    def attach(self, name: str) -> bool:
        return self._set(name, True, "source_reattached")

    def detach(self, name: str) -> bool:
        return self._set(name, False, "source_detached")

    def remove(self, name: str) -> None:
        """Forget a source with all its rows, edges too; its files stay."""
        self._put("sources", registry.remove_source(self.table("sources"), name))
        self._fs.delete(self._path(f"{self.root}/bundles/{_folder(name)}"), True)
        self.log("source_removed", source=name)

    def _scope(self, scope: list[str] | None = None) -> list[str]:
        """The names of the attached sources, in order."""
        rows = registry.attached(self.table("sources"), scope).select("name", "embedder").collect()  # one row a source
        if any(r.embedder != self.embedder.id for r in rows):
            raise ValueError("a source was indexed by another embedder; ingest it again")
        return [r.name for r in rows]

    # --- settings -------------------------------------------------------------------------

    def get_setting(self, key: str):
        return registry.setting(self.table("settings"), key)

    def put_setting(self, key: str, value) -> None:
        row = self.spark.createDataFrame([(key, json.dumps(value))], SMALL["settings"])
        self._put("settings", registry.put_settings(self.table("settings"), row))

    def delete_setting(self, key: str) -> None:
        self._put("settings", registry.delete_setting(self.table("settings"), key))

    def set_model(self, adapter: str, model: str, **options) -> None:
        """Which model to ask; keys are never stored, they come from the environment (prompt.api_key)."""
        self.put_setting("model", {"adapter": adapter, "model": model, **options})
        self.log("model_configured", adapter=adapter, model=model)

    def model(self) -> dict | None:
        return self.get_setting("model")

    def clear_model(self) -> None:
        self.delete_setting("model")

    # --- ingest ---------------------------------------------------------------------------

    def ingest(self, name: str) -> dict[str, int]:
        """Bring a source's index up to its folder: changed files are parsed once, removed ones become tombstones.

        A file that can't be read counts as failed; it isn't indexed, so that the next scan tries it again.
        """
        src = self.table("sources").where(F.col("name") == name).first()
        if src is None:
            raise ValueError(f"no source named {name}")
        old = {t: self.table(t, [name]) for t in BUNDLE}
        docs = old["documents"]
        files = readers.scan(self.spark, src.folder, name)
        diff = materialise(I.scan_diff(files, docs.where("not deleted")))
        todo = files.join(diff.where("outcome in ('new', 'changed')").select("source", "rel_path"), ["source", "rel_path"], "left_semi")
        tried = materialise(readers.attempt(todo).withColumn("doc_id", F.xxhash64("source", "rel_path")))
        failed = tried.where(F.col("para_no") == readers.FAILED).select("source", "rel_path").distinct()
        paras = tried.where(F.col("para_no") != readers.FAILED)
        text = paras.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
        heads = todo.select(F.xxhash64("source", "rel_path").alias("doc_id"), "source", "rel_path", "content_hash").join(failed, ["source", "rel_path"], "left_anti").join(text, "doc_id", "left").join(segment.titles(paras), "doc_id", "left")
        heads = L.with_document_labels(heads, F.substring_index("rel_path", "/", -1)).drop("text").withColumn("indexed_at", F.current_timestamp()).withColumn("deleted", F.lit(False))
        heads = materialise(heads.select(*docs.columns))
        obj = L.stamp(segment.objects(paras), heads).join(heads.select("doc_id", "source", "rel_path"), "doc_id")
        obj = obj.withColumn("clause_id", F.xxhash64("doc_id", "ord")).withColumn("approved", F.lit(None).cast("boolean"))
        obj = materialise(obj.select(*old["clauses"].columns))
        gone = diff.where("outcome != 'unchanged'").join(failed, ["source", "rel_path"], "left_anti").select("source", "rel_path")
        out = old["clauses"].join(gone, ["source", "rel_path"], "left_semi").select("clause_id")
        vectors = I.embed(obj.select("clause_id", segment.embedding_text(F.col("heading"), F.col("term"), F.col("body")).alias("t")), "clause_id", "t", make=self.embedder.embed).withColumn("source", F.lit(name))
        add = {"postings": I.postings(obj), "sizes": I.sizes(obj), "vectors": vectors, "clauses": obj}
        new = {t: old[t].join(out, "clause_id", "left_anti").unionByName(rows.select(*old[t].columns)) for t, rows in add.items()}
        new["edges"] = I.drop_edges(old["edges"], out).unionByName(I.uses_term(obj)).dropDuplicates()
        new["documents"] = I.tombstone(I.upsert(docs, heads), diff.where("outcome = 'removed'"))
        self._put_bundle(name, new)
        self._put("sources", self.table("sources").withColumn("embedder", F.when(F.col("name") == name, F.lit(self.embedder.id)).otherwise(F.col("embedder"))))
        counts = {r.outcome: r["count"] for r in diff.groupBy("outcome").count().collect()}
        stats = {k: counts.get(k, 0) for k in ("new", "changed", "unchanged", "removed")}
        bad = failed.join(diff, ["source", "rel_path"]).groupBy("outcome").count().collect()
        for r in bad:
            stats[r.outcome] -= r["count"]
        stats["failed"] = sum(r["count"] for r in bad)
        stats["objects"] = obj.count()
        self.log("source_scanned", source=name, **stats)
        return stats

    def watch(self, name: str, checkpoint: str, once: bool = False, on_event: Callable[[str, dict], None] | None = None):
        """Ingest whenever files change (every batch is a full rescan, so deletions are seen too).

        ``on_event`` is told 'source-updated' with the counters, or 'source-error' with the reason.
        """
        folder = self.table("sources").where(F.col("name") == name).first().folder

        def scan(df, n):
            try:
                event, what = "source-updated", {"source": name, **self.ingest(name)}
            except Exception as e:  # noqa: BLE001  the watcher goes on; the next change tries again
                event, what = "source-error", {"source": name, "reason": str(e)}
                if on_event is None:
                    raise
            if on_event is not None:
                on_event(event, what)

        return watch.watch(self.spark, folder, checkpoint, scan, once)

    def watch_all(self, checkpoint: str, once: bool = False, on_event: Callable[[str, dict], None] | None = None) -> dict:
        """A watcher for each attached source, each with a state of its own below ``checkpoint``."""
        return {n: self.watch(n, f"{checkpoint}/{_folder(n)}", once, on_event) for n in self._scope()}

    # --- search ---------------------------------------------------------------------------

    def search(self, query: str, k: int = 20, sources: list[str] | None = None, expand: bool = False, **where) -> DataFrame:
        """Hits in order of ``place``; filters: kind, exclude_kinds, approved_only, clause_type, contract_type."""
        if not query.strip():
            raise ValueError("an empty query")
        scope = self._scope(sources)
        clauses, docs = self.table("clauses", scope), self.table("documents", scope)
        q = self.spark.createDataFrame([(0, query, E.embed_one(self.embedder, query))], "query_id long, query string, embedding array<float>")
        if isinstance(where.get("kind"), str):
            where["kind"] = search.kind_of(where["kind"])
        hits = self._hybrid(q, scope, k, search.filters(**where) if where else None)
        if expand:
            more = search.expand(hits, self.table("edges", scope), clauses, docs, k)
            hits = hits.withColumn("origin", F.lit("hit")).unionByName(more.withColumn("place", F.col("place") + k).withColumn("origin", F.lit("expanded")))
        self.log("search", query=query)
        return hits

    def contract_types(self) -> DataFrame:
        scope = self._scope()
        docs = A.clause_counts(self.table("documents", scope), self.table("clauses", scope))
        return docs.where("clause_count > 0 and contract_type is not null").groupBy("contract_type").agg(F.count(F.lit(1)).alias("precedents")).orderBy(F.desc("precedents"), "contract_type")

    # --- drafting -------------------------------------------------------------------------

    def assemble(self, spec: A.Spec) -> Draft:
        """Draft from the best precedent: its tree without excluded types, checklist gaps filled, renumbered."""
        scope, notes = [], []
        for r in registry.attached(self.table("sources"), spec.source_scope or None).select("name", "embedder").collect():
            if r.embedder == self.embedder.id:
                scope.append(r.name)
            else:
                notes.append(f"source '{r.name}' was indexed by another embedder and is left out")
        clauses = self.table("clauses", scope)
        docs = A.clause_counts(self.table("documents", scope), clauses)
        want = self.spark.createDataFrame([(0, spec.contract_type, spec.jurisdiction, spec.skeleton_precedent)], "spec_id int, want_type string, want_jurisdiction string, want_precedent string")
        best = A.choose_skeleton(docs, want).first()
        if best is None:
            raise ValueError("no precedent to draft from")
        if not best.exact:
            notes.append(f"no precedent of type '{spec.contract_type}'; drafted from '{best.rel_path}'")
        own = clauses.where(F.col("doc_id") == best.doc_id)
        rows = tree.effective_depth(own.where(~F.col("kind").isin(*search.OPERATIVE)), order=("seq", "clause_id"))
        rows = A.exclude_roots(rows, spec.exclude_clause_types)
        roots = [r.x for r in rows.where("eff = 0").orderBy("pos").select(A.label_of(F.col("clause_type"), F.col("heading")).alias("x")).collect()]  # one document's roots
        present = {r.x.lower() for r in own.select(A.label_of(F.col("clause_type"), F.col("heading")).alias("x")).distinct().collect()}
        skip = {x.lower() for x in spec.exclude_clause_types}
        wanted = [t for t in [*A.required(spec.contract_type), *spec.include_clause_types] if t.lower() not in present | skip]
        filled, missing, extra = [], [], []
        wanted = list(dict.fromkeys(wanted))
        gaps = self._gaps(wanted, spec, scope)
        for t in wanted:
            hit = gaps.get(t)
            (missing if hit is None else filled).append(t)
            if hit is not None:
                extra.append((t, hit))
        rows = rows.withColumn("__at", F.col("pos").cast("double"))
        if extra:
            starts = [r.pos for r in rows.where("eff = 0").orderBy("pos").select("pos").collect()]
            order = list(zip(roots, starts, strict=True))
            for t, hit in extra:
                at = A.insert_gaps([o[0] for o in order], [t], spec.contract_type)[0][1]
                after = order[at][1] if at < len(order) else 1e9
                before = order[at - 1][1] if at else 0.0
                # between the whole tree of the root before and the root behind
                place = after - 0.5 if at < len(order) and after - 0.5 > before else (before + after) / 2
                order.insert(at, (t, place))
                one = clauses.where(F.col("clause_id") == hit.clause_id).withColumn("pos", F.lit(0)).withColumn("eff", F.lit(0)).withColumn("__at", F.lit(float(place)))
                rows = rows.unionByName(one, allowMissingColumns=True)
        rows = rows.withColumn("doc_id", F.lit(best.doc_id)).withColumn("pos", F.row_number().over(W.partitionBy("doc_id").orderBy("__at", "clause_id"))).drop("__at")
        variables = F.create_map(*[F.lit(x) for kv in spec.variables.items() for x in kv]) if spec.variables else F.create_map().cast("map<string,string>")
        rows = materialise(tree.numbered(rows))
        first = tree.number_map(rows).first()  # one document's numbers
        numbers = dict(first.numbers) if first else {}
        mapped = F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv]) if numbers else F.create_map().cast("map<string,string>")
        rows = rows.withColumn("new_body", A.rewrite_refs(A.substitute(F.coalesce("body", F.lit("")), variables), mapped))
        rows = rows.withColumn("new_heading", F.when(A.trim_ws(F.coalesce("heading", F.lit(""))) == "", "").otherwise(A.normalize_label(F.col("heading")))).withColumn("refs", A.cross_refs(F.col("new_body")))
        defs = tree.first_wins(own.where("kind = 'definition' and term is not null"), ["doc_id", "term"], "seq", "clause_id").withColumn("body", A.substitute(F.coalesce("body", F.lit("")), variables))
        sched = tree.fold_schedules(own).withColumn("title", A.substitute(F.col("title"), variables)).withColumn("body", rewrite_refs(A.substitute(F.col("body"), variables), mapped))
        lines = [r.b for r in A.recitals(own).orderBy("seq", "clause_id").select(A.substitute(F.col("body"), variables).alias("b")).collect()] or [A.synthetic_recital(spec)]
        return Draft(spec, best.asDict(), A.definitions_used(rows, defs), defs, sched, lines, missing, filled, notes, numbers)

    def _gaps(self, types: list[str], spec: A.Spec, scope: list[str]) -> dict[str, object]:
        """The best clause of each type: of the wanted contract type first, then of any. One search for all of them."""
        if not types:
            return {}
        n = len(types)
        rows = [(i, types[i % n], E.embed_one(self.embedder, types[i % n])) for i in range(2 * n)]  # first with the contract type, then without
        q = self.spark.createDataFrame(rows, "query_id int, query string, embedding array<float>")
        wanted = F.create_map(*[F.lit(x) for i in range(2 * n) for x in (i, types[i % n].lower())])
        where = search.filters(exclude_kinds=search.OPERATIVE, approved_only=spec.approved_only)
        where = where & F.coalesce(F.lower("clause_type") == wanted[F.col("query_id")], F.lit(False))
        where = where & ((F.col("query_id") >= n) | F.coalesce(F.lower("contract_type") == spec.contract_type.lower(), F.lit(False)))
        hits = self._hybrid(q, scope, 6, where).where("place = 1").orderBy("query_id").collect()  # at most two a type
        found: dict[str, object] = {}
        for h in hits:
            found.setdefault(types[h.query_id % n], h)
        return found

    def _hybrid(self, queries: DataFrame, scope: list[str], k: int, where=None) -> DataFrame:
        """Ranked hits of a few queries over the stored index; only postings of their words are read."""
        words = [r.token for r in search.query_tokens(queries).select("token").distinct().collect()]
        post = self.table("postings", scope).where(F.col("token").isin(words))
        return search.hybrid(queries, post, self.table("sizes", scope), self.table("vectors", scope), self.table("clauses", scope), self.table("documents", scope), k, where)

    def validate(self, draft: Draft) -> DataFrame:
        """Findings (doc_id, severity, code, location, detail) of a draft."""
        doc = draft.skeleton["doc_id"]
        docs = self.spark.createDataFrame([(doc,)], "doc_id long")
        parties = self.spark.createDataFrame([(doc, p["name"]) for p in draft.spec.parties], "doc_id long, name string")
        rows = draft.clauses.withColumn("body", F.col("new_body")).withColumn("heading", F.col("new_heading")).withColumn("number", F.col("new_number"))
        used, unused = validate.terms(rows, draft.definitions)
        out = validate.structure(docs, rows, parties, parties)
        texts = rows.select("doc_id", F.col("pos").cast("long").alias("place"), validate.location(F.col("new_number"), F.col("new_heading")).alias("location"), F.col("body").alias("text"))
        front = self.spark.createDataFrame([(doc, 1_000_000 + i, f"recital {i + 1}", t) for i, t in enumerate(draft.recitals)], "doc_id long, place long, location string, text string")
        back = draft.schedules.select("doc_id", (F.col("schedule_no") + 2_000_000).alias("place"), F.concat(F.lit('schedule "'), "title", F.lit('"')).alias("location"), F.col("body").alias("text"))
        for part in (validate.numbering(rows), validate.empty_clauses(rows), validate.unresolved(rows), validate.dangling(rows), validate.undefined(used, draft.definitions), unused, validate.foreign_parties(texts.unionByName(front).unionByName(back), parties)):
            out = out.unionByName(part)
        return out

    def markdown(self, draft: Draft) -> str:
        s = draft.spec
        docs = self.spark.createDataFrame([(draft.skeleton["doc_id"], s.title, s.contract_type, s.jurisdiction)], "doc_id long, title string, contract_type string, jurisdiction string")
        body = render.markdown(draft.clauses, docs, draft.schedules).first().markdown
        head, _, rest = body.partition("\n\n")
        between = "".join(f"- **{p['name']}** (the \"{p['role']}\")" + (f", registration number {p['reg_no']}" if p.get("reg_no") else "") + "\n" for p in s.parties)
        front = (f"**Between:**\n\n{between}\n" if between else "") + "".join("\n\n".join(x for x in r.split("\n") if x.strip()) + "\n\n\n" for r in draft.recitals)
        foot = "## Execution\n\n" + "".join(f"Signed for and on behalf of {p['name']} \n\n_____________________________\n\n" for p in s.parties) if s.parties else ""
        law = rest.rfind("\n_Governing law: ")
        rest, tail = (rest[:law], rest[law:]) if law >= 0 else (rest, "")
        return f"{head}\n\n{front}{rest}{foot}{tail}"

    def render(self, draft: Draft, path: str, force: bool = False, donor: render.Donor | None = None) -> DataFrame:
        """Write a draft as .md or .docx; findings of severity 'error' block it unless forced."""
        findings = self.validate(draft)
        if not force and findings.where("severity = 'error'").limit(1).count():
            self.log("draft_blocked", path=path)
            raise ValueError("the draft has errors")
        if path.endswith(".docx"):
            data = self._docx(draft, donor)
        else:
            data = self.markdown(draft).encode()
        self._write(path, data)
        self.log("draft_rendered", path=path)
        return findings

    def _docx(self, draft: Draft, donor: render.Donor | None) -> bytes:
        """A draft as DOCX. With a usable donor the source's own paragraphs come along, cleaned and renumbered."""
        text = self.markdown(draft)
        lines = [(f"Heading{min(6, len(x) - len(x.lstrip('#')) - 1)}" if x.startswith("## ") or x.startswith("###") else None, x.lstrip("# ")) for x in text.split("\n")[1:] if x.strip()]
        lifted: dict[str, list[str]] = {}
        if donor is not None and donor.usable and "ooxml" in draft.clauses.columns:
            own = draft.clauses.where("size(ooxml) > 0")
            if "adapted" in own.columns:
                own = own.where("not coalesce(adapted, false)")
            for r in own.orderBy("pos").select("new_number", "new_heading", "new_body", "ooxml").collect():  # one document's rows
                start = f"{r.new_number}. {r.new_heading}" if r.new_heading.strip() else f"{r.new_number} {next((x.strip() for x in r.new_body.split(chr(10)) if x.strip()), '')}"
                raw = [A.substitute_text(x, draft.spec.variables) for x in r.ooxml]
                lifted[start] = [r.new_body, bool(r.new_heading.strip()), [render.sanitise(render.rewrite_ooxml(x, draft.numbers), donor.num_ids) for x in raw]]
        return render.docx_bytes(text.split("\n", 1)[0].lstrip("# "), render.lift(lines, lifted), donor)

    def _write(self, path: str, data: bytes) -> None:
        """A file, through the file system that its path names (a plain path is this machine's)."""
        if "://" in path:
            where = self._path(path)
            out = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
            out.write(data)
            out.close()
        else:
            with open(path, "wb") as f:
                f.write(data)

    def save_draft(self, draft: Draft, path: str) -> None:
        self._write(path, draft.to_json().encode())

    def load_draft(self, path: str) -> Draft:
        return Draft.from_json(self.spark, self.spark.read.text(path if "://" in path else f"file://{path}", wholetext=True).first().value)

    # --- assistant ------------------------------------------------------------------------

    def ask(self, question: str, adapter: prompt.Adapter, k: int = 8) -> str:
        hits = self.search(question, k, expand=True)
        context = prompt.extracts(hits).first()
        answer = adapter.complete(prompt.ask(question, context.context if context else ""))
        self.log("model_call", adapter=adapter.id, tokens_in=answer.tokens_in, tokens_out=answer.tokens_out)
        return answer.text

    def adapt(self, draft: Draft, number: str, instructions: str, adapter: prompt.Adapter) -> Draft:
        """A draft with one top-level clause rewritten by a model.

        Its answer must be blocks, and the whole draft is validated again: with errors the draft given stays as it is.
        """
        row = draft.clauses.where((F.col("new_number") == number) & (F.col("eff") == 0)).first()
        if row is None:
            raise ValueError(f"no top-level clause {number}")
        terms = [r.term for r in draft.definitions.select("term").collect()]  # one document's terms
        answer = adapter.complete(prompt.adapt(row.new_heading, row.new_body, instructions, draft.spec.parties, terms))
        body = "\n".join(prompt.plain_text(b) for b in prompt.parse_blocks(answer.text))
        self.log("model_call", adapter=adapter.id, tokens_in=answer.tokens_in, tokens_out=answer.tokens_out)
        mine = F.col("new_number") == number
        clauses = draft.clauses.withColumn("new_body", F.when(mine, F.lit(body)).otherwise(F.col("new_body"))).withColumn("refs", F.when(mine, A.cross_refs(F.lit(body))).otherwise(F.col("refs")))
        before = F.coalesce("adapted", F.lit(False)) if "adapted" in clauses.columns else F.lit(False)
        clauses = A.definitions_used(clauses.withColumn("adapted", mine | before).drop("terms"), draft.definitions)
        new = Draft(draft.spec, draft.skeleton, clauses, draft.definitions, draft.schedules, draft.recitals, draft.missing, draft.filled, draft.notes, draft.numbers)
        errors = [f"[{r.code}] {r.location}: {r.detail}" for r in self.validate(new).where("severity = 'error'").collect()]
        if errors:
            raise ValueError("the adapted clause fails validation: " + "; ".join(errors))
        return new


def _folder(source: str) -> str:
    """A source's name as the name of its folder."""
    return "s=" + quote(source, safe="")
