"""One object for what a client of the service can ask: ingest, search, answer, graph, diff, traces, listings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.functions import access, ids
from tidewater.operators import chunking, difference, governance, graph, retrieval, traces
from tidewater.operators.embedding import Embed, embedded
from tidewater.plans import schema
from tidewater.sources import lexicon, markdown, settings, store, vectors


class Engine:
    """Tables in a ``Store``; every question is a plan over them.

    ``embed`` turns texts into vectors (for ingest in batches inside tasks, for queries on the driver); without it,
    retrieval is lexical alone.  ``answer_with`` turns a prompt into text; without it, answers quote the evidence.
    ``tokenizer`` makes the terms of index and queries alike.
    """

    def __init__(self, spark: SparkSession, folder: str, gazetteer: list[dict[str, Any]] | None = None, config: dict[str, Any] | None = None, embed: Embed | None = None, answer_with: Callable[[str], str] | None = None, tokenizer: lexicon.Tokenizer | None = None, pause: float = 1.0):
        self.spark, self.store, self.settings = spark, store.Store(spark, folder), settings.load(config)
        self.gazetteer, self.embed, self.answer_with, self.pause = gazetteer or [], embed, answer_with, pause
        self.index, self.vectors = lexicon.LexicalIndex(self.store, tokenizer), vectors.VectorIndex(self.store)
        self.settings["pii_patterns"], self.broken_patterns = governance.usable_patterns(spark, self.settings["pii_patterns"])

    def table(self, name: str, tx: store.Transaction | None = None) -> DataFrame:
        state = tx.state if tx else self.store.head()[1]
        return self.store.load(state[name]) if name in state else self.spark.createDataFrame([], schema.schema(name))

    def _entities(self, tenant: str) -> DataFrame:
        rows = [(g["name"], g["type"], list(g.get("aliases", ())), g.get("description", "")) for g in self.gazetteer]
        df = self.spark.createDataFrame(rows, "name string, entity_type string, aliases array<string>, description string")
        return schema.complete(df.withColumns({"tenant": F.lit(tenant), "rid": ids.entity_rid(F.lit(tenant), F.col("entity_type"), F.col("name"))}), "entities")

    def ingest(self, folder: str, tenant: str = "default", force: bool = False, as_of: str = "2024-01-01 00:00:00") -> dict[str, int]:
        """Collect, classify, gate, chunk, embed, index and extract, in one commit; returns the counts.  Unchanged files are left alone.

        ``total`` files stood in the folder, and each of them is ``indexed``, ``quarantined``, ``failed`` (none of its chunks got its vector), without
        anything to index (``empty``) or unchanged (``skipped``).  Failed documents are indexed for lexical search; ``errors`` lists what went wrong, and
        ``embed_missing`` tries again.  A run that breaks off changes nothing.
        """
        tx = self.store.begin()
        found = markdown.collect(self.spark, folder, tenant)
        now = F.to_timestamp(F.lit(as_of))
        files = store.changed(found, self.table("documents", tx).where(F.col("tenant") == tenant), force)
        columns = {"rid": ids.doc_rid(F.lit(tenant), F.col("source_uri")), "tenant": F.lit(tenant), "title": F.col("path"), "hash": F.col("content_hash"), "updated_at": now, "created_at": now, "status": F.lit("active")}
        docs = tx.staged(governance.classify(files, self.settings).withColumns(columns))
        owners = docs.select(F.col("rid").alias("doc_rid"))
        replaced = ["hash", "content_hash", "classification", "is_quarantined", "quality_flags", "updated_at", "doc_type", "language"]
        tx.merge("documents", tx.staged(schema.complete(docs, "documents")), "rid", lambda old, new: store.replace_columns(old, new, "rid", replaced))

        open_ = docs.where("not is_quarantined")
        made = chunking.chunks(open_.select("rid", "text", "language"), self.settings).join(open_.select(F.col("rid").alias("doc_rid"), "source_uri", "classification", "tenant"), "doc_rid").withColumn("updated_at", now)
        made = embedded(made, "chunk_text", self.embed, self.settings.get("document_prefix", ""), pause=self.pause) if self.embed else made.withColumn("embed_error", F.lit(None).cast("string"))
        made = tx.staged(made)
        chunks = tx.staged(schema.complete(made, "chunks"))
        # all active chunks of a document that comes anew are superseded, also if it has none now
        tx.merge("chunks", chunks, "doc_rid", lambda old, new: store.supersede(old, new, "doc_rid", owners=owners), touched=owners)
        self.index.update(tx, chunks.select("rid", "doc_rid", "tenant", "classification", F.col("search_text").alias("text")), owners)
        self.vectors.update(tx, chunks.select("rid", F.lit(tx.number).cast("long").alias("generation"), "embedding"))

        tx.merge("entities", tx.staged(self._entities(tenant)), "rid", lambda old, new: store.insert_absent(old, new, ["tenant", "entity_type", "name"]))
        self._index_names(tx, self._entities(tenant))
        relations = graph.relations(chunks, graph.patterns(self.gazetteer), self.settings)
        edges, evidence = graph.edges_and_evidence(relations, self.table("entities", tx).where(F.col("tenant") == tenant), tenant)
        tx.merge("edges", tx.staged(schema.complete(edges.withColumn("tenant", F.lit(tenant)), "edges")), "rid", lambda old, new: store.merge_greatest(old, new, "rid", "confidence"))
        tx.merge("evidence", tx.staged(schema.complete(evidence.withColumn("tenant", F.lit(tenant)), "evidence")), "rid", lambda old, new: store.insert_absent(old, new, ["rid"]))

        outcomes = tx.staged(governance.ingest_outcomes(docs, made))
        wrong = made.where("embed_error is not null").select("doc_rid", "rid", F.lit("embed").alias("stage"), F.col("embed_error").alias("error"), F.lit(as_of).alias("at"))
        tx.merge("ingest_errors", tx.staged(wrong), "doc_rid", lambda old, new: old.join(owners, "doc_rid", "left_anti").select(*new.columns).unionByName(new), touched=owners)
        counts = outcomes.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("indexed", "quarantined", "failed", "skipped")), F.count("*").alias("n")).first()
        total = found.count()
        tx.commit()
        return {"total": total, "indexed": counts["indexed"], "quarantined": counts["quarantined"], "failed": counts["failed"], "empty": counts["skipped"], "skipped": total - counts["n"]}

    def _index_names(self, tx: store.Transaction, entities: DataFrame) -> None:
        """The trigrams of new names, for suggestions."""
        tx.merge("trigrams", tx.staged(graph.trigram_index(entities)), "gram", lambda old, new: old.unionByName(new).distinct())

    def errors(self) -> DataFrame:
        """(doc_rid, rid, stage, error, at): what went wrong with the chunks of each document when it was last ingested."""
        state = self.store.head()[1]
        return self.store.load(state["ingest_errors"]) if "ingest_errors" in state else self.spark.createDataFrame([], "doc_rid string, rid string, stage string, error string, at string")

    def embed_missing(self) -> int:
        """Ask the provider again for active chunks without a vector, as after a run that it failed; returns how many have one now."""
        tx = self.store.begin()
        missing = self.table("chunks", tx).where("status = 'active' and embedding is null")
        if self.embed is None or missing.isEmpty():
            return 0
        made = tx.staged(embedded(missing, "chunk_text", self.embed, self.settings.get("document_prefix", ""), pause=self.pause).where("embedding is not null"))
        new = made.select(*schema.schema("chunks").names)
        tx.merge("chunks", new, "doc_rid", lambda old, new: store.replace_columns(old, new, "rid", ["embedding"]))
        if tx.has("ingest_errors"):
            done = made.select("doc_rid", "rid")
            tx.merge("ingest_errors", tx.read("ingest_errors").limit(0), "doc_rid", lambda old, _: old.join(done, ["doc_rid", "rid"], "left_anti").select(*old.columns), touched=done.select("doc_rid"))
        if tx.has("lengths"):
            self.vectors.update(tx, made.join(tx.read("lengths").select("rid", "generation"), "rid"))
        n = made.count()
        tx.commit()
        return n

    def index_vectors(self, n_lists: int | None = None) -> int:
        """Put the vectors of all active chunks in inverted lists, which ingest then keeps up and ``search`` probes; returns the number of lists."""
        tx = self.store.begin()
        if not tx.has("lengths"):
            return 0
        n = self.vectors.build(tx, tx.staged(self.table("chunks", tx).where("status = 'active' and embedding is not null").select("rid", "embedding")), n_lists)
        tx.commit()
        return n

    def visible_chunks(self, tenant: str = "default", clearance: str = "INTERNAL") -> DataFrame:
        docs = self.table("documents").select(F.col("rid").alias("d"), "title")
        rows = access.base_filter(self.table("chunks"), tenant, clearance)
        return rows.join(docs, F.col("doc_rid") == F.col("d"), "left").withColumn("text", F.col("chunk_text")).drop("d")

    def route(self, query: str, asked: str = "auto") -> str:
        """The route of one query, by the same expression as for a table of queries."""
        return self._named(query).select(retrieval.route(F.col("query"), F.size("entities"), F.lit(asked), self.settings).alias("r")).first()["r"]

    def _named(self, query: str) -> DataFrame:
        """One row: the query and the entities that it names."""
        return graph.with_entities(self.spark.createDataFrame([(query,)], "query string"), "query", graph.patterns(self.gazetteer))

    def search(self, query: str, tenant: str = "default", clearance: str = "INTERNAL", top_k: int = 10, route: str = "auto") -> DataFrame:
        """Hits in rank order; the access filter stands below both rankings.  The route ``vector_only`` leaves the lexical ranking out.

        Texts are read for the hits alone: terms, lengths and statistics are stored by ingest.
        """
        if not query.strip():
            raise ValueError("the query is blank")
        chunks = self.visible_chunks(tenant, clearance)
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        lexical = self.index.search(asked, tenant, clearance, self.settings["top_k"]).drop("query_id")
        if self.route(query, route) == "vector_only":
            if self.embed is None:
                raise ValueError("vector_only needs embed")
            lexical = lexical.limit(0)
        vector = lexical.limit(0)
        if self.embed is not None:
            target = list(map(float, self.embed([self.settings.get("query_prefix", "") + query])[0]))
            if self.store.has("vectors"):
                one = self.spark.createDataFrame([(0, target)], "query_id long, embedding array<float>")
                vector = self.vectors.search(one, tenant, clearance, self.settings["top_k"]).drop("query_id")
            else:
                vector = retrieval.vector_search(chunks, target, self.settings["top_k"])
        best = retrieval.fuse(lexical, vector, top_k, self.settings["rrf_k"])
        return retrieval.enrich(F.broadcast(best), chunks)  # top_k rows

    def answer(self, query: str, **how: Any) -> dict[str, Any]:
        """Answer, evidence and provenance; without hits a fixed text, without a model or if it fails the evidence itself."""
        found = self.search(query, **how)
        hits = found.orderBy("rank").collect()
        if not hits:
            return {"answer": "Nothing was found for this question.", "evidence": [], "graph": [], "provenance": [], "route": self.route(query), "llm_failed": False}
        table = self.spark.createDataFrame(hits, found.schema)
        prompt, failed = retrieval.prompt_text(table).first()["prompt"], False
        out = prompt
        if self.answer_with is not None:
            try:
                out = self.answer_with(f"{prompt}\n\n## Question\n{query}")
            except Exception:
                failed = True
        sources = retrieval.packet(table).orderBy("first_rank").collect()
        route = self.route(query)
        around = self._around(query) if "graph" in route else []
        return {"answer": out, "evidence": [h.asDict() for h in hits], "graph": around, "provenance": [s.asDict() for s in sources], "route": route, "llm_failed": failed}

    def _around(self, query: str) -> list[dict[str, Any]]:
        """The edges within two hops of the first entity that the query names."""
        names = self._named(query).first()["entities"]
        return [r.asDict() for r in self.graph(names[0]["name"], 2).collect()] if names else []

    def answer_events(self, query: str, **how: Any) -> Iterator[tuple[str, Any]]:
        """The answer as events: evidence, graph, answer_delta, done; or error."""
        try:
            found = self.answer(query, **how)
            yield "evidence", found["evidence"]
            around = found["graph"] or self._around(query)
            if around:
                yield "graph", around
            for line in found["answer"].split("\n"):
                yield "answer_delta", line
            yield "done", {"provenance": found["provenance"]}
        except Exception as e:
            yield "error", str(e)

    def graph(self, entity: str, hops: int = 1, tenant: str = "default") -> DataFrame:
        """Designed edges around an entity, and at the first hop the observed ones, with names and evidence counts."""
        if hops not in (1, 2):
            raise ValueError("hops must be 1 or 2")
        entities = self.table("entities")
        centre = F.lit(graph.resolve(self.spark.createDataFrame([(entity,)], "name string"), entities).first()["rid"])
        active = lambda name: graph.with_names(self.table(name).where("status = 'active'"), entities).select("rid", "edge_type", "from_rid", "to_rid", "from_name", "to_name")
        designed = graph.neighbors(active("edges"), centre, hops).withColumn("origin", F.lit("designed"))
        seen = graph.neighbors(active("observed_edges"), centre, 1).withColumn("origin", F.lit("observed"))
        counts = self.table("evidence").groupBy(F.col("subject_rid").alias("rid")).agg(F.count("*").alias("n_evidence"))
        return designed.unionByName(seen).join(counts, "rid", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))

    def centre(self, entity: str) -> dict[str, Any] | None:
        """Name, type, aliases and description of the entity at the centre of a graph; None if it is unknown."""
        entities = self.table("entities")
        rid = graph.resolve(self.spark.createDataFrame([(entity,)], "name string"), entities).first()["rid"]
        found = entities.where(F.col("rid") == rid).select("rid", "name", "entity_type", "aliases", "description").first()
        return found.asDict() if found else None

    def evidence(self, edges: DataFrame, tenant: str = "default", clearance: str = "INTERNAL") -> DataFrame:
        """(edge_rid, evidence_rid, note, snippet, section_path, title) of ``edges`` (rid); texts above the clearance stay null."""
        return difference.with_evidence(edges, self.table("evidence"), self.visible_chunks(tenant, clearance))

    def graph_evidence(self, entity: str, hops: int = 1, tenant: str = "default", clearance: str = "INTERNAL") -> DataFrame:
        """The evidence of all edges around an entity."""
        return self.evidence(self.graph(entity, hops, tenant).select("rid").distinct(), tenant, clearance)

    def diff_evidence(self, flag: str | None = None, entity: str | None = None, tenant: str = "default", clearance: str = "INTERNAL") -> DataFrame:
        """The evidence of the edges that differ, of either side, with the kind of difference."""
        return difference.diff_evidence(self.diff(flag, entity), self.table("evidence"), self.visible_chunks(tenant, clearance))

    def aggregate_traces(self, trace_documents: DataFrame, tenant: str = "default", as_of: str = "2024-01-01 00:00:00", max_traces: int | None = None, lookback_minutes: int | None = None) -> int:
        """Fold trace documents (column ``trace``, JSON) into the observed edges; returns the number of edges.

        With ``lookback_minutes`` only traces that began within so many minutes before ``as_of`` count.
        """
        rows = traces.spans(trace_documents)
        if lookback_minutes is not None:
            rows = traces.recent(rows, F.to_timestamp(F.lit(as_of)), lookback_minutes)
        if max_traces is not None:
            rows = traces.earliest(rows, max_traces)
        known = [w for w, _, _ in graph.patterns(self.gazetteer)]
        pairs = traces.pairs(rows, known).withColumns({c: ids.canonical_name(F.col(c)) for c in ("from_service", "to_service")})
        edges = traces.observed_edges(traces.aggregate_pairs(pairs), F.to_timestamp(F.lit(as_of)), tenant, self.settings["window_minutes"]).cache()
        ends = edges.select(F.col("from_service").alias("name")).union(edges.select("to_service")).distinct().withColumns({"entity_type": F.lit("Service"), "tenant": F.lit(tenant)})
        new = schema.complete(ends.withColumn("rid", ids.entity_rid(F.lit(tenant), F.lit("Service"), F.col("name"))), "entities")
        tx = self.store.begin()
        tx.merge("entities", tx.staged(new), "rid", lambda old, new: store.insert_absent(old, new, ["tenant", "entity_type", "name"]))
        self._index_names(tx, new)
        replaced = ["call_count", "error_rate", "latency_p50", "latency_p95", "latency_p99", "sample_trace_ids", "trace_query_ref", "window_start", "window_end", "last_seen_at"]
        tx.merge("observed_edges", tx.staged(schema.complete(edges, "observed_edges")), "rid", lambda old, new: store.replace_columns(old, new, "rid", replaced))
        proof = traces.evidence(edges, as_of, tenant)
        # evidence that is there already is only marked as seen again
        tx.merge("evidence", tx.staged(schema.complete(proof, "evidence").withColumn("updated_at", F.to_timestamp(F.lit(as_of)))), "rid", lambda old, new: store.replace_columns(old, new, "rid", ["updated_at"]))
        tx.commit()
        n = edges.count()
        edges.unpersist()
        return n

    def diff(self, flag: str | None = None, entity: str | None = None) -> DataFrame:
        """Designed against observed edges, with a line of detail."""
        entities = self.table("entities")
        named = lambda name: graph.with_names(self.table(name).where("status = 'active'"), entities)
        seen = named("observed_edges").withColumn("call_count", F.col("call_count").cast("long"))
        return difference.detail(difference.filtered(difference.edge_diff(named("edges"), seen), flag, entity))

    def tag_differences(self) -> None:
        """Set the flags of all edges anew from the current differences."""
        found = self.diff().cache()
        edges = difference.tag(self.table("edges"), found.where("diff_type = 'doc_only'").select(F.col("edge_rid").alias("rid")), "doc_only")
        seen = difference.tag(self.table("observed_edges"), found.where("diff_type = 'observed_only'").select(F.col("obs_rid").alias("rid")), "observed_only")
        tx = self.store.begin()
        tx.replace("edges", edges.select(*schema.schema("edges").names), "rid")
        tx.replace("observed_edges", seen.select(*schema.schema("observed_edges").names), "rid")
        tx.commit()
        found.unpersist()

    def suggest(self, query: str, limit: int = 10, tenant: str = "default") -> DataFrame:
        if not query or not 1 <= limit <= 50:
            raise ValueError("a query and a limit of 1 to 50 are needed")
        active = self.table("entities").where((F.col("tenant") == tenant) & (F.col("status") == "active"))
        return graph.suggest_indexed(active, self.store.read("trigrams"), query, limit) if self.store.has("trigrams") else graph.suggest(active, query, limit)

    def documents(self, tenant: str = "default", clearance: str = "INTERNAL", offset: int = 0, limit: int = 20) -> DataFrame:
        if offset < 0 or not 1 <= limit <= 100:
            raise ValueError("offset must not be negative, limit must be 1 to 100")
        counts = self.table("chunks").where("status = 'active'").groupBy("doc_rid").agg(F.count("*").alias("n"))
        rows = access.base_filter(self.table("documents"), tenant, clearance).join(counts, F.col("rid") == F.col("doc_rid"), "left")
        return rows.orderBy(F.desc("updated_at"), "rid").offset(offset).limit(limit).select("rid", "title", "source_uri", "classification", "doc_type", "language", "updated_at", F.coalesce("n", F.lit(0)).alias("chunk_count"))

    def status(self) -> dict[str, Any]:
        """Counts of active rows, the latest change, and the summary of differences."""
        out: dict[str, Any] = {name: self.table(name).where("status = 'active'").count() for name in schema.TABLES}
        out["quarantined"] = self.table("documents").where("is_quarantined").count()
        out["updated_at"] = self.table("documents").agg(F.max("updated_at")).first()[0]
        out["differences"] = {r["diff_type"]: r["n"] for r in difference.summary(self.diff()).collect()}
        return out
