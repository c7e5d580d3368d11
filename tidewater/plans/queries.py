"""The registered queries over the sample tables: each applies one operator, or one composition of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewater.functions import access, ids, text as T
from tidewater.operators import chunking, difference, embedding, governance, graph, retrieval, traces
from tidewater.sources import lens, lexicon, scratch, settings, store, vectors

SETTINGS = settings.load(lens.RULES)
QUERY = "the and"
GAZETTEER = [
    {"name": "payment-service", "type": "Service", "aliases": ["payment"]},
    {"name": "order-service", "type": "Service", "aliases": ["order"]},
    {"name": "the-topic", "type": "Topic", "aliases": ["the and"]},
    {"name": "tion-service", "type": "Service", "aliases": ["tion"]},
]
Spark = SparkSession


def rid_documents(s: Spark, d: str) -> DataFrame:
    return lens.files(s, d).select("doc_id", "rid", "source_uri")


def canonical_names(s: Spark, d: str) -> DataFrame:
    parts = lens.table(s, d, "part").select(F.concat(F.lit(" "), F.col("p_name"), F.lit("__x ")).alias("raw"), "p_partkey")
    return parts.select("p_partkey", ids.canonical_name(F.col("raw")).alias("name"))


def content_hash_changed(s: Spark, d: str) -> DataFrame:
    files = lens.files(s, d).withColumn("content_hash", F.sha2("text", 256))
    old = files.select("source_uri", F.when(F.col("doc_id") % 3 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("content_hash")).alias("content_hash"), F.lit("active").alias("status")).where(F.col("source_uri") != "")
    return store.changed(files, old).select("doc_id", "content_hash")


def base_filter_docs(s: Spark, d: str) -> DataFrame:
    return access.base_filter(lens.documents(s, d), lens.TENANT, "INTERNAL").select("doc_id", "classification")


def pii_scan(s: Spark, d: str) -> DataFrame:
    rows = lens.files(s, d).select("doc_id", F.explode(governance.pii_matches(F.col("text"), SETTINGS["pii_patterns"])).alias("m"))
    return rows.select("doc_id", "m.pii_type", "m.n")


def classify_docs(s: Spark, d: str) -> DataFrame:
    return lens.documents(s, d).select("doc_id", "classification", "is_quarantined", "language", "doc_type")


def quarantine_split(s: Spark, d: str) -> DataFrame:
    return governance.outcomes(lens.documents(s, d))


def language_ratio(s: Spark, d: str) -> DataFrame:
    return lens.files(s, d).select("doc_id", T.language(F.col("text")).alias("language"))


def token_estimate(s: Spark, d: str) -> DataFrame:
    return lens.files(s, d).select("doc_id", T.token_estimate(F.col("text"), F.lit("en")).alias("en"), T.token_estimate(F.col("text"), F.lit("ko")).alias("ko"))


def section_split(s: Spark, d: str) -> DataFrame:
    return chunking.sections(lens.conversations(s, d)).select("rid", "section", "section_path", F.sha2("section_text", 256).alias("text_hash"))


def chunk_pack(s: Spark, d: str) -> DataFrame:
    small = SETTINGS | {"chunk_tokens": {"ko": 60, "other": 40}}
    return chunking.chunks(lens.conversations(s, d), small).select("rid", "doc_rid", "section_path", "chunk_index", "token_count", F.sha2("chunk_text", 256).alias("text_hash"))


def paragraph_split(s: Spark, d: str) -> DataFrame:
    """Conversations with a fence before each turn of a user, so that blank lines stand inside and outside of fences."""
    fenced = F.replace("text", F.lit("## user"), F.lit("```\n\n## user"))
    rows = lens.conversations(s, d).select("rid", F.posexplode(chunking.paragraphs(fenced)).alias("place", "paragraph"))
    return rows.select("rid", "place", F.sha2("paragraph", 256).alias("text_hash"))


def mention_free(s: Spark, d: str) -> DataFrame:
    turns = lens.table(s, d, "conversations")
    said = F.concat(F.lit("<@U"), F.col("conv_id").cast("string"), F.lit("> "), "text", F.lit(" <@BOT> <@low>"))
    return turns.select("conv_id", "turn", F.sha2(T.mention_free(said), 256).alias("text_hash"))


def search_text(s: Spark, d: str) -> DataFrame:
    parts = chunking.sections(lens.conversations(s, d))
    prefix = F.when(F.col("section") % 3 == 0, F.lit("")).when(F.col("section") % 3 == 1, F.concat(F.lit("about "), "rid"))
    return parts.select("rid", "section", F.sha2(T.search_text(prefix, F.col("section_path"), F.col("section_text")), 256).alias("text_hash"))


def postings_build(s: Spark, d: str) -> DataFrame:
    return retrieval.postings(lens.files(s, d).select("doc_id", "text"), key="doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _docs(s: Spark, d: str) -> DataFrame:
    return access.base_filter(lens.stored_documents(s, d), lens.TENANT, "INTERNAL")


def _enriched(s: Spark, d: str, ranked: DataFrame) -> DataFrame:
    # the texts of the few ranked rows alone
    few = F.broadcast(ranked.select("rid"))  # top-k rows
    texts = lens.files(s, d).join(few, "rid", "left_semi").select("rid", "text")
    return retrieval.enrich(ranked, _docs(s, d).join(F.broadcast(texts), "rid"))  # texts: as many as the ranked rows


def _lexical(s: Spark, d: str) -> DataFrame:
    asked = s.createDataFrame([(0, QUERY)], "query_id long, query string")
    return retrieval.indexed_search(lens.stored_postings(s, d), _docs(s, d).select("rid", "length"), asked, 20).drop("query_id")


def lexical_topk(s: Spark, d: str) -> DataFrame:
    return _lexical(s, d)


def _vector(s: Spark, d: str) -> DataFrame:
    found = lens.table(s, d, "embeddings").orderBy("vec_id").select("embedding").first()
    near = lens.vectors(s, d).join(_docs(s, d).select("rid"), "rid", "left_semi")
    return retrieval.vector_search(near, list(found["embedding"]) if found else [0.0], 20)


def vector_topk(s: Spark, d: str) -> DataFrame:
    return _vector(s, d)


def vector_index_topk(s: Spark, d: str) -> DataFrame:
    """Inverted lists over all vectors, every list probed: the ten nearest of each vector whose id can be divided by 50, exact."""
    tables = store.Store(s, scratch.new_path(s, "vectors"))
    rows = scratch.written(lens.table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("rid"), "embedding", "vec_id"), "vector-rows")
    tx = tables.begin()
    tx.replace("lengths", rows.select("rid", F.lit(lens.TENANT).alias("tenant"), F.lit("PUBLIC").alias("classification"), F.lit(1).cast("long").alias("generation")), "rid")
    index = vectors.VectorIndex(tables)
    lists = index.build(tx, rows.select("rid", "embedding"))
    tx.commit()
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return index.search(asked, lens.TENANT, "PUBLIC", 10, probes=lists)


def rrf_fusion(s: Spark, d: str) -> DataFrame:
    return retrieval.fuse(_lexical(s, d), _vector(s, d), 10)


def hybrid_search(s: Spark, d: str) -> DataFrame:
    hits = _enriched(s, d, retrieval.fuse(_lexical(s, d), _vector(s, d), 10))
    return hits.select("rank", "rid", "title", "classification", "score", "snippet")


def batch_lexical(s: Spark, d: str) -> DataFrame:
    return retrieval.indexed_search(lens.stored_postings(s, d), lens.stored_documents(s, d).select("doc_id", "length"), lens.query_texts(s, d), 5, key="doc_id")


def lexical_scan(s: Spark, d: str) -> DataFrame:
    """The same ranking straight from the texts, for corpora that are not indexed."""
    return retrieval.lexical_search(lens.files(s, d).select("doc_id", "text"), lens.query_texts(s, d), 5, key="doc_id")


def indexed_after_change(s: Spark, d: str) -> DataFrame:
    """A stored index made of all documents, then updated: a tenth of them has a new text, a tenth goes; searched after both commits."""
    index = lexicon.LexicalIndex(store.Store(s, scratch.new_path(s, "lexicon")))
    docs = lens.documents(s, d).select("doc_id", "rid", F.col("rid").alias("doc_rid"), "tenant", "classification", "is_quarantined", "text")
    tx = index.store.begin()
    index.update(tx, docs.where("not is_quarantined"), docs.select("doc_rid"))
    tx.commit()
    changed = docs.where("not is_quarantined and doc_id % 10 = 3").withColumn("text", F.concat("text", F.lit(" the and")))
    tx = index.store.begin()
    index.update(tx, changed, docs.where("doc_id % 10 in (3, 7)").select("doc_rid"))
    tx.commit()
    asked = s.createDataFrame([(0, QUERY)], "query_id long, query string")
    return index.search(asked, lens.TENANT, "INTERNAL", 20).select("rid", "score", "rank")


def phrase_search(s: Spark, d: str) -> DataFrame:
    """The first two terms of each benchmark item as a phrase, by the places in the postings."""
    first = F.slice(T.terms(F.col("text")), 1, 2)
    asked = lens.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(first).alias("place", "term"))
    stored = retrieval.positional(lens.files(s, d).select("doc_id", T.terms(F.col("text")).alias("terms")), ["doc_id"])
    return retrieval.in_a_row(retrieval.of_terms(stored, asked), asked, key="doc_id")


def ingest_outcomes(s: Spark, d: str) -> DataFrame:
    """What becomes of each document where one PII pattern is broken and the provider of vectors refuses some texts."""

    def embed(texts: list[str]) -> list[list[float]]:
        if any(len(t) % 7 == 0 for t in texts):
            raise ValueError("refused")
        return [[float(len(t))] for t in texts]

    patterns, _ = governance.usable_patterns(s, SETTINGS["pii_patterns"] | {"broken": "(["})
    docs = governance.classify(lens.files(s, d), SETTINGS | {"pii_patterns": patterns})
    parts = F.when(F.col("text") != "", F.array("text", "path")).otherwise(F.array().cast("array<string>"))
    chunks = docs.where("not is_quarantined").select(F.col("rid").alias("doc_rid"), F.explode(parts).alias("chunk_text"))
    made = embedding.embedded(chunks, "chunk_text", embed, tries=1).select("doc_rid", "embed_error")
    return governance.ingest_outcomes(docs, made)


def route_queries(s: Spark, d: str) -> DataFrame:
    known = graph.patterns(GAZETTEER)
    rows = lens.table(s, d, "benchmark").withColumn("query", F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("topology of "), "text")).when(F.col("item_id") % 4 == 1, F.concat(F.lit("DIFF "), "text")).otherwise(F.col("text")))
    rows = rows.withColumn("asked", F.when(F.col("item_id") % 7 == 6, "vector_only").otherwise("auto"))
    rows = graph.with_entities(rows.select("item_id", "query", "asked"), "query", known)
    return rows.select("item_id", retrieval.route(F.col("query"), F.size("entities"), F.col("asked"), SETTINGS).alias("route"))


def entity_match(s: Spark, d: str) -> DataFrame:
    rows = graph.with_entities(lens.files(s, d).select("doc_id", "text"), "text", graph.patterns(GAZETTEER)).select("doc_id", F.explode("entities").alias("e"))
    return rows.select("doc_id", "e.name", "e.type", "e.position")


def entity_match_large(s: Spark, d: str) -> DataFrame:
    """Names of all parts, customers and suppliers and of the gazetteer as one dictionary, found in texts that name some of them."""
    names = [r[0] for t, c in (("part", "p_name"), ("supplier", "s_name")) for r in lens.table(s, d, t).select(c).distinct().orderBy(c).collect()]  # a dictionary is bounded by what a worker holds
    known = graph.patterns([*GAZETTEER, *({"name": n, "type": "Part"} for n in names)])
    parts = lens.table(s, d, "part").select("p_partkey", F.col("p_name").alias("one"), F.concat("p_name", F.lit(" and the and "), F.upper("p_name"), F.lit("; order of "), F.reverse("p_name")).alias("text"))
    found = graph.with_entities(parts, "text", known).select("p_partkey", F.explode("entities").alias("e"))
    return found.select("p_partkey", "e.name", "e.type", "e.position")


def _relations(s: Spark, d: str) -> DataFrame:
    # the sample prose states nothing, so every third item gets a sentence that does
    rows = lens.table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("rid"), F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit(" payment calls order. "), "text")).when(F.col("item_id") % 3 == 1, F.concat("text", F.lit(". payment does not call order. it emits tion. "))).otherwise(F.col("text")).alias("chunk_text"))
    return graph.relations(rows, graph.patterns(GAZETTEER), SETTINGS)


def relation_extract(s: Spark, d: str) -> DataFrame:
    return _relations(s, d)


def relation_evidence(s: Spark, d: str) -> DataFrame:
    known = s.createDataFrame([(g["name"], g["type"]) for g in GAZETTEER], "name string, type string").select("name", ids.entity_rid(F.lit("default"), F.col("type"), F.col("name")).alias("rid"))
    edges, evidence = graph.edges_and_evidence(_relations(s, d), known)
    return edges.join(evidence.groupBy("subject_rid").agg(F.count("*").alias("n_evidence")), F.col("rid") == F.col("subject_rid")).select("rid", "edge_type", "confidence", "n_evidence")


def edge_upsert_max(s: Spark, d: str) -> DataFrame:
    old = lens.designed(s, d).select("rid", "from_name", "to_name", "confidence")
    new = old.withColumns({"confidence": F.when(F.length("from_name") > 8, 0.9).otherwise(0.3), "from_name": F.upper("from_name")})
    return store.merge_greatest(old, new, "rid", "confidence")


def entity_insert_absent(s: Spark, d: str) -> DataFrame:
    rows = lens.entities(s, d).select("rid", "name", "n_nationkey")
    old, new = rows.where("n_nationkey % 2 = 0").withColumn("origin", F.lit("old")), rows.withColumn("origin", F.lit("new"))
    return store.insert_absent(old, new, ["name"])


def observed_replace(s: Spark, d: str) -> DataFrame:
    columns = ["rid", "call_count", "error_rate", "latency_p95", "protocol"]
    old = lens.observed(s, d, 30).select(*columns)
    new = lens.observed(s, d, 7).select(*columns).withColumn("protocol", F.lit("http"))
    return store.replace_columns(old, new, "rid", ["call_count", "error_rate", "latency_p95"])


def chunk_supersede(s: Spark, d: str) -> DataFrame:
    rows = lens.table(s, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("rid"), F.col("conv_id").alias("owner"), F.lit("active").alias("status"))
    new = rows.where("owner % 4 = 0").where(~F.col("rid").endswith("-1"))
    return store.supersede(rows, new, "owner")


def evidence_link(s: Spark, d: str) -> DataFrame:
    edges = lens.designed(s, d)
    docs = lens.files(s, d).select(F.col("rid"), F.col("text").alias("chunk_text"), "doc_id")
    links = edges.withColumn("n", F.length("from_name") + F.length("to_name")).join(docs.select(F.col("rid").alias("evidence_rid"), "doc_id"), F.col("doc_id") == F.col("n"), "left")
    evidence = links.select(F.col("rid").alias("subject_rid"), F.coalesce("evidence_rid", F.lit("gone")).alias("evidence_rid"), F.concat(F.lit("n="), F.col("n").cast("string")).alias("note"))
    return difference.with_evidence(edges, evidence, docs)


def _named(s: Spark, d: str, edges: DataFrame) -> DataFrame:
    return graph.with_names(edges.drop("from_name", "to_name"), lens.entities(s, d))


def resolve_names(s: Spark, d: str) -> DataFrame:
    nations, parts = lens.table(s, d, "nation").select(F.lower("n_name").alias("name")), lens.table(s, d, "part").select(F.col("p_name").alias("name"))
    return graph.resolve(nations.union(parts).distinct(), lens.entities(s, d))


def designed_edges(s: Spark, d: str) -> DataFrame:
    return _named(s, d, lens.designed(s, d)).select("rid", "from_name", "to_name", "confidence")


def observed_edges(s: Spark, d: str) -> DataFrame:
    return _named(s, d, lens.observed(s, d)).select("rid", "from_name", "to_name", "call_count", "error_rate", "latency_p50", "latency_p95", "latency_p99")


def edge_diff(s: Spark, d: str) -> DataFrame:
    return difference.edge_diff(lens.designed(s, d), lens.observed(s, d))


def diff_summary(s: Spark, d: str) -> DataFrame:
    return difference.summary(edge_diff(s, d))


def diff_detail(s: Spark, d: str) -> DataFrame:
    return difference.detail(edge_diff(s, d)).select("diff_type", "edge_rid", "obs_rid", "detail")


def trace_evidence(s: Spark, d: str) -> DataFrame:
    return traces.evidence(lens.observed(s, d), lens.AS_OF)


def _evidence(s: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    # a designed edge's document is the one whose id is the length of both names; ids above the clearance have no text
    docs = lens.files(s, d).select("doc_id", F.col("rid").alias("evidence_rid"))
    written = lens.designed(s, d).withColumn("n", F.length("from_name") + F.length("to_name")).join(docs, F.col("doc_id") == F.col("n"))
    written = written.select(F.col("rid").alias("subject_rid"), "evidence_rid", F.concat(F.lit("n="), F.col("n").cast("string")).alias("note"))
    texts = lens.files(s, d).select("rid", F.col("text").alias("chunk_text"))
    chunks = _docs(s, d).select("rid", "title", "section_path").join(texts, "rid")
    return written.unionByName(trace_evidence(s, d).select("subject_rid", "evidence_rid", "note")), chunks


def diff_evidence(s: Spark, d: str) -> DataFrame:
    return difference.diff_evidence(edge_diff(s, d), *_evidence(s, d))


def graph_evidence(s: Spark, d: str) -> DataFrame:
    edges = graph.neighbors(lens.designed(s, d).select("rid", "from_rid", "to_rid"), _centre(s, d), 2)
    return difference.with_evidence(edges.select("rid").distinct(), *_evidence(s, d))


def diff_filtered(s: Spark, d: str) -> DataFrame:
    return difference.filtered(edge_diff(s, d), "observed_only", "nation-3").select("obs_rid", "from_name", "to_name", "call_count")


def tag_flags(s: Spark, d: str) -> DataFrame:
    rows = lens.designed(s, d).select("rid", F.when(F.length("from_name") % 2 == 0, F.array(F.lit("old"), F.lit("doc_only"))).otherwise(F.array(F.lit("old"))).alias("quality_flags"))
    hit = edge_diff(s, d).where("diff_type = 'doc_only'").select(F.col("edge_rid").alias("rid"))
    return difference.tag(rows, hit, "doc_only").select("rid", F.array_join("quality_flags", ",").alias("flags"))


def _centre(s: Spark, d: str):
    return ids.entity_rid(F.lit(lens.TENANT), F.lit("Service"), F.lit("NATION_0"))


def neighbors_1hop(s: Spark, d: str) -> DataFrame:
    return graph.neighbors(lens.designed(s, d).select("rid", "from_rid", "to_rid", "from_name", "to_name"), _centre(s, d), 1).select("hop", "rid", "from_name", "to_name")


def neighbors_2hop(s: Spark, d: str) -> DataFrame:
    return graph.neighbors(lens.designed(s, d).select("rid", "from_rid", "to_rid", "from_name", "to_name"), _centre(s, d), 2).select("hop", "rid", "from_name", "to_name")


def find_path(s: Spark, d: str) -> DataFrame:
    target = ids.entity_rid(F.lit(lens.TENANT), F.lit("Service"), F.lit("NATION_16"))
    found = graph.find_path(lens.designed(s, d).select("rid", "from_rid", "to_rid", "from_name", "to_name"), _centre(s, d), target, 3)
    return found.select("hop", "rid", "from_name", "to_name", F.array_join("path_edges", ",").alias("path_edges"))


def span_pairs(s: Spark, d: str) -> DataFrame:
    rows = traces.pairs(traces.spans(lens.trace_documents(s, d)), ["svc-1", "svc-2"])
    return rows.select("trace_id", "from_service", "to_service", F.round("duration_ms", 3).alias("duration_ms"), "is_error", "resolved_via", "protocol")


def recent_traces(s: Spark, d: str) -> DataFrame:
    """The first hundred traces of the hour before a time; the limit is the feature."""
    rows = traces.recent(traces.spans(lens.trace_documents(s, d)), F.to_timestamp(F.lit(lens.LAST_TRACES)), SETTINGS["lookback_minutes"])
    return traces.earliest(rows, 100).select("trace_id", "start_ns", "end_ns", "code")


def observed_windows(s: Spark, d: str) -> DataFrame:
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return lens.observed(s, d).select("rid", "interaction_style", shown("window_start"), shown("window_end"), shown("last_seen_at"))


def pair_aggregate(s: Spark, d: str) -> DataFrame:
    rows = traces.aggregate_pairs(traces.pairs(lens.spans(s, d), ["svc-1", "svc-2"]))
    return rows.select("from_service", "to_service", "call_count", "error_count", "error_rate", F.round("latency_p50", 3).alias("latency_p50"), "protocol", F.array_join("sample_trace_ids", ",").alias("samples"))


def pair_percentiles(s: Spark, d: str) -> DataFrame:
    return traces.percentiles(lens.calls(s, d, None).where("duration_ms > 0"), ["from_service", "to_service"])


def suggest_entities(s: Spark, d: str) -> DataFrame:
    """By the trigrams of all names; ``suggest`` itself gives the same rows."""
    entities = lens.entities(s, d)
    return graph.suggest_indexed(entities, graph.trigram_index(entities), "nation-2", 10).select("rid", "name", "similarity")


def documents_page(s: Spark, d: str) -> DataFrame:
    docs = _docs(s, d).select("doc_id", "title", "classification")
    turns = lens.table(s, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n"))
    return docs.join(turns, "doc_id", "left").select("doc_id", "title", "classification", F.coalesce("n", F.lit(0)).alias("chunk_count")).orderBy(F.desc("doc_id")).offset(10).limit(20)


def status_counts(s: Spark, d: str) -> DataFrame:
    docs = lens.stored_documents(s, d).agg(F.count_if(F.col("status") == "active").alias("documents"), F.count_if("is_quarantined").alias("quarantined"), F.max("doc_id").alias("last_doc"))
    edges, seen = lens.designed(s, d).agg(F.count("*").alias("edges")), lens.observed(s, d).agg(F.count("*").alias("observed_edges"))
    names = lens.entities(s, d).agg(F.count("*").alias("entities"))
    return docs.crossJoin(edges).crossJoin(seen).crossJoin(names)  # one row each


def _hits(s: Spark, d: str) -> DataFrame:
    # rows of one tenth of the ranks share a document here, so that documents repeat
    hits = _enriched(s, d, retrieval.fuse(_lexical(s, d), _vector(s, d), 10))
    return hits.withColumn("doc_rid", F.concat(F.lit("d"), (F.col("rank") % 4).cast("string")))


def evidence_packet(s: Spark, d: str) -> DataFrame:
    return retrieval.packet(_hits(s, d).withColumn("source_uri", F.col("doc_rid")))


def prompt_text(s: Spark, d: str) -> DataFrame:
    return retrieval.prompt_text(_enriched(s, d, retrieval.fuse(_lexical(s, d), _vector(s, d), 3)))


def stream_span_windows(s: Spark, d: str) -> DataFrame:
    """The batch form of the streaming windows."""
    from tidewater.streaming import spans

    return spans.windowed_pairs(lens.spans(s, d), ["svc-1"], 60).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "from_service", "to_service", "call_count", "error_count")


def crm_validation(s: Spark, d: str) -> DataFrame:
    """Keys that repeat and edges without an end: no rows where the tables are sound; here every table's counts."""
    edges, ends = lens.designed(s, d), lens.entities(s, d)
    orphans = edges.join(ends.select(F.col("rid").alias("to_rid")), "to_rid", "left_anti").agg(F.count("*").alias("orphans"))
    repeated = lens.files(s, d).groupBy("rid").count().agg(F.count_if(F.col("count") > 1).alias("repeated"), F.count("*").alias("distinct_rids"))
    return orphans.crossJoin(repeated)


def turn_order(s: Spark, d: str) -> DataFrame:
    """Turns with the roles before and after, as the sliding frame of sentences has its neighbours."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    return lens.table(s, d, "conversations").select("conv_id", "turn", F.lag("role").over(by).alias("before"), F.lead("role").over(by).alias("after"))


ALL = [
    rid_documents, canonical_names, content_hash_changed, base_filter_docs, pii_scan, classify_docs, quarantine_split, language_ratio, token_estimate, section_split, paragraph_split, chunk_pack, search_text, mention_free, postings_build, indexed_after_change, phrase_search, ingest_outcomes, lexical_topk, vector_topk, vector_index_topk, rrf_fusion, hybrid_search,
    batch_lexical, lexical_scan, route_queries, entity_match, entity_match_large, relation_extract, relation_evidence, edge_upsert_max, entity_insert_absent, observed_replace, chunk_supersede, evidence_link, resolve_names, designed_edges, observed_edges, edge_diff, diff_summary, diff_detail, trace_evidence, diff_evidence, graph_evidence, diff_filtered, tag_flags,
    neighbors_1hop, neighbors_2hop, find_path, span_pairs, recent_traces, observed_windows, pair_aggregate, pair_percentiles, suggest_entities, documents_page, status_counts, evidence_packet, prompt_text, stream_span_windows, crm_validation, turn_order,
]
