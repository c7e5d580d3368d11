"""Views of the sample tables as the inputs that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.functions.ids import canonical_name, doc_rid, edge_rid, entity_rid
from tidewater.operators import governance, retrieval, traces
from tidewater.sources import scratch, settings

#: The path rules of this view.
RULES = {"path_rules": [("src3/*", "RESTRICTED"), ("src7/*", "PUBLIC")]}
AS_OF = "2024-06-01 00:00:00"
#: The end of the hour whose traces are listed.
LAST_TRACES = "2024-01-15 12:00:00"
TENANT = "default"
#: What the rid of a document begins with.
PREFIX = "doc_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as collected files."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    uri = F.concat(F.lit(f"{TENANT}:"), path)
    return docs.select("doc_id", path.alias("path"), uri.alias("source_uri"), doc_rid(F.lit(TENANT), uri).alias("rid"), F.coalesce("text", F.lit("")).alias("text"), F.create_map().cast("map<string,string>").alias("frontmatter"), F.lit(TENANT).alias("tenant"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified documents."""
    rows = governance.classify(files(spark, sf_dir), settings.load(RULES))
    return rows.withColumns({"title": F.col("path"), "doc_rid": F.col("rid"), "section_path": F.lit("root"), "status": F.lit("active")})


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified documents without their texts, and their number of terms, classified once."""
    from tidewater.functions.text import terms

    return scratch.stored(spark, "documents", f"{sf_dir}/documents.parquet", lambda: documents(spark, sf_dir).withColumn("length", F.size(terms(F.col("text")))).drop("text", "frontmatter"))


def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of all documents, tokenised once and stored in the order of the terms; ``rid`` and ``doc_id`` name the document.

    A rid is stored as the number that its digits are, which is much shorter.
    """

    def make() -> DataFrame:
        digits = F.conv(F.substring("rid", len(PREFIX) + 1, 12), 16, 10).cast("long")
        keyed = files(spark, sf_dir).select(F.struct(digits.alias("number"), "doc_id").alias("key"), "text")
        return retrieval.postings(keyed, "key").select("key.number", "key.doc_id", "term", "tf", "length")

    rows = scratch.stored(spark, "postings", f"{sf_dir}/documents.parquet", make, ["term", "number"])
    rid = F.concat(F.lit(PREFIX), F.lpad(F.lower(F.hex("number")), 12, "0"))
    return rows.select(rid.alias("rid"), "doc_id", "term", "tf", "length")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a Markdown document; its turns are aggregated by conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("## "), F.coalesce("role", F.lit("none")), F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("part"))
    parts = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n\n").alias("parts"))
    return parts.select(F.col("conv_id").cast("string").alias("rid"), F.concat(F.lit("# conv "), F.col("conv_id").cast("string"), F.lit("\n\n"), "parts").alias("text"), F.lit("en").alias("language"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the documents that have one."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ids = files(spark, sf_dir).select("doc_id", "rid")
    return emb.join(ids, F.col("vec_id") == F.col("doc_id")).select("rid", "doc_id", "embedding")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as service entities."""
    nations = table(spark, sf_dir, "nation")
    return nations.select("n_nationkey", entity_rid(F.lit(TENANT), F.lit("Service"), F.col("n_name")).alias("rid"), canonical_name(F.col("n_name")).alias("name"), F.array(F.col("n_name")).alias("aliases"))


def designed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed set of designed edges between nations."""
    a = entities(spark, sf_dir).select(F.col("n_nationkey").alias("a"), F.col("rid").alias("from_rid"), F.col("name").alias("from_name"))
    b = entities(spark, sf_dir).select(F.col("n_nationkey").alias("b"), F.col("rid").alias("to_rid"), F.col("name").alias("to_name"))
    pairs = a.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(24)))).where("a <> b and (7 * a + b) % 8 = 0").join(b, "b")
    rid = edge_rid(F.lit(TENANT), F.lit("CALLS"), F.col("from_rid"), F.col("to_rid"))
    return pairs.select(rid.alias("rid"), F.lit("CALLS").alias("edge_type"), "from_rid", "to_rid", "from_name", "to_name", F.lit(0.6).alias("confidence"))


def calls(spark: SparkSession, sf_dir: str, days: int | None = 7) -> DataFrame:
    """Line items as calls from the supplier's nation to the customer's; the last days of shipping, or all."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate")
    if days is not None:
        last = li.agg(F.max("l_shipdate").alias("last"))
        li = li.join(F.broadcast(last), F.col("l_shipdate") > F.col("last") - F.expr(f"INTERVAL {int(days)} DAYS"))  # last: one row
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers, suppliers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = li.join(orders, li.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("from_service")), "s_nationkey").join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("to_service")), "c_nationkey")
    took = F.greatest(F.datediff("l_shipdate", "o_orderdate").cast("double"), F.lit(0.0))
    return rows.select("from_service", "to_service", took.alias("duration_ms"), (F.col("l_returnflag") == "R").alias("is_error"), F.col("l_orderkey").cast("string").alias("trace_id"), F.lit("service.name").alias("resolved_via"), F.lit("grpc").alias("protocol"), F.struct("l_orderkey", "l_linenumber").alias("ord"))


def observed(spark: SparkSession, sf_dir: str, days: int | None = 7) -> DataFrame:
    return traces.observed_edges(traces.aggregate_pairs(calls(spark, sf_dir, days)), F.to_timestamp(F.lit(AS_OF)))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans: service by type, peer by ``props.k``, duration by value."""
    return as_spans(table(spark, sf_dir, "events"))


def as_spans(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return events.select(
        F.col("event_id").cast("string").alias("trace_id"), start.alias("start_ns"), (start + F.round(F.col("value") * 1e6).cast("long")).alias("end_ns"),
        F.when(F.col("event_type") == "error", 2).otherwise(0).alias("code"),
        F.create_map(F.lit("peer.service"), F.when(k % 8 == 7, "").otherwise(F.concat(F.lit("svc-"), (k % 8).cast("string"))), F.lit("rpc.system"), F.lit("grpc")).alias("span_attrs"),
        F.create_map(F.lit("service.name"), F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))).alias("resource_attrs"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id",
    )


def trace_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trace documents in JSON, as a trace store returns them; the spans come out of these again."""
    rows = spans(spark, sf_dir)
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    own = F.array(pair("peer.service", F.col("span_attrs")["peer.service"]), pair("rpc.system", F.col("span_attrs")["rpc.system"]))
    span = F.struct(F.col("trace_id").alias("traceId"), F.col("start_ns").cast("string").alias("startTimeUnixNano"), F.col("end_ns").cast("string").alias("endTimeUnixNano"), F.struct("code").alias("status"), own.alias("attributes"))
    resource = F.struct(F.array(pair("service.name", F.col("resource_attrs")["service.name"])).alias("attributes"))
    batch = F.struct(resource.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))
    return rows.select(F.to_json(F.struct(F.array(batch).alias("batches"))).alias("trace"))


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries: the first two terms of three letters or more."""
    from tidewater.functions.text import terms

    rows = table(spark, sf_dir, "benchmark")
    words = F.slice(F.array_distinct(F.filter(terms(F.col("text")), lambda w: F.length(w) >= 3)), 1, 2)
    return rows.select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"))
