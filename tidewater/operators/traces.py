"""The observed graph: spans of traces into service pairs, and pairs into edges with rates and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.functions.ids import canonical_name, entity_rid, evidence_rid, observed_rid
from tidewater.sources import scratch

_ATTRIBUTES = "array<struct<key:string,value:struct<stringValue:string,intValue:string>>>"
_SPANS = f"array<struct<spans:array<struct<traceId:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:int>,attributes:{_ATTRIBUTES}>>>>"
TRACE = f"struct<batches:array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:{_SPANS},instrumentationLibrarySpans:{_SPANS}>>>"


def _as_map(attributes: Column, ints: bool) -> Column:
    """Attribute list to map; of one key the last holds."""
    value = lambda a: F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], F.lit("")) if ints else F.coalesce(a["value"]["stringValue"], F.lit(""))
    pairs = F.transform(F.coalesce(attributes, F.array().cast(_ATTRIBUTES)), lambda a: F.struct(F.coalesce(a["key"], F.lit("")).alias("key"), value(a).alias("value")))
    keys = F.transform(pairs, lambda p: p["key"])
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"]))
    return F.map_from_entries(last)


def spans(traces: DataFrame, column: str = "trace") -> DataFrame:
    """(trace_id, start_ns, end_ns, code, span_attrs, resource_attrs) of trace documents as JSON."""
    rows = traces.select(F.explode(F.from_json(F.col(column), TRACE)["batches"]).alias("b"))
    rows = rows.select(F.col("b.resource.attributes").alias("r"), F.explode(F.coalesce("b.scopeSpans", "b.instrumentationLibrarySpans")).alias("s")).select("r", F.explode("s.spans").alias("s"))
    return rows.select(F.coalesce("s.traceId", F.lit("")).alias("trace_id"), F.coalesce(F.col("s.startTimeUnixNano").cast("long"), F.lit(0)).alias("start_ns"), F.coalesce(F.col("s.endTimeUnixNano").cast("long"), F.lit(0)).alias("end_ns"), F.coalesce("s.status.code", F.lit(0)).alias("code"), _as_map(F.col("s.attributes"), True).alias("span_attrs"), _as_map(F.col("r"), False).alias("resource_attrs"))


def service(span: Column, resource: Column, known: list[str]) -> Column:
    """(name, via) of a service: its own name, the peer, the deployment, the address, else a hash of the attributes."""
    get = lambda m, k: F.nullif(F.try_element_at(m, F.lit(k)), F.lit(""))
    own, peer, address = F.trim(get(resource, "service.name")), F.trim(get(span, "peer.service")), F.trim(get(span, "server.address"))
    deploy, space = get(resource, "k8s.deployment.name"), get(resource, "k8s.namespace.name")
    both = F.concat(F.to_json(F.array_sort(F.map_entries(span))), F.to_json(F.array_sort(F.map_entries(resource))))
    pick = lambda name, via: F.struct(name.alias("name"), F.lit(via).alias("via"))
    return (
        F.when((get(resource, "service.name") != "unknown_service") & (own != ""), pick(own, "service.name"))
        .when(peer.isin(known), pick(peer, "peer.service+gazetteer"))
        .when((peer != "") & (peer != "unknown"), pick(peer, "peer.service"))
        .when(deploy.isNotNull(), pick(F.concat_ws("/", space, deploy), "k8s.metadata"))
        .when(address.isNotNull(), pick(address, "server.address"))
        .otherwise(pick(F.concat(F.lit("unknown_svc_"), F.substring(F.sha2(both, 256), 1, 8)), "hash_fallback"))
    )


def recent(found: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """Spans of the traces that began in the last ``minutes`` before ``as_of``, whole traces."""
    since = (F.unix_micros(as_of) - F.lit(int(minutes) * 60_000_000)) * 1000
    begun = found.groupBy("trace_id").agg(F.min("start_ns").alias("begun")).where((F.col("begun") >= since) & (F.col("begun") <= F.unix_micros(as_of) * 1000))
    return found.join(begun.select("trace_id"), "trace_id", "left_semi")


def earliest(found: DataFrame, most: int) -> DataFrame:
    """Spans of the ``most`` traces that began first, whole traces; ties go by the id."""
    begun = found.groupBy("trace_id").agg(F.min("start_ns").alias("begun")).orderBy("begun", "trace_id").limit(most)
    return found.join(begun.select("trace_id"), "trace_id", "left_semi")


def pairs(found: DataFrame, known: list[str]) -> DataFrame:
    """(from_service, to_service, duration_ms, is_error, trace_id, resolved_via, protocol, ord) of spans that name a peer."""
    empty = F.create_map().cast("map<string,string>")
    peer = F.try_element_at("span_attrs", F.lit("peer.service"))
    rows = found.where(F.coalesce(peer, F.lit("")) != "")
    source, target = service(F.col("span_attrs"), F.col("resource_attrs"), known), service(F.map_from_arrays(F.array(F.lit("peer.service")), F.array(peer)), empty, known)
    took = F.greatest((F.col("end_ns") - F.col("start_ns")) / 1e6, F.lit(0.0))
    protocol = F.coalesce(F.try_element_at("span_attrs", F.lit("rpc.system")), F.try_element_at("span_attrs", F.lit("http.method")), F.lit(""))
    return rows.select(source["name"].alias("from_service"), target["name"].alias("to_service"), took.alias("duration_ms"), (F.col("code") == 2).alias("is_error"), "trace_id", source["via"].alias("resolved_via"), protocol.alias("protocol"), F.struct("start_ns", "trace_id").alias("ord"))


def rank_percentile(durations: Column, q: float) -> Column:
    """The value at index floor(n * q), n - 1 at most, of the sorted durations; null if there are none."""
    n = F.size(durations)
    return F.get(durations, F.least(F.floor(n * F.lit(q)).cast("int"), n - 1))


def aggregate_pairs(found: DataFrame, by: tuple[str, ...] = ("from_service", "to_service"), samples: int = 5) -> DataFrame:
    """Edges of service pairs: calls, error rate, exact rank percentiles of positive durations, first samples.

    ``found`` is read twice: once for its counts by pair and duration, which are stored and give all but the samples, and once for these.
    """
    keys = list(by)
    spoken = F.col("protocol") != ""
    counts = found.groupBy(*keys, "duration_ms").agg(
        F.count("*").alias("n"), F.count_if("is_error").alias("errors"), F.min(F.struct("ord", "resolved_via")).alias("first"), F.max(F.when(spoken, F.struct("ord", "protocol"))).alias("last")
    )
    counts = scratch.written(counts, "pair-durations")
    base = counts.groupBy(*keys).agg(F.sum("n").alias("call_count"), F.sum("errors").alias("error_count"), F.min("first")["resolved_via"].alias("resolved_via"), F.coalesce(F.max("last")["protocol"], F.lit("")).alias("protocol"))
    out = base.withColumn("error_rate", F.round(F.col("error_count") / F.col("call_count"), 6))
    wide = of_counts(counts.where("duration_ms > 0").select(*keys, "duration_ms", "n"), keys, "duration_ms")
    first = first_samples(found.where("trace_id <> ''"), keys, samples)
    for extra in (wide, first):
        renamed = extra.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in extra.columns if c not in keys))
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        out = out.join(renamed, on, "left").drop(*(f"__{k}" for k in keys))
    return out


def percentiles(found: DataFrame, keys: list[str], value: str = "duration_ms", at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """latency_p50, latency_p95, ... of each key by rank: index floor(n * q), n - 1 at most; null values take no part."""
    counts = found.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return of_counts(scratch.written(counts, "value-counts"), keys, value, at)


def of_counts(counts: DataFrame, keys: list[str], value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99), most: int = 65536) -> DataFrame:
    """``percentiles`` of stored counts (keys, value, n), each value of a key once.

    Level by level: sums over ranges of the value find the range that holds an index, first 64 ranges to an octave, then a
    thousandth of what the range spans, until it has ``most`` values or fewer.  Only these are ordered, so no window holds all values of a crowded key.
    """
    ends = [F.col(k).eqNullSafe(F.col(f"h_{i}")) for i, k in enumerate(keys)]
    named = [F.col(k).alias(f"h_{i}") for i, k in enumerate(keys)]
    part = F.when(F.col(value) > 0, F.floor(F.log2(value) * 64)).otherwise(F.lit(-(1 << 20))).cast("long")
    sums = counts.groupBy(*keys, part.alias("part")).agg(F.sum("n").alias("n"))
    every = Window.partitionBy(*keys)
    sums = sums.withColumn("total", F.sum("n").over(every)).withColumn("upto", F.sum("n").over(every.orderBy("part")))
    index = lambda q: F.least(F.floor(F.col("total") * F.lit(q)), F.col("total") - 1)
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("q"), index(q).alias("index")) for i, q in enumerate(at)))).alias("one")
    held = sums.select(*keys, "part", "n", "upto", asked).where((F.col("upto") > F.col("one.index")) & (F.col("upto") - F.col("n") <= F.col("one.index")))
    held = held.select(*named, F.col("part").alias("h_part"), "one.q", (F.col("one.index") - F.col("upto") + F.col("n")).alias("rest"))
    inside = scratch.written(counts.withColumn("part", part).join(held, [*ends, F.col("part") == F.col("h_part")]).select(*keys, "q", "rest", value, "n"), "held-range")
    while ((inside.groupBy(*keys, "q").count().agg(F.max("count")).first()[0]) or 0) > most:
        span = Window.partitionBy(*keys, "q")
        bounds = inside.groupBy(*keys, "q").agg(F.min(value).alias("low"), F.max(value).alias("high")).select(*named, F.col("q").alias("h_q"), "low", "high")
        cut = inside.join(bounds, [*ends, F.col("q") == F.col("h_q")]).select(*keys, "q", "rest", value, "n", F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("low"), F.col("high") - F.col("low")) * 1000), F.lit(0)).alias("part"))
        sums = cut.groupBy(*keys, "q", "rest", "part").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(span.orderBy("part")))
        held = sums.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest"))).select(*named, F.col("q").alias("h_q"), F.col("part").alias("h_part"), (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))
        inside = scratch.written(cut.join(held, [*ends, F.col("q") == F.col("h_q"), F.col("part") == F.col("h_part")]).select(*keys, "q", F.col("left").alias("rest"), value, "n"), "held-range")
    upto = F.sum("n").over(Window.partitionBy(*keys, "q").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    met = inside.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
    return met.groupBy(*keys).agg(*(F.min(F.when(F.col("q") == i, F.col(value))).alias(f"latency_p{round(q * 100)}") for i, q in enumerate(at)))


def first_samples(found: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """sample_trace_ids: the ids of the first n spans of each key, in order; the limit is applied before the shuffle, too."""
    rows = found.select(*keys, "ord", "trace_id").withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where(F.col("place") <= n)
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "trace_id"))), lambda x: x["trace_id"]).alias("sample_trace_ids"))


def observed_edges(edges: DataFrame, as_of: Column, tenant: str = "default", window_minutes: int = 5) -> DataFrame:
    """Aggregated pairs as observed edges with rids, window and last_seen_at.  Names are canonical."""
    ends = {f"{x}_rid": entity_rid(F.lit(tenant), F.lit("Service"), F.col(f"{x}_service")) for x in ("from", "to")}
    rows = edges.withColumns(ends | {"from_name": canonical_name(F.col("from_service")), "to_name": canonical_name(F.col("to_service"))})
    rid = observed_rid(F.lit(tenant), F.lit("CALLS"), F.col("from_rid"), F.col("to_rid"))
    return rows.withColumns({"rid": rid, "edge_type": F.lit("CALLS"), "tenant": F.lit(tenant), "interaction_style": F.lit("SYNC"), "window_end": as_of, "window_start": as_of - F.expr(f"INTERVAL {int(window_minutes)} MINUTES"), "last_seen_at": as_of})


def evidence(edges: DataFrame, as_of: str, tenant: str = "default") -> DataFrame:
    """(rid, subject_rid, evidence_rid, kind, weight, note, tenant): one row for each observed edge, with its calls and errors."""
    source = F.lit(f"traces@{as_of}")
    note = F.format_string("calls=%d, error_rate=%.2f%%", "call_count", F.round(F.col("error_rate") * 100, 2))
    return edges.select(evidence_rid(F.col("rid"), source).alias("rid"), F.col("rid").alias("subject_rid"), source.alias("evidence_rid"), F.lit("trace_ref").alias("kind"), F.lit(0.25).alias("weight"), note.alias("note"), F.lit(tenant).alias("tenant"))
