"""The designed graph: entity dictionary, relation extraction, neighbourhoods and paths."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewater.functions.ids import canonical_name, edge_rid, evidence_rid

SENTENCE_END = r"[.!?。]\s*|\n"
ENTITIES = "array<struct<name:string,type:string,position:int,place:int>>"
UNROLLED = 32  # patterns that are written into the plan
MOST_BYTES = 256 << 20


def patterns(gazetteer: list[dict[str, Any]]) -> list[tuple[str, str, str]]:
    """(pattern, canonical name, type) of all names and aliases, longest first; equal lengths keep their order."""
    out = []
    for entity in gazetteer:
        out += [(word, entity["name"], entity["type"]) for word in (entity["name"], *entity.get("aliases", ()))]
    return sorted(out, key=lambda p: -len(p[0]))


def entities_in(text: Column, known: list[tuple[str, str, str]]) -> Column:
    """(name, type, position, place): entities of the dictionary in the text, each once, in the order of their patterns.

    The dictionary is part of the plan; ``with_entities`` takes large ones.  A longer name does not hide a shorter one inside it.
    """
    low = F.lower(text)
    found = [F.when(F.locate(w.lower(), low) > 0, F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), (F.locate(w.lower(), low) - 1).alias("position"), F.lit(i).alias("place"))) for i, (w, name, kind) in enumerate(known)]
    out = F.array_compact(F.array(*found)) if found else F.array().cast(ENTITIES)
    names = F.transform(out, lambda e: e["name"])
    return F.filter(out, lambda e, i: F.array_position(names, e["name"]) == i + 1)


_AUTOMATA: dict[str, Any] = {}


def _automaton(key: str, held: Any) -> Any:
    """One automaton for a worker process: pattern to its places in the order of the dictionary."""
    import ahocorasick

    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        words: dict[str, list[int]] = {}
        for i, (w, _, _) in enumerate(held.value):
            words.setdefault(w.lower(), []).append(i)
        made = ahocorasick.Automaton()
        for w, places in words.items():
            if w:
                made.add_word(w, (len(w), places))
        made.make_automaton()
        _AUTOMATA[key] = made
    return _AUTOMATA[key]


def with_entities(rows: DataFrame, text: str, known: list[tuple[str, str, str]], name: str = "entities") -> DataFrame:
    """``rows`` with ``entities_in`` of a column: as an expression for few patterns, else by an automaton that each worker builds once.

    The automaton takes a text in one pass, however many patterns there are; the patterns, MOST_BYTES at most, are broadcast.  A null text has no entities.
    """
    if len(known) <= UNROLLED:
        return rows.withColumn(name, F.coalesce(entities_in(F.col(text), known), F.array().cast(ENTITIES)))
    size = sum(len(w.encode()) + len(n.encode()) for w, n, _ in known)
    if size > MOST_BYTES:
        raise ValueError(f"the dictionary has {size} bytes, more than {MOST_BYTES}")
    held, key = rows.sparkSession.sparkContext.broadcast(known), uuid.uuid4().hex

    def found(value: str | None, automaton: Any) -> list[dict[str, Any]]:
        first: dict[int, int] = {}
        if value and len(automaton):
            for end, (n, places) in automaton.iter(value.lower()):
                for i in places:
                    first.setdefault(i, end - n + 1)
        out, names = [], set()
        for i in sorted(first):
            _, entity, kind = held.value[i]
            if entity not in names:
                names.add(entity)
                out.append({"name": entity, "type": kind, "position": first[i], "place": i})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("position", pa.int32()), ("place", pa.int32())]))
        automaton = _automaton(key, held)
        for batch in batches:
            entities = pa.array([found(x.as_py(), automaton) for x in batch.column(text)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, entities], [*batch.schema.names, name])

    rows = rows.drop(name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, `{name}` {ENTITIES}")


def relations(chunks: DataFrame, known: list[tuple[str, str, str]], settings: dict[str, Any], key: str = "rid", text: str = "chunk_text") -> DataFrame:
    """(key, edge_type, from_name, to_name, trigger, confidence): relations stated in each row.

    A window is a sentence with its neighbours.  It needs two entities or more and a trigger whose first place has no
    negation within 30 characters; then every ordered pair of its entities, in the order of their patterns,
    is a relation.  A relation counts once for each row, with the first window and trigger that states it.
    """
    sentences = F.split(F.col(text), SENTENCE_END)
    rows = chunks.select(key, F.posexplode(F.transform(sentences, lambda s, i: F.array_join(F.slice(sentences, F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), " "))).alias("w", "window"))
    rows = with_entities(rows, "window", known).where(F.size("entities") >= 2)
    triggers = [(kind, word, n) for n, (kind, word) in enumerate((kind, word) for kind, words in settings["triggers"].items() for word in words)]
    low = F.lower("window")
    met = []
    for kind, word, n in triggers:
        at = F.locate(word.lower(), low)
        near = F.substring("window", F.greatest(at - 30, F.lit(1)), F.when(at > 30, 60).otherwise(at + 29))
        denied = F.lit(False)
        for phrase in settings["negations"]:
            denied = denied | near.contains(phrase)
        met.append(F.when((at > 0) & ~denied, F.struct(F.lit(n).alias("n"), F.lit(kind).alias("edge_type"), F.lit(word).alias("trigger"))))
    rows = rows.select(key, "w", "entities", F.explode(F.array_compact(F.array(*met))).alias("t"))
    pairs = F.flatten(F.transform("entities", lambda a, i: F.transform(F.slice("entities", i + 2, F.size("entities")), lambda b: F.struct(a["name"].alias("from_name"), b["name"].alias("to_name")))))
    rows = rows.select(key, "w", "t.n", "t.edge_type", "t.trigger", F.inline(pairs))
    once = rows.groupBy(key, "edge_type", "from_name", "to_name").agg(F.min_by("trigger", F.struct("w", "n")).alias("trigger"))
    return once.withColumn("confidence", F.lit(0.6))


def edges_and_evidence(found: DataFrame, entities: DataFrame, tenant: str = "default", key: str = "rid") -> tuple[DataFrame, DataFrame]:
    """Edges (rid, edge_type, from_rid, to_rid, confidence) and the evidence (rid, subject_rid, evidence_rid, kind, weight, note) of each."""
    ends = entities.select("name", F.col("rid").alias("e_rid"))
    named = found.join(ends.select(F.col("name").alias("from_name"), F.col("e_rid").alias("from_rid")), "from_name").join(ends.select(F.col("name").alias("to_name"), F.col("e_rid").alias("to_rid")), "to_name")
    named = named.withColumn("edge_rid", edge_rid(F.lit(tenant), F.col("edge_type"), F.col("from_rid"), F.col("to_rid")))
    edges = named.groupBy(F.col("edge_rid").alias("rid"), "edge_type", "from_rid", "to_rid").agg(F.max("confidence").alias("confidence"))
    evidence = named.select(evidence_rid(F.col("edge_rid"), F.col(key)).alias("rid"), F.col("edge_rid").alias("subject_rid"), F.col(key).alias("evidence_rid"), F.lit("text_snippet").alias("kind"), F.lit(0.15).alias("weight"), F.concat(F.lit("trigger: "), "trigger").alias("note"))
    return edges, evidence.dropDuplicates(["rid"])


def with_names(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the names of both ends; an edge with an unknown end drops out."""
    ends = entities.select(F.col("rid").alias("e"), F.col("name").alias("n"))
    out = edges.join(ends.select(F.col("e").alias("from_rid"), F.col("n").alias("from_name")), "from_rid")
    return out.join(ends.select(F.col("e").alias("to_rid"), F.col("n").alias("to_name")), "to_rid")


def neighbors(edges: DataFrame, centre: Column, hops: int = 1, distinct: bool = False) -> DataFrame:
    """(hop, rid, from_rid, to_rid, ...): edges at the centre, then those that continue forwards or lead in, as a bag.

    From a hop's edge the next hop takes edges out of its target and edges into its source, but not
    itself; an edge that does both comes once for each.  The number of hops bounds the plan.
    """
    columns = edges.columns
    out = step = edges.where((F.col("from_rid") == centre) | (F.col("to_rid") == centre)).select(F.lit(1).alias("hop"), *columns)
    for hop in range(2, hops + 1):
        last = step.select(F.col("rid").alias("l_rid"), F.col("from_rid").alias("l_from"), F.col("to_rid").alias("l_to"))
        ahead = edges.join(last, (F.col("from_rid") == F.col("l_to")) & (F.col("rid") != F.col("l_rid")))
        # those that also go on forwards are in the first part already
        back = edges.join(last, (F.col("to_rid") == F.col("l_from")) & (F.col("rid") != F.col("l_rid"))).where(F.col("from_rid") != F.col("l_to"))
        step = ahead.unionByName(back).select(F.lit(hop).alias("hop"), *columns)
        out = out.unionByName(step)
    if distinct:
        return out.groupBy(*columns).agg(F.min("hop").alias("hop")).select("hop", *columns)
    return out


def find_path(edges: DataFrame, source: Column, target: Column, max_hops: int = 4) -> DataFrame:
    """At most one row: the last edge of a shortest directed walk, its hop and all its edges.

    Of equally short walks the one with the smallest edge ids.  Breadth first: each hop keeps the best way to each node
    that no earlier hop has reached, so the rows are as many as the nodes, not the walks.
    """
    columns = edges.columns

    def best(step: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("to_rid").orderBy("path_edges"))
        return step.withColumn("place", place).where("place = 1").drop("place")

    walk = best(edges.where(F.col("from_rid") == source).select(F.lit(1).alias("hop"), *columns, F.array("rid").alias("path_edges")))
    found, seen = walk.where(F.col("to_rid") == target), walk.select("to_rid")
    for hop in range(2, max_hops + 1):
        last = walk.where(F.col("to_rid") != target).select(F.col("to_rid").alias("l_to"), F.col("path_edges").alias("l_path"))
        walk = edges.join(last, F.col("from_rid") == F.col("l_to")).select(F.lit(hop).alias("hop"), *columns, F.array_append("l_path", F.col("rid")).alias("path_edges"))
        walk = best(walk.join(seen, "to_rid", "left_anti").select("hop", *columns, "path_edges"))
        found, seen = found.unionByName(walk.where(F.col("to_rid") == target)), seen.unionByName(walk.select("to_rid"))
    return found.orderBy("hop", "path_edges").limit(1)


def suggest(entities: DataFrame, query: str, limit: int = 10, least: float = 0.3) -> DataFrame:
    """Entities whose name holds the query or is similar to it, or that have it as an alias; the most similar first."""
    from tidewater.functions.text import similarity

    like = similarity(F.col("name"), F.lit(query))
    rows = entities.withColumn("similarity", F.round(like, 6))
    return rows.where(F.lower("name").contains(query.lower()) | F.array_contains("aliases", query) | (like > least)).orderBy(F.desc("similarity"), "name").limit(limit)


def trigram_index(entities: DataFrame) -> DataFrame:
    """(gram, rid): the trigrams of each entity's name, to be stored by gram."""
    from tidewater.functions.text import trigrams

    return entities.select(F.explode(trigrams(F.col("name"))).alias("gram"), "rid").distinct()


def candidates(index: DataFrame, query: str, least: float = 0.3) -> DataFrame | None:
    """(rid): the entities that can hold the query in their name or be similar to it; None where the query has no run of three letters, so that any can.

    A similar name shares more than ``least`` of the query's trigrams, and one that holds the query all that lie inside its words, so
    only names that share the smaller number of both are left.
    """
    from tidewater.functions.text import terms, trigrams

    asked = index.sparkSession.range(1).select(trigrams(F.lit(query)).alias("grams"), terms(F.lit(query)).alias("words")).first()
    inside = {w[i : i + 3] for w in asked["words"] for i in range(len(w) - 2)}
    if not inside:
        return None
    shared = min(len(inside), int(least * len(asked["grams"])) + 1)
    return index.where(F.col("gram").isin(sorted(asked["grams"]))).groupBy("rid").agg(F.count("*").alias("n")).where(F.col("n") >= shared).select("rid")


def suggest_indexed(entities: DataFrame, index: DataFrame, query: str, limit: int = 10, least: float = 0.3) -> DataFrame:
    """``suggest`` from a stored ``trigram_index``: the same rows, without a look at the trigrams of names that can't be among them."""
    few = candidates(index, query, least)
    if few is None:
        return suggest(entities, query, limit, least)
    named = entities.where(F.array_contains("aliases", query)).select("rid")
    return suggest(entities.join(few.union(named).distinct(), "rid", "left_semi"), query, limit, least)


def resolve(names: DataFrame, entities: DataFrame) -> DataFrame:
    """``names`` (name) with the rid of the entity of that canonical name, else the rid it would have as a service."""
    from tidewater.functions.ids import entity_rid

    ends = entities.select(canonical_name(F.col("name")).alias("c"), F.col("rid").alias("known"))
    rows = names.join(ends, canonical_name(names["name"]) == F.col("c"), "left")
    return rows.select(names["name"], F.coalesce("known", entity_rid(F.lit("default"), F.lit("Service"), names["name"])).alias("rid"))
