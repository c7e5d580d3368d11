"""The lexical index of a store: positional postings in ordered segments, lengths of all rows, and corpus statistics, kept in step."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewater.functions import access, text as T
from tidewater.operators import retrieval
from tidewater.sources.store import Store, Transaction


@dataclass(frozen=True)
class Tokenizer:
    """How texts become terms.  ``split`` takes a batch of texts and gives the terms of each; without it terms are lower-case runs of letters and digits."""

    name: str = "letters and digits"
    split: Callable[[list[str]], list[list[str]]] | None = None

    def applied(self, rows: DataFrame, text: str, name: str = "terms") -> DataFrame:
        """``rows`` with the terms of ``text`` in place of it; a null text has none, and neither has one that ``split`` fails on alone."""
        if self.split is None:
            return rows.withColumn(name, T.terms(F.coalesce(F.col(text), F.lit("")))).drop(text)
        split, others = self.split, [c for c in rows.columns if c != text]

        def one(value: str) -> list[str]:
            try:
                return list(split([value])[0])
            except Exception:  # whatever the tokenizer raises
                return []

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts = batch[text].fillna("").tolist()
                try:
                    terms = [list(x) for x in split(texts)]
                except Exception:
                    terms = [one(x) for x in texts]
                yield batch[others].assign(**{name: terms})

        kept = rows.select(*others, text)
        fields = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in others)
        return kept.mapInPandas(run, f"{fields}, `{name}` array<string>")


class LexicalIndex:
    """Three tables of a store.

    ``postings`` (term, rid, generation, tf, length, positions) comes in segments, one for each update, each ordered by term over its
    files; a posting counts while ``lengths`` (rid, doc_rid, tenant, classification, length, generation), in buckets of the document, has its row in its
    generation.  ``statistics`` has rows and terms by tenant and classification, and each update adds what changes.  So an update writes
    what it brings and the touched buckets of lengths, and a search reads its terms' postings and no text.
    """

    def __init__(self, store: Store, tokenizer: Tokenizer | None = None):
        self.store, self.tokenizer = store, tokenizer or Tokenizer()

    def update(self, tx: Transaction, rows: DataFrame, changed: DataFrame) -> None:
        """``rows`` (rid, doc_rid, tenant, classification, text) are from now on what the documents ``changed`` (doc_rid) have in the index."""
        self._check(tx.state)
        spark = self.store.spark
        new = tx.staged(self.tokenizer.applied(rows.select("rid", "doc_rid", "tenant", "classification", "text"), "text").withColumn("generation", F.lit(tx.number).cast("long")))
        sizes = tx.staged(new.select("rid", "doc_rid", "tenant", "classification", F.size("terms").cast("long").alias("length"), "generation"))
        gone = changed.select("doc_rid").distinct()
        old = tx.read("lengths").join(gone, "doc_rid", "left_semi") if tx.has("lengths") else spark.createDataFrame([], sizes.schema)
        parts = [old.select("tenant", "classification", F.lit(-1).cast("long").alias("rows"), (-F.col("length")).alias("terms")), sizes.select("tenant", "classification", F.lit(1).cast("long").alias("rows"), F.col("length").alias("terms"))]
        if tx.has("statistics"):
            parts.append(tx.read("statistics"))
        total = parts[0].unionByName(parts[1]).unionByName(parts[-1]) if len(parts) == 3 else parts[0].unionByName(parts[1])
        total = tx.staged(total.groupBy("tenant", "classification").agg(F.sum("rows").alias("rows"), F.sum("terms").alias("terms")))
        tx.merge("lengths", sizes, "doc_rid", lambda have, come: have.join(gone, "doc_rid", "left_anti").select(*come.columns).unionByName(come), touched=gone)
        tx.replace("statistics", total, "tenant")
        lengths = tx.read("lengths").select("rid", "generation")
        tx.append("postings", retrieval.positional(new, ["rid", "generation"]), ["term", "rid"], live=lambda p: p.join(lengths, ["rid", "generation"], "left_semi").select(*p.columns))
        tx.state["postings"]["tokenizer"] = self.tokenizer.name

    def _check(self, state: dict) -> None:
        stored = state.get("postings", {}).get("tokenizer", self.tokenizer.name)
        if stored != self.tokenizer.name:
            raise ValueError(f"the index was made with the tokenizer {stored!r}, not {self.tokenizer.name!r}")

    def _visible(self, state: dict, tenant: str, clearance: str) -> tuple[DataFrame, DataFrame]:
        """(lengths, one row of statistics) of what the reader may see."""
        seen = lambda df: df.where((F.col("tenant") == tenant) & (access.level(F.col("classification")) <= access.clearance(clearance)))
        stats = seen(self.store.load(state["statistics"])).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n_docs"), (F.sum("terms") / F.sum("rows")).alias("mean"))
        return seen(self.store.load(state["lengths"])), stats

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, place, term) of ``queries`` (query_id, query), in the index's terms."""
        return self.tokenizer.applied(queries.select("query_id", "query"), "query").select("query_id", F.posexplode("terms").alias("place", "term"))

    def _hits(self, state: dict, asked: DataFrame, visible: DataFrame, columns: list[str]) -> DataFrame:
        found = retrieval.of_terms(self.store.load(state["postings"]), asked)
        return found.join(visible.select("rid", "generation"), ["rid", "generation"], "left_semi").select("rid", "term", *columns)

    def search(self, queries: DataFrame, tenant: str = "default", clearance: str = "INTERNAL", k: int = 20) -> DataFrame:
        """(query_id, rid, score, rank): the k best rows that hold all terms of each of ``queries`` (query_id, query); an empty index gives none."""
        _, state = self.store.head()
        if "postings" not in state:
            return self.store.spark.createDataFrame([], "query_id long, rid string, score double, rank int")
        self._check(state)
        asked = self._asked(queries).select("query_id", "term").distinct()
        visible, stats = self._visible(state, tenant, clearance)
        return retrieval.rank_postings(self._hits(state, asked, visible, ["length", "tf"]), stats, asked, k, "rid")

    def phrases(self, queries: DataFrame, tenant: str = "default", clearance: str = "INTERNAL") -> DataFrame:
        """(query_id, rid, n): the rows that hold the terms of a query one behind the other, and how often."""
        _, state = self.store.head()
        if "postings" not in state:
            return self.store.spark.createDataFrame([], "query_id long, rid string, n long")
        self._check(state)
        asked = self._asked(queries)
        visible, _ = self._visible(state, tenant, clearance)
        return retrieval.in_a_row(self._hits(state, asked, visible, ["positions"]), asked)
