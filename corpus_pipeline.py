"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read by the next.

All stages take empty tables, which give empty results, and columns of any names beside those of documents, which
they hand on unchanged (the last one returns the records alone).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.llm import decontamination, jaccard_join, mixing, quality, token_records
from tidewater.llm.shared import scratch_path, written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rates below 0.5 go.

    Null and empty texts get the rating of the prior, repeated rows one rating; without labels all are rated 0.5 and stay.
    """
    model = quality.fit(docs, _table(spark, sf_dir, "labels").where(~quality.held_out()))
    return quality.keep(docs, model)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id: five words, a similarity of 0.8.

    Null ids come last, of repeated rows one stays, unlike documents that share an id both do, and so does every text without words.
    """
    return jaccard_join.keep_one(docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.

    Null and empty texts hold none, null and empty items are in none, and repeated rows go together.
    """
    return decontamination.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"), similarity=0.8)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them, twice at most.

    A null source is a source of its own; null and empty texts have no words and come as often as their source's rate says in whole;
    of repeated rows some may come once more than others; ties go by a hash of the row.
    """
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as records in ascending order of the ids; returns what is read back from them.

    A null text counts as empty, a null id comes first, and repeated rows give a record each.
    """
    path = scratch_path(spark, "pipeline-records")
    token_records.write_records(docs, path, TOKENIZER, end_id=2)
    return token_records.read_records(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: The trained classifier, the search by hashing and the tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
