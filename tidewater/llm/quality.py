"""Supervised subword embeddings for document quality.

A document is the average of learned vectors of its hashed words and character n-grams, a softmax
over the classes stands on it, and numpy stochastic gradient descent trains both on a bounded sample
of labelled documents.  Since the softmax of an average of vectors is the softmax of an average of
per-feature numbers, scoring looks up one number for each feature: a table of fixed size, broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import own_jobs, slices
from .words import Words, mix

BITS = 16  # of a hashed feature; words and each n-gram length have a region of their own
NGRAMS = (2, 3)


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, where each begins) of UTF-8 bytes."""
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    if len(begin) == len(data):
        return data.astype(np.uint64), begin
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32)
    lead, rest = padded[begin], [padded[begin + k] & 0x3F for k in (1, 2, 3)]
    two, three = (lead & 0x1F) << 6 | rest[0], (lead & 0x0F) << 12 | rest[0] << 6 | rest[1]
    four = (lead & 0x07) << 18 | rest[0] << 12 | rest[1] << 6 | rest[2]
    return np.where(lead < 0x80, lead, np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))).astype(np.uint64), begin


def _features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, first) for words and for each n-gram length; text i has the ids ``first[i]:first[i + 1]``."""
    shift = np.uint64(64 - BITS)
    yield (words.hashes >> shift).astype(np.int64), words.first
    data, begin = _characters(words.data)
    offsets = np.searchsorted(begin, words.offsets)
    for region, n in enumerate(NGRAMS, 1):
        if len(data) < n:
            yield np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
            continue
        code = np.zeros(len(data) - n + 1, np.uint64)
        for k in range(n):
            code = code << np.uint64(21) | data[k : len(data) - n + 1 + k]
        ids = (mix(code ^ np.uint64(n << 60)) >> shift).astype(np.int64) + (region << BITS)
        whole = np.ones(len(data), bool)  # n-grams that begin near a text's end run into the next one
        for k in range(1, n):
            at = offsets[1:] - k
            whole[at[at >= offsets[:-1]]] = False
        ids = ids[whole[: len(ids)]]
        sizes = np.maximum(np.diff(offsets) - n + 1, 0)
        yield ids, np.concatenate([[0], np.cumsum(sizes)])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of labelled rows as distinct ids with their shares."""
    for batch in slices(batches, limit=1 << 20):
        parts = list(_features(Words(batch.column("text"))))
        ids, shares = [], []
        for i in range(batch.num_rows):
            own, n = np.unique(np.concatenate([x[f[i] : f[i + 1]] for x, f in parts]), return_counts=True)
            ids.append(own.astype(np.int32))
            shares.append((n / max(1, n.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["id", "label", "ids", "shares"])


@dataclass
class Model:
    """``table[f]``: what feature f adds to the log odds of class 1; ``bias``: the log odds without features."""

    table: np.ndarray
    bias: float


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, dim: int = 16, epochs: int = 12, rate: float = 0.5, batch: int = 32, seed: int = 1) -> Model:
    """Stochastic gradient descent on mini-batches; Adagrad scales the steps of vectors seen rarely."""
    if not docs:
        return Model(np.zeros((1 + len(NGRAMS)) << BITS, np.float32), 0.0)
    rng = np.random.RandomState(seed)
    size = (1 + len(NGRAMS)) << BITS
    vectors = ((rng.rand(size, dim) - 0.5) / dim).astype(np.float32)
    top, bias = ((rng.rand(dim, 2) - 0.5) / dim).astype(np.float32), np.zeros(2, np.float32)
    seen, seen_top, seen_bias = np.full(size, 1e-6, np.float32), np.full((dim, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            ids = np.concatenate([docs[i][0] for i in own])
            share = np.concatenate([docs[i][1] for i in own])
            row = np.repeat(np.arange(len(own)), [len(docs[i][0]) for i in own])
            distinct, inverse = np.unique(ids, return_inverse=True)
            mean = np.zeros((len(distinct), len(own)), np.float32)
            mean[inverse, row] = share
            used = vectors[distinct]
            hidden = mean.T @ used
            logits = hidden @ top + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), labels[own]] -= 1
            p *= weights[own][:, None] / len(own)
            into, d_top, d_bias = mean @ (p @ top.T), hidden.T @ p, p.sum(0)
            seen[distinct] += (into**2).mean(1)
            seen_top += d_top**2
            seen_bias += d_bias**2
            vectors[distinct] -= rate * into / np.sqrt(seen[distinct])[:, None]
            top -= rate * d_top / np.sqrt(seen_top)
            bias -= rate * d_bias / np.sqrt(seen_bias)
    return Model((vectors @ (top[:, 1] - top[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on a bounded sample of ``labels`` (id, 0/1): ``max_rows`` in all, half for each label, in the order of a hash of the id.

    Rows weigh as much as their label does among all labels given.  Labels other than 0 and 1 and null ids
    take no part; an id with both labels counts as 0, and of texts with one id the least is taken.  A null text counts as
    empty.  Without any label the model knows nothing and scores 0.5.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picks = [known.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(max_rows // 2) for y in (0, 1)]
    sample = F.broadcast(picks[0].unionByName(picks[1]))  # max_rows rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(sample, "id")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = texts.select("id", "label", "text").mapInArrow(_sparse, "id long, label int, ids array<int>, shares array<float>")
    with own_jobs(docs.sparkSession):
        found = rows.withColumn("key", F.xxhash64("id")).toArrow().sort_by([("key", "ascending"), ("id", "ascending")])  # max_rows rows
    y = found["label"].to_numpy()
    own = [(np.asarray(a.values), np.asarray(b.values)) for a, b in zip(found["ids"], found["shares"], strict=True)]
    have = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    total = max(1, sum(totals.values()))
    share = np.array([totals.get(int(k), 0) / total / have[int(k)] for k in y], np.float32)
    model = train(own, y.astype(np.int64), share * len(y) if len(y) else share)
    del own, found
    pa.default_memory_pool().release_unused()
    return model


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    n, total = np.zeros(len(texts)), np.zeros(len(texts))
    for ids, first in _features(Words(texts)):
        some = first[1:] > first[:-1]
        if some.any():  # each text's sum depends on the text alone
            total[some] += np.add.reduceat(model.table[ids].astype(np.float64), first[:-1][some])
        n += np.diff(first)
    odds = model.bias + total / np.maximum(n, 1)
    return np.round(1 / (1 + np.exp(-np.clip(odds, -500, 500))), 9)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 1 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(_scores(model.value, batch.column("__text")))], [*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of class 1 (0 to 1), of each whole text.

    A null text counts as empty; an empty text has no features and gets the prior.  Equal texts get
    equal scores.  A column named ``score`` that is there already is replaced; all other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: (1 + len(NGRAMS)) << BITS floats
    rows = docs.drop("score").withColumn("__text", F.col(text_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", score double"
    return rows.mapInArrow(_scorer(shared), schema)


def _keeper(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            yield batch.filter(pa.array(_scores(model.value, batch.column("text")) >= threshold))

    return run


def keep(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (with a column ``text``) that score ``threshold`` or more, with all their columns, whatever their names.

    A null text counts as empty, an empty text has the score of the prior, repeated rows stay or go together, a score
    at the threshold stays, and an empty table gives an empty result.
    """
    return docs.mapInArrow(_keeper(docs.sparkSession.sparkContext.broadcast(model), threshold), docs.schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves the remainder 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
