"""Convolutional text classifier for toxicity.

A word's vector is the sum of hashed embeddings: two of the word, so that two words seldom share both, and one for each of
its beginnings of 3 to 6 characters, so that inflected and compound words share what their stem has.  Filters of several widths run
over the whole text, each gives its largest response, and a logistic layer stands on these.  Training begins in numpy on a bounded
sample of labelled documents and goes on over all of them, in rounds: each task takes its rows once from the round's model, and the
tasks' changes are averaged.  A quarter of the labelled documents that training doesn't see calibrates, language by language,
the threshold that documents of the language must pass; scores are odds against that threshold, so it is always 0.5.  The
language is read off the text's function words, never off a column.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy, deepcopy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .shared import own_jobs, slices, written
from .words import Words, mix

BITS = 17  # of a hashed embedding
WIDTHS = (1, 2, 3)
PIECE = 1 << 14  # words that go through the filters at a time
STEMS = (3, 4, 5, 6)
BLANK = 0  # a row of the table that stays zero

#: Frequent function words of the languages that thresholds are calibrated for; texts with none of them are "other".
FUNCTION_WORDS = {
    "de": "der die das und ist von mit den dem des ein eine nicht auf für auch sich zu im es",
    "en": "the of and to in is that for was with as on are be by this it at from or",
    "es": "el la los las de que y en un una del por con para no se es al lo como",
    "fr": "le la les des et est une que qui dans pour pas sur au avec ne se en du de",
}
OTHER = len(FUNCTION_WORDS)


def _votes() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all function words in order, and for each the languages that it speaks for."""
    each = sorted({w for x in FUNCTION_WORDS.values() for w in x.split()})
    hashes = Words(pa.array(each), lower=True).hashes
    speaks = np.array([[w in x.split() for x in FUNCTION_WORDS.values()] for w in each], np.float64)
    order = np.argsort(hashes)
    return hashes[order], speaks[order]


def languages(words: Words) -> np.ndarray:
    """The language of each text, as a number, by the most function words; ties go to the first, texts without any are ``OTHER``."""
    known, speaks = _votes()
    at = np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)
    hits = np.flatnonzero(known[at] == words.hashes)
    text = np.searchsorted(words.first, hits, side="right") - 1
    total = np.stack([np.bincount(text, weights=speaks[at[hits], k], minlength=len(words)) for k in range(OTHER)], 1)
    return np.where(total.max(1) > 0, total.argmax(1), OTHER)


def _ids(words: Words) -> np.ndarray:
    """The places of each word's embeddings in the table: two of the word, one of each beginning; ``BLANK`` where it is no longer than that."""
    shift = np.uint64(64 - BITS)
    starts = np.flatnonzero((words.data & 0xC0) != 0x80)
    at = np.searchsorted(starts, words.begin)
    starts = np.append(starts, np.full(max(STEMS), len(words.data)))
    ids = [words.hashes >> shift, mix(words.hashes) >> shift]
    for n in STEMS:
        stem = copy(words)
        stem.end = np.minimum(starts[at + n], words.end)
        hashes = mix(stem.hashed() + np.uint64(n))
        ids.append(np.where(stem.end < words.end, hashes >> shift, BLANK))
    return np.stack(ids, 1).astype(np.int32)


@dataclass
class Model:
    """``embeddings`` of 2^BITS rows; ``filters[i]``: WIDTHS[i], dimension, number; ``bias`` of the filters, ``top`` and ``prior`` of
    the logistic layer; ``slope``, and ``threshold`` by language, of the log odds.
    """

    embeddings: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    top: np.ndarray
    prior: float
    slope: float
    threshold: np.ndarray


def _vectors(model: Model, ids: np.ndarray) -> np.ndarray:
    total = model.embeddings[ids[..., 0]]
    for k in range(1, ids.shape[-1]):
        total += model.embeddings[ids[..., k]]
    return total


def _responses(model: Model, ids: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """What each filter says at each of the first ``len(stop)`` words; word i's text ends at ``stop[i]``, and zeros stand behind it."""
    n = len(stop)
    vectors = _vectors(model, ids)
    vectors = np.concatenate([vectors, np.zeros((n + max(WIDTHS) - len(ids), vectors.shape[1]), np.float32)]) if len(ids) < n + max(WIDTHS) else vectors
    left = stop - np.arange(n)  # words up to the text's end
    found = []
    for f in model.filters:
        out = vectors[:n] @ f[0]
        for k in range(1, len(f)):
            more = vectors[k : n + k] @ f[k]
            more[left <= k] = 0
            out += more
        found.append(out)
    return found


def _odds(model: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The log odds of whole texts, text i with the words ``first[i]:first[i + 1]``.

    The words go through the filters in pieces, each with a look at the words behind it.
    """
    n, texts = len(ids), len(first) - 1
    best = np.full((texts, len(model.bias)), -np.inf, np.float32)
    ends = np.repeat(first[1:], np.diff(first))
    for lo in range(0, n, PIECE):
        hi = min(lo + PIECE, n)
        out = np.concatenate(_responses(model, ids[lo : hi + max(WIDTHS)], ends[lo:hi] - lo), 1)
        cuts = np.clip(first, lo, hi) - lo
        own = np.flatnonzero(np.diff(cuts))
        best[own] = np.maximum(best[own], np.maximum.reduceat(out, cuts[:-1][own], axis=0))
    active = np.maximum(best + model.bias, 0)  # a text without words has no response
    return active.astype(np.float64) @ model.top + model.prior


def _largest(model: Model, ids: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest response to each text, all with words, and the place of the first word that has it, in pieces."""
    best = np.full((len(first) - 1, len(model.bias)), -np.inf, np.float32)
    places = np.zeros(best.shape, np.int64)
    for lo in range(0, len(ids), PIECE):
        hi = min(lo + PIECE, len(ids))
        out = np.concatenate(_responses(model, ids[lo : hi + max(WIDTHS)], stop[lo:hi] - lo), 1)
        for i in range(np.searchsorted(first, lo, side="right") - 1, np.searchsorted(first, hi)):
            a, b = max(first[i], lo) - lo, min(first[i + 1], hi) - lo
            at = out[a:b].argmax(0)
            value = np.take_along_axis(out[a:b], at[None], 0)[0]
            better = value > best[i]
            best[i, better], places[i, better] = value[better], lo + a + at[better]
    return best, places


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    words = Words(texts, lower=True)
    odds = model.slope * (_odds(model, _ids(words), words.first) - model.threshold[languages(words)])
    return np.round(1 / (1 + np.exp(-np.clip(odds, -500, 500))), 5)


class _Trainer:
    """Mini-batch gradient descent; Adagrad scales the steps of words that are seen rarely."""

    def __init__(self, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, dim: int, number: int, least: int, seed: int):
        self.rng = np.random.RandomState(seed)
        self.labels, self.weights = labels, weights
        # what is in fewer than ``least`` documents has no vector: it could only be learnt by heart
        seen = np.zeros(1 << BITS, np.int32)
        for d in docs:
            seen[np.unique(d)] += 1
        known = seen >= least
        known[BLANK] = False
        self.docs = [np.where(known[d], d, BLANK) for d in docs]
        table = np.zeros((1 << BITS, dim), np.float32)
        table[known] = self.rng.normal(0, 0.1, (int(known.sum()), dim))
        n = number * len(WIDTHS)
        filters = [self.rng.normal(0, 0.3, (w, dim, number)).astype(np.float32) for w in WIDTHS]
        self.model = Model(table, filters, np.zeros(n, np.float32), self.rng.normal(0, 0.3, n).astype(np.float32), 0.0, 1.0, np.zeros(OTHER + 1))
        self.seen = {"table": np.full(1 << BITS, 1e-4, np.float32), "filters": [np.full_like(f, 1e-4) for f in filters], "bias": np.full(n, 1e-4, np.float32), "top": np.full(n, 1e-4, np.float32), "prior": 1e-4}

    @classmethod
    def resumed(cls, model: Model, seen: dict, seed: int) -> _Trainer:
        """A trainer that goes on from ``model`` and its sums of squares, which it changes in copies."""
        self = cls.__new__(cls)
        self.rng = np.random.RandomState(seed)
        self.model, self.seen = deepcopy(model), deepcopy(seen)
        return self

    def taught(self, docs: list[np.ndarray], labels: np.ndarray, rate: float, batch: int, drop: float) -> None:
        """One pass over ``docs``, as they come."""
        self.docs, self.labels, self.weights = docs, labels, np.ones(len(docs))
        for at in range(0, len(docs), batch):
            self._step(np.arange(at, min(at + batch, len(docs))), rate, drop)

    def epoch(self, rate: float, batch: int, drop: float) -> None:
        """One pass; of each batch's words a share ``drop`` is left out, so that no document hangs on one word."""
        order = self.rng.permutation(len(self.docs))
        for at in range(0, len(order), batch):
            self._step(order[at : at + batch], rate, drop)

    def _step(self, own: np.ndarray, rate: float, drop: float) -> None:
        m, seen = self.model, self.seen
        own = own[[len(self.docs[i]) > 0 for i in own]]
        if not len(own):
            return
        sizes = np.array([len(self.docs[i]) for i in own])
        first = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.concatenate([self.docs[i] for i in own])
        ids[self.rng.rand(len(ids)) < drop] = BLANK
        stop = np.repeat(first[1:], sizes)
        value, places = _largest(m, ids, first, stop)
        value = value + m.bias
        active = np.maximum(value, 0)
        odds = active @ m.top + m.prior
        wrong = ((1 / (1 + np.exp(-np.clip(odds, -50, 50))) - self.labels[own]) * self.weights[own] / len(own)).astype(np.float32)
        into = wrong[:, None] * m.top * (value > 0)
        d_top, d_prior, d_bias = wrong @ active, float(wrong.sum()), into.sum(0)
        rows, changes = [], []
        for i, f in enumerate(m.filters):
            number = f.shape[2]
            part = slice(i * number, (i + 1) * number)
            where, g = places[:, part], into[:, part]
            d_f = np.zeros_like(f)
            for k in range(len(f)):
                at = where + k
                inside = at < stop[where]
                at, gk = np.where(inside, at, 0), np.where(inside, g, 0)
                pair = ids[at]
                d_f[k] = np.einsum("bn,bnd->dn", gk, _vectors(m, pair))  # pair: documents, filters, places in the table
                rows.append(pair.reshape(-1, pair.shape[-1]))
                changes.append((gk[..., None] * f[k].T).reshape(-1, f.shape[1]))
            seen["filters"][i] += d_f**2
            f -= rate * d_f / np.sqrt(seen["filters"][i])
        rows, changes = np.concatenate(rows), np.concatenate(changes)
        moved = np.abs(changes).sum(1) > 0
        rows, changes = rows[moved], changes[moved]
        used, inverse = np.unique(rows, return_inverse=True)
        total = np.zeros((len(used), changes.shape[1]), np.float32)
        for k in range(rows.shape[1]):
            np.add.at(total, inverse.reshape(rows.shape)[:, k], changes)
        total[used == BLANK] = 0
        seen["table"][used] += (total**2).mean(1)
        m.embeddings[used] -= rate * total / np.sqrt(seen["table"][used])[:, None]
        for name, d in (("top", d_top), ("bias", d_bias), ("prior", d_prior)):
            seen[name] = seen[name] + d * d
            setattr(m, name, getattr(m, name) - rate * d / np.sqrt(seen[name]))


def train(docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, dim: int = 12, number: int = 16, steps: int = 1200, rate: float = 0.1, batch: int = 16, drop: float = 0.4, least: int = 3, seed: int = 1) -> tuple[Model, dict | None]:
    """A model from ``docs`` (places in the table of each one's words), 0/1 ``labels`` and their weights, and the sums of squares that scale its steps.

    Without documents, or with documents of one label alone, the model knows nothing and scores 0.5 or the label's side of it.
    """
    if not len(docs) or not sum(map(len, docs)):
        return Model(np.zeros((1 << BITS, dim), np.float32), [np.zeros((w, dim, number), np.float32) for w in WIDTHS], np.zeros(number * len(WIDTHS), np.float32), np.zeros(number * len(WIDTHS), np.float32), 0.0, 1.0, np.zeros(OTHER + 1)), None
    trainer = _Trainer(docs, labels, weights, dim, number, least, seed)
    epochs = min(20, max(1, round(steps * batch / len(docs))))
    for k in range(epochs):
        trainer.epoch(rate / (1 + 2 * k / epochs), batch, drop)
    return trainer.model, trainer.seen


def _dense(model: Model, seen: dict) -> np.ndarray:
    """All parameters but the table, with their sums of squares, end to end."""
    return np.concatenate([np.ravel(x) for x in (*model.filters, model.bias, model.top, model.prior, *seen["filters"], seen["bias"], seen["top"], seen["prior"])]).astype(np.float64)


def _undense(model: Model, seen: dict, flat: np.ndarray) -> None:
    def take(like: np.ndarray) -> np.ndarray:
        nonlocal flat
        out, flat = flat[: like.size].reshape(like.shape).astype(np.float32), flat[like.size :]
        return out

    model.filters, model.bias, model.top, model.prior = [take(f) for f in model.filters], take(model.bias), take(model.top), float(take(np.zeros(1))[0])
    seen["filters"], seen["bias"], seen["top"], seen["prior"] = [take(f) for f in seen["filters"]], take(seen["bias"]), take(seen["top"]), float(take(np.zeros(1))[0])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's rows each place of the table is."""
    total = np.zeros(1 << BITS, np.int64)
    for batch in slices(batches, limit=1 << 20):
        words = Words(batch.column("text"), lower=True)
        ids = _ids(words)
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            total[np.unique(ids[a:b])] += 1
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["place", "n"])


def _pass(held, rate: float, batch: int, drop: float):
    """One pass over a task's rows: what it changes in each row of the table, and (-1) in all else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen, known = held.value
        trainer, any_ = _Trainer.resumed(model, seen, 1 + TaskContext.get().partitionId()), False
        for part in slices(batches, limit=1 << 20):
            words = Words(part.column("text"), lower=True)
            ids = _ids(words)
            ids = np.where(known[ids], ids, BLANK)
            docs = [ids[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            trainer.taught(docs, part.column("label").to_numpy(), rate, batch, drop)
            any_ = True
        if any_:
            change = np.concatenate([trainer.model.embeddings - model.embeddings, (trainer.seen["table"] - seen["table"])[:, None]], 1)
            used = np.flatnonzero(np.abs(change).sum(1))
            dense = _dense(trainer.model, trainer.seen) - _dense(model, seen)
            rows = pa.array([*change[used].astype(np.float64), dense], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), rows], ["place", "change"])

    return run


def _taught(rows: DataFrame, model: Model, seen: dict, n_rows: int, rounds: int = 2, task_rows: int = 4000, rate: float = 0.05, batch: int = 16, drop: float = 0.4, least: int = 3) -> Model:
    """``model`` trained on over all ``rows`` (id, key, label, text), in as many tasks as their number asks, whatever the cluster."""
    spark = rows.sparkSession
    counts = rows.mapInArrow(_counts, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()  # 2^BITS rows at most
    known = np.zeros(1 << BITS, bool)
    known[counts.column("place").to_numpy()] = True
    known[BLANK] = False
    fresh = known & ~model.embeddings.any(1)
    model.embeddings[fresh] = np.random.RandomState(2).normal(0, 0.1, (int(fresh.sum()), model.embeddings.shape[1]))
    tasks = max(1, n_rows // task_rows)
    dealt = rows.repartition(tasks, "id").sortWithinPartitions("key", "id").select("text", "label")
    for k in range(rounds):
        held = spark.sparkContext.broadcast((model, seen, known))
        parts = dealt.mapInArrow(_pass(held, rate / (1 + k), batch, drop), "place int, change array<double>")
        # averaged over the tasks that have changed a row of the table; 2^BITS rows at most come back
        each = parts.select("place", F.posexplode("change").alias("i", "x")).groupBy("place", "i").agg(F.avg("x").alias("x"))
        found = each.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("change")).toArrow()
        at = found.column("place").to_numpy()
        for i in np.flatnonzero(at == -1):
            _undense(model, seen, _dense(model, seen) + np.array(found.column("change")[int(i)].as_py()))
        table = found.filter(pa.array(at >= 0))
        change = np.array(table.column("change").combine_chunks().flatten()).reshape(table.num_rows, -1)
        model.embeddings[at[at >= 0]] += change[:, :-1].astype(np.float32)
        seen["table"][at[at >= 0]] += change[:, -1].astype(np.float32)
        held.destroy()
    return model


def _measured(held):
    """Language, label and odds of each row, the odds to two digits, so that they can be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            words = Words(batch.column("text"), lower=True)
            odds = np.round(np.clip(_odds(held.value, _ids(words), words.first), -100, 100), 2) + 0.0
            yield pa.RecordBatch.from_arrays([pa.array(languages(words), pa.int64()), batch.column("label"), pa.array(odds)], ["speaks", "label", "odds"])

    return run


def _best(odds: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The threshold with the least weight on its wrong side, in the middle of the widest gap that has it."""
    order = np.argsort(odds)
    odds, toxic, weights = odds[order], labels[order] == 1, weights[order]
    # with the threshold below the k-th: toxic ones before it and clean ones from it on are wrong
    wrong = np.concatenate([[0], np.cumsum(np.where(toxic, weights, 0))]) + np.where(toxic, 0, weights).sum() - np.concatenate([[0], np.cumsum(np.where(toxic, 0, weights))])
    edges = np.concatenate([[odds[0] - 1], odds, [odds[-1] + 1]])
    gap = np.where(wrong <= wrong.min() + 1e-9, np.diff(edges), -1)
    k = int(gap.argmax())
    return float((edges[k] + edges[k + 1]) / 2)


def calibrated(odds: np.ndarray, labels: np.ndarray, weights: np.ndarray, speaks: np.ndarray, least: int = 25) -> np.ndarray:
    """The threshold of each language, from odds with their numbers of documents; one with fewer than ``least`` of either label here shares that of all languages."""
    if not len(odds) or len(np.unique(labels)) < 2:
        return np.zeros(OTHER + 1)
    out = np.full(OTHER + 1, _best(odds, labels, weights))
    for k in range(OTHER + 1):
        own = speaks == k
        if min(weights[own & (labels == y)].sum() for y in (0, 1)) >= least:
            out[k] = _best(odds[own], labels[own], weights[own])
    return out


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled rows as places in the table, flat, and their language."""
    for batch in slices(batches):
        words = Words(batch.column("text"), lower=True)
        ids, speaks = _ids(words), languages(words)
        offsets = pa.array(words.first * ids.shape[1], pa.int32())
        places = pa.ListArray.from_arrays(offsets, pa.array(ids.ravel(), pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), places, pa.array(speaks, pa.int64())], ["id", "label", "places", "speaks"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = 3000, max_chars: int = 12_000_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on all ``labels`` (id, 0/1) whose hash of the id leaves no 3 by 4, and calibrate thresholds on all the others.

    Training begins on a sample: ``max_rows`` in all, half for each label, in the order of a hash of the id, and of
    these as many as have ``max_chars`` characters together, one at least.  If that is not all, it goes on over all rows.
    Rows weigh alike, those of the sample as much as their label does among all labels given.  Labels other than 0 and 1 and null ids take no part; an id with
    both labels counts as 1, and of texts with one id the least is taken.  A null text counts as empty.  Without any label the
    model knows nothing and scores 0.5.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(known, "id")
    rows = written(texts.groupBy("id", "label").agg(F.min("text").alias("text")).withColumn("key", F.xxhash64("id")), "toxicity-labelled")
    mine, others = rows.where("pmod(key, 4) <> 3"), rows.where("pmod(key, 4) = 3")
    totals = {r["label"]: r["count"] for r in mine.groupBy("label").count().collect()}
    picks = [mine.where(F.col("label") == y).select("id", "key").orderBy("key", "id").limit(max_rows // 2) for y in (0, 1)]
    sample = mine.join(F.broadcast(picks[0].unionByName(picks[1]).select("id")), "id")  # max_rows rows at most
    # a word takes two characters with its space, so this bounds what comes to the driver
    size = F.sum("n").over(Window.orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1))  # max_rows rows
    few = sample.select("id", "key", F.length("text").alias("n")).withColumn("before", F.coalesce(size, F.lit(0))).where(F.col("before") <= max_chars).select("id")
    with own_jobs(docs.sparkSession):
        found = mine.join(F.broadcast(few), "id").select("id", "label", "text").mapInArrow(_known, "id long, label int, places array<int>, speaks long").withColumn("key", F.xxhash64("id")).toArrow().sort_by([("key", "ascending"), ("id", "ascending")])
        y = found["label"].to_numpy()
        own = [np.asarray(a.values).reshape(-1, 2 + len(STEMS)) for a in found["places"]]
        total = max(1, sum(totals.values()))
        share = np.array([totals[int(k)] / total / (y == k).sum() for k in y]) * len(y)
        model, seen = train(own, y.astype(np.int64), share)
        whole = len(own) == total
        del own, found
        pa.default_memory_pool().release_unused()
        if seen is not None and not whole:
            model = _taught(mine, model, seen, total)
        back = others if others.limit(1).count() else mine
        counted = back.mapInArrow(_measured(docs.sparkSession.sparkContext.broadcast(model)), "speaks long, label int, odds double").groupBy("speaks", "label", "odds").count().toArrow().sort_by([("odds", "ascending"), ("speaks", "ascending"), ("label", "ascending")])  # a bounded number of values
    if seen is not None:
        model.threshold = calibrated(*(counted[c].to_numpy() for c in ("odds", "label", "count", "speaks")))
    return model


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(_scores(model.value, batch.column("__text")))], [*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) of each whole text; 0.5 is the threshold of the text's language.

    A null text counts as empty, and an empty one gets the score of the prior.  Equal texts get equal scores, up to the
    rounding of single floats, which five digits of the score seldom show.  A column ``score`` that is there already is replaced; columns of other names pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2^BITS vectors and the filters
    rows = docs.drop("score").withColumn("__text", F.col(text_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", score double"
    return rows.mapInArrow(_scorer(shared), schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text can be divided by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
