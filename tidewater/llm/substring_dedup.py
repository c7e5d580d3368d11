"""Substring dedup by level-wise doubling.

Every word that lies in a window of ``length`` words whose word sequence also
starts somewhere else is removed.  Lengths double level by level up to ``length``
(35: 18, then 35).  At each level a window still in question points at one piece of
the level's length inside it: the piece with the smallest hash, the leftmost of
equals, which is the same piece wherever the window's words occur.  If that piece is
nowhere else in the corpus, neither is the window, and it is out.  Only windows whose
pieces repeat are taken to twice the length, until none is left or the full length is
reached, where the piece is the window itself.

One shuffle counts a level's pieces.  A piece that occurs once carries its own place
through the count, so places of unique pieces come out of the aggregation itself:
no join back to all places, and no group is ever gathered, however often its words
occur.  Equal texts form one class and stand for each other.

Hashes have 64 bits at the levels that only rule windows out and 96 bits at the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import slices, written
from .words import Words, mix, windows

_LOW = np.int64((1 << 31) - 1)


def levels(length: int, least: int = 16) -> list[int]:
    """Lengths from the shortest of at least ``least`` words (or ``length``) up to ``length``."""
    out = [length]
    while (out[0] + 1) // 2 >= least:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the index of the smallest of ``values[i:i + width]``, the leftmost of equals."""
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        have += step
    return at


def _open_windows(words: Words, length: int, runs: list | None) -> np.ndarray:
    """Starts of the windows in question, as indexes into all words of the batch."""
    n = words.counts()
    if runs is None:
        begin, end = words.first[:-1], np.maximum(words.first[1:] - length + 1, words.first[:-1])
    else:
        flat = [np.asarray(r, np.int64).reshape(-1, 2) + words.first[i] for i, r in enumerate(runs) if len(r)]
        pairs = np.concatenate(flat) if flat else np.zeros((0, 2), np.int64)
        begin, end = pairs[:, 0], pairs[:, 1]
    size = end - begin
    return np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)


def _pieces(words: Words, length: int, level: int, runs: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Open windows, the piece each of them points at, and the hashes of all pieces."""
    starts, hashes = _open_windows(words, length, runs), windows(words.hashes, level)
    if not len(starts):
        return starts, starts, hashes
    return starts, _leftmost_minimum(hashes, length - level + 1)[starts], hashes


def _emit(length: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"))
            runs = batch.column("runs").to_pylist() if "runs" in batch.schema.names else None
            _, piece, hashes = _pieces(words, length, level, runs)
            piece = np.unique(piece)
            text = np.searchsorted(words.first, piece, side="right") - 1
            c1, c2 = (batch.column(c).to_numpy(zero_copy_only=False)[text] for c in ("c1", "c2"))
            again = mix(hashes[piece] ^ words.hashes[piece]) if level == length else np.zeros(len(piece), np.uint64)
            times = batch.column("copies").to_numpy(zero_copy_only=False)[text] if "copies" in batch.schema.names else np.ones(len(piece), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[piece].view(np.int64)), pa.array((again >> np.uint64(32)).astype(np.int64).astype(np.int32)), pa.array(c1), pa.array((c2 & _LOW) << 31 | (piece - words.first[text])), pa.array(np.minimum(times, 2).astype(np.int32))],
                ["h", "g", "c1", "place", "times"],
            )

    return run


def _unique_places(rows: DataFrame) -> DataFrame:
    """(c1, c2low, places): the places, by class, of pieces that occur once."""
    once = rows.groupBy("h", "g").agg(F.sum("times").alias("n"), F.min("c1").alias("c1"), F.min("place").alias("place")).where("n = 1")
    once = once.select("c1", F.shiftright("place", 31).alias("c2low"), F.col("place").bitwiseAND(int(_LOW)).cast("int").alias("at"))
    return once.groupBy("c1", "c2low").agg(F.collect_list("at").alias("places"))


def _runs(starts: np.ndarray) -> np.ndarray:
    """[begin, end) pairs, flat, of sorted starts."""
    if not len(starts):
        return np.zeros(0, np.int32)
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    begin, end = starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + 1
    return np.stack([begin, end], 1).ravel().astype(np.int32)


def _narrow(length: int, level: int):
    """Rule out the windows whose pieces are unique; with none left, or at the last level, settle the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"))
            runs = batch.column("runs").to_pylist() if "runs" in batch.schema.names else None
            starts, piece, _ = _pieces(words, length, level, runs)
            copies = batch.column("copies").to_numpy(zero_copy_only=False)
            unique = np.zeros(len(words.hashes), bool)
            for i, places in enumerate(batch.column("places")):
                if copies[i] == 1 and places.is_valid:
                    unique[places.values.to_numpy() + words.first[i]] = True
            starts = starts[~unique[piece]]
            bounds = np.searchsorted(starts, words.first)
            texts = batch.column("text")
            out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "text", "runs", "removed")}
            for i in range(len(words)):
                own = starts[bounds[i] : bounds[i + 1]] - words.first[i]
                n = int(words.first[i + 1] - words.first[i])
                more = level < length and len(own) > 0
                removed = None
                if not more:
                    cover = np.zeros(n + 1, np.int32)
                    pairs = _runs(own).reshape(-1, 2)
                    np.add.at(cover, pairs[:, 0], 1)
                    np.add.at(cover, pairs[:, 1] + length - 1, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    removed = _runs(np.flatnonzero(gone))
                    kept = (texts[i].as_py() or "").encode().split()
                    if gone.any():
                        kept = [kept[j] for j in np.flatnonzero(~gone)]
                    out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    out["n_removed"].append(int(gone.sum()))
                else:
                    out["kept_sha256"].append(None)
                    out["n_removed"].append(None)
                out["n_words"].append(n)
                out["text"].append(texts[i].as_py() if more else None)
                out["runs"].append(_runs(own) if more else None)
                out["removed"].append(removed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("c1"), batch.column("c2"), batch.column("copies"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["text"], pa.string()), pa.array(out["runs"], pa.list_(pa.int32())), pa.array(out["removed"], pa.list_(pa.int32()))],
                ["c1", "c2", "copies", "n_words", "n_removed", "kept_sha256", "text", "runs", "removed"],
            )

    return run


_PIECE = "h long, g int, c1 long, place long, times int"
_STATE = "c1 long, c2 long, copies long, n_words long, n_removed long, kept_sha256 string, text string, runs array<int>, removed array<int>"


def remove_repeats(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``kept_sha256`` and ``removed``.

    ``removed`` holds [begin, end) word spans, flat, in word order.  A null text counts as empty;
    empty and short texts keep all they have.  Rows with equal texts, repeated rows included, are
    copies of each other: all their windows repeat, so texts of ``length`` words or more lose every
    word.  Null ids pass through.  An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("c1"), F.xxhash64(F.lit("tidewater"), text).alias("c2"))
    classes = base.groupBy("c1", "c2").agg(F.count("*").alias("copies"), F.min(F.coalesce(F.col("id"), F.lit(-(2**63)))).alias("rep"))
    steps = levels(length)
    # level one reads the table itself: every copy of a text adds to the counts
    first = base.select("text", "c1", "c2").mapInArrow(_emit(length, steps[0]), _PIECE)
    known = classes.join(_unique_places(first).withColumnRenamed("c1", "p1"), (F.col("c1") == F.col("p1")) & (F.col("c2").bitwiseAND(int(_LOW)) == F.col("c2low")), "left")
    known = written(known.select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "copies", "rep", "places"), "repeats-known")
    joined = base.join(known, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")) & (F.coalesce(F.col("id"), F.lit(-(2**63))) == F.col("rep")))
    state = joined.select("c1", "c2", "copies", "text", "places").mapInArrow(_narrow(length, steps[0]), _STATE)
    state = written(state, "repeats-level0")
    settled = state.where("text is null").drop("text", "runs")
    for k, level in enumerate(steps[1:], 1):
        going = state.where("text is not null")
        rows = going.select("text", "runs", "c1", "c2", "copies").mapInArrow(_emit(length, level), _PIECE)
        places = _unique_places(rows).withColumnRenamed("c1", "p1")
        joined = going.join(places, (F.col("c1") == F.col("p1")) & (F.col("c2").bitwiseAND(int(_LOW)) == F.col("c2low")), "left")
        state = written(joined.select("c1", "c2", "copies", "text", "runs", "places").mapInArrow(_narrow(length, level), _STATE), f"repeats-level{k}")
        settled = settled.unionByName(state.where("text is null").drop("text", "runs"))
    # repeated rows give their class more than one representative row; written, so that the join that follows
    # deals both sides anew and a text with many copies can be split
    settled = written(settled.groupBy("c1", "c2").agg(*(F.first(c).alias(c) for c in ("n_words", "n_removed", "kept_sha256", "removed"))), "repeats-settled")
    return base.select("id", "c1", "c2").join(settled, ["c1", "c2"]).select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", "removed")
