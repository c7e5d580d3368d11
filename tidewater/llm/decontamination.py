"""Benchmark decontamination: documents that hold a benchmark item up to a few word edits.

The CGK embedding walks through a sequence: at each step it puts out the current word, and a random
bit of that word for that step decides whether it moves on.  Two sequences a few edits apart put out
mostly the same words, since after an edit the walks soon meet again, so edit distance becomes Hamming
distance, and sampling a few of the steps is a locality sensitive hash for it.  Every repetition has
walk bits and sampled steps of its own.

Items of LONG words or more and documents are walked from anchors: each word whose hash is the smallest of some
4 consecutive words, so a run of 4 words without edits has the same anchor in both.  Shorter items, which may
lose all their anchors to one edit, are walked in few steps and from every word; besides, their exact copies are
looked up by the hash of the whole item.  An equal key places an item-sized window in the document; the exact edit
distance between the item and that window, with room for the allowed edits at both ends, decides.

A document's work needs the document and the items alone: no shuffle, whatever the number of hits.
Items are broadcast in blocks of bounded bytes, and a larger benchmark takes more passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import own_jobs, slices
from .substring_dedup import _leftmost_minimum
from .words import Words, mix, windows

STEPS, SAMPLES, ANCHOR = 12, 4, 4
LONG, SHORT_STEPS, SHORT_SAMPLES = 15, 4, 2


def repetitions(recall: float, similarity: float, steps: int = STEPS, anchors: int = 2) -> int:
    """So many that an item with all the edits it may have is met with probability ``recall``.

    A walk of ``steps`` passes about steps / 2 + 1 words and surely survives if none of them is edited.
    Even an item of 15 words has two anchors from which such a walk stays inside, and one of 5 words three words.
    """
    survives = similarity ** (steps / 2 + 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survives) / anchors))


def _anchors(hashes: np.ndarray) -> np.ndarray:
    """Positions of the anchors; a sequence of fewer than ANCHOR words has its smallest."""
    rank = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    if len(rank) < ANCHOR:
        return np.array([int(np.argmin(rank))]) if len(rank) else np.zeros(0, np.int64)
    return np.unique(_leftmost_minimum(rank, ANCHOR))


def _walk(hashes: np.ndarray, at: np.ndarray, turn: int, steps: int = STEPS, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the walks from ``at``, and the last position that each has read (past the end: no word)."""
    every = steps // samples
    taken = np.random.RandomState(1000 + turn).randint(every, size=samples) + np.arange(samples) * every  # one of each part
    bits = mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) % 2**64))
    padded, bits = np.append(hashes, np.uint64(0)), np.append(bits, np.uint64(0))
    pos, key = at.copy(), np.full(len(at), turn, np.uint64)
    for j in range(int(taken[-1]) + 1):
        if j in taken:
            key = mix(key * np.uint64(0xD1342543DE82EF95) + padded[pos])
            last = pos
        pos = np.minimum(pos + (bits[pos] >> np.uint64(j) & np.uint64(1)).astype(np.int64), len(hashes))
    return key, last


def edit_ends(item: np.ndarray, window: np.ndarray, anchored: bool = False) -> np.ndarray:
    """For each j, the least number of word edits that turn ``item`` into a piece of ``window`` that ends at j.

    The piece begins anywhere, or at the window's begin if ``anchored``.
    """
    at = np.arange(len(window) + 1)
    row = at.copy() if anchored else np.zeros(len(window) + 1, np.int64)
    for word in item:
        step = row + 1
        step[1:] = np.minimum(step[1:], row[:-1] + (window != word))
        row = np.minimum.accumulate(step - at) + at
    return row


class Table:
    """Sorted keys with what stands behind each, and a bitmap that most other keys fail."""

    def __init__(self, keys: list[np.ndarray], items: list[int], offsets: list[np.ndarray]):
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.item = np.repeat(np.array(items, np.int64), [len(k) for k in keys])[order]
        self.offset = np.concatenate(offsets)[order] if offsets else np.zeros(0, np.int64)
        self.keys = self.keys[order]
        self.shift = np.uint64(64 - max(16, int(len(self.keys) * 64).bit_length()))
        self.present = np.zeros(1 << (64 - int(self.shift)), bool)
        self.present[(self.keys >> self.shift).astype(np.int64)] = True

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.present[(keys >> self.shift).astype(np.int64)]) if len(self.keys) else np.zeros(0, np.int64)

    def places(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(item, position of its first word, position met) for each meeting of keys."""
        some = self.maybe(keys)
        keys, at = keys[some], at[some]
        low = np.searchsorted(self.keys, keys, side="left")
        n = np.searchsorted(self.keys, keys, side="right") - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        return np.stack([self.item[rows], np.repeat(at, n) - self.offset[rows], np.repeat(at, n)], 1)


def _whole(hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` words from each position."""
    key = np.full(len(at), length, np.uint64)
    for k in range(length):
        key = mix(key * np.uint64(0xD1342543DE82EF95) + hashes[at + k])
    return key


class Items:
    """One block of items, prepared for look-up."""

    def __init__(self, ids: pa.Array, texts: pa.Array, similarity: float, recall: float):
        words = Words(texts, lower=True)
        self.ids, self.similarity = ids.to_pylist(), similarity
        self.items = [words.hashes[words.first[i] : words.first[i + 1]] for i in range(len(words))]
        self.allowed = [int((1 - similarity) * len(h) + 1e-9) for h in self.items]
        self.walks = [self._walks(turn, [i for i, h in enumerate(self.items) if len(h) >= LONG], STEPS, SAMPLES, False) for turn in range(repetitions(recall, similarity))]
        edited = [i for i, h in enumerate(self.items) if len(h) < LONG and self.allowed[i]]
        turns = repetitions(recall, similarity, SHORT_STEPS, 3) if edited else 0
        self.short_walks = [self._walks(100 + turn, edited, SHORT_STEPS, SHORT_SAMPLES, True) for turn in range(turns)]
        # exact copies of short items: a piece of 4 words at most first, then the whole item
        self.pieces, self.whole = {}, {}
        for n in sorted({len(h) for h in self.items if 0 < len(h) < LONG}):
            own = [i for i, h in enumerate(self.items) if len(h) == n]
            first = np.zeros(1, np.int64)
            self.whole[n] = Table([_whole(self.items[i], first, n) for i in own], own, [first] * len(own))
        for size in sorted({min(n, ANCHOR) for n in self.whole}):
            own = [i for i, h in enumerate(self.items) if 0 < len(h) < LONG and min(len(h), ANCHOR) == size]
            self.pieces[size] = Table([windows(self.items[i][:size], size) for i in own], own, [np.zeros(1, np.int64)] * len(own))

    def _walks(self, turn: int, own: list[int], steps: int, samples: int, everywhere: bool) -> tuple[int, Table]:
        keys, offsets = [], []
        for i in own:
            h = self.items[i]
            at = np.arange(len(h)) if everywhere else _anchors(h)
            key, last = _walk(h, at, turn, steps, samples)
            keys.append(key[last < len(h)])
            offsets.append(at[last < len(h)])
        return turn, Table(keys, own, offsets)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        """(item, position of its first word, position met) to verify; the first may lie outside."""
        found = [np.zeros((0, 3), np.int64)]
        if any(len(t.keys) for _, t in self.walks):
            at = _anchors(hashes)
            found += [t.places(_walk(hashes, at, turn)[0], at) for turn, t in self.walks if len(at)]
        if self.short_walks and len(hashes):
            at = np.arange(len(hashes))
            found += [t.places(_walk(hashes, at, turn, SHORT_STEPS, SHORT_SAMPLES)[0], at) for turn, t in self.short_walks]
        for size, pieces in self.pieces.items():
            maybe = pieces.maybe(windows(hashes, size))
            for n, whole in self.whole.items():
                if min(n, ANCHOR) == size:
                    at = maybe[maybe + n <= len(hashes)]
                    found.append(whole.places(_whole(hashes, at, n), at))
        met = np.unique(np.concatenate(found), axis=0)
        return met[self._near(hashes, met)]

    def _near(self, hashes: np.ndarray, met: np.ndarray) -> np.ndarray:
        """Which of the places are within the allowed edits, rows' bounds aside: all places of one length in step."""
        good = np.zeros(len(met), bool)
        length = np.array([len(h) for h in self.items])[met[:, 0]] if len(met) else np.zeros(0, np.int64)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            room = int((1 - self.similarity) * n + 1e-9)
            for part in np.split(own, np.arange(1 << 13, len(own), 1 << 13)):
                at = met[part, 1][:, None] - room + np.arange(n + 2 * room)[None, :]
                inside = (at >= 0) & (at < len(hashes))
                window = hashes[np.clip(at, 0, len(hashes) - 1)]
                item = np.stack([self.items[i] for i in met[part, 0]])
                place = np.arange(window.shape[1] + 1)[None, :]
                row = np.zeros((len(part), window.shape[1] + 1), np.int64)
                for k in range(n):
                    step = row + 1
                    step[:, 1:] = np.minimum(step[:, 1:], row[:, :-1] + ((window != item[:, k : k + 1]) | ~inside))
                    row = np.minimum.accumulate(step - place, axis=1) + place
                good[part] = row.min(1) <= room
        return good

    def hits(self, texts: pa.Array) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(row, index of the item): (edits, begin, end), the fewest edits and then the first, in words of the row."""
        words, best = Words(texts, lower=True), {}
        seen: set[tuple[int, int, int]] = set()
        for i, start, at in self._places(words.hashes).tolist():
            row = int(np.searchsorted(words.first, at, side="right")) - 1
            item, low, high = self.items[i], int(words.first[row]), int(words.first[row + 1])
            if (row, i, start) in seen or best.get((row, i), (1,))[0] == 0:
                continue
            seen.add((row, i, start))
            n = len(item)
            if low <= start and start + n <= high and np.array_equal(words.hashes[start : start + n], item):
                best[row, i] = (0, start - low, start - low + n)
                continue
            allowed = self.allowed[i]
            begin, end = max(low, start - allowed), min(high, start + n + allowed)
            window = words.hashes[begin:end]
            ends = edit_ends(item, window)
            edits = int(ends.min())
            if edits <= allowed:
                stop = int(ends.argmin())
                length = int(edit_ends(item[::-1], window[:stop][::-1], anchored=True).argmin())
                hit = (edits, begin + stop - length - low, begin + stop - low)
                best[row, i] = min(best.get((row, i), hit), hit)
        return best


def _blocks(benchmark: DataFrame, similarity: float, recall: float, id_col: str, text_col: str, block_bytes: int):
    """Broadcasts of the items, about ``block_bytes`` of text in each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        with own_jobs(spark):
            block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).toArrow()  # a bounded block
        block = block.sort_by([("id", "ascending"), ("text", "ascending")]).combine_chunks()
        yield spark.sparkContext.broadcast(Items(block["id"], block["text"], similarity, recall))


def _find(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        for batch in slices(batches):
            found = sorted(block.hits(batch.column("text")).items())
            ids = batch.column("id").take(pa.array([r for (r, _), _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([block.ids[i] for (_, i), _ in found], pa.int64()), *(pa.array([x[k] for _, x in found], pa.int32()) for k in range(3)), pa.array([len(block.items[i]) for (_, i), _ in found], pa.int32())],
                ["doc_id", "item_id", "edits", "begin", "end", "item_words"],
            )

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.95, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, edits, begin, end, item_words): each item in each row of ``docs``, its best place, in words.

    A hit takes at most (1 - similarity) of the item's words as edits: words put in, left out or
    replaced, after lower-casing A-Z.  Ties go to the first place.  Exact copies are always found, whatever the
    item's length; items with edits with probability ``recall`` or more.  Empty and null texts on either side take no
    part; repeated items and rows each give rows of their own; null ids pass through.  Empty tables give an empty
    result.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = None
    for items in _blocks(benchmark, similarity, recall, item_id_col, item_text_col, block_bytes):
        part = rows.mapInArrow(_find(items), "doc_id long, item_id long, edits int, begin int, end int, item_words int")
        out = part if out is None else out.unionByName(part)
    return out


def _clean(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, _ in items.value.hits(batch.column("text"))]] = False
            yield batch.filter(pa.array(keep))

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.95, item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` (with a column ``text``) without the rows in which ``find_items`` finds anything; nothing is shuffled.

    All columns are kept, whatever their names.  Null and empty texts hold nothing and stay, repeated rows go or stay
    together, null ids don't matter, and an empty table on either side leaves ``docs`` as it is.
    """
    for items in _blocks(benchmark, similarity, recall, item_id_col, item_text_col, block_bytes):
        docs = docs.mapInArrow(_clean(items), docs.schema)
    return docs
