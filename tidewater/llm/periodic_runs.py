"""Maximal runs of repeated words, by the Stoye-Gusfield suffix tree algorithm.

A run is a stretch of words with smallest period q, at least twice as long as q, that cannot be extended.  At its right
end stands exactly one branching tandem repeat of its period: two equal halves of q words, after which the period breaks.
Two suffixes i and i + q part after q common words there, so both are leaves below one node of depth q of the text's suffix
tree, in different branches.  For each node, the leaf lists of all children but the largest are walked, and each
leaf i asks whether i + depth or i - depth is below the node as well; leaves are walked at most log n times.

The suffix tree of a batch of texts stands in arrays: suffixes sorted by prefix doubling, lengths of common prefixes, and
the intervals of sorted suffixes that are its nodes.  Texts without a repeated piece as long as the shortest run less its
period leave after the sorting.  Rotating a branching repeat to the left as far as the period holds gives its run, and
repeats of a multiple of a run's period merge into that run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import slices
from .words import Words, mix


def _doubled(keys: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffixes in order, ranks by their first 1, 2, 4, ... words); a suffix ends at ``stop``, where its text does.

    Words of different texts have different ``keys``.  Only suffixes that are still equal to others are sorted again.
    """
    n = len(keys)
    order = np.argsort(keys)
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, h = [rank], 1
    while True:
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, n))
        at = np.flatnonzero(np.repeat(size > 1, size))  # places in the order that share their rank
        if not len(at):
            return order, levels
        own = order[at]
        after = own + h
        second = np.where(after < stop[own], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[own].astype(np.int64) * (n + 1) + second
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[at] = own
        new[at] = differs = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[own] = np.maximum.accumulate(np.where(differs, at, 0))
        levels.append(rank)
        h *= 2


def _common(order: np.ndarray, levels: list[np.ndarray], stop: np.ndarray) -> np.ndarray:
    """Words that each suffix has in common with the one before it in the order."""
    n = len(order)
    out = np.zeros(n, np.int64)
    pairs = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b, got = order[pairs], order[pairs + 1], np.zeros(len(pairs), np.int64)
    for k in reversed(range(len(levels))):
        x, y = a + got, b + got
        inside = (x < stop[a]) & (y < stop[b])
        got[inside] += (levels[k][x[inside]] == levels[k][y[inside]]).astype(np.int64) << k
    out[pairs + 1] = got
    return out


def _nodes(common: np.ndarray) -> np.ndarray:
    """Rows depth, left, right, left of the largest child, its right, of the tree's inner nodes; the right ends are exclusive.

    One pass with a stack, on which an interval of the order waits until a shorter common prefix closes it.
    """
    found: list[tuple[int, int, int, int, int]] = []
    stack = [[0, 0, 0, 0]]  # depth, left, largest child
    lengths = common.tolist()
    lengths.append(0)
    for right in range(1, len(lengths)):
        depth, left = lengths[right], right - 1  # the child that ends here is a leaf at first
        while stack[-1][0] > depth:
            top = stack.pop()
            if right - left > top[3] - top[2]:
                top[2], top[3] = left, right
            left = top[1]
            found.append((top[0], left, right, top[2], top[3]))
        top = stack[-1]
        if top[0] < depth:
            stack.append([depth, left, left, right])
        elif right - left > top[3] - top[2]:
            top[2], top[3] = left, right
    return np.array(found, np.int64).reshape(-1, 5).T


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the index of the range that each is from."""
    size = end - begin
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + begin[which], which


def _branching(codes: np.ndarray, order: np.ndarray, common: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, period) of all branching tandem repeats, ordered by end and period."""
    n = len(codes)
    place = np.full(n, -1, np.int64)
    place[order] = np.arange(len(order))
    depth, left, right, big, big_end = _nodes(common)
    found = [np.zeros((0, 2), np.int64)]
    # blocks of nodes that have about a million leaves in their smaller children
    walked = np.cumsum(right - left - (big_end - big))
    cuts = np.flatnonzero(np.diff(walked >> 20)) + 1 if len(walked) else walked
    for nodes in np.split(np.arange(len(depth)), cuts):
        for begin, end in ((left, big), (big_end, right)):
            leaf, which = _spread(begin[nodes], end[nodes])
            node, i = nodes[which], order[leaf]
            d = depth[node]
            for first, other in ((i, i + d), (i - d, i - d)):
                inside = (other >= 0) & (other < n)
                f, o, d_, v = first[inside], other[inside], d[inside], node[inside]
                below = (place[o] >= left[v]) & (place[o] < right[v])
                f, d_ = f[below], d_[below]
                past = f + 2 * d_
                parts = past >= stop[f]
                parts[~parts] = codes[(f + d_)[~parts]] != codes[past[~parts]]
                found.append(np.stack([past[parts], d_[parts]], 1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _start(codes: np.ndarray, first: int, end: int, period: int) -> int:
    """Where the stretch up to ``end`` with this period begins, ``first`` at the earliest; its last two periods are known to hold."""
    at, size = end - 2 * period, 64
    while at > first:
        low = max(first, at - size)
        breaks = np.flatnonzero(codes[low:at] != codes[low + period : at + period])
        if len(breaks):
            return low + int(breaks[-1]) + 1
        at, size = low, size * 4
    return first


def runs_of(words: Words, shortest: int) -> list[list[tuple[int, int, int]]]:
    """For each text its runs of ``shortest`` words or more, (start, length, period), ordered by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(words))]
    text = np.repeat(np.arange(len(words)), words.counts())
    if not len(text):
        return out
    stop, begin = words.first[1:][text], words.first[:-1][text]
    order, levels = _doubled(mix(words.hashes ^ mix(text.astype(np.uint64) + np.uint64(1))), stop)
    common = _common(order, levels, stop)
    codes = levels[0]
    # a run and the same stretch one period later have half of its length in common, so other texts have none
    deep = np.zeros(len(words), bool)
    deep[text[order[2 * common >= shortest]]] = True
    mine = deep[text[order]]
    ends, periods = _branching(codes, order[mine], common[mine], stop)
    # repeats shorter than a run may be are rotated first, all together
    for k in range(1, shortest - 1):
        short = 2 * periods + k <= shortest
        at = ends - 2 * periods - k
        holds = ~short | (at >= begin[ends - 1]) & (codes[np.maximum(at, 0)] == codes[np.maximum(at, 0) + periods])
        ends, periods = ends[holds], periods[holds]
    last, known = -1, []
    for end, period in zip(ends.tolist(), periods.tolist(), strict=True):
        if end != last:
            last, known = end, []
        if any(period % q == 0 and s <= end - 2 * period for q, s in known):
            continue  # a multiple of a run's period, inside that run
        first = int(begin[end - 1])
        start = _start(codes, first, end, period)
        known.append((period, start))
        out[text[end - 1]].append((start - first, end - start, period))
    for own in out:
        own.sort(key=lambda r: (r[0], r[2]))
    return out


def _collapsed(text: str | None, runs: list[tuple[int, int, int]]) -> str:
    words = (text or "").encode().split()
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
    return b" ".join(words).decode()


def _finder(shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in slices(batches, limit=2 << 20):
            texts = batch.column("text")
            runs = runs_of(Words(texts), shortest)
            collapsed = [_collapsed(x, r) for x, r in zip(texts.to_pylist(), runs, strict=True)]
            found = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], kind)
            yield pa.RecordBatch.from_arrays([batch.column("id"), found, pa.array(collapsed, pa.string())], ["id", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, shortest: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row the id, ``runs`` (array of start, length, period, in words) and ``collapsed``, the text that keeps of each run its first period.

    A run has ``shortest`` words or more.  ``runs`` are ordered by start, then period; runs may overlap, and a word goes
    that any run holds behind its first period.  Words are joined by one space.  A null text counts as empty, empty and short texts
    have no runs, repeated rows give a row each, null ids pass through, an empty table gives an empty result, and other
    columns are ignored.  Each text is judged by itself, in batches of 2 MB or one longer text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_finder(shortest), f"id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)
