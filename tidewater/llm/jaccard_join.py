"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word n-grams; documents link when the Jaccard similarity of their
sets reaches a threshold.  All n-grams have one global order, rare ones first, and the order is cut into
fragments.  A document's set falls into one segment for each fragment.  Partial overlaps are counted
fragment by fragment and summed for each pair; after the first fragment, pairs that can't reach the
threshold any more, even if all their other n-grams agree, are out.

Pairs to count come from the order, too.  Similar sets share an n-gram among the first
n - ceil(t * n) + 1 of each; and of the first one they share, all that stands before it in either set is
lost to the overlap.  Equal sets form one class and stand for each other.  Links are wanted for
components, so an n-gram's classes are first compared with one of them alone, the one with the least
to lose; only classes that are then still in different components are looked at pair by pair.  For that they
are cut into bands of sizes that can be similar at all, a class that has lost too much for the smallest of its
band is out, and the rest is dealt in blocks of bounded size.  No link between different components
is left out, while copies by the thousand cost one comparison each.

Classes are told apart by 128 bits of their sets, n-grams by 60-bit hashes (48 bits of them in segments);
equal hashes of different n-grams in one pair are as likely as 1e-8 for sets of a thousand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .components import stars
from .shared import discard, own_jobs, slices, written
from .words import Words, mix, windows

BUCKETS = 22  # bits of the table of n-gram frequencies
CHUNKS, SHARES = 64, 8  # that it is added up in
FRAGMENTS = 3  # two halves of the rare n-grams, and the frequent ones
BLOCK = 512


def _sets(texts: pa.Array, size: int, level: np.ndarray | None) -> list[np.ndarray]:
    """The sorted set of each text: order keys (level, then 60 bits of the hash), or plain hashes without ``level``."""
    words = Words(texts, lower=True)
    hashes, n, out = windows(words.hashes, size), words.counts(), []
    for i, a in enumerate(words.first[:-1]):
        if n[i] >= size:
            own = hashes[a : a + n[i] - size + 1]
        else:
            own = mix(windows(words.hashes[a : a + n[i]], int(n[i])) + np.uint64(int(n[i]))) if n[i] else hashes[:0]
        if level is not None:
            own = level[(own >> np.uint64(64 - BUCKETS)).astype(np.int64)].astype(np.uint64) << np.uint64(60) | own >> np.uint64(4)
        out.append(np.unique(own))
    return out


def _class(own: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    place = mix(np.arange(len(own), dtype=np.uint64) + np.uint64(1)) | np.uint64(1)
    sums = [(mix(own ^ salt) * place).sum(dtype=np.uint64) ^ np.uint64(len(own)) for salt in (np.uint64(0), np.uint64(0x9E3779B97F4A7C15))]
    return mix(np.array(sums, np.uint64)).tobytes()


def _frequencies(size: int):
    """How many of this task's sets have an n-gram in each bucket, in chunks; counts stop at 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, task = np.zeros(1 << BUCKETS, np.int32), TaskContext.get().partitionId()
        for batch in slices(batches):
            own = _sets(batch.column("text"), size, None)
            if own:
                bucket = (np.concatenate(own) >> np.uint64(64 - BUCKETS)).astype(np.int64)
                counts += np.bincount(bucket, minlength=1 << BUCKETS).astype(np.int32)
        if counts.any():
            packed = np.minimum(counts, 255).astype(np.uint8).reshape(CHUNKS, -1)
            for chunk in range(CHUNKS):
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([task % SHARES], pa.int32()), pa.array([packed[chunk].tobytes()])], ["chunk", "share", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each (chunk, share); rows come sorted by them."""
    key, total = None, None
    for batch in batches:
        for chunk, share, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "share", "counts")), strict=True):
            if key != (chunk, share):
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()])], ["chunk", "share", "counts"])
                key, total = (chunk, share), np.zeros((1 << BUCKETS) // CHUNKS, np.uint32)
            total += np.frombuffer(counts, np.uint8 if len(counts) == len(total) else np.uint32)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()])], ["chunk", "share", "counts"])


def frequency_levels(rows: DataFrame, size: int) -> np.ndarray:
    """A level from 0 (rare) to 7 for each bucket of n-grams; 2 ** BUCKETS entries, whatever the corpus.

    Any fixed order gives the same links; this one keeps the frequent n-grams out of the prefixes.
    """
    schema, n = "chunk int, share int, counts binary", int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select("text").mapInArrow(_frequencies(size), schema)
    for by in (["chunk", "share"], ["chunk"]):
        found = found.repartition(min(n, CHUNKS), *by).sortWithinPartitions("chunk", "share").mapInArrow(_added, schema)
        found = found.withColumn("share", F.lit(0)) if by == ["chunk", "share"] else found
    counts = np.zeros((CHUNKS, (1 << BUCKETS) // CHUNKS), np.uint32)
    with own_jobs(rows.sparkSession):
        for r in found.select("chunk", "counts").collect():  # CHUNKS rows of fixed size
            counts[r["chunk"]] += np.frombuffer(r["counts"], np.uint32)
    usual, levels = counts.mean(), np.zeros(counts.shape, np.uint8)
    for own, out in zip(counts, levels, strict=True):
        over = np.maximum(own - usual - 3 * np.sqrt(usual), 0)  # what a bucket has beyond its share of rare n-grams
        out[:] = np.where(over >= 3, np.clip(np.floor(np.log2(np.maximum(over, 1)) / 2) + 1, 1, 7), 0)
    return levels.ravel()


def _prefixes(size: int, percent: int, level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = _sets(batch.column("text"), size, level.value)
            prefix = [own[: len(own) - -(-percent * len(own) // 100) + 1].view(np.int64) for own in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array([_class(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], ["id", "text_key", "h", "n", "prefix"])

    return run


def _segments(size: int, level):
    """(c, part, grams, length) of the rows whose set is that of the class asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for own, want, h in zip(_sets(batch.column("text"), size, level.value), batch.column("want").to_pylist(), batch.column("h").to_pylist(), strict=True):
                if _class(own) == h:
                    cut = np.searchsorted(own, np.array([1 << 59, 1 << 60], np.uint64))
                    for part, x in enumerate(np.split(own, cut)):
                        out.append((want, part, np.ascontiguousarray(((x << np.uint64(4)) | (x >> np.uint64(60))).view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes(), len(x)))
            yield pa.RecordBatch.from_pylist([dict(zip(("c", "part", "grams", "length"), x, strict=True)) for x in out], schema=pa.schema([("c", pa.int64()), ("part", pa.int32()), ("grams", pa.binary()), ("length", pa.int64())]))

    return run


def _grams(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial overlap of a pair's segments in one fragment."""
    for batch in batches:
        n = [len(np.intersect1d(_grams(x), _grams(y), assume_unique=True)) for x, y in zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("part"), pa.array(n, pa.int64())], ["a", "b", "part", "overlap"])


def _needed(n_a, n_b, percent: int):
    """The least overlap of sets of these sizes at the threshold: ceil(t / (1 + t) * (a + b))."""
    return -((-percent * (n_a + n_b)) // (100 + percent))


def _cross_pairs(percent: int):
    """Pairs of rows of one (token, band, block, block) that can reach the threshold and are in different components.

    Rows come sorted by the key; groups are bounded by BLOCK, and the last one of a batch waits for the next.
    """
    by = ("token", "band", "lo", "hi")

    def pairs(key: np.ndarray, c, n, i, comp, side, visits) -> np.ndarray:
        found, at = [], np.arange(len(c))
        for step in range(1, len(c)):
            at = at[at + step < len(c)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            to = at + step
            need = _needed(n[at], n[to], percent)
            good = (comp[at] != comp[to]) & (n[at] - i[at] >= need) & (n[to] - i[to] >= need) & ((side[at] != side[to]) | (side[at] == 2)) & ~(visits[at] & visits[to])
            found.append(np.stack([np.minimum(c[at], c[to]), np.maximum(c[at], c[to]), np.where(c[at] < c[to], n[at], n[to]), np.where(c[at] < c[to], n[to], n[at])], 1)[good])
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names}
            rows = {k: np.concatenate([kept[k], v]) for k, v in rows.items()} if kept else rows
            if not len(rows["token"]):
                continue
            last = np.logical_and.reduce([rows[k] == rows[k][-1] for k in by])
            kept = {k: v[last] for k, v in rows.items()}
            yield from out({k: v[~last] for k, v in rows.items()})
        if kept:
            yield from out(kept)

    def out(rows: dict) -> Iterator[pa.RecordBatch]:
        if len(rows["token"]):
            new = np.ones(len(rows["token"]), bool)
            new[1:] = np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in by])
            found = pairs(np.cumsum(new), *(rows[k] for k in ("c", "n", "i", "comp", "side", "visits")))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(4)], ["a", "b", "n_a", "n_b"])

    return run


class Join:
    """The steps of one join, over ``rows`` (id, text_key, text) with the class table in hand.

    ``text_key`` is a hash of the text, by which a class's text is found again, whatever the ids are.
    """

    def __init__(self, rows: DataFrame, size: int, percent: int):
        self.rows, self.size, self.percent, self.spark = rows, size, percent, rows.sparkSession
        self.level = self.spark.sparkContext.broadcast(frequency_levels(rows, size))  # 2 ** BUCKETS bytes
        prefixes = written(rows.mapInArrow(_prefixes(size, percent, self.level), "id long, text_key long, h binary, n long, prefix array<long>"), "join-prefixes")
        self.members = written(prefixes.select("id", "text_key", "h", "n"), "join-members")
        # equal sets have equal prefixes; a class is known by a number from here on
        classes = prefixes.where("n > 0").groupBy("h").agg(F.first("n").alias("n"), F.min("text_key").alias("text_key"), F.first("prefix").alias("prefix"))
        classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "join-numbered")
        self.classes = written(classes.drop("prefix"), "join-classes")
        self.shared = written(self._shared(classes.select("c", "n", "prefix")), "join-shared")
        discard(prefixes, classes)

    def _shared(self, classes: DataFrame) -> DataFrame:
        """(token, c, n, i): the classes of each n-gram that stands in the prefixes of two classes or more."""
        rows = classes.select("c", "n", F.posexplode("prefix").alias("i", "token"))
        tokens = rows.groupBy("token").agg(F.count("*").alias("times")).where("times > 1").select(F.col("token").alias("t"))
        return rows.join(tokens, F.col("token") == F.col("t")).select("token", "c", "n", F.col("i").cast("long").alias("i"))

    def star_pairs(self) -> DataFrame:
        """Each n-gram's classes with that one of them which has the least before the n-gram."""
        hub = self.shared.groupBy("token").agg(F.min(F.struct("i", (-F.col("n")).alias("m"), "c")).alias("hub")).select(F.col("token").alias("t"), F.col("hub.i").alias("i_h"), (-F.col("hub.m")).alias("n_h"), F.col("hub.c").alias("h"))
        need = F.ceil(F.lit(self.percent) * (F.col("n") + F.col("n_h")) / F.lit(100.0 + self.percent) - F.lit(1e-9))
        rows = self.shared.join(hub, F.col("token") == F.col("t")).where((F.col("c") != F.col("h")) & (F.col("n") - F.col("i") >= need) & (F.col("n_h") - F.col("i_h") >= need))
        low = F.col("c") < F.col("h")
        return rows.select(F.least("c", "h").alias("a"), F.greatest("c", "h").alias("b"), F.when(low, F.col("n")).otherwise(F.col("n_h")).alias("n_a"), F.when(low, F.col("n_h")).otherwise(F.col("n")).alias("n_b")).distinct()

    def cross_pairs(self, roots: DataFrame) -> DataFrame:
        """Pairs of classes of one n-gram that are still in different components, each pair once for an n-gram.

        Sets that can be similar are in one band of sizes or in bands next to each other: each class is at home in
        its own band and visits the one below.
        """
        rows = self.shared.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), F.col("c") == F.col("node"), "left").select("token", "c", "n", "i", F.coalesce("root", "c").alias("comp"))
        live = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select(F.col("token").alias("t"))
        rows = written(rows.join(live, F.col("token") == F.col("t")).drop("t"), "join-live")
        ratio = max(math.log(100 / self.percent) * 1.001, 0.01)
        home = F.floor(F.log(F.col("n")) / F.lit(ratio)).cast("int")
        rows = rows.withColumn("band", F.explode(F.array(home, home - 1))).withColumn("visits", F.col("band") < home)
        # the size that a partner may have at most, after what stands before the n-gram is lost
        reach = F.lit(100 + self.percent) * (F.col("n") - F.col("i")) - F.lit(self.percent) * F.col("n")
        groups = rows.groupBy("token", "band").agg(F.count("*").alias("all"), F.min("n").alias("least"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count_if(~F.col("visits")).alias("homes"))
        groups = groups.where("low < high and homes > 0").select(F.col("token").alias("t"), F.col("band").alias("g"), "least", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"))
        rows = rows.join(groups, (F.col("token") == F.col("t")) & (F.col("band") == F.col("g"))).where(reach >= F.lit(self.percent) * F.col("least"))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") < F.col("other")).cast("int"))
        rows = rows.select("token", "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side.alias("side"), "visits", "c", "n", "i", "comp")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(n, "token", "band", "lo", "hi").sortWithinPartitions("token", "band", "lo", "hi")
        return rows.mapInArrow(_cross_pairs(self.percent), "a long, b long, n_a long, n_b long").distinct()

    def links(self, pairs: DataFrame) -> DataFrame:
        """(a, b): the pairs that reach the threshold, by partial overlaps."""
        pairs = written(pairs, "join-pairs")
        ask = pairs.select(F.col("a").alias("want")).unionByName(pairs.select(F.col("b").alias("want"))).distinct()
        ask = ask.join(self.classes, F.col("want") == F.col("c")).select("want", "h", F.col("text_key").alias("asked_key"))
        # one text for each class, however many rows have it
        texts = self.rows.join(ask, F.col("text_key") == F.col("asked_key")).groupBy("want").agg(F.first("h").alias("h"), F.any_value("text").alias("text"))
        segments = written(texts.mapInArrow(_segments(self.size, self.level), "c long, part int, grams binary, length long"), "join-segments")
        parts, open_pairs = None, pairs
        for own in ([0], list(range(1, FRAGMENTS))):
            a = segments.where(F.col("part").isin(own)).select(F.col("c").alias("a"), "part", F.col("grams").alias("grams_a"))
            b = segments.where(F.col("part").isin(own)).select(F.col("c").alias("b"), "part", F.col("grams").alias("grams_b"))
            both = open_pairs.select("a", "b").join(a, "a").join(b, ["b", "part"])
            counted = written(both.select("a", "b", "part", "grams_a", "grams_b").mapInArrow(_overlaps, "a long, b long, part int, overlap long"), "join-overlaps")
            parts = counted if parts is None else parts.unionByName(counted)
            if own == [0]:
                # what the other fragments can still bring is bounded by what is in them
                first = segments.where("part = 0").select("c", "length")
                rest = open_pairs.join(counted.drop("part"), ["a", "b"])
                for x in ("a", "b"):
                    rest = rest.join(first.select(F.col("c").alias(x), F.col("length").alias(f"first_{x}")), x)
                most = F.col("overlap") + F.least(F.col("n_a") - F.col("first_a"), F.col("n_b") - F.col("first_b"))
                open_pairs = written(rest.where((100 + self.percent) * most >= self.percent * (F.col("n_a") + F.col("n_b"))).select("a", "b", "n_a", "n_b"), "join-open")
        total = parts.groupBy("a", "b").agg(F.sum("overlap").alias("overlap")).join(open_pairs, ["a", "b"])
        found = written(total.where((100 + self.percent) * F.col("overlap") >= self.percent * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "join-links")
        discard(segments, pairs)
        return found


def _text_key(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _members(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, n, comp) for each row; ``comp`` names its component, null for empty sets."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _text_key(text_col).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    join = Join(rows, size, percent)
    first = join.links(join.star_pairs())
    roots = stars(first)
    second = join.links(join.cross_pairs(roots))
    discard(join.shared)
    roots = stars(roots.unionByName(second))
    named = join.classes.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), F.col("c") == F.col("node"), "left")
    named = written(named.select(F.col("h").alias("set"), F.coalesce("root", "c").alias("comp")), "join-named")
    members = join.members.join(named, F.col("h") == F.col("set"), "left").select("id", "text_key", "n", "comp")
    return written(members, "join-found")


def components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Words are lower-cased (A-Z); a text of fewer than ``size`` words has them all as its one n-gram.
    Texts without words and null texts have an empty set and link with nothing, not even each other.
    Rows with equal sets, repeated rows included, link.  A null id stands for no smallest id: such a row
    gets the component of the rows it links with, else null.  An empty table gives an empty result.
    Other columns are ignored.
    """
    members = _members(docs, size, percent, id_col, text_col)
    # written, so that the join that follows deals both sides anew and large components can be split
    least = written(members.where("n > 0").groupBy(F.col("comp").alias("label")).agg(F.min("id").alias("component_id")), "join-least")
    linked = members.where("n > 0").join(least, F.col("comp") == F.col("label")).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    alone = members.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component; texts without words and null texts all stay.

    The row with the smallest id stays, a null id after all others; of rows with that id, the one whose text has the
    smallest hash; of rows alike in both, an arbitrary one.  Unlike documents that share an id are in components
    of their own and each stay.  All columns are kept, whatever their names; an empty table gives an empty result.
    """
    members = _members(docs, size, percent, id_col, text_col).where("n > 0")
    first = members.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("one"))
    first = written(first.select(F.col("one.id").alias("stay_id"), F.col("one.text_key").alias("stay_key")), "join-stay")
    alike = members.groupBy("id", "text_key").agg(F.count("*").alias("alike")).where("alike > 1").select(F.col("id").alias("a_id"), F.col("text_key").alias("a_key"), "alike")
    first = first.join(alike, F.col("stay_id").eqNullSafe(F.col("a_id")) & (F.col("stay_key") == F.col("a_key")), "left")
    first = written(first.select("stay_id", "stay_key", F.coalesce("alike", F.lit(1)).alias("alike")), "join-one")
    wordless = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(F.struct("*").alias("whole_row"), F.col(id_col).cast("long").alias("id"), _text_key(text_col).alias("text_key"), wordless.alias("wordless"))
    kept = rows.where("not wordless").join(first, (F.coalesce("id", F.lit(0)) == F.coalesce("stay_id", F.lit(0))) & (F.col("text_key") == F.col("stay_key")) & F.col("id").eqNullSafe(F.col("stay_id")))
    once = kept.where("alike = 1").select("whole_row.*")
    if first.where("alike > 1").isEmpty():
        return once.unionByName(rows.where("wordless").select("whole_row.*"))
    one = kept.where("alike > 1").groupBy("stay_id", "stay_key").agg(F.first("whole_row").alias("whole_row"))
    return once.unionByName(one.select("whole_row.*")).unionByName(rows.where("wordless").select("whole_row.*"))
