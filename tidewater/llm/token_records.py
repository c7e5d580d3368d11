"""Token ids as length-delimited binary records with a separate offset index.

Shard format, little-endian, one record after another::

    u64 length | u32 masked crc of the length | payload | u32 masked crc of the payload

The payload is one byte, 2 or 4, then the ids as unsigned integers of so many bytes.  A checksum c
(CRC-32) is stored masked, as ``rotate_right(c, 15) + 0xa282ead8``, so that checksums of data that
themselves hold checksums stay useful.

The index is a Parquet table with a row for each record: where it lies, whose it is, and how many
ids lie before it in its shard.  It is also the commit record.  A task writes its shard under a name
of its own, and Spark's committer keeps the index rows of one attempt only; shards of lost or
repeated attempts are never named in the index and ``clean`` deletes them.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count, islice
from urllib.parse import urlencode

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import own_jobs, slices

INDEX = "shard int, file string, seq long, offset long, length long, doc_id long, n_tokens long, before long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    payload = bytes([width]) + ids.astype(f"<u{width}").tobytes()
    size = len(payload).to_bytes(8, "little")
    return b"".join([size, masked(size).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")])


def unframe(record: bytes) -> np.ndarray:
    """The ids of one whole record; ValueError if it is damaged."""
    n = int.from_bytes(record[:8], "little")
    payload = record[12:-4]
    if len(payload) != n or masked(record[:8]) != int.from_bytes(record[8:12], "little") or masked(payload) != int.from_bytes(record[-4:], "little"):
        raise ValueError("damaged record")
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1)


#: A line that is letters that case and composition leave as letters, then signs other than the apostrophe; or any other line.
PLAIN = re.compile(r"^(?:([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u0148\u014A-\u017E]*)([!-&(-/:-@\[-`{-~]*)|(.+))$", re.MULTILINE)


class Pool:
    """Strings numbered as they come up, and the ids of each, end to end in one array."""

    def __init__(self):
        self.index: dict = defaultdict(count().__next__)
        self.known = self.used = self.bytes = 0
        self.sizes, self.begin, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)

    def fresh(self) -> list:
        return list(islice(reversed(self.index), len(self.index) - self.known))[::-1]

    def keep(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        """The ids of the next ``len(sizes)`` strings."""
        while self.known + len(sizes) > len(self.sizes):
            self.sizes, self.begin = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.begin))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        own = slice(self.known, self.known + len(sizes))
        self.sizes[own], self.begin[own] = sizes, self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.known, self.used = self.known + len(sizes), self.used + len(ids)

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes, and the ids of all the strings numbered ``at``."""
        sizes = self.sizes[at]
        return sizes, self.flat[np.repeat(self.begin[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


class Encoder:
    """Ids of whole texts, as the tokenizer gives them without special tokens.

    A vocabulary with an end-of-word suffix never joins words across white space, so a text's ids are
    those of its words in turn; then each distinct word is encoded once and kept, and a word of letters
    and then signs is put together from its two pieces.  Words and pieces that are kept are bounded by
    ``most`` and by ``most_bytes``; beyond that they are forgotten and met anew.  Other vocabularies encode text by text.
    """

    def __init__(self, tokenizer: str, most: int = 500_000, most_bytes: int = 16 << 20):
        from tokenizers import Tokenizer

        self.model, self.most, self.most_bytes = Tokenizer.from_str(tokenizer), most, most_bytes
        suffix = json.loads(tokenizer)["model"].get("end_of_word_suffix")
        self.by_word, self.words, self.pieces = bool(suffix), Pool(), Pool()
        if suffix:
            vocab = self.model.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for word, i in vocab.items() if word.endswith(suffix)]] = True

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self) -> None:
        """Encode the new pieces: each ends with the one token that has the suffix, so many go as one text."""
        fresh = self.pieces.fresh()
        for at in range(0, len(fresh), 512):
            part = fresh[at : at + 512]
            ids = self._batch([" ".join(part)])[0]
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != sum(map(bool, part)):  # not so with this vocabulary: one by one
                found = self._batch(part)
                self.pieces.keep(np.array([len(x) for x in found], np.int64), np.concatenate(found))
                continue
            sizes = np.zeros(len(part), np.int64)
            sizes[[bool(x) for x in part]] = np.diff(stops, prepend=0)
            self.pieces.keep(sizes, ids)

    def _learn(self) -> None:
        """Encode the words that came up since the last call."""
        lines = b"\n".join(self.words.fresh()).decode()  # words hold no line ends
        if not lines:
            return
        self.words.bytes, self.pieces.bytes = self.words.bytes + len(lines), self.pieces.bytes + len(lines)
        fresh = PLAIN.findall(lines)
        other = np.flatnonzero(np.fromiter((bool(x[2]) for x in fresh), bool, len(fresh)))
        number = self.pieces.index.__getitem__
        pairs = np.array([(-1, -1) if whole else (number(letters), number(signs)) for letters, signs, whole in fresh], np.int64)
        self._learn_pieces()
        rest = self._batch([fresh[i][2] for i in other])
        sizes = np.where(pairs < 0, 0, self.pieces.sizes[np.maximum(pairs, 0)]).sum(1)
        sizes[other] = [len(x) for x in rest]
        out = np.empty(sizes.sum(), np.uint32)
        plain = np.ones(len(fresh), bool)
        plain[other] = False
        from_plain = np.repeat(plain, sizes)
        out[from_plain] = self.pieces.ids(pairs[plain].ravel())[1]
        if rest:
            out[~from_plain] = np.concatenate(rest)
        self.words.keep(sizes, out)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return self._batch(texts)
        if self.words.known > self.most or self.words.bytes > self.most_bytes:
            self.words = Pool()
        if self.pieces.known > self.most or self.pieces.bytes > self.most_bytes:
            self.pieces = Pool()
        words = [x.encode().split() for x in texts]
        n = np.array([len(x) for x in words], np.int64)
        at = np.fromiter(map(self.words.index.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        self._learn()
        sizes, ids = self.words.ids(at)
        stops = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(n)]
        return np.split(ids, stops[:-1])


_ENCODERS: dict[int, Encoder] = {}


def _encoder(tokenizer: str) -> Encoder:
    """One encoder for a worker process, which keeps its words from task to task."""
    key = zlib.crc32(tokenizer.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer)
    return _ENCODERS[key]


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as Hadoop understands it: with the scheme and host of the default file system where it names none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def opened_by(path: str, setting: Callable[[str], str | None] = lambda name: None) -> str:
    """The address under which pyarrow opens what Spark knows as ``path``, a qualified one; ValueError for schemes that it can't open.

    ``setting`` looks up Hadoop's settings: an S3 endpoint, region and plain HTTP are taken over.
    """
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    if scheme in ("s3a", "s3n", "s3"):
        endpoint, region = setting("fs.s3a.endpoint"), setting("fs.s3a.endpoint.region")
        plain = (setting("fs.s3a.connection.ssl.enabled") or "true").lower() == "false" or (endpoint or "").startswith("http://")
        extra = {"endpoint_override": re.sub(r"^https?://", "", endpoint) if endpoint else None, "scheme": "http" if plain else None, "region": region}
        extra = urlencode({k: v for k, v in extra.items() if v})
        return f"s3:{rest}" + (f"?{extra}" if extra else "")
    if scheme in ("hdfs", "viewfs", "gs", "abfs", "abfss"):
        return path
    raise ValueError(f"records can't be kept under {scheme}:")


def _address(spark: SparkSession, path: str) -> str:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return opened_by(qualified(spark, path), lambda name: conf.get(name))


def _writer(folder: str, tokenizer, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _encoder(tokenizer.value)
        fs, base = pa.fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name = f"part-{shard:06d}-{uuid.uuid4().hex}.records"
        stream, offset, seq, before = None, 0, 0, 0
        try:
            for batch in slices(batches, limit=1 << 20):
                if stream is None:
                    stream = fs.open_output_stream(f"{base}/{name}")
                sizes, counts = [], []
                for ids in encode([x or "" for x in batch.column("text").to_pylist()]):
                    record = frame(np.append(ids, np.uint32(end_id)))
                    stream.write(record)
                    sizes.append(len(record))
                    counts.append(len(ids) + 1)
                n, sizes, counts = len(sizes), np.array(sizes, np.int64), np.array(counts, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, np.int32)), pa.array([name] * n), pa.array(np.arange(seq, seq + n)), pa.array(offset + np.cumsum(sizes) - sizes), pa.array(sizes), batch.column("doc_id"), pa.array(counts), pa.array(before + np.cumsum(counts) - counts)],
                    ["shard", "file", "seq", "offset", "length", "doc_id", "n_tokens", "before"],
                )
                offset, seq, before = offset + int(sizes.sum()), seq + n, before + int(counts.sum())
        finally:
            if stream is not None:
                stream.close()

    return run


def write_records(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write it under ``path``: shards in ``data``, the index in ``index``.

    Records lie in ascending id order over the shards; rows of one id are ordered by text, a null id
    comes first and a null text is encoded as an empty one, which leaves the end id alone.  Repeated
    rows each give a record.  An empty table gives an index without rows.  Other columns are ignored.

    ``path`` is one that Spark knows: without a scheme it lies in the default file system, for the shards as for the
    index.  Shards go to local and shared folders, HDFS, S3 (``s3a``), and the stores that pyarrow knows.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer = f.read()
    jvm = spark.sparkContext._jvm
    data = jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    data.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(data)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")
    rows = rows.mapInArrow(_writer(_address(spark, f"{path}/data"), spark.sparkContext.broadcast(tokenizer), end_id), INDEX)
    with own_jobs(spark):
        rows.write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with ``start``, the number of ids in all records before this one."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("own"))  # a row for each shard: bounded by the number of write tasks
    base = shards.select("shard", F.coalesce(F.sum("own").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return index.join(base, "shard").withColumn("start", F.col("base") + F.col("before")).drop("base")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        name = stream = None
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                ids = []
                for file, offset, length in zip(part.column("file").to_pylist(), part.column("offset").to_pylist(), part.column("length").to_pylist(), strict=True):
                    if file != name:
                        name, stream = file, fs.open_input_file(f"{base}/{file}")
                    ids.append(unframe(stream.read_at(length, offset)).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("start"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_records(spark: SparkSession, path: str, index: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the records that ``index`` names, in any order, read by offset.

    ``ids`` are little-endian unsigned 32-bit integers.  Every checksum is verified; a damaged record ends the job with a
    ValueError.  Null ids come back as nulls, repeated rows as often as they were written, and an empty index gives no rows.
    """
    index = read_index(spark, path) if index is None else index
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = index.repartition(n, "shard", F.floor(F.col("seq") / 4096)).sortWithinPartitions("file", "offset").select("file", "offset", "length", "doc_id", "start")
    return index.mapInArrow(_reader(_address(spark, f"{path}/data")), "doc_id long, start long, n_tokens long, ids binary")


def clean(spark: SparkSession, path: str) -> int:
    """Delete the shards that the index does not name, left behind by lost attempts; returns how many."""
    named = {r[0] for r in spark.read.schema(INDEX).parquet(f"{path}/index").select("file").distinct().toLocalIterator()}
    fs, base = pa.fs.FileSystem.from_uri(_address(spark, f"{path}/data"))
    stray = [x.path for x in fs.get_file_info(pa.fs.FileSelector(base)) if x.base_name not in named]
    for x in stray:
        fs.delete_file(x)
    return len(stray)
