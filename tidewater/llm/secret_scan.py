"""Secret scanning with a random forest that removes false positives.

A wide search takes everything that could be a secret: tokens of 12 characters or more, dotted ones whole; the value
behind a key word and ``=`` or ``:``, of any characters and from 4 on, or from 6 on without a sign; the password of a URL; and
the body of a private key in PEM form.
Each candidate is described by its length, its character classes and entropy, how likely its character
transitions are in ordinary words, how much of it words of the corpus cover, the path of its document, and the
words around it.  A random forest trained on labelled findings then separates secrets from identifiers,
numbers, checksums, placeholders and long words.

Where nobody has labelled findings, they are planted: made secrets and made look-alikes are put into a
bounded sample of the corpus' own texts, and beside them the texts' own candidates count as no secrets, unless they
are assigned to something or have the form of a key id.  Labels therefore don't come from the features.  A part of the planted texts is held out, and
``evaluate`` gives precision and recall on it.

What ordinary words look like is counted over the words of all texts; every text is scanned whole.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .shared import sample_by_hash, slices, written

TOKEN = re.compile(rb"[A-Za-z0-9+/_-]{12,}(?:\.[A-Za-z0-9+/_-]{8,})*=*")
#: Words that stand before secrets, words that stand around samples, and path pieces of samples.
KEY_WORDS = (b"password", b"passwd", b"pwd", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"access_key", b"auth", b"bearer", b"credential", b"private_key", b"privatekey", b"private key", b"accountkey", b"account_key", b"secretkey", b"sharedkey", b"passphrase")
#: What a key in PEM form stands between.
PEM, DASHES = b"PRIVATE KEY-----", b"-----"
SAMPLE_WORDS = (b"example", b"sample", b"dummy", b"placeholder", b"changeme", b"your", b"xxxx", b"test")
SAMPLE_PATHS = ("test", "example", "sample", "fixture", "doc", "mock")
#: From a key word to its value; from ``://`` to the password.
VALUE = re.compile(rb"[A-Za-z_-]*+[\"']?+[ \t]*+(?:=>|:=|=|:)[ \t]*+(?:[Bb]earer[ \t]++)?[\"'`]?([^\s\0\"'`,;<>()]{4,})|[ \t]++([A-Za-z0-9._~+/=-]{6,})")
USERINFO = re.compile(rb"://[^/\s\0:@]*+:([^@/\s\0]{3,})@")
FEATURES = ("length", "digits", "uppers", "lowers", "signs", "entropy", "transitions", "coverage", "hexadecimal", "assigned", "quoted", "key_before", "sample_near", "path_sample", "path_depth", "sentence", "before_at")


PAD = 128  # zero bytes before and behind all texts


class Ordinary:
    """Character transitions and frequent words of a corpus; both of fixed size."""

    def __init__(self, words: list[str], cells: list[tuple[int, int, int]]):
        counts = np.ones((256, 256))
        for a, b, n in cells:
            counts[a, b] += n
        self.log = np.log(counts / counts.sum(1, keepdims=True))
        self.pieces = {w.lower().encode() for w in words if len(w.encode()) >= 3}
        self.by_size: dict[int, np.ndarray] = {}
        for size in sorted({len(w) for w in self.pieces}):
            rows = np.frombuffer(b"".join(sorted(w for w in self.pieces if len(w) == size)), np.uint8).reshape(-1, size)
            key = np.zeros(len(rows), np.uint64)
            for k in range(size):
                key = _roll(key, rows[:, k])
            self.by_size[size] = np.sort(key)

    def covered(self, low: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Share of each token that lies in known words; token i is ``low[first[i]:first[i + 1]]``, in lower case."""
        cover = np.zeros(len(low) + 1, np.int32)
        crosses = np.zeros(len(low), np.int64)  # how far the token goes from here
        crosses[:] = np.repeat(first[1:], np.diff(first)) - np.arange(len(low))
        key = np.zeros(len(low), np.uint64)
        for k in range(max(self.by_size, default=0)):
            n = len(low) - k
            if n <= 0:
                break
            key = _roll(key[:n], low[k:])
            known = self.by_size.get(k + 1)
            if known is not None:
                at = np.flatnonzero((crosses[:n] > k) & (known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key))
                np.add.at(cover, at, 1)
                np.add.at(cover, at + k + 1, -1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        return (inside[first[1:]] - inside[first[:-1]]) / np.maximum(np.diff(first), 1)


def _roll(key: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return (key ^ byte) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B97F4A7C15)


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros((256, 256), np.int64)
    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("count").to_pylist(), strict=True):
            b = np.frombuffer(word.encode(), np.uint8)
            np.add.at(cells, (b[:-1], b[1:]), n)
    a, b = np.nonzero(cells)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(cells[a, b])], ["a", "b", "n"])


def learn_ordinary(docs: DataFrame, words: int = 4000, text_col: str = "text", longest: int = 24) -> Ordinary:
    """The most frequent ``words`` words of 2 to ``longest`` letters, and the character transitions of words of any length, over all texts.

    Null and empty texts have no words; of equally frequent words the first in code point order are taken; an empty table gives an
    empty dictionary and even transitions.
    """
    found = docs.select(F.explode(F.split(text_col, r"[^\p{L}]+")).alias("word")).where("length(word) >= 2").groupBy("word").count()
    found = written(found, "secret-words")
    top = found.where(F.length("word") <= longest).orderBy(F.desc("count"), "word").limit(words).collect()
    cells = found.mapInArrow(_transitions, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()  # 65,536 at most
    return Ordinary([r["word"] for r in top], [tuple(r) for r in cells])


def _found(data: bytes, words: tuple[bytes, ...]) -> np.ndarray:
    """Where the words stand in ``data``: sorted (begin, end) pairs."""
    out = []
    for w in words:
        at = data.find(w)
        while at >= 0:
            out.append((at, at + len(w)))
            at = data.find(w, at + 1)
    return np.array(sorted(out), np.int64).reshape(-1, 2)


def _spans(data: bytes, low: bytes, keys: np.ndarray) -> np.ndarray:
    """Sorted distinct spans (begin, end) of all candidates; of spans that begin together the longest."""
    found = [m.span() for m in TOKEN.finditer(data)]
    for _, end in keys.tolist():
        m = VALUE.match(data, end)
        if m:
            found.append(m.span(1) if m[1] is not None else m.span(2))
    at = data.find(b"://")
    while at >= 0:
        m = USERINFO.match(data, at)
        if m:
            found.append(m.span(1))
        at = data.find(b"://", at + 1)
    at = data.find(PEM)
    while at >= 0:
        if data.rfind(b"-----BEGIN", max(0, at - 40), at) >= 0:
            a = at + len(PEM)
            z = min(x for x in (data.find(DASHES, a), data.find(b"\0", a)) if x >= 0)
            body = data[a:z]
            a, z = a + len(body) - len(body.lstrip()), z - len(body) + len(body.rstrip())
            if z - a >= 16:
                found.append((a, z))
        at = data.find(PEM, at + 1)
    best: dict[int, int] = {}
    for a, z in found:
        best[a] = max(best.get(a, 0), z)
    out, last = [], 0
    for a in sorted(best):
        if best[a] > last:  # a span inside the one before it is no candidate of its own
            out.append((a, best[a]))
            last = best[a]
    return np.array(out, np.int64).reshape(-1, 2)


def _near(marks: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether one of the sorted marks (begin, end) begins at ``low`` or later and ends by ``high``."""
    at = np.searchsorted(marks[:, 0], low)
    ends = np.append(np.minimum.accumulate(marks[::-1, 1])[::-1], np.iinfo(np.int64).max)
    return ends[at] <= high


def describe(texts: list[str | None], paths: list[str | None], known: Ordinary) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(row, spans, values of FEATURES, tokens) of all candidates; spans are byte offsets in the row's text."""
    parts = [(t or "").encode() for t in texts]
    data = b"\0" * PAD + (b"\0" * PAD).join(parts) + b"\0" * PAD
    offset = PAD + np.cumsum([0, *(len(x) + PAD for x in parts)])[: len(parts)]
    low = data.lower()
    keys = _found(low, KEY_WORDS)
    spans = _spans(data, low, keys)
    if not len(spans):
        return np.zeros(0, np.int64), spans, np.zeros((0, len(FEATURES))), []
    begin, end = spans.T
    n = end - begin
    b = np.frombuffer(data, np.uint8)
    row = np.searchsorted(offset, begin, side="right") - 1

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[end] - total[begin]) / n

    digits, uppers, lowers = share((b >= 48) & (b <= 57)), share((b >= 65) & (b <= 90)), share((b >= 97) & (b <= 122))
    hexes = share(((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 70)) | ((b >= 97) & (b <= 102)))
    steps = np.concatenate([[0.0], np.cumsum(known.log[b[:-1], b[1:]])])
    first = np.concatenate([[0], np.cumsum(n)])
    flat = b[np.repeat(begin - first[:-1], n) + np.arange(first[-1])]
    entropy = np.zeros(len(n))
    for at in range(0, len(n), 4096):
        own = slice(at, min(at + 4096, len(n)))
        counts = np.bincount(np.repeat(np.arange(own.stop - at), n[own]) * 256 + flat[first[at] : first[own.stop]], minlength=(own.stop - at) * 256).reshape(-1, 256)
        p = counts / n[own][:, None]
        entropy[own] = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    folded = np.where((flat >= 65) & (flat <= 90), flat + 32, flat)
    before, quotes = b[begin - 1], np.isin(b, np.frombuffer(b"\"'`", np.uint8))
    at = begin - 1
    for _ in range(6):  # over quotes and blanks to what assigns
        at = np.where(quotes[at] | (b[at] == 32), at - 1, at)
    sentence = (before == 32) & (b[end] == 32) & (b[begin - 2] >= 97) & (b[begin - 2] <= 122) & (b[begin - 3] >= 97) & (b[begin - 3] <= 122)
    samples = _found(low, SAMPLE_WORDS)
    by_path = [(float(any(k in (p or "").lower() for k in SAMPLE_PATHS)), float((p or "").count("/"))) for p in paths]
    by_path = np.array(by_path).reshape(-1, 2)[row]
    values = np.stack(
        [
            n, digits, uppers, lowers, 1 - digits - uppers - lowers, entropy, np.where(n > 1, (steps[end - 1] - steps[begin]) / np.maximum(n - 1, 1), 0.0), known.covered(folded, first), hexes == 1,
            np.isin(b[at], np.frombuffer(b"=:", np.uint8)), quotes[begin - 1], _near(keys, begin - 40, begin), _near(samples, begin - 48, end + 48), by_path[:, 0], by_path[:, 1], sentence, b[end] == 64,
        ], 1,
    ).astype(np.float64)
    tokens = [data[a:z].decode("utf-8", "replace") for a, z in spans.tolist()]
    return row, spans - offset[row][:, None], np.round(values, 9), tokens


def _batch(id_: pa.Array, row, spans, values, tokens) -> list[pa.Array]:
    features = pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1) * len(FEATURES), pa.int32()), pa.array(values.ravel()))
    return [id_.take(pa.array(row)), pa.array(spans[:, 0], pa.int32()), pa.array(spans[:, 1], pa.int32()), pa.array(tokens, pa.string()), features]


def _scan(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            found = describe(batch.column("text").to_pylist(), batch.column("path").to_pylist(), known.value)
            yield pa.RecordBatch.from_arrays(_batch(batch.column("id"), *found), ["id", "begin", "end", "token", "features"])

    return run


#: Forms of key ids that are secrets wherever they stand.
KNOWN_IDS = re.compile(r"(AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36}$|xox[abp]-|eyJ[A-Za-z0-9_-]+\.")
#: Characters of made values.
HEX, B64, SIGNS, UPPER, LOWER = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "!@#$^&*_+-.?~", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz"
#: Kinds of made secrets (Slack, Google, SendGrid, storage account, Stripe) that a test leaves out of training and then looks for.
HELD_KINDS = (20, 21, 22, 23, 24)


def _values(rng: random.Random, words: list[str]) -> tuple[list[Callable[[], str]], list[Callable[[], str]]]:
    """Makers of secrets, and of what only looks like them; ``%`` marks the value in its wording."""
    some = lambda letters, a, z: "".join(rng.choice(letters) for _ in range(rng.randint(a, z)))
    word = lambda: rng.choice(words)
    lines = lambda n: "\n".join(some(B64, 64, 64) for _ in range(n))
    part = lambda n: base64.urlsafe_b64encode(rng.randbytes(n)).decode().rstrip("=")
    key = lambda: rng.choice(["token", "api_key", "secret", "access_key", "auth_token", "client_secret", "API_KEY", "apikey"])
    assign = lambda value: rng.choice([f'{key()} = "%{value}%"', f"{key()}=%{value}%", f"{key()}: %{value}%", f'"{key()}": "%{value}%"', f"export {key().upper()}='%{value}%'"])
    password = lambda: word().capitalize() + some(SIGNS, 1, 2) + some("0123456789", 1, 4) + some(B64[:62], 2, 6) + some(SIGNS, 0, 1)
    secrets = [
        lambda: assign(some(HEX, 24, 64)), lambda: assign(some(B64, 20, 60)), lambda: assign(some(B64[:62], 16, 48)), lambda: f"%AKIA{some(UPPER, 16, 16)}%", lambda: f"%ghp_{some(B64[:62], 36, 36)}%",
        lambda: f"Authorization: Bearer %eyJ{part(20)}.{part(40)}.{part(32)}%", lambda: f"%eyJ{part(20)}.{part(60)}.{part(32)}%", lambda: f"{rng.choice(['password', 'passwd', 'pwd', 'PASSWORD'])}{rng.choice([' = ', '=', ': '])}%{password()}%",
        lambda: f'{rng.choice(["password", "db_password", "pwd"])} = "%{password()}%"', lambda: f"postgres://{word()}:%{password().replace('@', '!').replace('/', '1')}%@{word()}.com/db", lambda: f"https://{word()}:%{some(HEX, 20, 40)}%@{word()}.org",
        lambda: f"%{some(LOWER, 2, 5)}{rng.choice(['_', '-', '_live_', '_prod_', '_v1_'])}{some(B64[:62], 20, 40)}%", lambda: f"-----BEGIN {rng.choice(['RSA ', 'EC ', '', 'OPENSSH '])}PRIVATE KEY-----\n%{lines(rng.randint(3, 24))}%\n-----END PRIVATE KEY-----",
        lambda: f"{rng.choice(['password', 'passwd', 'pwd'])} %{password()}%", lambda: f"{rng.choice(['password', 'passphrase'])} %{word()}{some('0123456789', 2, 4)}{some(LOWER, 1, 3)}%", lambda: f"{rng.choice(['SecretKey', 'sharedkey', 'storage_account_key'])}={'%'}{some(B64, 42, 86)}==%;", lambda: f"%{some(UPPER, 2, 4)}{some(B64[:62], 24, 36)}%",
        lambda: f"%{some(rng.choice([LOWER, UPPER]), 2, 5)}" + "".join(rng.choice(".-_") + some(rng.choice(["0123456789", B64[:62] + "_-", B64[:62]]), 10, 40) for _ in range(rng.randint(1, 2))) + f".{some(B64[:62], 18, 44)}%", lambda: f"%{some(LOWER, 2, 5)}-{some('0123456789', 8, 14)}-{some(B64[:62], 20, 40)}%",
        # the kinds of HELD_KINDS
        lambda: f"%xoxb-{some('0123456789', 11, 12)}-{some('0123456789', 11, 13)}-{some(B64[:62], 24, 24)}%", lambda: f"%AIza{some(B64[:62] + '_-', 35, 35)}%", lambda: f"%SG.{part(16)}.{part(32)}%", lambda: f"AccountName={word()};AccountKey=%{some(B64, 86, 86)}==%;EndpointSuffix=core", lambda: f"%sk_live_{some(B64[:62], 24, 24)}%",
    ]
    likes = [
        lambda: f"commit %{some(HEX, 40, 40)}%", lambda: f"sha256: %{some(HEX, 64, 64)}%", lambda: f"id %{some(HEX, 8, 8)}-{some(HEX, 4, 4)}-4{some(HEX, 3, 3)}-{some(HEX, 4, 4)}-{some(HEX, 12, 12)}%", lambda: f"{word()} %{'_'.join(word() for _ in range(4))}% {word()}",
        lambda: f'{key()} = "%your-{word()}-here%"', lambda: "password: %changeme%", lambda: f'password = "%{word()}%"', lambda: f"{key()} = %{rng.choice(['None', 'null', 'os.environ', 'get_token', 'self.token', 'request.headers'])}%", lambda: f"the token: %{word()}% {word()}",
        lambda: f"%{'/'.join(word() for _ in range(5))}%", lambda: f"% {some('0123456789', 12, 20)}%".replace("% ", "%"), lambda: f"%{''.join(word() for _ in range(4))}%", lambda: f"example {key()}=%{some(HEX, 32, 32)}%", lambda: f"data:image/png;base64,%{some(B64, 40, 120)}%",
        lambda: f"{rng.choice(['password', 'secret', 'token', 'auth'])} %{word()}{word()}% {word()}", lambda: f"the %{word()}-{word()}-{some('0123456789', 2, 4)}% {word()}", lambda: f"%{word()}_{word()}_{word()}{some('0123456789', 0, 3)}%", lambda: f"-----BEGIN PUBLIC KEY-----\n%{some(B64, 64, 64)}%\n-----END PUBLIC KEY-----",
        lambda: f"ssh-rsa %AAAAB3NzaC1yc2E{some(B64, 60, 120)}% {word()}", lambda: f"etag: %{some(HEX, 32, 32)}%", lambda: f"version %{some('0123456789', 1, 2)}.{some('0123456789', 1, 2)}.{some('0123456789', 8, 12)}%", lambda: f"%{word().capitalize()}{word().capitalize()}{word().capitalize()}{some('0123456789', 1, 3)}%",
    ]
    return secrets, likes


def _plant(known, words: list[str], copies: int):
    """Labelled candidates of texts with something planted: (held, label, kind, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            out = []
            for text, path in zip(batch.column("text").to_pylist(), batch.column("path").to_pylist(), strict=True):
                digest = hashlib.sha256((text or "").encode()).digest()
                rng = random.Random(digest)
                for copy in range(copies):
                    cut = [m.start() for m in re.finditer(r"(?<=\s)", text or "")] or [0]
                    at = rng.choice(cut)
                    secret = copy % 2 == 0
                    kind, make = rng.choice(list(enumerate(_values(rng, words)[0 if secret else 1])))
                    left, value, right = make().split("%")
                    before = (text or "")[:at] + left
                    begin = len(before.encode())
                    span = (begin, begin + len(value.encode()))
                    whole = before + value + right + rng.choice([" ", "\n", ", "]) + (text or "")[at:]
                    _, spans, values, tokens = describe([whole], [path], known.value)
                    # a candidate counts as the planted one if they share a character; of the text's own, those that may be secrets are left open
                    meets = (spans[:, 0] < span[1]) & (spans[:, 1] > span[0]) if len(spans) else np.zeros(0, bool)
                    placed = values[:, [FEATURES.index(x) for x in ("key_before", "assigned", "before_at")]].any(1)
                    for k in range(len(spans)):
                        if meets[k] or (copy == 0 and not placed[k] and not KNOWN_IDS.match(tokens[k])):
                            out.append((digest[0] < 64, int(meets[k] and secret), kind + 1 + (0 if secret else 100) if meets[k] else 0, values[k].tolist()))
            yield pa.RecordBatch.from_pylist([dict(zip(("held", "label", "kind", "features"), x, strict=True)) for x in out], schema=pa.schema([("held", pa.bool_()), ("label", pa.int32()), ("kind", pa.int32()), ("features", pa.list_(pa.float64()))]))

    return run


def planted(docs: DataFrame, known: Ordinary, sample_rows: int = 1500, copies: int = 8, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(held, label, kind, features): labelled findings from ``sample_rows`` distinct texts at most, each planted ``copies`` times.

    A quarter of the texts, by a hash, is held out.  ``kind`` tells made values apart (0: the text's own).  An empty table is
    planted in an empty text.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(text_col).isNotNull()).select(F.struct(F.col(text_col).alias("text"), F.col(path_col).cast("string").alias("path")).alias("one"))
    few = sample_by_hash(rows, "one", sample_rows).select("one.text", "one.path")
    words = sorted(w.decode("utf-8", "ignore") for w in known.pieces if len(w) >= 4)[:2000] or ["word", "other", "river", "stone"]
    return few.mapInArrow(_plant(spark.sparkContext.broadcast(known), words, copies), "held boolean, label int, kind int, features array<double>")


def candidates(docs: DataFrame, known: Ordinary, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, begin, end, token, features): every candidate of every whole text, with byte offsets of its UTF-8."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(path_col).cast("string").alias("path"))
    return rows.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(known)), "id long, begin int, end int, token string, features array<double>")


def _vectors(rows: DataFrame) -> DataFrame:
    wide = rows.select("*", *(F.get("features", i).alias(f"f_{name}") for i, name in enumerate(FEATURES)))
    return VectorAssembler(inputCols=[f"f_{name}" for name in FEATURES], outputCol="vector").transform(wide).drop(*(f"f_{name}" for name in FEATURES))


def train(labelled: DataFrame, max_rows: int = 10000, trees: int = 40, depth: int = 10, seed: int = 5) -> RandomForestClassificationModel | None:
    """A forest over ``labelled`` (features, label 0/1): at most ``max_rows`` rows, half of each label, by a hash; ties are rows alike.

    Both labels weigh alike, however many rows they have.  None without findings of both labels.
    """
    order = F.xxhash64("features")
    picks = [labelled.where(F.col("label") == y).orderBy(order).limit(max_rows // 2) for y in (0, 1)]
    sample = written(picks[0].unionByName(picks[1]).select("features", F.col("label").cast("double").alias("label")), "secret-sample")
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    sample = sample.withColumn("weight", F.when(F.col("label") == 1, counts[0.0] / counts[1.0]).otherwise(1.0))
    return RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed).fit(_vectors(sample.coalesce(1).sortWithinPartitions(order)))


def probabilities(rows: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """``rows`` (features, ...) with ``score``; rows alike get equal scores."""
    return model.transform(_vectors(rows)).withColumn("score", F.round(F.get(vector_to_array("probability"), 1), 9)).drop("vector", "rawPrediction", "probability", "prediction")


def evaluate(labelled: DataFrame, model: RandomForestClassificationModel) -> dict[str, float]:
    """Precision and recall of ``score >= 0.5`` on ``labelled`` (features, label)."""
    rows = probabilities(labelled, model).select("label", (F.col("score") >= 0.5).alias("said"))
    r = rows.agg(F.count_if((F.col("label") == 1) & F.col("said")).alias("hit"), F.count_if("said").alias("said"), F.count_if(F.col("label") == 1).alias("there")).first()
    return {"precision": r["hit"] / max(1, r["said"]), "recall": r["hit"] / max(1, r["there"])}


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", **how) -> DataFrame:
    """(doc_id, begin, end, token_sha256, length, score, secret): every candidate, with the forest's probability.

    ``findings`` (id, begin, label) are labelled candidates; without them secrets and look-alikes are ``planted``.  ``secret`` is
    1 where the score is 0.5 or more.  Without labels of both kinds every candidate stays a secret
    with a null score.  Null and empty texts have no candidates; null ids pass through; repeated rows repeat
    their candidates; an empty table gives an empty result.  Other columns are ignored.
    """
    known = learn_ordinary(docs, text_col=text_col)
    found = written(candidates(docs, known, id_col, text_col, path_col), "secret-candidates")
    if findings is None:
        labelled = written(planted(docs, known, text_col=text_col, path_col=path_col), "secret-planted").where("not held")
    else:
        marks = findings.select(F.col(findings.columns[0]).alias("k_id"), F.col(findings.columns[1]).alias("k_begin"), F.col("label"))
        labelled = found.join(marks, (F.col("id") == F.col("k_id")) & (F.col("begin") == F.col("k_begin"))).where(F.col("label").isin(0, 1))
    model = train(labelled.select("features", "label"), **how)
    scored = found.withColumn("score", F.lit(None).cast("double")) if model is None else probabilities(found, model)
    return scored.select(F.col("id").alias(id_col), "begin", "end", F.sha2("token", 256).alias("token_sha256"), F.length("token").alias("length"), "score", F.coalesce((F.col("score") >= 0.5).cast("int"), F.lit(1)).alias("secret"))
