"""Substring dedup, the Jaccard join, decontamination and components against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidewater.llm import decontamination, jaccard_join
from tidewater.llm.components import stars
from tidewater.llm.substring_dedup import levels, remove_repeats
from tidewater.llm.words import Words, windows

SCHEMA = "doc_id long, text string, size int, c1 string, id string"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def rows_of(spark, texts):
    """Rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in texts], SCHEMA)


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7)))
    prose = lambda n: [word() for _ in range(n)]
    passage, base = prose(60), prose(150)
    out = [(i, " ".join(prose(rng.randint(1, 80)))) for i in range(30)]
    out += [(100 + i, " ".join(prose(20) + passage[: rng.randint(30, 60)] + prose(20))) for i in range(12)]
    for i in range(25):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = word()
        out.append((200 + i, " ".join(own)))
    out += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "ONE"), (305, "one two"), (306, "a" * 5000), (307, " ".join(["la"] * 3000)), (None, " ".join(base))]
    out += [(310, " ".join(passage))] * 2 + [(311, "Éa é" * 3 + "\u3000x")]
    return out


def repeats_by_hand(texts, length):
    words = [split(t) for _, t in texts]
    count = collections.Counter(tuple(w[j : j + length]) for w in words for j in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(texts, words, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            if count[tuple(w[j : j + length])] > 1:
                gone[j : j + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def sort(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("length", [35, 20, 70])
def test_repeats(spark, length):
    texts = corpus()
    found = [tuple(r)[:4] for r in remove_repeats(rows_of(spark, texts), length).collect()]
    assert sort(found) == sort(repeats_by_hand(texts, length))


def test_levels():
    assert levels(35) == [18, 35] and levels(100) == [25, 50, 100] and levels(10) == [10]


def test_empty_tables(spark):
    none = rows_of(spark, [])
    assert remove_repeats(none).count() == 0
    assert jaccard_join.components(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_items(none, items).count() == 0
    assert decontamination.find_items(rows_of(spark, corpus()), items).count() == 0
    assert stars(spark.createDataFrame([], "a long, b long")).count() == 0


def groups_by_hand(texts, percent=80):
    sets = []
    for _, t in texts:
        w = split((t or "").translate(ASCII))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            m = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * m >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(texts):
        ids = [texts[b][0] for b in range(len(texts)) if find(b) == find(a) and texts[b][0] is not None]
        out.append((i, len(sets[a]), min(ids) if ids else None))
    return out


@pytest.mark.parametrize("percent", [80, 90])
def test_components(spark, percent):
    texts = corpus(2)
    found = [tuple(r) for r in jaccard_join.components(rows_of(spark, texts), percent=percent).collect()]
    assert sort(found) == sort(groups_by_hand(texts, percent))


def test_links_that_the_first_comparison_misses(spark):
    """A chain: each document is near the next alone, so the hub of an n-gram links few of its documents."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    texts = [(i, " ".join(words[i * 6 : i * 6 + 120])) for i in range(40)] + [(100 + i, " ".join(rng.sample(words, 60))) for i in range(20)]
    found = [tuple(r) for r in jaccard_join.components(rows_of(spark, texts)).collect()]
    assert sort(found) == sort(groups_by_hand(texts))
    assert len({c for i, _, c in found if i < 40}) == 1


def test_blocks_of_a_crowded_ngram(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    texts = corpus(3)
    found = [tuple(r) for r in jaccard_join.components(rows_of(spark, texts)).collect()]
    assert sort(found) == sort(groups_by_hand(texts))


def test_keep_one(spark):
    texts = corpus(4) + [(9, "two unlike documents share one id here a"), (9, "nothing in common with that other one b"), (None, None), (None, ""), (None, " ".join(["la"] * 30)), (None, " ".join(["la"] * 30))]
    texts += [(3, "the same words stand in rows three and five"), (5, "the same words stand in rows three and five"), (5, "the same words stand in rows three and five"), (5, "another text of row five it is")]
    docs = spark.createDataFrame([(i, t, n, "x", "y", 1) for n, (i, t) in enumerate(texts)], "doc_id long, text string, id long, text_key string, wordless string, c int").repartition(5)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    found = [r["id"] for r in kept.collect()]
    assert len(found) == len(set(found))
    groups = groups_by_hand([(n, t) for n, (_, t) in enumerate(texts)])
    want: dict = {}
    for n, size, c in groups:
        want.setdefault(c if size else ("alone", n), []).append(n)
    for members in want.values():
        stays = [n for n in found if n in members]
        ids = [texts[n][0] for n in members if texts[n][0] is not None]
        assert len(stays) == 1 and texts[stays[0]][0] == (min(ids) if ids else None)


def test_many_rows_without_ids(spark):
    """Rows without ids meet their own class alone, and a text by the hundreds is compared once."""
    rng = random.Random(6)
    base = [rng.choice("abcdefghijkl") * 3 + str(k) for k in range(60)]
    texts = [(None, " ".join(base))] * 300 + [(None, " ".join(base[:-2] + [f"x{i}"])) for i in range(20)] + [(None, " ".join(rng.sample(base, 30))) for _ in range(30)] + [(7, " ".join(base))] * 40
    found = [tuple(r) for r in jaccard_join.components(rows_of(spark, texts)).collect()]
    assert sort(found) == sort(groups_by_hand(texts))


def test_stars(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)] + [(None, 1), (7, 7)]
    found = {r["a"]: r["b"] for r in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert found == {x: find(x) for x in parent if find(x) != x}


def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7)))
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 60)))) for k in range(60)] + [(60, None), (61, ""), (62, "gggg zz")]
    texts, want, close = [(900, None), (901, ""), (902, "clean " * 50), (903, " ".join(items[0][1].split()[:6]))], set(), []
    for k in range(60):
        w = items[k][1].split()
        texts.append((k, " ".join([word() for _ in range(30)] + w + [word()]).upper()))
        want.add((k, k))
        own = list(w)
        for _ in range(int(0.1 * len(w))):
            own[rng.randrange(len(own))] = "zzz"
        texts.append((1000 + k, " ".join([word()] * 3 + own)))
        close.append((1000 + k, k))
    texts.append((None, items[5][1]))
    found = decontamination.find_items(rows_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert want <= pairs and (None, 5) in pairs
    assert all(r["edits"] == 0 and r["end"] - r["begin"] == r["item_words"] for r in found if r["doc_id"] in range(60))
    assert np.mean([p in pairs for p in close]) >= 0.95
    assert pairs <= want | set(close) | {(None, 5)}
    docs = rows_of(spark, texts)
    clean = decontamination.remove_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in texts if i is not None} - {d for d, _ in pairs}
    blocks = decontamination.find_items(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=2000)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == pairs


def spoilt(rng, words, n):
    """``words`` after n random edits."""
    out = list(words)
    for _ in range(n):
        kind, j = rng.choice("rip"), rng.randrange(len(out))
        if kind == "r":
            out[j] = f"new{rng.randrange(10**6)}"
        elif kind == "p":
            out.insert(j, f"put{rng.randrange(10**6)}")
        elif len(out) > 1:
            del out[j]
    return out


@pytest.mark.parametrize("length", [1, 3, 4, 5, 6, 7, 9, 10, 14, 15, 16, 20, 33, 60])
def test_recall_at_every_length(length):
    """Exact copies are all found; with all the edits an item may have, 95 in 100 or more."""
    rng, n = random.Random(length), 200
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(length)] for _ in range(n)]
    block = decontamination.Items(pa.array(range(n)), pa.array([" ".join(x) for x in items]), 0.8, 0.95)
    around = lambda x: " ".join([word() for _ in range(9)] + x + [word() for _ in range(9)])
    exact = block.hits(pa.array([around(x) for x in items]))
    assert all(exact[i, i][0] == 0 for i in range(n))
    close = block.hits(pa.array([around(spoilt(rng, x, int(0.2 * length + 1e-9))) for x in items]))
    assert np.mean([(i, i) in close for i in range(n)]) >= 0.95


def test_decontamination_by_brute_force(spark):
    """Every item against every piece of every text: nothing found is wrong, and 95 in 100 of what is there are found."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 2, 4, 5, 8, 12, 16, 25])))) for k in range(30)] + [(99, None), (98, " ")]
    texts = []
    for i in range(60):
        own = items[i % 30][1].split()
        texts.append((i, " ".join(rng.choices(words, k=10) + spoilt(rng, own, rng.randint(0, len(own) // 5)) + rng.choices(words, k=10))))
    texts += [(100, None), (101, ""), (None, items[3][1]), (7, texts[7][1])]
    want: dict = {}
    for row, (_, t) in enumerate(texts):
        have = split(t)
        for k, item in items:
            own = split(item)
            best = min((edits(own, have[i:j]) for i in range(len(have)) for j in range(i, min(len(have), i + len(own) + 6) + 1)), default=99) if own else 99
            if best <= int(0.2 * len(own) + 1e-9):
                want[row, k] = best
    docs = rows_of(spark, texts).withColumn("item_id", F.lit("a")).withColumn("edits", F.lit(0))
    found = decontamination.find_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    by_doc = collections.Counter((texts[row][0], k, e) for (row, k), e in want.items())
    got = collections.Counter((r["doc_id"], r["item_id"], r["edits"]) for r in found)
    assert not {(i, k) for i, k, _ in got} - {(i, k) for i, k, _ in by_doc}
    assert sum((got & by_doc).values()) >= 0.95 * sum(by_doc.values())
    assert all(got[x] == n for x, n in by_doc.items() if x[2] == 0)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=7), st.lists(st.integers(0, 3), max_size=9))
def test_edit_ends(item, window):
    ends = decontamination.edit_ends(np.array(item, np.int64), np.array(window, np.int64))
    assert ends.tolist() == [min(edits(item, window[i:j]) for i in range(j + 1)) for j in range(len(window) + 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB é\n\t\x0b\x1c\u3000", max_size=12)), max_size=6))
def test_words(texts):
    words = Words(pa.array(texts, pa.string()))
    expected = [split(t) for t in texts]
    assert words.counts().tolist() == [len(w) for w in expected]
    flat = [w for ws in expected for w in ws]
    assert [words.data[a:z].tobytes().decode() for a, z in zip(words.begin, words.end, strict=True)] == flat
    assert len(set(words.hashes.tolist())) == len(set(flat))


def test_windows_depend_on_their_words_alone():
    words = Words(pa.array(["a b c d e f g h", "x b c d e f g y", "w" * 200 + " " + "w" * 201]))
    h = windows(words.hashes, 6)
    assert h[1] == h[9] and h[0] != h[1] and words.hashes[-1] != words.hashes[-2]
