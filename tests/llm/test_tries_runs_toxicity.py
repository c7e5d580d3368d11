"""Conversation trie, periodic runs and toxicity, against brute force and held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from tidewater.llm import conversation_trie, periodic_runs, queries, scans, toxicity
from tidewater.llm.words import Words

# conversation trie


def trie_by_hand(rebuilt):
    """Rows of the trie of {conversation: [(role, text), ...]}."""
    members: dict = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) > len(x) for y in below)]
        saved = sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below)
        ends = ",".join(str(c) for c in sorted(c for c in own if len(rebuilt[c]) == len(node)))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def in_order(rows):
    """{conversation: turns} of (conv_id, turn, role, text): null turns first, then by turn and role; ids that are null are left out."""
    out: dict = {}
    for c, t, r, x in rows:
        if c is not None:
            out.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(own)] for c, own in out.items()}


def rebuilt_by_hand(rows):
    turns = in_order(rows)
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    return out


TURNS = "conv_id long, turn long, role string, text string, conv int, pos string, depth double"


def turns_of(spark, rows):
    """Turns with columns beside them whose names the operator uses itself."""
    return spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], TURNS)


def nodes(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def plain(spark, rows):
    turns = conversation_trie.turns_in_order(turns_of(spark, rows))
    convs = spark.createDataFrame([(c,) for c in {r[0] for r in rows} - {None}], "conv long")
    return conversation_trie.trie(turns, convs)


def test_trie_by_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(0, 7) if c % 11 else 0):
            rows.append((c, None if t == 0 and c % 5 == 0 else t, rng.choice(["user", None]), rng.choice(["a", "b", "", None, "é😀"])))
    rows += [(70, 0, "user", "a"), (71, 0, "user", "a"), (71, 0, "user", "a"), (None, 0, "user", "lost")]
    want = trie_by_hand(in_order(rows))
    assert nodes(plain(spark, rows)) == want


def test_chains_on_chains(spark):
    """Every conversation leaves the one before it at its last turn but one, so the tree of chains is as high as it has chains."""
    rows = [(c, t, "u", f"t{t}" if t < c else f"end{c}") for c in range(20) for t in range(c + 1)]
    assert nodes(plain(spark, rows)) == trie_by_hand(in_order(rows))


def test_a_conversation_of_many_turns(spark, monkeypatch):
    """One conversation with most of the rows, in blocks of 16 turns; equal ones end at its nodes."""
    monkeypatch.setattr(scans, "BLOCK", 16)
    rng = random.Random(4)
    long = [rng.choice("ab") for _ in range(700)]
    rows = [(0, t, "u", x) for t, x in enumerate(long)] + [(1, t, "u", x) for t, x in enumerate(long[:300])] + [(2, t, "u", x) for t, x in enumerate(long[:300] + ["c"])] + [(3, t, "u", x) for t, x in enumerate(long)]
    got = nodes(plain(spark, rows))
    n = 701 + 1  # all prefixes of the longest, and one more turn
    assert len(got) == n
    by = {(r[0], r[1]): r for r in got}
    assert by[(0, 0)][3:7] == (4, 1, 2, sum(3 if t < 300 else 1 for t in range(700)))
    assert by[(0, 300)][3:6] == (4, 2, 2) and by[(2, 301)][2:7] == (0, 1, 0, 1, 0)
    assert by[(0, 300)][7] == hashlib.sha256(b"1").hexdigest() and by[(0, 700)][7] == hashlib.sha256(b"0,3").hexdigest()


def test_nothing_to_put_in_a_trie(spark):
    assert nodes(plain(spark, [])) == []
    empty = conversation_trie.trie(conversation_trie.turns_in_order(turns_of(spark, [])), spark.createDataFrame([(5,), (7,)], "conv long"))
    assert nodes(empty) == [(5, 0, None, 2, 0, 1, 0, hashlib.sha256(b"5,7").hexdigest())]


def test_the_query_rebuilds_conversations(spark, tmp_path):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["u", "a"]), rng.choice("abc")) for c in [*range(0, 8), *range(100, 109), *range(203, 209), 300] for t in range(rng.randrange(1, 9))]
    turns_of(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert nodes(queries.op11_conversation_trie(spark, str(tmp_path))) == trie_by_hand(rebuilt_by_hand(rows))


def test_ends_of_more_than_a_piece(spark):
    ids = [3, 5000, 4096, 100_000, 4095, 7]
    got = conversation_trie.ends(spark.createDataFrame([(1, 2, i) for i in ids] + [(4, 0, 9)], "conv long, depth long, member long")).collect()
    want = {(1, 2): ",".join(map(str, sorted(ids))), (4, 0): "9"}
    assert {(r["e_conv"], r["e_depth"]): r["ends_sha256"] for r in got} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


# periodic runs


def runs_by_hand(words, shortest):
    found: dict = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(i + 1, j + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


@hyp(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=4), st.sampled_from([2, 5, 12]))
def test_runs_by_brute_force(texts, shortest):
    got = periodic_runs.runs_of(Words(pa.array([" ".join(t) for t in texts])), shortest)
    assert got == [runs_by_hand(list(t), shortest) for t in texts]


def test_runs_of_strings_with_many():
    """Fibonacci words, which have the most runs, a word repeated for long, and both in one batch."""
    a, b = "a", "ab"
    for _ in range(11):
        a, b = b, b + a
    texts = [b, "a" * 500, ("ab" * 40 + "c") * 6, ""]
    got = periodic_runs.runs_of(Words(pa.array([" ".join(t) for t in texts])), 12)
    assert got == [runs_by_hand(list(t), 12) for t in texts] and len(got[0]) > 20 and got[1] == [(0, 500, 1)]


def test_runs_on_odd_rows(spark):
    rows = [(1, "x y " * 10, 5, "r"), (1, "x y " * 10, 5, "r"), (None, "one two", 5, "r"), (2, None, 5, "r"), (3, "", 5, "r"), (4, " \t\n", 5, "r"), (5, "lead " + "w " * 50_000, 5, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, runs string")
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.find_runs(docs).collect()), key=str)
    want = [(1, [(0, 20, 2)], "x y"), (1, [(0, 20, 2)], "x y"), (None, [], "one two"), (2, [], ""), (3, [], ""), (4, [], ""), (5, [(1, 50_000, 1)], "lead w")]
    assert got == sorted(want, key=str)
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_query_of_runs_by_brute_force(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(words) > 800:
            continue
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_by_hand(words, 12)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        r = got[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *top, 1000 * top[1] // top[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()


# toxicity


def toxic_rows(n, seed):
    """Texts of four languages, of which a quarter hold a bad word or one of many forms of a bad stem."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(toxicity.FUNCTION_WORDS))
        common = toxicity.FUNCTION_WORDS[lang].split()
        words = [rng.choice(common) if rng.random() < 0.4 else rng.choice(made) for _ in range(rng.randint(20, 200))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            bad = "zorgling" if rng.random() < 0.5 else "quexar" + "".join(rng.choice(letters) for _ in range(3))
            words.insert(rng.randrange(len(words)), bad)
        rows.append((i, " ".join(words).capitalize(), toxic))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows(1500, 1)
    docs = spark.createDataFrame([(i, t, "x", 3.0) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    got = toxicity.score(docs, model).withColumn("held", toxicity.held_out()).join(labels, "doc_id").where("held").collect()
    hit = [(r["score"] >= 0.5) == (r["toxic"] == 1) for r in got]
    assert np.mean(hit) >= 0.97 and len(got) > 200
    # long texts in pieces say what their worst piece says
    clean = " ".join(t for _, t, y in rows if not y)
    long = [clean, clean + " zorgling " + clean]
    one = [toxicity._odds(model, toxicity._ids(w := Words(pa.array([t]), lower=True)), w.first)[0] for t in long]
    assert one[1] >= one[0]


def test_toxicity_learns_from_all_rows(spark, monkeypatch):
    """A sample of 60 rows knows few of the words that mark the label; all rows do."""
    rows = toxic_rows(1500, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    seen = []
    calibrated = toxicity.calibrated
    monkeypatch.setattr(toxicity, "calibrated", lambda odds, label, n, speaks: seen.append(n.sum()) or calibrated(odds, label, n, speaks))
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()), max_rows=60)
    again = toxicity.fit(docs, labels.where(~toxicity.held_out()), max_rows=60)
    assert np.array_equal(model.embeddings, again.embeddings) or np.allclose(model.embeddings, again.embeddings, atol=1e-4)
    assert seen[0] == labels.where(~toxicity.held_out()).where("pmod(xxhash64(doc_id), 4) = 3").count()
    words = Words(pa.array([t for i, t, _ in rows]), lower=True)
    places = toxicity._ids(words)[:, 0]
    often = [p for p, n in zip(*np.unique(places, return_counts=True), strict=True) if n > 50]
    assert model.embeddings[often].any(1).all()


def test_pieces_change_nothing(monkeypatch):
    rng = np.random.RandomState(2)
    model = toxicity.Model(rng.rand(1 << toxicity.BITS, 4).astype(np.float32) - 0.5, [rng.rand(w, 4, 3).astype(np.float32) - 0.5 for w in toxicity.WIDTHS], rng.rand(9).astype(np.float32), rng.rand(9), 0.1, 1.0, np.zeros(toxicity.OTHER + 1))
    words = Words(pa.array(["a b c d e f g", "", "x", None, "long " * 50, "y z"]), lower=True)
    ids = toxicity._ids(words)
    whole = toxicity._odds(model, ids, words.first)
    monkeypatch.setattr(toxicity, "PIECE", 3)
    assert np.allclose(toxicity._odds(model, ids, words.first), whole, atol=1e-5)
    alone = [toxicity._odds(model, toxicity._ids(w := Words(pa.array([t]), lower=True)), w.first)[0] for t in ("a b c d e f g", "x", "y z")]
    assert np.allclose(alone, whole[[0, 2, 5]], atol=1e-5)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "word", 1), (1, "word", 1), (3, "long " * 30_000, 1)], "doc_id long, body string, text int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none, text_col="body")
    got = toxicity.score(docs, model, text_col="body")
    assert got.columns == ["doc_id", "body", "text", "score"] and {r["score"] for r in got.collect()} == {0.5} and got.count() == 5
    assert toxicity.score(docs.limit(0), model, text_col="body").count() == 0
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, 7), (None, 1), (3, None), (9, 1)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, toxicity.fit(docs, odd, text_col="body"), text_col="body").collect())


def test_languages_by_function_words():
    texts = ["The cat and the dog", "der Hund und die Katze", "el perro y los gatos", "le chien et les chats", "xyz", ""]
    names = [*sorted(toxicity.FUNCTION_WORDS), "other"]
    assert [names[k] for k in toxicity.languages(Words(pa.array(texts), lower=True))] == ["en", "de", "es", "fr", "other", "other"]


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_toxicity", "op13_periodic_runs"])
def test_columns_of_the_contract(spark, sf_dir, name):
    want = {
        "op11_conversation_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
        "op12_toxicity": {"doc_id", "held_out", "score", "predicted"},
        "op13_periodic_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    }
    df = queries.QUERIES[name](spark, sf_dir)
    assert want[name] <= set(df.columns)
    if name == "op12_toxicity":
        assert df.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
        assert df.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)).count() == 0
