"""The prefix trie of conversations.

Every distinct sequence of first turns is a node, and the smallest conversation that starts with it owns it.  A
conversation that owns a node owns all that it passes below, so what it owns is a chain, from its first owned depth down
to its end.  That depth is found by binary search: each round probes one depth of every conversation that is still in
question, all in one batched join against the minima of the digests at the depths that the round can ask for.  The
depth just above the chain belongs to another chain, on which this one stands, so that chains form the tree.

Sums over subtrees go bottom-up over chains: a chain hands its sum to the chain 1, 2, 4, ... steps above it, so that a
tree of any height takes as many rounds as its height has binary digits; inside a chain they are running sums.
A digest is a sum of hashes of (place, turn), 128 bits, so that it is a running sum, too: no conversation, chain or
group of equal conversations is ever gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scans import BLOCK, numbered, running
from .shared import delete, own_jobs, scratch_path, written

_MASK = (1 << 32) - 1


def turns_in_order(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, k1, k2, chars): turns numbered from 1 in each conversation, with a 128-bit key of role and text and the text's code points.

    A null turn comes first; equal turn numbers go by role, then by the text's hash; repeated rows are turns of their own.  A null role
    or text counts as empty.  Rows without a conversation's id belong to none and are left out.  Other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = rows.select("conv", "turn", "role", F.xxhash64("digest").alias("k1"), F.xxhash64(F.lit(1), "digest").alias("k2"), "chars")
    return numbered(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("k1"), F.col("k2")], "trie-turns").select("conv", "pos", "k1", "k2", "chars")


def borrow_heads(turns: DataFrame, convs: DataFrame, most: int) -> DataFrame:
    """``turns`` after each conversation has given its first ``h`` turns for the first ``h`` turns of the conversation ``base``.

    ``convs`` has (conv, base, h), h at most ``most``; a base with fewer turns lends all it has, and one that is absent none.
    """
    heads = turns.where(F.col("pos") <= most).join(convs.select(F.col("base").alias("conv")).distinct(), "conv", "left_semi")
    heads = written(heads.withColumnRenamed("conv", "base"), "trie-heads")
    lent = convs.join(heads, "base").where("pos <= h").select("conv", "pos", "k1", "k2", "chars")
    have = heads.groupBy("base").agg(F.max("pos").alias("have"))
    shift = written(convs.join(have, "base", "left").select(F.col("conv").alias("id"), "h", (F.least("h", F.coalesce("have", F.lit(0))) - F.col("h")).alias("shift")), "trie-shifts")
    own = turns.join(shift, F.col("conv") == F.col("id")).where("pos > h").select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "k1", "k2", "chars")
    return lent.unionByName(own)


def _prefixes(turns: DataFrame, longest: int) -> tuple[DataFrame, str]:
    """(conv, pos, a, b, chars, step), written by ``step``, the lowest set bit of ``pos``: what one round of the search probes."""
    a, b = F.xxhash64("pos", "k1", "k2"), F.xxhash64("k2", "pos", "k1")
    lanes = turns.select("conv", "pos", "chars", *(part.alias(f"{name}{i}") for name, x in (("a", a), ("b", b)) for i, part in enumerate((F.shiftrightunsigned(x, 32), x.bitwiseAND(_MASK)))))
    sums = running(lanes, "conv", "pos", ["a0", "a1", "b0", "b1"], longest)
    whole = {c: F.shiftleft((F.col(f"{c}0") + F.shiftrightunsigned(f"{c}1", 32)).bitwiseAND(_MASK), 32).bitwiseOR(F.col(f"{c}1").bitwiseAND(_MASK)).alias(c) for c in "ab"}
    out = sums.select("conv", "pos", whole["a"], whole["b"], "chars", F.col("pos").bitwiseAND(-F.col("pos")).alias("step"))
    path = scratch_path(turns.sparkSession, "trie-prefixes")
    with own_jobs(turns.sparkSession):
        out.write.partitionBy("step").parquet(path)
    return turns.sparkSession.read.schema("conv long, pos long, a long, b long, chars long, step long").parquet(path), path


def _first_owned(prefixes: DataFrame, convs: DataFrame, root: int, longest: int) -> DataFrame:
    """(conv, len, pos, owner): the deepest depth ``pos`` of each conversation that another one, ``owner``, owns; 0 is the root."""
    state = written(convs.select("conv", "len", F.lit(0).cast("long").alias("pos"), F.lit(root).cast("long").alias("owner")), "trie-state")
    for step in (1 << k for k in reversed(range(longest.bit_length()))):
        level = prefixes.where(F.col("step") == step)
        minima = level.groupBy("pos", "a", "b").agg(F.min("conv").alias("least"), F.max("conv").alias("last")).where("least <> last")
        minima = written(minima.select(F.col("pos").alias("m_pos"), F.col("a").alias("m_a"), F.col("b").alias("m_b"), "least"), "trie-minima")
        at = F.col("pos") + step
        asked = state.where(at <= F.col("len")).select(F.col("conv").alias("c"), at.alias("p"))
        probes = level.join(asked, (F.col("conv") == F.col("c")) & (F.col("pos") == F.col("p"))).select("conv", "pos", "a", "b")
        probes = probes.join(minima, (F.col("pos") == F.col("m_pos")) & (F.col("a") == F.col("m_a")) & (F.col("b") == F.col("m_b"))).where("least < conv")
        moved = probes.select(F.col("conv").alias("c"), F.col("pos").alias("to"), "least")
        joined = state.join(moved, F.col("conv") == F.col("c"), "left")
        state = written(joined.select("conv", "len", F.coalesce("to", "pos").alias("pos"), F.coalesce("least", "owner").alias("owner")), "trie-state")
    return state


def _over_subtrees(chains: DataFrame, columns: list[str]) -> DataFrame:
    """(conv, up, up_at, columns): each of ``columns`` summed over the chain and all chains that stand on it, directly or not."""
    sums = written(chains.select("conv", "up", "up_at", F.col("up").alias("far"), *columns), "trie-sums")
    while not (going := sums.where("far is not null")).isEmpty():
        got = going.groupBy(F.col("far").alias("to")).agg(*(F.sum(c).alias(f"more_{c}") for c in columns))
        hops = going.select(F.col("conv").alias("c"), F.col("far").alias("via")).join(sums.select(F.col("conv").alias("v"), F.col("far").alias("next")), F.col("via") == F.col("v")).select("c", "next")
        joined = sums.join(got, F.col("conv") == F.col("to"), "left").join(hops, F.col("conv") == F.col("c"), "left")
        sums = written(joined.select("conv", "up", "up_at", F.col("next").alias("far"), *((F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x) for x in columns)), "trie-sums")
    return sums.drop("far")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, which come in order; one state is held at a time."""
    key, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], ["e_conv", "e_depth", "ends_sha256"])

    for batch in batches:
        out = []
        for conv, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("conv", "depth", "piece")), strict=True):
            if (conv, depth) != key:
                if key is not None:
                    out.append(done())
                key, state = (conv, depth), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield from out
    if key is not None:
        yield done()


def ends(members: DataFrame) -> DataFrame:
    """(e_conv, e_depth, ends_sha256) of (conv, depth, member): the digest of each node's members, ascending, joined by commas.

    Members, which are distinct, are joined in pieces of 4096 ids at most; the pieces go through the digest one after the
    other, since SHA-256 can only be taken in order.
    """
    pieces = members.groupBy("conv", "depth", F.floor(F.col("member") / 4096).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda x: x.cast("string")), ",").alias("piece"))
    pieces = pieces.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "block").select("conv", "depth", "piece")
    return pieces.mapInArrow(_digests, "e_conv long, e_depth long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``turns`` (conv, pos, k1, k2, chars), as ``turns_in_order`` gives them.

    ``convs`` (conv) names all conversations once, those without turns as well, which end at the root.  Returns ``conv_id`` (the
    smallest member, which with ``depth`` names the node), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (code points that need not be held or computed again, over the subtree) and ``ends_sha256``.
    Without conversations there are no nodes.
    """
    turns = written(turns, "trie-sequences")
    bounds = convs.agg(F.min("conv").alias("root")).crossJoin(turns.agg(F.max("pos").alias("longest"))).first()  # one row each
    root, longest = bounds["root"] if bounds["root"] is not None else 0, bounds["longest"] or 0
    prefixes, path = _prefixes(turns, longest)
    lengths = turns.groupBy(F.col("conv").alias("c")).agg(F.max("pos").alias("n"))
    state = _first_owned(prefixes, convs.join(lengths, F.col("conv") == F.col("c"), "left").select("conv", F.coalesce("n", F.lit(0)).cast("long").alias("len")), root, longest)

    is_root = F.col("conv") == root
    chains = state.where((F.col("pos") < F.col("len")) | is_root).select("conv", "len", F.when(is_root, 0).otherwise(F.col("pos") + 1).alias("first"), F.when(~is_root, F.col("owner")).alias("up"), F.when(~is_root, F.col("pos")).alias("up_at"))
    twins = state.where((F.col("pos") == F.col("len")) & ~is_root).select(F.col("owner").alias("conv"), F.col("pos").alias("depth"), F.col("conv").alias("member"))

    # what each chain holds itself: the ends, and a leaf where nothing stands on its last node
    twin_ends = twins.groupBy(F.col("conv").alias("t_conv")).agg(F.count("*").alias("twin_ends"))
    topped = chains.where("up is not null").select(F.col("up").alias("u_conv"), F.col("up_at").alias("u_len")).distinct()
    own = chains.join(twin_ends, F.col("conv") == F.col("t_conv"), "left").join(topped, (F.col("conv") == F.col("u_conv")) & (F.col("len") == F.col("u_len")), "left")
    own = own.select("conv", "up", "up_at", (1 + F.coalesce("twin_ends", F.lit(0))).alias("members"), F.col("u_conv").isNull().cast("long").alias("leaves"))
    totals = _over_subtrees(own, ["members", "leaves"])

    # what stands on single nodes
    standing = totals.where("up is not null").select(F.col("up").alias("on"), F.col("up_at").alias("at"), F.lit(1).cast("long").alias("branches"), "members", "leaves")
    standing = standing.unionByName(twins.select(F.col("conv").alias("on"), F.col("depth").alias("at"), F.lit(0).cast("long").alias("branches"), F.lit(1).cast("long").alias("members"), F.lit(0).cast("long").alias("leaves")))
    standing = written(standing.groupBy("on", "at").agg(*(F.sum(c).alias(c) for c in ("branches", "members", "leaves"))), "trie-standing")
    spine = chains.select(F.col("conv").alias("c"), "len", "first", "up")
    nodes = prefixes.select("conv", F.col("pos").alias("depth"), "chars").join(spine, F.col("conv") == F.col("c")).where("depth >= first").drop("c")
    nodes = nodes.unionByName(chains.where("up is null").select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "len", "first", "up"))
    nodes = nodes.join(standing, (F.col("conv") == F.col("on")) & (F.col("depth") == F.col("at")), "left").withColumn("n_children", F.coalesce("branches", F.lit(0)) + (F.col("depth") < F.col("len")).cast("long"))
    nodes = nodes.select(
        "conv", "depth", "chars", "n_children", (F.col("len") - F.col("depth")).alias("below"), F.when(F.col("depth") == 0, None).when(F.col("depth") > F.col("first"), F.col("conv")).otherwise(F.col("up")).alias("parent_conv_id"),
        (F.coalesce("members", F.lit(0)) + (F.col("depth") == F.col("len")).cast("long")).alias("n_convs"), (F.coalesce("leaves", F.lit(0)) + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
    )
    nodes = running(written(nodes, "trie-nodes"), "conv", "below", ["n_convs", "n_leaves"], longest)
    nodes = written(nodes.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars")).drop("chars"), "trie-counted")

    # the savings need the counts, so they go up in a second pass
    saved = nodes.groupBy(F.col("conv").alias("c")).agg(F.sum("saved_tokens").alias("saved"))
    saved = _over_subtrees(chains.join(saved, F.col("conv") == F.col("c")), ["saved"]).where("up is not null")
    saved = written(saved.groupBy(F.col("up").alias("on"), F.col("up_at").alias("at")).agg(F.sum("saved").alias("saved")), "trie-saved")
    nodes = nodes.join(saved, (F.col("conv") == F.col("on")) & (F.col("depth") == F.col("at")), "left").withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("saved", F.lit(0))).drop("on", "at", "saved")
    nodes = running(nodes if longest < BLOCK else written(nodes, "trie-topped"), "conv", "below", ["saved_tokens"], longest)

    members = twins.unionByName(chains.select("conv", F.col("len").alias("depth"), F.col("conv").alias("member")))
    out = nodes.join(ends(members), (F.col("conv") == F.col("e_conv")) & (F.col("depth") == F.col("e_depth")), "left")
    out = out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    out = written(out, "trie")
    delete(turns.sparkSession, path)
    return out
