"""Mixing sources to target weights by entropy balancing.

Among all document rates that give each group its target number of words, the mix takes those closest
to the base rates in relative entropy.  The convex dual has one multiplier for each group value; its
solution tilts the base rates exponentially: rate = base * exp(sum of the multipliers of the groups
that the document is in).  Newton iterations solve it.  Documents with equal groups share a cell, so the
documents are aggregated once, before the iterations; gradient and Hessian of a step are one aggregation over the
cells.  With one grouping the Hessian is diagonal and each cell takes its steps alone.  With several, the
Hessian has a row for each pair of groups that share a cell, and the step solves that small system.

Rates become whole copies.  Every document gets the whole part; the rest of a cell's words goes, as one
more copy each, to the documents that come first in the order of a hash, as far as their words reach.
The cut is found by two rounds of 4096 hash ranges, so only the last range's few documents are ordered,
and no cell is ever gathered.  Then, three times, the document whose size comes closest to what is still amiss
in a cell is put in or taken out, so a cell's words differ from its share by far less than one document's size.

A document's copies follow from its own hash, its cell's cut, and a short list of the documents around the
cut; texts are never shuffled.  Rows alike in id, source and text have one hash and stand on that list once,
with the number of them that have one more copy.  All of it is DataFrame operations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import written

WORD = r"[^\x20\x09-\x0D]+"
DIGIT = 4096
FITS = 3  # corrections of a cell by one document


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (group, size) with ``target``: total_share of all sizes dealt by weight, at most ``most`` times a size.

    Groups in order of their code points, null last, take the weights in turn.  What exceeds a group's
    limit goes to the others by weight, again and again.  That fills all groups to one level of
    target / weight; the level follows from the sums over the groups in order of limit / weight.
    One row for each group: the windows order groups, never documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("group").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = sizes.select("group", "size", weight.alias("weight"), (F.col("size") * F.lit(float(most))).alias("limit"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("group").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        (F.sum("size").over(every) * F.lit(float(total_share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("rest"),
    )
    # the level if just the groups before this one are at their limits; the first that its own group can bear holds
    level = F.min(F.when(F.col("left") / F.col("rest") <= F.col("limit") / F.col("weight"), F.struct((F.col("limit") / F.col("weight")).alias("at"), (F.col("left") / F.col("rest")).alias("level")))).over(every)
    rows = rows.withColumn("level", level["level"])
    return rows.select("group", "size", F.coalesce(F.least("limit", F.col("weight") * F.col("level")), F.col("limit")).alias("target"))


def balance(cells: DataFrame, targets: dict[str, DataFrame], most: float = 2.0, rounds: int = 40, tolerance: float = 1e-6, groups: int = 2000) -> DataFrame:
    """``cells`` (the grouping columns, size) with ``rate``, the solution of the dual.

    ``targets[c]`` has (group, target); a group without one is free.  A target of 0 makes its rates 0.  Rates are
    held to ``most``.  Steps are damped to a factor of 8 at most.  ValueError if some sum is still off by more than
    ``tolerance`` of its target after ``rounds``, as it must be where targets contradict one another or
    ``most``, or if there are more than ``groups`` multipliers in several groupings together.  Nulls are
    a group like others; cells of size 0 or null take no part and keep rate 1.
    """
    if len(targets) == 1 and cells.groupBy(*targets).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        out = _balance_alone(cells, *next(iter(targets.items())), most, rounds)
    else:
        out = _balance_jointly(cells, targets, most, rounds, tolerance, groups)
    for c, target in targets.items():
        sums = out.groupBy(F.col(c).alias("s_group")).agg(F.sum(F.col("size") * F.col("rate")).alias("have"), F.sum("size").alias("all")).where(F.col("all") > 0)
        off = sums.join(target, F.col("s_group").eqNullSafe(F.col("group"))).where(F.abs(F.col("have") - F.col("target")) > F.greatest(F.abs("target"), F.lit(1.0)) * tolerance)
        bad = off.select("s_group", "have", "target").limit(3).collect()
        if bad:
            raise ValueError(f"targets of {c} are out of reach: {bad}")
    return out


def _balance_alone(cells: DataFrame, column: str, target: DataFrame, most: float, rounds: int) -> DataFrame:
    """One grouping with a cell for each group: the dual falls apart, so each cell takes all its steps in one go."""
    rows = cells.alias("l").join(target.alias("t"), F.col(f"l.{column}").eqNullSafe(F.col("t.group")), "left").select("l.*", "target")

    def step(eta, _):
        have = F.col("size") * F.exp(eta)
        return eta + F.least(F.greatest((F.col("target") - have) / have, F.lit(-2.0)), F.lit(2.0))

    eta = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(0.0), step)
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("size") > 0, F.least(F.exp(eta), F.lit(float(most)))).otherwise(1.0)
    return written(rows.withColumn("rate", F.coalesce(rate, F.lit(1.0))).drop("target"), "mix-rates")


def _balance_jointly(cells: DataFrame, targets: dict[str, DataFrame], most: float, rounds: int, tolerance: float, groups: int) -> DataFrame:
    """Newton steps on all multipliers together; each step aggregates the cells once, on the executors."""
    names = [(k, r["group"], float(r["target"])) for k, t in enumerate(targets.values()) for r in t.select("group", "target").limit(groups + 1).collect()]
    if len(names) > groups:
        raise ValueError(f"more than {groups} groups in several groupings")
    n = len(names)
    want, eta = np.array([x[2] for x in names]), np.zeros(n)
    zero = want <= 0
    place = cells.sparkSession.createDataFrame([(k, g, i) for i, (k, g, _) in enumerate(names)], f"k int, g {next(iter(targets.values())).schema['group'].dataType.simpleString()}, i int")
    rows = cells.where("size > 0").withColumn("own", F.array().cast("array<int>"))
    for k, c in enumerate(targets):
        one = place.where(F.col("k") == k).select("g", "i")
        rows = rows.join(F.broadcast(one), F.col(c).eqNullSafe(F.col("g")), "left").withColumn("own", F.array_compact(F.array_append("own", F.col("i")))).drop("g", "i")  # one: `groups` rows at most
    rows = written(rows.groupBy("own").agg(F.sum("size").alias("size")), "mix-cells")

    def rate(own: Column) -> Column:
        values = F.array(*map(F.lit, np.where(zero, -800.0, eta).tolist()))
        return F.exp(F.aggregate(own, F.lit(0.0), lambda s, i: s + F.get(values, i)))

    for _ in range(rounds):
        tilted = rows.select("own", (F.col("size") * F.least(rate(F.col("own")), F.lit(float(most)))).alias("w"), F.when(rate(F.col("own")) < most, F.col("size") * rate(F.col("own"))).otherwise(0.0).alias("h"))
        pairs = tilted.select("w", "h", "own", F.explode("own").alias("a")).select("w", "h", "a", F.explode("own").alias("b"))
        found = pairs.groupBy("a", "b").agg(F.sum("w").alias("w"), F.sum("h").alias("h")).collect()  # groups squared at most
        have, hessian = np.zeros(n), np.zeros((n, n))
        for r in found:
            hessian[r["a"], r["b"]] = r["h"]
            if r["a"] == r["b"]:
                have[r["a"]] = r["w"]
        live = ~zero & (have > 0)
        gap = np.where(live, want - have, 0.0)
        if (np.abs(gap) <= tolerance / 10 * np.maximum(np.abs(want), 1)).all():
            break
        # the groupings' sums agree, so the system has a null space: the least step is taken
        step = np.zeros(n)
        step[live] = np.linalg.lstsq(hessian[np.ix_(live, live)] + np.diag(1e-9 * np.maximum(have[live], 1)), gap[live], rcond=1e-12)[0]
        eta += step * min(1.0, 2 / max(np.abs(step).max(), 1e-300))
    out = cells
    terms = F.lit(0.0)
    for k, c in enumerate(targets):
        one = cells.sparkSession.createDataFrame([(g, float(-800.0 if zero[i] else eta[i])) for i, (j, g, _) in enumerate(names) if j == k], f"g {targets[c].schema['group'].dataType.simpleString()}, eta{k} double")
        out = out.join(F.broadcast(one), F.col(c).eqNullSafe(F.col("g")), "left").drop("g")
        terms = terms + F.coalesce(F.col(f"eta{k}"), F.lit(0.0))
    tilted = F.when(terms < -400, 0.0).when(F.col("size") > 0, F.least(F.exp(terms), F.lit(float(most)))).otherwise(1.0)
    return written(out.withColumn("rate", F.coalesce(tilted, F.lit(1.0))).drop(*(f"eta{k}" for k in range(len(targets)))), "mix-rates")


def _cut(rows: DataFrame, by: list[str], digit: str) -> DataFrame:
    """The hash range of each cell in which its words reach ``wanted``, and what is wanted of it.

    ``rows``: (cell, wanted, digit, size).  At most DIGIT rows for each cell reach the window.
    """
    sums = rows.groupBy(*by, "wanted", digit).agg(F.sum("size").alias("own"))
    running = F.sum("own").over(Window.partitionBy(*by).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("upto", running)
    return sums.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("own") < F.col("wanted"))).select(*by, F.col(digit).alias("cut"), (F.col("wanted") - F.col("upto") + F.col("own")).alias("left"))


def _digit(key: Column, k: int) -> Column:
    return F.conv(F.substring(key, 1 + 3 * k, 3), 16, 10).cast("int")


def _below(key: Column) -> Column:
    """Whether a hash lies before its cell's cut; false for cells that have none."""
    d1, d2 = _digit(key, 0), _digit(key, 1)
    return F.coalesce((d1 < F.col("cut1")) | ((d1 == F.col("cut1")) & (d2 < F.col("cut2"))), F.lit(False))


def round_copies(rows: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cuts (cell, whole, wanted, cut1, cut2), a row for each cell, and the list (cell, key, size, n, extra) of documents around them.

    ``rows`` has (cell, size, key), ``cells`` (cell, rate, size).  ``key`` is a hexadecimal hash; rows with equal keys
    are alike: one entry of the list stands for all ``n`` of them, and ``extra`` of these have one more copy.
    A row that is not on the list has one more if its hash lies before the cut and it has words.
    """
    split = cells.select("cell", F.floor(F.col("rate") + 1e-9).alias("whole"), ((F.col("rate") - F.floor(F.col("rate") + 1e-9)) * F.col("size")).alias("wanted"))
    split = written(split.withColumn("wanted", F.when(F.col("wanted") > 1e-6, F.col("wanted")).otherwise(0.0)), "mix-split")
    play = rows.select("cell", "size", "key", _digit(F.col("key"), 0).alias("d1"), _digit(F.col("key"), 1).alias("d2")).join(split.where("wanted > 0").select("cell", "wanted"), "cell").where("size > 0")
    one = _cut(play, ["cell"], "d1").select("cell", F.col("cut").alias("cut1"), F.col("left").alias("left1"))
    in_one = play.drop("wanted").join(one, "cell").where("d1 = cut1").withColumnRenamed("left1", "wanted")
    two = _cut(in_one, ["cell"], "d2").select("cell", F.col("cut").alias("cut2"), F.col("left").alias("left2"))
    cuts = written(split.join(one.select("cell", "cut1"), "cell", "left").join(two, "cell", "left"), "mix-cuts")
    last = play.drop("wanted").join(cuts, "cell").where("d1 = cut1 and d2 = cut2")
    last = last.groupBy("cell", "key", "size", "left2").agg(F.count("*").alias("n"))
    # a 16-millionth of a cell's distinct keys: alike rows are one entry
    before = F.coalesce(F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("cell").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = last.select("cell", "key", "size", "n", F.least(F.col("n"), F.greatest(F.lit(0), F.floor((F.col("left2") - before) / F.col("size")))).cast("long").alias("extra"), (F.col("left2") - before).alias("rest"))
    # a smaller document behind one that no longer fits stays out: the words up to it are beyond the cut as well
    crossed = F.max(F.when(F.col("extra") < F.col("n"), F.col("key"))).over(Window.partitionBy("cell").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    listed = written(listed.withColumn("extra", F.when(crossed.isNull(), F.col("extra")).otherwise(F.lit(0).cast("long"))).drop("rest"), "mix-listed")
    cuts = cuts.drop("left2")
    for _ in range(FITS):
        listed = written(_closer(rows, cuts, listed), "mix-listed")
    return cuts, listed


def _with_extra(rows: DataFrame, cuts: DataFrame, listed: DataFrame) -> DataFrame:
    """``rows`` (cell, key, size, ...) with whole, wanted, ``sure`` (the answer of the cut) and n and extra of the list, null off it.

    Both tables are small by construction (a row for each cell; the last hash range and FITS documents of each),
    and their size on disk is known, so Spark broadcasts them as long as they are.
    """
    named = listed.select(F.col("cell").alias("l_cell"), F.col("key").alias("l_key"), "n", "extra")
    out = rows.join(cuts, "cell").join(named, (F.col("cell") == F.col("l_cell")) & (F.col("key") == F.col("l_key")), "left").drop("l_cell", "l_key")
    return out.withColumn("sure", ((F.col("wanted") > 0) & (F.col("size") > 0) & _below(F.col("key"))).cast("long"))


def _closer(rows: DataFrame, cuts: DataFrame, listed: DataFrame) -> DataFrame:
    """The list after at most one document of each cell, one alone of alike ones, is put in or taken out, whose size comes closest to what is amiss."""
    live = _with_extra(rows.select("cell", "key", "size"), cuts.where("wanted > 0"), listed).where("size > 0")
    on = F.col("n").isNotNull()
    sums = live.where(~on).groupBy("cell").agg(F.sum(F.col("sure") * F.col("size")).alias("part"))
    more = listed.groupBy("cell").agg(F.sum(F.col("extra") * F.col("size")).alias("more"))
    gap = cuts.where("wanted > 0").join(sums, "cell", "left").join(more, "cell", "left").select("cell", (F.col("wanted") - F.coalesce("part", F.lit(0)) - F.coalesce("more", F.lit(0))).alias("gap"))
    off = F.abs(F.col("size") - F.abs("gap"))
    able = F.when(F.col("gap") > 0, F.when(on, F.col("extra") < F.col("n")).otherwise(F.col("sure") == 0)).otherwise(F.when(on, F.col("extra") > 0).otherwise(F.col("sure") == 1))
    best = live.join(written(gap, "mix-gap"), "cell").where((off < F.abs("gap")) & able).groupBy("cell").agg(F.min(F.struct(off.alias("off"), "key", "size", "gap", "n", "extra", "sure")).alias("best"))
    best = written(best.select("cell", "best.*"), "mix-best")
    alike = rows.join(best.where("n is null").select(F.col("cell").alias("b_cell"), F.col("key").alias("b_key"), "sure"), (F.col("cell") == F.col("b_cell")) & (F.col("key") == F.col("b_key")))
    new = alike.groupBy("cell", "key", "size").agg(F.count("*").alias("n"), F.first("sure").alias("sure")).select("cell", "key", "size", "n", (F.col("n") * F.col("sure")).alias("extra"))
    turn = best.select(F.col("cell").alias("b_cell"), F.col("key").alias("b_key"), F.signum("gap").cast("long").alias("turn"))
    both = listed.unionByName(new).join(turn, (F.col("cell") == F.col("b_cell")) & (F.col("key") == F.col("b_key")), "left")
    return both.select("cell", "key", "size", "n", (F.col("extra") + F.coalesce("turn", F.lit(0))).alias("extra"))


def _key(id_col: str, source_col: str, text_col: str) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.sha2(F.concat_ws("\x01", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(source_col), F.lit("")), F.sha2(text, 256)), 256)


def _cell(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _plan(docs: DataFrame, weights: tuple[float, ...], total_share: float, most: float, source_col: str, text_col: str, id_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows without their texts, the cells' facts, the cuts and the list."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _cell(F.col(source_col)).alias("cell"), word_count(F.col(text_col)).alias("size"), _key(id_col, source_col, text_col).alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "mix-rows")
    sizes = written(rows.groupBy("source").agg(F.sum("size").alias("size")).withColumnRenamed("source", "group"), "mix-sizes")
    targets = written(share_targets(sizes, weights, total_share, most), "mix-targets")
    cells = balance(sizes.withColumnRenamed("group", "source"), {"source": targets.select("group", "target")}, most)
    facts = cells.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.group"))).select(_cell(F.col("c.source")).alias("cell"), F.col("c.size").alias("source_size"), "target", "rate")
    facts = written(facts, "mix-facts")
    cuts, listed = round_copies(rows, facts.select("cell", "rate", F.col("source_size").alias("size")))
    return rows, facts, cuts, listed


def _copies(rows: DataFrame, cuts: DataFrame, listed: DataFrame) -> DataFrame:
    """``rows`` (cell, key, size, row, ...) with ``copies``.

    Of alike rows of which some have one more copy, the first by ``row`` have it.  They are counted by ranges of
    ``row`` (a range is what one task has written), so even a third of all rows alike is no single task.
    """
    some = listed.where("extra > 0 and extra < n")
    out = _with_extra(rows, cuts, listed)
    extra = F.when(F.col("n").isNotNull(), (F.col("extra") == F.col("n")).cast("long")).otherwise(F.col("sure"))
    if some.isEmpty():
        return out.withColumn("copies", (F.col("whole") + extra).cast("long")).drop("whole", "wanted", "cut1", "cut2", "n", "extra", "sure")
    out = out.withColumn("part", F.shiftright("row", 33))
    split = F.coalesce((F.col("extra") > 0) & (F.col("extra") < F.col("n")), F.lit(False))
    counts = out.where(split).groupBy("cell", "key", "part").agg(F.count("*").alias("own"))
    base = counts.select(F.col("cell").alias("c_cell"), F.col("key").alias("c_key"), F.col("part").alias("c_part"), (F.sum("own").over(Window.partitionBy("cell", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("cell", "key", "part").orderBy("row"))
    ranked = out.where(split).withColumn("rank", rank).join(base, (F.col("cell") == F.col("c_cell")) & (F.col("key") == F.col("c_key")) & (F.col("part") == F.col("c_part")))
    ranked = ranked.withColumn("copies", (F.col("whole") + (F.col("base") + F.col("rank") <= F.col("extra")).cast("long")).cast("long"))
    rest = out.where(~split).withColumn("copies", (F.col("whole") + extra).cast("long"))
    return ranked.select(*rows.columns, "copies").unionByName(rest.select(*rows.columns, "copies"))


def decide(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), total_share: float = 1.5, most: float = 2.0, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, key, size, source_size, target, rate, copies, taken (copies times size).

    Null and empty texts have size 0 and take nothing beyond the whole part of the rate.  A null source is a source
    of its own, the last.  Null ids and repeated rows take part like others: of rows alike in id, source and
    text, as many as needed get one more copy.  Ties in size go to the smaller hash.  Nothing but hashes of the
    rows decides, so reruns agree.  An empty table gives an empty result.  Other columns are ignored.
    """
    rows, facts, cuts, listed = _plan(docs, weights, total_share, most, source_col, text_col, id_col)
    made = _copies(rows.drop("source"), cuts, listed)
    return made.join(facts, "cell").select("doc_id", "key", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), total_share: float = 1.5, most: float = 2.0, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``decide`` says, with all the columns that they have, whatever their names.

    Null and empty texts, null sources and ids, repeated rows and ties are treated as in ``decide``; of rows alike
    in id, source and text it is arbitrary which of them come once more.  An empty table gives an empty
    result.  Texts stay where they are: no shuffle, unless rows alike have to be told apart.
    """
    _, _, cuts, listed = _plan(docs, weights, total_share, most, source_col, text_col, id_col)
    rows = docs.select(F.struct("*").alias("whole_row"), _cell(F.col(source_col)).alias("cell"), word_count(F.col(text_col)).alias("size"), _key(id_col, source_col, text_col).alias("key"), F.monotonically_increasing_id().alias("row"))
    some = listed.where("extra > 0 and extra < n").select(F.col("cell").alias("s_cell"), F.col("key").alias("s_key"))
    if not some.isEmpty():
        # ranks among alike rows need row numbers that stay
        mark = (F.col("cell") == F.col("s_cell")) & (F.col("key") == F.col("s_key"))
        alike = written(rows.join(some, mark, "left_semi"), "mix-alike")
        rows = rows.join(some, mark, "left_anti").unionByName(alike)
    made = _copies(rows, cuts, listed).where("copies > 0")
    return made.select("whole_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole_row.*")
