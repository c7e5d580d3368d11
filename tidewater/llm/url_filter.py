"""URL filtering by rules and by a tree of path templates for each host.

Hand-kept rules come first; the longest that fits decides.  What they leave open is judged by templates.
Each host has a tree over its path segments.  Segments that look like numbers or keys, and at every node
those that few pages have, are generalised into one wildcard.  Branches of a node whose shares of bad labels
don't differ significantly are merged: in order of their shares, each is tested against all that its
branch has taken in so far, so small steps don't chain.  A leaf is a template, and it is rejected when its
smoothed share of bad labels is high: its own labels count together with a few made-up ones that have its
host's share, which in turn leans on the whole table's.

URLs are first counted by shape (segments with the obviously variable ones replaced), so the tree is built
from aggregated rows, level by level.  Branches are merged by bins of their shares, 51 at most for a node, so
no node is ever gathered, however many segments it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BINS = 50
#: A segment that is a number, a date or a long key, with or without a file ending.
VARIABLE = r"^(?:[0-9][0-9._-]*|[0-9a-fA-F-]{16,}|[A-Za-z0-9_-]{32,})(\.[A-Za-z]{2,5})?$"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what is between the first ``://`` and one of ``/?#``, A-Z lower-cased; then up to ``?`` or ``#``.

    Both are empty for null and where there is no ``://``.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    A rule is (``domain/path``, verdict); it fits its domain and all subdomains if the path starts with its path.
    Of equally long rules the first in code point order is taken.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The path's segments, variable ones as ``*`` with their ending."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(s, VARIABLE, "*$1"))


def _share(bad: Column, labelled: Column, host_rate: Column, smoothing: float) -> Column:
    return (bad + smoothing * host_rate) / (labelled + smoothing)


def _merged(bins: DataFrame, z: float) -> DataFrame:
    """``bins`` (host, node, bin, labelled, bad) with ``branch`` in place of the counts.

    Bins in order join the branch before them unless the two-proportion test tells them apart from all that
    the branch holds; bins without labels and with labels are never one branch.
    """
    rows = bins.groupBy("host", "node").agg(F.array_sort(F.collect_list(F.struct("bin", F.col("labelled").cast("double").alias("n"), F.col("bad").cast("double").alias("bad")))).alias("all"))  # BINS + 1 at most

    def step(acc, x):
        pooled = (acc["bad"] + x["bad"] + 0.5) / (acc["n"] + x["n"] + 1)
        gap = F.abs((acc["bad"] + 0.5) / (acc["n"] + 1) - (x["bad"] + 0.5) / (x["n"] + 1))
        apart = gap >= z * F.sqrt(pooled * (1 - pooled) * (1 / (acc["n"] + 1) + 1 / (x["n"] + 1)))
        new = (F.size(acc["out"]) > 0) & (((acc["n"] == 0) != (x["n"] == 0)) | ((x["n"] > 0) & apart))
        branch = acc["branch"] + new.cast("int")
        out = F.array_append(acc["out"], F.struct(x["bin"].alias("bin"), branch.alias("branch")))
        return F.struct(branch.alias("branch"), F.when(new, x["n"]).otherwise(acc["n"] + x["n"]).alias("n"), F.when(new, x["bad"]).otherwise(acc["bad"] + x["bad"]).alias("bad"), out.alias("out"))

    none = F.array().cast("array<struct<bin:bigint,branch:int>>")
    start = F.struct(F.lit(0).alias("branch"), F.lit(0.0).alias("n"), F.lit(0.0).alias("bad"), none.alias("out"))
    return rows.select("host", "node", F.inline(F.aggregate("all", start, step, lambda acc: acc["out"])))


def _split(rows: DataFrame, hosts: DataFrame, least_pages: int, z: float, smoothing: float) -> DataFrame:
    """(host, node, child, label): the children of the nodes of ``rows`` (host, node, seg, n, labelled, bad), and what their branches are called.

    A branch of one child has its name, others the first and last of their children's names and how many these are.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    segments = rows.where("seg is not null").groupBy("host", "node", "seg").agg(*sums)
    child = F.when((F.col("n") >= least_pages) | F.col("seg").startswith("*"), F.col("seg")).otherwise("*")
    children = segments.groupBy("host", "node", child.alias("child")).agg(*sums).join(hosts, "host")
    share = _share(F.col("bad"), F.col("labelled"), F.col("host_rate"), smoothing)
    children = children.withColumn("bin", F.floor(share * BINS)).select("host", "node", "child", "bin", "labelled", "bad")
    children = written(children, "url-children")
    bins = children.groupBy("host", "node", "bin").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    named = children.select("host", "node", "child", "bin").join(_merged(bins, z), ["host", "node", "bin"])
    called = named.groupBy("host", "node", "branch").agg(F.min("child").alias("low"), F.max("child").alias("high"), F.count("*").alias("many"))
    label = F.when(F.col("many") == 1, F.col("low")).otherwise(F.concat(F.lit("{"), "low", F.lit("..."), "high", F.lit(":"), F.col("many").cast("string"), F.lit("}")))
    return written(named.join(called.select("host", "node", "branch", label.alias("label")), ["host", "node", "branch"]).select("host", "node", "child", "label"), "url-branches")


def templates(shapes: DataFrame, least_pages: int = 8, z: float = 1.96, smoothing: float = 4.0, levels: int = 4) -> DataFrame:
    """(host, shape, template, labelled, bad, purity) from ``shapes`` (host, shape, n, labelled, bad).

    A segment has a branch of its own if ``least_pages`` pages have it at its node.  A node is split as long
    as it has more than one shape and labels of both kinds, and down to ``levels`` segments in any case; nodes
    of one kind of label are judged alike however deep they are split.  A round of jobs takes each open node to its next
    fork, so that rounds follow the forks of the paths and not their length.  A template that stands for deeper paths
    ends in ``**``.  ``purity`` is the smoothed share of bad labels of the template that the shape falls into.
    """
    hosts = shapes.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("bad").alias("h_bad"))
    base = shapes.agg(F.coalesce((F.sum("bad") + 0.5) / (F.sum("labelled") + 1), F.lit(0.5)).alias("base")).first()["base"]
    hosts = written(hosts.select("host", _share(F.col("h_bad"), F.col("h_labelled"), F.lit(base), smoothing).alias("host_rate")), "url-hosts")
    open_, done = shapes.withColumns({"node": F.lit(""), "depth": F.lit(0)}), None
    while True:
        rest = F.slice("shape", F.col("depth") + 1, F.greatest(F.size("shape"), F.lit(1)))
        stats = open_.groupBy("host", "node", "depth").agg(F.count("*").alias("n_shapes"), F.max(F.size("shape")).alias("deepest"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"), F.sum("n").alias("pages"), F.min(rest).alias("low"), F.max(rest).alias("high"))
        mixed = (F.col("b") > 0) & (F.col("b") < F.col("l"))
        # what all paths of a node go on with is what the first and the last of them share: one step, however long
        differs = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), False).cast("int")
        shared = F.when(differs == 0, F.size("low")).otherwise(differs - 1)
        shared = F.when(F.col("n_shapes") == 1, 0).when(mixed, shared).otherwise(F.least(shared, F.greatest(levels - F.col("depth"), F.lit(0))))
        names = F.transform(F.slice("low", 1, shared), lambda s: F.concat(F.lit("/"), F.when((F.col("pages") >= least_pages) | s.startswith("*"), s).otherwise("*")))
        stats = stats.withColumns({"to_node": F.concat("node", F.array_join(names, "")), "to_depth": F.col("depth") + shared})
        go = (F.col("n_shapes") > 1) & (F.col("deepest") > F.col("to_depth")) & (mixed | (F.col("to_depth") < levels))
        stats = stats.select("host", "node", "n_shapes", "to_node", "to_depth", go.alias("go"))
        # a node of a large host has most of the rows; they are the left side, so that its partition can be split
        rows = open_.drop("depth").join(stats, ["host", "node"]).drop("node").withColumnsRenamed({"to_node": "node", "to_depth": "depth"})
        rows = written(rows, "url-nodes")
        deeper = F.when(F.col("n_shapes") == 1, F.concat(F.lit("/"), F.array_join(rest, "/"))).otherwise("/**")
        stopped = rows.where(~F.col("go")).withColumn("template", F.when((F.size("shape") > F.col("depth")) | ((F.col("node") == "") & (F.col("n_shapes") == 1)), F.concat("node", deeper)).otherwise(F.col("node")))
        rows = rows.where("go").drop("n_shapes", "go").withColumn("seg", F.try_element_at("shape", F.col("depth") + 1))
        ended = rows.where("seg is null").withColumn("template", F.concat("node", F.lit("/")))
        out = stopped.select("host", "shape", "labelled", "bad", "template").unionByName(ended.select("host", "shape", "labelled", "bad", "template"))
        done = out if done is None else done.unionByName(out)
        rows = rows.where("seg is not null")
        if rows.isEmpty():
            break
        names = _split(rows, hosts, least_pages, z, smoothing)
        own = names.select("host", "node", F.col("child").alias("seg"), "label")
        wild = names.where("child = '*'").select("host", "node", F.col("label").alias("wild"))
        rows = rows.join(own, ["host", "node", "seg"], "left").join(wild, ["host", "node"], "left")
        rows = rows.withColumns({"node": F.concat("node", F.lit("/"), F.coalesce("label", "wild")), "depth": F.col("depth") + 1})
        open_ = written(rows.drop("seg", "label", "wild"), "url-level")
    done = written(done, "url-leaves")
    leaf = done.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).join(hosts, "host")
    leaf = leaf.withColumn("purity", _share(F.col("bad"), F.col("labelled"), F.col("host_rate"), smoothing)).drop("host_rate")
    return done.select("host", "shape", "template").join(leaf, ["host", "template"]).select("host", "shape", "template", "labelled", "bad", "purity")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], labels: DataFrame | None = None, threshold: float = 0.7, id_col: str = "page_id", url_col: str = "url", **how) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, template, purity.

    ``labels`` (id, bad 0/1) teaches the templates.  Without it, the pages that rules decide are the
    labelled ones; rules by host then make a template's purity mostly its host's share.  A template is rejected (``block``) when its purity is ``threshold`` or more; a page
    without a host is allowed and has no template.  Repeated rows are judged alike, null ids and urls
    pass through, an empty table gives an empty result, and other columns are ignored.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"), shape(F.col("path")).alias("shape"))
    known = rows.where("host <> ''")
    if labels is None:
        known = known.withColumn("bad", F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0))
    else:
        one = labels.groupBy(F.col(labels.columns[0]).alias("label_id")).agg(F.max(labels.columns[1]).alias("bad"))
        known = known.join(one, F.col("id") == F.col("label_id"), "left")
    shapes = known.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    made = written(templates(written(shapes, "url-shapes"), **how), "url-templates")
    out = rows.join(made, ["host", "shape"], "left")
    by_template = F.when(F.col("purity") >= threshold, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_template).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
