"""URL filters: rules, and a path-template tree per host for what no rule judges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenequarry.session import cut_lineage

# (verdict, host, path): the rules of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

DEPTH = 4                          # levels below the host that every path is smoothed over; deeper paths over all of theirs
FANOUT, REPEATS = 8, 2             # a node of FANOUT branches or more, seen fewer than REPEATS times each, has a variable segment
ALIKE = 4                          # square of the standard errors within which a branch is like its parent
PRIOR_WEIGHT, BLOCK_FROM = 4.0, 0.5
VARIABLE = r"^[0-9]+(\..*)?$|^[0-9a-f]{8}[0-9a-f-]{8,}$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for a null url or one without ://."""
    known = F.coalesce(url, F.lit(""))
    at = F.position(F.lit("://"), known)
    rest = F.when(at > 0, F.substring(known, at + 3, F.length(known))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def by_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule whose host is the url's or a parent domain of it and whose path begins the url's, else null."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    choice = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        choice = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(choice)
    return choice


def segments(path: Column) -> Column:
    """All segments of the path, numbers and long hex strings as *."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(VARIABLE), "*").otherwise(s))


def _segment(names: str, d: int) -> Column:
    """The d-th segment, from 1; empty behind the end."""
    return F.coalesce(F.get(names, F.lit(d - 1)), F.lit(""))


def _generalised(nodes: DataFrame, deepest: int) -> DataFrame:
    """Replaces the segments (array t) below a node by * where it has many branches that hardly repeat, level by level."""
    for d in range(1, deepest + 1):
        above, rest = F.slice("t", 1, d - 1), F.slice("t", F.lit(d + 1), F.greatest(F.size("t") - d, F.lit(0)))
        nodes = nodes.withColumn("above", above)
        branches = nodes.where(F.size("t") >= d).groupBy("host", "above", _segment("t", d).alias("name")).agg(F.sum("n").alias("n"))
        wide = branches.groupBy("host", "above").agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("n"))
        wide = wide.where((F.col("kids") >= FANOUT) & (F.col("n") < REPEATS * F.col("kids"))).select("host", "above", F.lit(True).alias("wide"))
        replaced = F.when(F.col("wide") & (F.size("t") >= d), F.concat("above", F.array(F.lit("*")), rest)).otherwise(F.col("t"))
        nodes = nodes.join(wide, ["host", "above"], "left").withColumn("t", replaced).drop("wide", "above")
        nodes = cut_lineage(nodes)                       # each level reads the one before several times
    return nodes


def _judged(nodes: DataFrame, deepest: int) -> DataFrame:
    """``nodes`` with ``purity``: the smoothed share of blocked urls, from the whole table down to the merged branch.

    Branches whose share does not differ from their parent's are merged into one, with the unlabelled ones; each level is smoothed toward
    the level above, down to the path's last or to DEPTH of them if it has fewer.
    """
    whole = nodes.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("a_labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("a_blocked"))
    labelled, blocked = whole.first()
    nodes = nodes.withColumn("purity", F.lit((blocked + PRIOR_WEIGHT * 0.5) / (labelled + PRIOR_WEIGHT)))
    nodes = nodes.withColumn("merged", F.array().cast("array<string>"))
    for d in range(max(DEPTH, deepest) + 1):
        if d:
            nodes = nodes.withColumn("name", _segment("t", d))          # "" behind a path's end, a branch of its own
            top = nodes.groupBy("host", "merged").agg(F.sum("labelled").alias("p_n"), F.sum("blocked").alias("p_b"))
            own = nodes.groupBy("host", "merged", "name").agg(F.sum("labelled").alias("c_n"), F.sum("blocked").alias("c_b")).join(top, ["host", "merged"])
            n, b, big_n, big_b = (F.col(c).cast("double") for c in ("c_n", "c_b", "p_n", "p_b"))
            gap = b * big_n - n * big_b
            alike = gap * gap <= ALIKE * n * big_b * (big_n - big_b)
            own = own.select("host", "merged", "name", F.when(alike & (F.col("name") != ""), "+").otherwise(F.col("name")).alias("branch"))
            nodes = nodes.join(own, ["host", "merged", "name"]).withColumn("merged", F.concat("merged", F.array("branch"))).drop("name", "branch")
        sums = nodes.groupBy("host", "merged").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        smoothed = (F.col("b") + PRIOR_WEIGHT * F.col("purity")) / (F.col("l") + PRIOR_WEIGHT)
        reached = F.greatest(F.size("t"), F.lit(DEPTH)) >= d
        nodes = nodes.join(sums, ["host", "merged"]).withColumn("purity", F.when(reached, smoothed).otherwise(F.col("purity"))).drop("l", "b")
        nodes = cut_lineage(nodes)
    return nodes


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url", label: Column | None = None,
) -> DataFrame:
    """One row per page: page_id, host, path, rule (like ``net/``, else null), verdict (allow or block), purity.

    The longest fitting rule decides. Other urls are judged by their template: the tree is learnt from the urls with a ``label``
    (1 block, 0 allow; by default the rules' verdicts), and a template whose smoothed share of blocked urls reaches BLOCK_FROM is
    rejected. Only distinct templates are joined and grouped, never the pages of a host.

    A null url, or one without ://, has an empty host and path and is judged like any host. Repeated rows and null ids are
    rows of their own; other columns are ignored. Without labels every purity is BLOCK_FROM's prior of one half, which blocks.
    An empty table gives an empty one.
    """
    host, path = host_and_path(F.col(url))
    given = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), (F.lit(None) if label is None else label).cast("int").alias("label"))
    given = given.withColumn("choice", by_rule(F.col("host"), F.col("path"), rules))
    if label is None:
        given = given.withColumn("label", F.when(F.col("choice").isNotNull(), (F.col("choice.verdict") == "block").cast("int")))
    split = given.withColumn("o", segments(F.col("path")))
    nodes = split.groupBy("host", "o").agg(
        F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("blocked")
    )
    nodes = cut_lineage(nodes.withColumn("t", F.col("o")))
    deepest = nodes.agg(F.max(F.size("o"))).first()[0] or 0
    named = _generalised(nodes, deepest)
    tree = named.groupBy("host", "t").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    judged = _judged(cut_lineage(tree), deepest).select("host", "t", "purity")
    purities = cut_lineage(named.join(judged, ["host", "t"]).select("host", "o", "purity"))
    method = F.when(F.col("purity") >= BLOCK_FROM, "block").otherwise("allow")
    return split.join(purities, ["host", "o"]).select(
        "page_id", "host", "path", F.col("choice.rule").alias("rule"), F.coalesce("choice.verdict", method).alias("verdict"), "purity",
    )
