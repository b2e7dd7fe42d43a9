"""URL filtering by fixed rules and a path-template tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, saved

#: Distinct literal values of one place in a tree from which it counts as variable.
VARIABLE = 32
#: Segments that get a level of their own; what follows them is one more level.
LEVELS = 6
#: Strength of the prior in the smoothed purity, and the z-score from which branches differ.
SMOOTH, DIFFERS = 4.0, 2.0
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and a path prefix, written host + path."""

    verdict: str
    host: str
    path: str


#: The production rules.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for a null url or one without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _ruled(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _shape(segment: Column) -> Column:
    """A segment with digits generalised: {hex}, {id} for numbers, with the letters around them kept."""
    s = F.regexp_replace(segment, r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", "{hex}")
    s = F.regexp_replace(s, r"(?i)^(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{8,}$", "{hex}")
    return F.regexp_replace(s, r"[0-9]+", "{id}")


def templates(paths: DataFrame) -> DataFrame:
    """(host, leaf, template, blocked, labelled): the template tree of every host.

    paths: (host, leaf, n, blocked, labelled), one row per host and shaped path. Level by
    level, places with over VARIABLE distinct values under one parent become {*}. Then, from
    the deepest level up, sibling branches with labels whose purity doesn't differ from that
    of all of them together (a two-sided z-test) are merged into one branch {+}, and
    sibling branches without any label into {-}. The first LEVELS segments have a level each; all that follows is one more
    segment, compared as a whole.
    """
    segs = F.split(F.expr("substring(leaf, 2)"), "/")
    deep = F.concat(F.slice(segs, 1, LEVELS), F.when(F.size(segs) > LEVELS, F.array(F.array_join(F.slice(segs, LEVELS + 1, 1 << 20), "/"))).otherwise(F.array().cast("array<string>")))
    tree = paths.withColumn("segs", F.when(F.col("leaf") == "", F.array().cast("array<string>")).otherwise(deep)).withColumn("up", F.lit(""))
    depth = paths.select(F.coalesce(F.max(F.size(segs)), F.lit(0))).first()[0]
    levels = min(LEVELS, depth) + (depth > LEVELS)
    for level in range(levels):
        seg = F.get("segs", F.lit(level))
        here = tree.withColumn("seg", seg)
        many = here.where("seg is not null").groupBy("host", "up", "seg").agg(F.count("*").alias("c")).groupBy("host", "up").agg(F.count("*").alias("values")).where(F.col("values") > VARIABLE).select("host", "up", F.lit(True).alias("many"))
        named = F.when(F.col("seg").isNull(), F.col("up")).otherwise(F.concat("up", F.lit("/"), F.when(F.col("many"), F.lit("{*}")).otherwise(F.col("seg"))))
        tree = here.join(many, ["host", "up"], "left").withColumn("up", named).drop("seg", "many")
        tree = saved(tree, "url-tree")
    leaves = tree.select("host", "leaf", F.col("up").alias("branch"), "blocked", "labelled")
    nodes = saved(leaves.groupBy("host", "branch").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")).withColumn("template", F.col("branch")), "url-nodes")
    for level in reversed(range(levels)):
        # Siblings at a level share everything but that segment.
        parts = F.split("template", "/")
        own = F.get(parts, F.lit(level + 1))
        literal = own.isNotNull() & ~own.contains("{")
        around = F.array_join(F.transform(parts, lambda s, i: F.when(i == level + 1, F.lit("{+}")).otherwise(s)), "/")
        now = nodes.withColumn("around", F.when(literal, around))
        branch = now.where("around is not null").groupBy("host", "around", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).withColumn("known", F.col("l") > 0)
        whole = branch.groupBy("host", "around", "known").agg(F.sum("b").alias("wb"), F.sum("l").alias("wl"), F.count("*").alias("k"))
        p, own_p = (F.col("wb") + 0.5) / (F.col("wl") + 1), F.col("b") / F.col("l")
        z = F.abs(own_p - p) / F.sqrt(p * (1 - p) * (1 / F.col("l")))
        alike = branch.join(whole, ["host", "around", "known"]).where((F.col("k") > 1) & (~F.col("known") | (z < DIFFERS))).select("host", F.col("template").alias("t"), F.when(F.col("known"), F.col("around")).otherwise(F.regexp_replace("around", r"\{\+\}", "{-}")).alias("merged"))
        new = now.join(alike.withColumnRenamed("host", "h"), (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")), "left").withColumn("template", F.coalesce("merged", "template"))
        nodes_ = saved(new.select("host", "branch", "template", "blocked", "labelled"), "url-nodes")
        drop(nodes)
        nodes = nodes_
    sums = nodes.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    placed = leaves.select("host", "leaf", "branch").join(nodes.select("host", "branch", "template"), ["host", "branch"])
    return placed.join(sums, ["host", "template"]).select("host", "leaf", "template", "blocked", "labelled")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, reject: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, template, purity.

    The longest rule that fits decides; pages under a rule are the labelled ones. Others
    are judged by their template: its share of blocked pages among its labelled ones, smoothed
    towards that of its host, which is smoothed towards that of all hosts. A template with labelled pages
    whose purity is `reject` or more is blocked; one without any is allowed.
    Path segments past the sixth count as one (see templates). Null urls and those without '://' have empty host and path, and form a
    template like others. Repeated rows get equal rows, an empty table none, and other
    columns are ignored.
    """
    host, path = split_url(F.col(url_col))
    d = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    d = d.withColumn("_r", _ruled(rules, F.col("host"), F.col("path"))).withColumn("leaf", F.array_join(F.transform(F.split("path", "/"), _shape), "/"))
    block, labelled = (F.col("_r.verdict") == "block").cast("long"), F.col("_r").isNotNull().cast("long")
    paths = saved(d.groupBy("host", "leaf").agg(F.count("*").alias("n"), F.sum(F.coalesce(block, F.lit(0))).alias("blocked"), F.sum(labelled).alias("labelled")), "url-paths")
    all_ = paths.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n")).first()
    prior = all_["b"] / all_["n"] if all_["n"] else 0.0
    hosts = paths.groupBy("host").agg(((F.sum("blocked") + SMOOTH * prior) / (F.sum("labelled") + SMOOTH)).alias("host_purity"))
    tree = saved(templates(paths).join(hosts, "host").select("host", "leaf", "template", "labelled", ((F.col("blocked") + SMOOTH * F.col("host_purity")) / (F.col("labelled") + SMOOTH)).alias("purity")), "url-templates")
    side = F.broadcast(tree) if tree.count() <= BROADCAST_ROWS // 8 else tree
    verdict = F.coalesce("_r.verdict", F.when((F.col("labelled") > 0) & (F.col("purity") >= reject), "block").otherwise("allow"))
    return d.join(side, ["host", "leaf"]).select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
