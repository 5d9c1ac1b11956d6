"""URL filter by a path-template tree, in DataFrame operations only.

Every host has a tree of path segments. Level by level, a segment becomes the wildcard `*` where it is one of many
rare siblings or looks like a number; labelled sibling branches whose share of bad URLs does not differ from the rest
of their siblings (a two-sided z test) are merged under the wildcard too. Where all paths under a node go on alike, as
far as they go on, the whole stretch up to the next branching is taken at once, and a path that is alone takes all its
segments; so there are as many levels as branchings on a path, whatever its depth: two paths that share a thousand
segments take one level. The leaves are templates.

A template's purity is its share of bad labels, smoothed towards the share that the same template has on all hosts,
that towards the host's share, and that towards the overall one. So a template without labels of its own is judged by
where labels of its kind are. It is rejected where the purity reaches the threshold and these places together have
enough labels. Paths are counted before the tree is built, so a host with a third of all rows is as many tree rows as
it has different paths, and joins on a host, a node or a template are salted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii

#: (verdict, host, path): a rule fits the host and its subdomains where the path starts with its path.
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty for null or without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The struct (size, rule, verdict) of the longest rule that fits, or null. Rules are code, not data: a short list."""
    fitting = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, h, p in rules
    ]
    if not fitting:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return fitting[0] if len(fitting) == 1 else F.greatest(*fitting)


#: Parts in which the children of one node, or the hosts of one template, meet it.
SALTS = 32


def _part(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def _summed(rows: DataFrame, key: list[str], part: Column, sums: dict[str, Column], add=F.sum) -> DataFrame:
    """key, part and the sums (or what `add` makes of the parts') over all rows of a key, a row for each part that the key has."""
    parts = rows.groupBy(*key, part.alias("part")).agg(*(c.alias(n) for n, c in sums.items()))
    whole = parts.groupBy(*key).agg(*(add(n).alias(n) for n in sums), F.collect_set("part").alias("parts"))
    return whole.withColumn("part", F.explode("parts")).drop("parts")


def _step(seg: Column) -> Column:
    return F.when(seg.rlike(r"^[0-9]+(\.[a-z0-9]+)?$"), F.lit("*")).otherwise(seg)


def _level(tree: DataFrame, many: int, rare: float, z: float, least: int) -> DataFrame:
    """Moves every path's next segment, or `*`, from its rest to its template."""
    node, seg = ["host", "template"], F.get("rest", F.lit(0))
    kids = tree.groupBy(*node, seg.alias("seg")).agg(
        F.count("*").alias("paths"), F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")
    )
    sums = {"all_n": F.sum("n"), "kids": F.count("*"), "all_labelled": F.sum("labelled"), "all_bad": F.sum("bad")}
    parents = _summed(kids, node, _part("seg"), sums)
    scarce = (F.col("kids") > many) & (F.col("n") < rare * F.col("all_n"))
    others = F.col("all_labelled") - F.col("labelled")
    rest = (F.col("all_bad") - F.col("bad")) / F.greatest(others, F.lit(1))
    pooled = F.col("all_bad") / F.greatest(F.col("all_labelled"), F.lit(1))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest("labelled", F.lit(1)) + 1 / F.greatest(others, F.lit(1))))
    alike = (F.col("labelled") >= least) & (others >= least) & (
        F.abs(F.col("bad") / F.greatest("labelled", F.lit(1)) - rest) <= z * spread
    )
    steps = kids.withColumn("part", _part("seg")).join(parents, [*node, "part"])
    steps = steps.select(*node, "seg", F.when(scarce | alike, F.lit("*")).otherwise(_step(F.col("seg"))).alias("step"))
    # a segment that many paths share meets its step in parts of the paths
    wide = _summed(tree.withColumn("seg", seg), [*node, "seg"], _part("path"), {"_n": F.count("*")}).join(steps, [*node, "seg"])
    grown = tree.withColumns({"seg": seg, "part": _part("path")}).join(wide.drop("_n"), [*node, "seg", "part"])
    left = F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0)))
    return grown.withColumns({"template": F.concat("template", F.lit("/"), "step"), "rest": left}).select(*tree.columns)


def _stretch(tree: DataFrame) -> DataFrame:
    """Moves from each path's rest to its template what all paths under its node have in common, as far as they reach; a path that is alone,
    or only the beginning of others, moves all its segments."""
    node, kept = ["host", "template"], tree.columns
    rows = tree.withColumn("part", _part("path"))
    longest = _summed(rows, node, F.col("part"), {"last": F.max("rest")}, F.max)
    met = rows.join(longest, [*node, "part"])
    # where a path parts from the last one in order; any two that part do so where one of them parts from that
    apart = F.array_position(F.zip_with("rest", "last", lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(False)) - 1
    met = met.withColumn("apart", F.when((apart >= 0) & (apart < F.size("rest")), apart.cast("int"))).drop("last")
    first = _summed(met, node, F.col("part"), {"common": F.min("apart")}, F.min)
    met = met.drop("apart").join(first, [*node, "part"])
    size = F.least(F.coalesce("common", F.size("rest")), F.size("rest"))
    taken = F.transform(F.slice("rest", 1, size), _step)
    return met.withColumns(
        {
            "template": F.when(size > 0, F.concat_ws("/", "template", F.array_join(taken, "/"))).otherwise(F.col("template")),
            "rest": F.slice("rest", size + 1, F.size("rest") - size),
        }
    ).select(*kept)


def template_tree(paths: DataFrame, scratch: Scratch, many: int = 8, rare: float = 0.1, z: float = 1.96, least: int = 5) -> DataFrame:
    """paths: host, path, n, labelled, bad. Adds the template."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    tree, level = paths.withColumn("rest", segments).withColumn("template", F.lit("")), 0
    while True:
        split = scratch.keep(_stretch(tree), f"level{level}")
        scratch.append(split.where(F.size("rest") == 0).drop("rest"), "leaves")
        scratch.drop(f"level{level - 1}")
        tree = split.where(F.size("rest") > 0)
        if tree.isEmpty():
            return scratch.read("leaves")
        tree, level = _level(tree, many, rare, z, least), level + 1


def _purity(leaves: DataFrame, smoothing: float, overall: float) -> DataFrame:
    """host, template, purity and evidence (the labels it rests on) of every template."""
    counts = {"labelled": F.sum("labelled"), "bad": F.sum("bad")}
    hosts = _summed(leaves, ["host"], _part("template"), counts).withColumnsRenamed({"labelled": "host_labelled", "bad": "host_bad"})
    kinds = _summed(leaves, ["template"], _part("host"), counts).withColumnsRenamed({"labelled": "kind_labelled", "bad": "kind_bad"})
    known = leaves.withColumn("part", _part("template")).join(hosts, ["host", "part"])
    known = known.withColumn("part", _part("host")).join(kinds, ["template", "part"])
    toward = F.lit(overall)
    for name in ("host_", "kind_", ""):
        toward = (F.col(f"{name}bad") + smoothing * toward) / (F.col(f"{name}labelled") + smoothing)
    # the labels of the template are among those of the host and those of its kind
    return known.select("host", "template", toward.alias("purity"), (F.col("host_labelled") + F.col("kind_labelled") - F.col("labelled")).alias("evidence"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    labels: DataFrame | None = None,
    threshold: float = 0.8,
    smoothing: float = 2.0,
    least: int = 5,
) -> DataFrame:
    """page_id, host, path, rule, template, purity and verdict of every row of pages.

    labels (page_id, bad as 0/1) teach the tree; without them the pages that a rule decides do. A rule's verdict wins
    over the template's. A null URL, or one without `://`, has an empty host and path and is judged like any other; a
    template is allowed where it, its kind on other hosts and its host have fewer than `least` labels. Repeated rows
    count and come out as often as they are in the table; an empty table gives an empty result. Other columns are
    ignored. Long URLs and deep paths are judged whole.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    parsed = parsed.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"))
    if labels is None:
        taught = parsed.withColumn("bad", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    else:
        known = labels.groupBy("page_id").agg(F.max("bad").alias("bad"))
        taught = parsed.join(known, "page_id", "left")
    paths = taught.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    )
    tree = template_tree(scratch.keep(paths, "paths"), scratch, least=least)
    leaves = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    total = leaves.agg(F.sum("labelled"), F.sum("bad")).first()
    overall = ((total[1] or 0) + 1) / ((total[0] or 0) + 2)
    reject = (F.col("evidence") >= least) & (F.col("purity") >= threshold)
    judged = _purity(leaves, smoothing, overall).select("host", "template", "purity", F.when(reject, "block").otherwise("allow").alias("learnt"))
    # a template that many paths have meets them in parts
    wide = _summed(tree, ["host", "template"], _part("path"), {"_n": F.count("*")}).drop("_n").join(judged, ["host", "template"])
    verdicts = tree.select("host", "path", "template", _part("path").alias("part")).join(wide, ["host", "template", "part"]).drop("part")
    return parsed.join(verdicts, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", "template", "purity", F.coalesce("ruled", "learnt", F.lit("allow")).alias("verdict")
    )
