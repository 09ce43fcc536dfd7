"""URL filters: explicit host and path rules, and a path-template tree that judges what no rule covers.

The tree grows a level at a time from the root of each host. At a node whose children are nearly as many as its pages, the
segment varies and becomes a wildcard of its shape ({n}, {x}, {w}, with a file's suffix kept); elsewhere it stays as it is.

Branches of a host that are alike are merged, so that few labels serve them all: of the branches of one depth whose commonest
shape is the same, each is held against the one with the most pages by a two-sample chi-square test on the counts of the shapes
of their children, and joins it unless the test tells them apart. Labels, the rules' own verdicts, count only between two branches
that both have some: the same test must not tell them apart either.

A template's purity is its share of blocked labels, smoothed towards the host's, that towards that of all hosts' branches of the
same shape, and that towards all labels'. What smooths is a number of labels, whatever the number of pages without one. Each
step is an aggregate and an equi-join; no host's pages are gathered anywhere, and tables of hosts meet templates in salted parts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakern.llm.common import ascii_lower, cut, table

#: verdict, host, start of the path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Levels of the tree; the last holds the rest of the path as one segment.
LEVELS = 4
#: A node's segment varies when it has so many distinct children and at most so many pages for each.
LEAST_CHILDREN, MOST_REPEATS = 5, 4.0
#: Labels that the smoothing adds to a template, a host and a shape; the purity that blocks; parts of a host's templates.
TEMPLATE_PRIOR, HOST_PRIOR, SHAPE_PRIOR, REJECT, PARTS = 2.0, 4.0, 20.0, 0.9, 32
#: Chi-square at one per cent for 1 to 4 degrees of freedom.
CRITICAL = (6.635, 9.210, 11.345, 13.277)

SHAPES = (("number", r"^\{n\}$"), ("file", r"^\{[nxw]\}\."), ("code", r"^\{x\}$"), ("word", r"^\{w\}$"), ("fixed", r"^[^{]"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a null url or one without ://."""
    url = F.coalesce(url, F.lit(""))
    host = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    """The wildcard of a segment: {n} digits, {x} hexadecimal, {w} anything else, and a suffix after the last dot."""
    stem, suffix = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{1,5})?$", 2)
    kind = F.when(stem.rlike(r"^[0-9]+$"), F.lit("{n}")).when(stem.rlike(r"^[0-9a-fA-F-]{8,}$"), F.lit("{x}")).otherwise(F.lit("{w}"))
    return F.concat(kind, suffix)


def _segments(path: Column) -> Column:
    found = F.filter(F.split(path, "/"), lambda s: s != "")
    head = F.slice(found, 1, LEVELS - 1)
    rest = F.when(F.size(found) >= LEVELS, F.array(F.array_join(F.slice(found, LEVELS, 1 << 30), "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(head, rest)


def _grown(pages: DataFrame) -> DataFrame:
    """Adds template to (host, _segments, ...): the page's node in the tree of its host. Pages meet the nodes that vary in salted
    parts, so neither this join nor the next level's counts are dealt by host."""
    pages = pages.withColumn("template", F.lit("")).withColumn("_part", F.pmod(F.xxhash64("_segments"), F.lit(PARTS)).cast("int"))
    for level in range(LEVELS):
        pages = pages.withColumn("_segment", F.get("_segments", F.lit(level)))
        children = pages.where(F.col("_segment").isNotNull()).groupBy("host", "template", "_segment").agg(F.count(F.lit(1)).alias("_n"))
        nodes = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("_children"), F.sum("_n").alias("_pages"))
        varies = (F.col("_children") >= LEAST_CHILDREN) & (F.col("_pages") <= F.col("_children") * MOST_REPEATS)
        nodes = nodes.where(varies).select("host", "template", F.lit(True).alias("_varies"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
        pages = pages.join(nodes, ["host", "template", "_part"], "left")
        step = F.when(F.col("_varies"), shape(F.col("_segment"))).otherwise(F.col("_segment"))
        pages = pages.withColumn("template", F.concat("template", F.coalesce(F.concat(F.lit("/"), step), F.lit("")))).drop("_varies", "_segment")
    return pages.drop("_part")


def _alike(a: list[Column], b: list[Column]) -> Column:
    """Whether a two-sample chi-square test leaves it open that two lists of counts come from one distribution."""
    total = lambda some: reduce(lambda x, y: x + y, some)
    n, m = total(a).cast("double"), total(b).cast("double")
    parts = [F.when(x + y > 0, F.pow(F.sqrt(m / n) * x - F.sqrt(n / m) * y, 2) / (x + y)).otherwise(0.0) for x, y in zip(a, b, strict=True)]
    kinds = total([(x + y > 0).cast("int") for x, y in zip(a, b, strict=True)])
    bound = F.get(F.array(*[F.lit(c) for c in CRITICAL]), F.greatest(kinds - 2, F.lit(0)))
    return (kinds == 1) | (total(parts) <= bound)


def _groups(counts: DataFrame) -> DataFrame:
    """(host, _branch, _group, _mark): the branch that each branch is merged with, and the depth and commonest shape of both."""
    shares = [F.sum(F.when(F.col("_leaf").rlike(p), F.col("n")).otherwise(0)).alias(f"_s_{k}") for k, p in SHAPES]
    branches = counts.groupBy("host", "_branch").agg(F.sum("n").alias("_all"), F.sum("b").alias("_b"), F.sum("m").alias("_m"), *shares)
    commonest = F.array_max(F.array(*[F.struct(F.col(f"_s_{k}").alias("n"), F.lit(k).alias("k")) for k, _ in SHAPES]))["k"]
    depth = F.size(F.split("_branch", "/"))
    branches = branches.withColumn("_mark", F.concat_ws(":", depth.cast("string"), commonest)).where(F.col("_all") > 0)
    best = branches.groupBy("host", "_mark").agg(F.max(F.struct("_all", "_branch", "_b", "_m", *[f"_s_{k}" for k, _ in SHAPES])).alias("_lead"))
    met = branches.join(best, ["host", "_mark"])
    same = _alike([F.col(f"_s_{k}") for k, _ in SHAPES], [F.col(f"_lead._s_{k}") for k, _ in SHAPES])
    said = _alike([F.col("_b"), F.col("_m") - F.col("_b")], [F.col("_lead._b"), F.col("_lead._m") - F.col("_lead._b")])
    same = same & ((F.col("_m") == 0) | (F.col("_lead._m") == 0) | said)
    return met.select("host", "_branch", F.when(same, F.col("_lead._branch")).otherwise(F.col("_branch")).alias("_group"), "_mark")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row of pages (page_id, url, ...).

    A null url, or one without ://, has an empty host and path and is judged with all such pages. Repeated rows each give
    a row. A table without labels rejects nothing; an empty one gives an empty one. Further columns of pages are left out.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("_said"), _segments(F.col("path")).alias("_segments"))
    rows = cut(_grown(rows).drop("_segments"))

    blocked, labelled = F.sum((F.col("_said") == "block").cast("long")), F.count("_said")
    leaf = F.regexp_extract("template", r"/([^/]*)$", 1)
    counts = rows.groupBy("host", "template").agg(F.count(F.lit(1)).alias("n"), F.coalesce(blocked, F.lit(0)).alias("b"), labelled.alias("m"))
    counts = counts.withColumn("_leaf", leaf).withColumn("_branch", F.expr("substr(template, 1, length(template) - length(_leaf))"))
    counts = counts.join(_groups(counts), ["host", "_branch"])
    wild = F.when(F.col("_leaf").startswith("{"), F.concat("_group", "_leaf")).otherwise(F.col("template"))
    counts = cut(counts.select("host", "template", "n", "b", "m", wild.alias("_merged"), F.concat_ws("/", "_mark", F.when(F.col("_leaf").startswith("{"), F.col("_leaf"))).alias("_shape")))

    sums = [F.sum("b").alias("b"), F.sum("m").alias("m")]
    overall = counts.agg(*sums).first()
    rate = (overall["b"] or 0) / max(1, overall["m"] or 0)
    shapes = counts.groupBy("_shape").agg(*sums).select("_shape", ((F.col("b") + SHAPE_PRIOR * rate) / (F.col("m") + SHAPE_PRIOR)).alias("_of_shape"))
    hosts = counts.groupBy("host").agg(F.sum("b").alias("_hb"), F.sum("m").alias("_hm")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    merged = counts.groupBy("host", "_merged", "_shape").agg(*sums).withColumn("_part", F.pmod(F.xxhash64("_merged"), F.lit(PARTS)).cast("int"))
    merged = merged.join(hosts, ["host", "_part"]).join(shapes, "_shape")
    prior = (F.col("_hb") + HOST_PRIOR * F.col("_of_shape")) / (F.col("_hm") + HOST_PRIOR)
    merged = merged.select("host", "_merged", "_shape", ((F.col("b") + TEMPLATE_PRIOR * prior) / (F.col("m") + TEMPLATE_PRIOR)).alias("purity"))
    purity = counts.select("host", "template", "_merged", "_shape").join(merged, ["host", "_merged", "_shape"]).select("host", "template", "purity")

    judged = rows.join(purity, ["host", "template"], "left")
    by_tree = F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce(F.col("_said"), by_tree).alias("verdict"), "template", "purity")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() over all pages with RULES."""
    return judge(table(spark, sf_dir, "pages"))
