"""URL filtering by rules and by trust and distrust that spread over the host graph.

Rules decide the urls they fit. The others are judged by their host: personalised PageRank starts at hosts in
proportion to their urls that a rule allows and follows links; distrust starts at hosts in proportion to their
blocked urls and follows links backwards. A host is blocked where its distrust is more than ``THRESHOLD`` of the two.

Host edges are the absolute links of a page, and a host and its parent domain both ways, but for domains of a
country's registry, which would join strangers; they are counted per pair of hosts before anything is joined. Both walks advance in one join per step. What reaches a host without a way out
returns to the seeds: for a personalised walk that is the same as bringing the ranks to a sum of one at the end. After
``STEPS`` steps the ranks are within 2 * DAMPING ** STEPS of the fixed point on any graph. Pages of a host that has
more than one in ``HEAVY_PART`` of all pages are judged by broadcast; there are fewer than ``HEAVY_PART`` such hosts.

Cases: a null url or one without ``://`` has an empty host and path, and is blocked as malformed; a host that no walk
reaches is allowed; a null html has no links; repeated rows give a row each and count each in the seeds; an empty table gives
no rows; other input columns are not read. All work is DataFrame operations.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import common

DAMPING = 0.85
STEPS = 40
THRESHOLD = 0.5
HEAVY_PART = 1000
#: Steps after which ranks are written to the shared folder, which ends their lineage.
CUT_EVERY = 10

ALLOW, BLOCK = "allow", "block"
# fixed values: labels under which countries' registries let names to anybody
REGISTRIES = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = [
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_rule(rules: list[Rule], value) -> Column:
    out = None
    for r in sorted(rules, key=lambda r: -len(r.host + r.path)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, value(r)) if out is None else out.when(fits, value(r))
    return out if out is not None else F.lit(None).cast("string")


def judged(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, and the rule and its verdict (both null where none fits)."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return split.select(
        "page_id", "host", "path",
        _by_rule(rules, lambda r: r.host + r.path).alias("rule"),
        _by_rule(rules, lambda r: r.verdict).alias("ruled"),
    )


def parents(hosts: DataFrame) -> DataFrame:
    """(host, parent) for every step from each host up to its last two labels; an empty label ends the way.

    A parent such as ``co.uk``, under which anybody has names, is nobody's: the way ends below it.
    """
    labels = F.split("host", r"\.")
    empty = F.array_position(labels, "")
    full = F.when(empty > 0, empty - 1).otherwise(F.size(labels)).cast("int")
    steps = hosts.select(labels.alias("labels"), full.alias("full")).where("full >= 3")
    steps = steps.select("labels", F.explode(F.sequence(F.lit(1), F.col("full") - 2)).alias("at"))
    below = lambda at: F.array_join(F.slice("labels", at, F.size("labels")), ".")
    steps = steps.select(below(F.col("at")).alias("host"), below(F.col("at") + 1).alias("parent"))
    return steps.where(~F.col("parent").rlike(rf"^({'|'.join(REGISTRIES)})\.[a-z]{{2}}$"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts, one row per pair."""
    links = pages.select(
        host_of(F.col("url")).alias("src"),
        F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lower_ascii))).alias("dst"),
    ).where("src <> '' and src <> dst")
    links = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).union(links.select("dst")).where("host <> ''").distinct()
    tree = parents(hosts).distinct()
    both = tree.select(F.explode(F.array(F.struct("host", "parent"), F.struct(F.col("parent").alias("host"), F.col("host").alias("parent")))).alias("e"))
    near = both.select("e.host", "e.parent", F.lit(1.0))
    return links.union(near).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(host, trust, distrust): both walks from ``seeds`` (host, walk, mass), where walk 0 follows edges and 1 goes back."""
    walks = edges.select(F.lit(0).alias("walk"), "src", "dst", "weight").union(
        edges.select(F.lit(1), F.col("dst"), F.col("src"), F.col("weight"))
    )
    out = walks.groupBy("walk", "src").agg(F.sum("weight").alias("total"))
    walks = walks.join(out, ["walk", "src"]).select("walk", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("total")).alias("share"))
    walks = common.settle(walks, "host-walks")
    total = seeds.groupBy("walk").agg(F.sum("mass").alias("all"))
    start = seeds.join(F.broadcast(total), "walk").select("walk", "host", (F.col("mass") / F.col("all")).alias("rank"))  # two rows
    start = common.settle(start, "host-seeds")
    rank = start
    for step in range(1, steps + 1):
        moved = rank.join(walks, ["walk", "host"]).select("walk", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        back = start.select("walk", "host", (F.col("rank") * (1 - damping)).alias("rank"))
        rank = moved.union(back).groupBy("walk", "host").agg(F.sum("rank").alias("rank"))
        if step % CUT_EVERY == 0 and step < steps:
            rank = common.settle(rank, "host-ranks")
    rank = common.settle(rank, "host-ranks")
    total = rank.groupBy("walk").agg(F.sum("rank").alias("all"))  # two rows
    rank = rank.join(F.broadcast(total), "walk").withColumn("rank", F.col("rank") / F.col("all"))
    mass = lambda walk: F.sum(F.when(F.col("walk") == walk, F.col("rank")).otherwise(0.0))
    return rank.groupBy("host").agg(mass(0).alias("trust"), mass(1).alias("distrust"))


def with_ranks(rows: DataFrame, ranks: DataFrame, part: int = HEAVY_PART) -> DataFrame:
    """``rows`` with the ranks of their hosts, null where no walk came; hosts of many rows are not shuffled."""
    ranks = common.settle(ranks, "host-trust")
    counts = rows.groupBy("host").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))  # one row
    heavy = counts.join(F.broadcast(total)).where(F.col("n") * part > F.col("all")).select("host").join(ranks, "host", "left")
    heavy = common.settle(heavy, "heavy-hosts")  # fewer than `part` rows
    hot = rows.join(F.broadcast(heavy), "host")
    cold = rows.join(F.broadcast(heavy.select("host")), "host", "left_anti").join(ranks, "host", "left")
    return hot.unionByName(cold)


def filter_urls(pages: DataFrame, rules: list[Rule] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    rows = judged(pages, rules)
    seeds = (
        rows.where("ruled is not null and host <> ''")
        .groupBy("host", F.when(F.col("ruled") == ALLOW, 0).otherwise(1).alias("walk"))
        .agg(F.count("*").cast("double").alias("mass"))
    )
    ranks = propagate(host_edges(pages), seeds)
    by_host = F.when(F.col("host") == "", BLOCK).when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), BLOCK).otherwise(ALLOW)
    return with_ranks(rows, ranks).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op3_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.read_table(spark, sf_dir, "pages"))
