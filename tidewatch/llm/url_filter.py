"""URL filter: rules by host and path, and link-graph trust for what no rule names.

A rule fits its host and all subdomains where the path starts with the rule's; the
longest wins. For other urls the host decides: trust spreads by personalised
PageRank along host edges from trusted hosts, distrust spreads against them from
blocked hosts (who links to bad hosts is suspect). A host is blocked if its distrust
is at least ``LEAST`` and above its trust.

Ranks are in units of what a seed starts with. Mass that comes to a host without links
would return to the seeds; that scales all ranks of a kind alike, so in these units it
cancels out, and neither it nor hosts and seeds that a host has no path to change the
host's verdict.

Ranks are spread until they are settled: as each step shrinks the summed change by
``DAMPING``, what is still to come is at most change * DAMPING / (1 - DAMPING). Steps
end when that is ``TOLERANCE`` or less for each kind, so no host's rank is off by more
than that. More than ``MOST_STEPS`` steps are an error.

Seeds come from the rules: a host is trusted if more of its pages are allowed by
rules than blocked, and blocked if at least half of all its pages are blocked.
Edges join the hosts of pages to those of their absolute links, weighted by number,
and are summed before anything is joined; links within a host don't count.

Everything is SQL expressions and joins. Rules are literals of the plan and limited
to ``MOST_RULES``. Ranks after each step are written to the shared folder. The DuckDB
text takes ``ORACLE_STEPS`` steps: it states the result where the links' ranks are
settled by then to the verdict, as without links between hosts.

Defined cases: a null url, or one without ://, has empty host and path and, as no
rule fits it, the verdict of the empty host; a null html has no links; rows that
repeat a page_id are judged one by one; an empty table gives no rows. Other columns of
the input are carried in ``row`` and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
MOST_RULES = 10_000
DAMPING, LEAST = 0.85, 0.1
TOLERANCE, MOST_STEPS = 1e-3, 400
ORACLE_STEPS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)<a\s[^<>]*?href\s*=\s*["']?(?:https?:)?//([^/"'?#<>\s]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def fitting(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (size, rule, verdict); null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    by_host: dict[str, list] = {}
    for rule_host, rule_path, verdict in rules:
        by_host.setdefault(rule_host, []).append(F.struct(F.lit(len(rule_host + rule_path)).alias("size"), F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(rule_path).alias("path")))
    table = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*found))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    known = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(known, lambda r: F.startswith(path, r["path"])))


def edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts: (src, dst, n)."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select(F.col("host").alias("src"), F.translate("dst", UPPER, LOWER).alias("dst")).filter("src <> dst and src <> ''")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def seeds(judged: DataFrame) -> DataFrame:
    """Starting mass (kind, host, mass) from ``judged(host, verdict)``, 1 for each seed."""
    count = judged.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    kind = F.when(F.col("good") > F.col("bad"), "trust").when(F.col("bad") * 2 >= F.col("n"), "distrust")
    return count.select(kind.alias("kind"), "host", F.lit(1.0).alias("mass")).filter("kind is not null")


def spread(scratch: common.Scratch, links: DataFrame, start: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most: int = MOST_STEPS) -> DataFrame:
    """Settled ranks (kind, host, mass) of ``links(src, dst, n)`` and seeds ``start(kind, host, mass)``, to ``tolerance``."""
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    total = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    flow = scratch.write(both.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")), "flow")
    none = F.lit(0.0)
    base = start.select("kind", "host", "mass", none.alias("was"))
    ranks, rows = start, None
    for k in range(most):
        few = ranks.withColumnRenamed("host", "src")
        few = common.small(few) if rows is None else F.broadcast(few) if rows <= common.BROADCAST_ROWS else few
        moved = flow.join(few, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"), none.alias("was"))
        before = ranks.select("kind", "host", none.alias("mass"), F.col("mass").alias("was"))
        both = scratch.write(moved.unionByName(base).unionByName(before).groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("was").alias("was")), f"ranks-{k}")
        if k:
            scratch.drop(f"ranks-{k - 1}")
        ranks = both.select("kind", "host", "mass")
        change, rows = both.groupBy("kind").agg(F.sum(F.abs(F.col("mass") - F.col("was"))).alias("c"), F.count("*").alias("n")).agg(F.max("c"), F.sum("n")).first()
        if (change or 0.0) * damping / (1 - damping) <= tolerance:
            return ranks
    raise RuntimeError(f"ranks of hosts are not settled after {most} steps: {change}")


def judge(scratch: common.Scratch, pages: DataFrame, rules=RULES, least: float = LEAST) -> DataFrame:
    """``row`` (all columns of ``pages(url, html, ...)`` but html), host, path, rule, verdict, trust and distrust."""
    keep = [F.col(f"`{c}`") for c in pages.columns if c != "html"]
    slim = pages.select(F.struct(*keep).alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    slim = scratch.write(slim.withColumn("fit", fitting(F.col("host"), F.col("path"), rules)), "slim")
    links = scratch.write(edges(pages.select(host_of(F.col("url")).alias("host"), "html")), "edges")
    start = scratch.write(seeds(slim.select("host", F.col("fit.verdict").alias("verdict"))), "seeds")
    ranks = spread(scratch, links, start)
    wide = ranks.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])
    wide = common.small(scratch.write(wide.withColumn("bad", (F.col("distrust") >= least) & (F.col("distrust") > F.col("trust"))), "hosts"))
    out = slim.join(wide, "host", "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("bad"), "block").otherwise("allow"))
    return out.select("row", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = judge(common.Scratch(spark, "url-filter"), pages)
    return out.select("row.page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    link = LINK.replace("'", "''")
    steps = "".join(f""",
r{k + 1} AS (SELECT kind, host, sum(mass) AS mass FROM (
  SELECT r.kind, f.dst AS host, r.mass * f.share * {DAMPING} AS mass FROM r{k} r JOIN flow f ON r.kind = f.kind AND r.host = f.src
  UNION ALL SELECT kind, host, mass FROM r0) GROUP BY ALL)""" for k in range(ORACLE_STEPS))
    return rf"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS html,
  translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages),
rules(h, p, v) AS (VALUES {rules}),
fits AS (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM u, rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid),
j AS (SELECT u.rid, page_id, host, path, rule, v FROM u LEFT JOIN fits USING (rid)),
c AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE v = 'allow') AS good, count(*) FILTER (WHERE v = 'block') AS bad FROM j WHERE host <> '' GROUP BY host),
k AS (SELECT host, CASE WHEN good > bad THEN 'trust' WHEN bad * 2 >= n THEN 'distrust' END AS kind FROM c),
r0 AS (SELECT kind, host, 1.0::DOUBLE AS mass FROM k WHERE kind IS NOT NULL),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM u),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst AND src <> '' GROUP BY ALL),
b AS (SELECT 'trust' AS kind, src, dst, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e),
flow AS (SELECT kind, src, dst, n::DOUBLE / sum(n) OVER (PARTITION BY kind, src) AS share FROM b){steps},
w AS (SELECT host, coalesce(sum(mass) FILTER (WHERE kind = 'trust'), 0) AS t, coalesce(sum(mass) FILTER (WHERE kind = 'distrust'), 0) AS d FROM r{ORACLE_STEPS} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(v, CASE WHEN d >= {LEAST} AND d > t THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN w ON j.host = w.host
"""


ORACLE = _oracle()
