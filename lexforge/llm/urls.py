"""URL filtering with redirect equivalence.

Block and allow rules name a host (with its sub-domains) and a path prefix. Redirects and canonical
links make several URLs one page; distributed connected components over those edges carry a block
decision to every alias. A rule that fits the URL itself always decides for it, and an explicit
allow anywhere in a component takes precedence over blocks that would be carried in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import connected_components


@dataclass(frozen=True)
class Rule:
    """verdict is allow or block; rule is host and path prefix in one, like example.net/en/."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]

#: Rules up to this count are compiled into the plan; a longer list is joined on host suffixes.
INLINE_RULES = 500

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def page_key(url: Column) -> Column:
    """Node of the alias graph: the URL without its fragment, host lower-cased; null without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    scheme = lower_ascii(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), rest))


def absolute(link: Column, base: Column) -> Column:
    """A link as found in a page, made absolute against the page's URL; null if it can't be."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    root = F.concat(scheme, F.lit("://"), host_of(base))
    return (
        F.when(link.isNull() | (link == ""), F.lit(None))
        .when(F.instr(link, "://") > 0, link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("#"), F.lit(None))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


CANONICAL_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(src, dst) page keys: canonical links and refresh redirects of the HTML, plus a redirect log (src, dst)."""
    tags = pages.select(
        F.col("url"),
        F.regexp_extract(F.regexp_extract("html", CANONICAL_TAG, 0), HREF, 1).alias("canonical"),
        F.regexp_extract(F.regexp_extract("html", REFRESH_TAG, 0), REFRESH_URL, 1).alias("refresh"),
    )
    links = tags.select("url", F.explode(F.array("canonical", "refresh")).alias("link")).where("link != ''")
    edges = links.select(page_key(F.col("url")).alias("src"), page_key(absolute(F.col("link"), F.col("url"))).alias("dst"))
    if redirects is not None:
        edges = edges.union(redirects.select(page_key(F.col("src")), page_key(F.col("dst"))))
    return edges.where("src is not null and dst is not null and src != dst").distinct()


def with_rule(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """urls (host, path, ...) with rule and its verdict rule_verdict: the longest rule that fits, else null.

    Equally long rules that fit one URL: allow before block, then the smaller text.
    """
    ranked = sorted(set(rules), key=lambda r: (-len(r.rule), r.verdict != "allow", r.rule))
    if len(ranked) <= INLINE_RULES:
        host, path = F.col("host"), F.col("path")
        pick = F.lit(None).cast("struct<rule:string,rule_verdict:string>")
        for r in reversed(ranked):
            fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
            pick = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("rule_verdict"))).otherwise(pick)
        return urls.withColumn("_pick", pick).select(*[F.col(c) for c in urls.columns], "_pick.rule", "_pick.rule_verdict")
    spark = urls.sparkSession
    table = spark.createDataFrame([(i, r.host, r.path, r.rule, r.verdict) for i, r in enumerate(ranked)], "place int, rule_host string, rule_path string, rule string, rule_verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("rule_host"))
    best = (
        keyed.join(table, "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path")
        .agg(F.min(F.struct("place", "rule", "rule_verdict")).alias("best"))
        .select("host", "path", "best.rule", "best.rule_verdict")
    )
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, "rule", "rule_verdict")


def filter_urls(pages: DataFrame, rules: list[Rule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, decided_by (rule, alias or default).

    Nulls: a null url, or one without ://, has an empty host and path, no rule and is allowed. A null
    html has no links. Repeated rows are judged alike, each in its own row. Only the columns page_id,
    url and html are read, so others may have any name. An empty table gives an empty result.
    """
    keyed = pages.select("page_id", page_key(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    edges = alias_edges(pages, redirects)
    ruled = with_rule(keyed, rules)
    parts = connected_components(edges)
    ends = parts.select(F.col("id").alias("node"), "component", host_of(F.col("id")).alias("host"), path_of(F.col("id")).alias("path"))
    judged = (
        with_rule(ends, rules)
        .groupBy("component")
        .agg(F.coalesce(F.bool_or(F.col("rule_verdict") == "block"), F.lit(False)).alias("blocked"), F.coalesce(F.bool_or(F.col("rule_verdict") == "allow"), F.lit(False)).alias("allowed"))
        .where("blocked and not allowed")
    )
    carried = parts.join(judged, "component", "left_semi").select(F.col("id").alias("node"), F.lit(True).alias("carried"))
    out = ruled.join(carried, "node", "left")
    return out.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.when(F.col("rule").isNotNull(), F.col("rule_verdict")).when(F.col("carried"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), F.lit("rule")).when(F.col("carried"), F.lit("alias")).otherwise(F.lit("default")).alias("decided_by"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         regexp_extract(url, '^([^#]*)', 1) AS node,
         nullif(regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1), '') AS link
  FROM pages),
rules(rule, rhost, rpath, rverdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
best AS (
  SELECT p.*, (SELECT arg_max({'rule': rule, 'v': rverdict}, length(rule)) FROM rules
               WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS r
  FROM p),
e AS (SELECT node AS a, link AS b FROM p WHERE link LIKE '%://%' UNION SELECT link, node FROM p WHERE link LIKE '%://%'),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
near AS (SELECT reach.a AS node, bool_or(best.r.v = 'block') AS blocked, bool_or(best.r.v = 'allow') AS allowed
         FROM reach JOIN best ON best.node = reach.b GROUP BY reach.a)
SELECT page_id, host, path, r.rule AS rule,
       CASE WHEN r.rule IS NOT NULL THEN r.v WHEN near.blocked AND NOT coalesce(near.allowed, false) THEN 'block' ELSE 'allow' END AS verdict
FROM best LEFT JOIN near ON near.node = best.node
"""
