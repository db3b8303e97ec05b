"""URL filters with redirect equivalence.

Rules name a host and the begin of a path. A rule fits its host and all subdomains; the longest that
fits decides (of equally long ones that with the longer host, then allow). Urls that no rule fits
take the verdict of their aliases: redirects (meta refresh, or a table of them) and canonical links
are edges between urls, distributed connected components make them classes, and a class with a
blocked url is blocked, unless one of its urls is explicitly allowed. All else is allowed.

Urls are one node if they differ only in scheme, letter case of the host, an empty path against
"/", or fragment.

Defined results: null, or no "://": host and path are empty, no rule fits, and there are no aliases,
so the verdict is allow; a null html has no links; repeated rows are judged one by one; an empty
table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import common
from lodestrand.llm.components import connected_components

#: Fixed values: (verdict, host, path) of the query's rules.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\bcontent\s*=\s*[\"']?\s*[\d.]*\s*[;,]\s*url\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What urls of one node have in common; null where there is no "://"."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def resolved(host: Column, path: Column, target: Column) -> Column:
    """A link's target as a whole url; host and path are those of its page."""
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "[^/]*$", "")).otherwise(F.lit("/"))
    return (
        F.when(target == "", F.lit(None))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(F.lit("http://"), host, target))
        .when(target.startswith("#"), F.lit(None))
        .when(target.startswith("?"), F.concat(F.lit("http://"), host, path, target))
        .otherwise(F.concat(F.lit("http://"), host, folder, target))
    )


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits. Rules are configuration: a
    list that its user writes, held in the plan."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "allow"))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes that a page's canonical links and meta refreshes join with its own."""
    targets = F.concat(*(F.coalesce(F.regexp_extract_all(html, F.lit(x), 1), F.array().cast("array<string>")) for x in (_CANONICAL, _REFRESH)))
    base = F.col(url)
    links = pages.select(node_of(base).alias("a"), host_of(base).alias("host"), path_of(base).alias("path"), F.explode(targets).alias("target")).where("a is not null")
    target = F.trim(F.regexp_replace("target", "(?i)&amp;", "&"))
    # An explode between the steps keeps the optimizer from writing each step's code into the next many times over.
    links = links.select("a", "host", "path", F.explode(F.array(target)).alias("target"))
    links = links.select("a", F.explode(F.array(resolved(F.col("host"), F.col("path"), F.col("target")))).alias("target"))
    return links.select("a", node_of(F.col("target")).alias("b")).where("a <> b").distinct()


def alias_verdicts(edges: DataFrame, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(node, inherited): allow or block, for the nodes whose class has a url that a rule fits."""
    classes = connected_components(edges)
    url = F.concat(F.lit("x://"), F.col("node"))
    own = rule_of(host_of(url), path_of(url), rules)[1]
    decided = classes.withColumn("own", own).groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"), F.count("*").alias("nodes"))
    inherited = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
    decided = common.written(decided.select("component", inherited.alias("inherited"), "nodes").where("inherited is not null"), "decided")
    # A component may hold a third of all nodes: those of the largest stay where they are.
    return common.hot_join(classes, decided, "component", "nodes").select("node", "inherited")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url", html: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, inherited) of every page. redirects: urls (a, b)."""
    edges = [link_edges(pages, url, html)] if html else []
    if redirects is not None:
        edges.append(redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).where("a <> b"))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), node_of(F.col(url)).alias("node"))
    judged = judged.withColumns({"rule": rule, "own": verdict})
    if edges:
        # Many pages may have one url, or none that is a node.
        linked, alone = judged.where("node is not null"), judged.where("node is null").withColumn("inherited", F.lit(None).cast("string"))
        pages_of = linked.groupBy("node").agg(F.count("*").alias("pages"))
        aliases = common.written(alias_verdicts(reduce(DataFrame.union, edges), rules).join(pages_of, "node"), "aliases")
        judged = common.hot_join(linked, aliases, "node", "pages", "left").drop("pages").unionByName(alone)
    else:
        judged = judged.withColumn("inherited", F.lit(None).cast("string"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", "inherited", F.lit("allow")).alias("verdict"), "inherited")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages).drop("inherited")


def _rules_sql(column: str, host: str, path: str) -> str:
    """CASE over the rules, the longest first."""
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "allow"))
    whens = (f"WHEN ({host} = '{h}' OR {host} LIKE '%.{h}') AND starts_with({path}, '{p}') THEN '{h + p if column == 'rule' else v}'" for v, h, p in ordered)
    return f"CASE {' '.join(whens)} END"


#: DuckDB: the same edges, closed by recursion.
ORACLE = f"""
WITH RECURSIVE p AS (
  SELECT row_number() OVER () AS row_no, page_id, url, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS rest FROM pages
), n AS (SELECT *, CASE WHEN contains(url, '://') THEN host || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS node FROM p),
tags AS (
  SELECT node, host, path, unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*>')) AS tag, '(?is)\\brel\\s*=\\s*["'']?canonical\\b' AS must, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)' AS grab FROM n WHERE node IS NOT NULL
  UNION ALL
  SELECT node, host, path, unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*>')), '(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b', '(?is)\\bcontent\\s*=\\s*["'']?\\s*[\\d.]*\\s*[;,]\\s*url\\s*=\\s*["'']?([^"''\\s>]+)' FROM n WHERE node IS NOT NULL
), targets AS (
  SELECT node, host, path, trim(regexp_replace(regexp_extract(tag, grab, 1), '(?i)&amp;', '&', 'g')) AS t FROM tags WHERE regexp_matches(tag, must) AND regexp_matches(tag, grab)
), whole AS (
  SELECT node, CASE WHEN t = '' OR starts_with(t, '#') THEN NULL WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t
    WHEN starts_with(t, '/') THEN 'http://' || host || t WHEN starts_with(t, '?') THEN 'http://' || host || path || t
    ELSE 'http://' || host || CASE WHEN contains(path, '/') THEN regexp_replace(path, '[^/]*$', '') ELSE '/' END || t END AS url FROM targets
), ends AS (
  SELECT node AS a, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS rest FROM whole WHERE contains(url, '://')
), edges AS (SELECT DISTINCT a, host || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS b FROM ends),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
seen AS (SELECT a, {_rules_sql("verdict", "regexp_extract(b, '^[^/]*')", "regexp_replace(substr(b, length(regexp_extract(b, '^[^/]*')) + 1), '[?].*$', '', 's')")} AS v FROM reach),
inherited AS (SELECT a, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v FROM seen GROUP BY a)
SELECT page_id, n.host, n.path, {_rules_sql("rule", "n.host", "n.path")} AS rule, coalesce({_rules_sql("verdict", "n.host", "n.path")}, i.v, 'allow') AS verdict
FROM n LEFT JOIN inherited i ON n.node = i.a
"""
