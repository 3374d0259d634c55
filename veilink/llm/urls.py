"""URL rules with redirect equivalence.

Rules block or allow hosts and path prefixes.  Pages that point at one another by canonical links, refreshes or a given
table of redirects are aliases: a distributed connected-components run over these edges puts them in classes, and what
the rules say about any address of a class holds for its members without a rule of their own.  An explicit allow
anywhere in the class takes precedence over a block, a page's own rule over its class, and a page that nothing is said
about is allowed.

Defined results: a null url, or one without ``://``, has empty host and path, no aliases and no rule; repeated pages are
judged alike; columns other than id, url and html are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from veilink.llm.components import components

# (verdict, rule): host, then the path from its first slash
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does.  ``rules`` is a list written by hand."""
    said = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        said = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(said)
    return said


def address(url: Column) -> Column:
    """What identifies an address: host, path and query; null without ``://``."""
    query = F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.concat(F.lit("x://"), host_of(url), path, query))


def absolute(link: Column, url: Column) -> Column:
    """A link of a page as a full address."""
    folder = F.regexp_extract(path_of(url), "^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(link == "", F.lit(None))
        .when(F.instr(link, "://") > 0, link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("x:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(F.lit("x://"), host_of(url), link))
        .otherwise(F.concat(F.lit("x://"), host_of(url), folder, link))
    )


def _first_tag(html: Column, tag: str, with_text: str) -> Column:
    tags = F.regexp_extract_all(html, F.lit(rf"(?i)<{tag}\s[^>]*>"), F.lit(0))
    return F.get(F.filter(tags, lambda t: t.rlike(with_text)), 0)


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): addresses tied by a page's canonical link or by its refresh."""
    canonical = F.regexp_extract(_first_tag(F.col(html), "link", r"(?i)\srel\s*=\s*.?canonical"), r"(?i)\shref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(_first_tag(F.col(html), "meta", r"(?i)http-equiv\s*=\s*.?refresh"), r"(?i)url\s*=\s*[\"']?([^\"'\s>]+)", 1)
    targets = pages.select(F.col(url).alias("u"), F.explode(F.array(canonical, refresh)).alias("link"))
    return targets.select(address(F.col("u")).alias("a"), address(absolute(F.col("link"), F.col("u"))).alias("b")).where(
        "a IS NOT NULL AND b IS NOT NULL AND a <> b"
    )


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, redirects: DataFrame | None = None,
    id_col: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``redirects`` adds edges (from_url, to_url)."""
    edges = page_links(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(
            redirects.select(address(F.col("from_url")).alias("a"), address(F.col("to_url")).alias("b")).where("a <> b")
        )
    members = components(edges)
    said = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    classes = members.withColumn("said", said).groupBy("component").agg(
        F.when(F.bool_or(F.col("said") == "allow"), "allow").when(F.bool_or(F.col("said") == "block"), "block").alias("class_verdict")
    )
    ruled = members.join(classes.where("class_verdict IS NOT NULL"), "component").select(F.col("node").alias("_at"), "class_verdict")
    judged = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("_url")).select(
        "page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), address(F.col("_url")).alias("_at"),
    ).withColumn("_said", rule_of(F.col("host"), F.col("path"), rules))
    return judged.join(ruled, "_at", "left").select(
        "page_id", "host", "path", F.col("_said.rule").alias("rule"),
        F.coalesce("_said.verdict", "class_verdict", F.lit("allow")).alias("verdict"),
    )


SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
tags AS (
  SELECT url, host, path,
    list_filter(regexp_extract_all(html, '(?i)<link\s[^>]*>'), lambda t: regexp_matches(t, '(?i)\srel\s*=\s*.?canonical'))[1] AS can,
    list_filter(regexp_extract_all(html, '(?i)<meta\s[^>]*>'), lambda t: regexp_matches(t, '(?i)http-equiv\s*=\s*.?refresh'))[1] AS ref
  FROM parts WHERE url LIKE '%://%'),
links AS (
  SELECT url, host, path, regexp_extract(can, '(?i)\shref\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM tags
  UNION ALL SELECT url, host, path, regexp_extract(ref, '(?i)url\s*=\s*["'']?([^"''\s>]+)', 1) FROM tags),
full_links AS (
  SELECT url, CASE WHEN link LIKE '%://%' THEN link WHEN link LIKE '//%' THEN 'x:' || link
    WHEN link LIKE '/%' THEN 'x://' || host || link
    ELSE 'x://' || host || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || link END AS target
  FROM links WHERE link <> ''),
ends AS (SELECT url AS x, target AS y FROM full_links),
spots AS (
  SELECT u, 'x://' || translate(regexp_extract(u, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || coalesce(nullif(regexp_extract(u, '://[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract(u, '://[^?#]*(\?[^#]*)', 1) AS a
  FROM (SELECT url AS u FROM parts WHERE url LIKE '%://%' UNION SELECT y FROM ends)),
edges AS (SELECT f.a AS a, t.a AS b FROM ends JOIN spots f ON f.u = x JOIN spots t ON t.u = y WHERE f.a <> t.a),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b),
rules(verdict, rule, rhost, rpath) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
places AS (
  SELECT DISTINCT a, regexp_extract(a, '://([^/?#]*)', 1) AS h, regexp_extract(a, '://[^/?#]*([^?#]*)', 1) AS p FROM spots),
said AS (
  SELECT a, arg_max(verdict, length(rule)) AS v FROM places JOIN rules ON (h = rhost OR ends_with(h, '.' || rhost)) AND starts_with(p, rpath)
  GROUP BY a),
class AS (
  SELECT r.a, CASE WHEN bool_or(v = 'allow') THEN 'allow' ELSE 'block' END AS cv
  FROM (SELECT a, b FROM reach UNION SELECT a, a FROM both_ways) r JOIN said s ON s.a = r.b GROUP BY r.a),
own AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS v
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, o.rule, coalesce(o.v, c.cv, 'allow') AS verdict
FROM parts p LEFT JOIN own o USING (page_id) LEFT JOIN spots ON spots.u = p.url LEFT JOIN class c ON c.a = spots.a
"""
