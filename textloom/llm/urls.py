"""URL filters with redirect equivalence, with DataFrame operations only.

A page's own rule decides first: the longest rule whose host is the page's host
or a parent domain of it and whose path starts the page's path. Pages without a
rule get the verdict of their aliases. Two URLs are aliases only where a page or
a redirect says so: it names the other as its canonical link (<link
rel=canonical>, <meta property=og:url>, <meta http-equiv=refresh>), or a table of
redirects leads from one to the other. The distributed connected components of
these edges are the alias classes. Every URL of a class is judged by the rules,
crawled or not. An explicit allow takes precedence: a class with an allowed URL
is allowed, else one with a blocked URL blocks its members without a rule; a
page that a rule fits keeps that rule's verdict, whatever its aliases are.

A URL's node is the URL itself without its fragment, with scheme and host in
lower case and an empty path as / (the forms that RFC 3986 calls equal; hosts,
paths and queries stay whole). Links that are not absolute are resolved against
the page's URL as in RFC 3986, section 5, dot segments included; &amp; stands
for & in them. <base> and tags inside scripts or comments are not told apart.

Pages without links take no part in any shuffle but the last: an equi-join with
the blocked URLs, which Spark splits where one URL has a third of all rows.

Defined cases: null urls and those without `://` have empty host and path, fit
no rule, have no alias and are allowed; a null page_id and repeated rows are
given back; null and empty html names nothing; links without a scheme that can
be fetched (mailto:, javascript:) and empty ones name nothing; an unclosed tag
ends at the next < or >; other columns don't matter, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components

#: (verdict, host, path) of the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOST, _PATH = r"^(?s).*?://([^/?#]*)", r"^(?s).*?://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def _scheme(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"^(?s)(.*?)://", 1), UPPER, LOWER)


def node(url: Column) -> Column:
    """The URL as a node of the alias graph; null for one without `://`."""
    p = path(url)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(_scheme(url), F.lit("://"), host(url), F.when(p == "", "/").otherwise(p), query))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not ('' if it is not there)."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])


def links(html: Column) -> Column:
    """array<string>: what a page names as its own URL, as it is written."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<((?:link|meta)\s[^<>]*)"), F.lit(1))

    def named(tag: Column) -> Column:
        is_link = F.lower(F.substring(tag, 1, 4)) == "link"
        refresh = F.regexp_extract(_attribute(tag, "content"), r"(?is)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*[\"']?([^\"'\s]+)", 1)
        return (
            F.when(is_link, F.when(_attribute(tag, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)"), _attribute(tag, "href")))
            .when(F.lower(_attribute(tag, "property")) == "og:url", _attribute(tag, "content"))
            .when(F.lower(_attribute(tag, "http-equiv")) == "refresh", refresh)
        )

    return F.filter(F.transform(tags, lambda t: F.replace(F.trim(named(t)), F.lit("&amp;"), F.lit("&"))), lambda u: u != "")


def _without_dots(p: Column) -> Column:
    """A path without its . and .. segments."""
    parts = F.split(p, "/")
    step = lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.lit(1), F.size(done) - 1))).otherwise(F.concat(done, F.array(s)))
    kept = F.array_join(F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), F.array(F.lit("")), step), "/")
    return F.when(p.rlike(r"/\.{1,2}(?:/|$)"), F.concat(kept, F.when(p.rlike(r"/\.{1,2}$"), "/").otherwise(""))).otherwise(p)


def resolved(base: Column, link: Column) -> Column:
    """The absolute URL that a link of the page at base stands for, or null."""
    root = F.concat(F.regexp_extract(base, r"^(?s)(.*?://[^/?#]*)", 1))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    whole = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(_scheme(base), F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(F.startswith(link, F.lit("?")), F.concat(root, path(base), link))
        .when(~F.startswith(link, F.lit("#")), F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )
    bare = F.concat(F.regexp_extract(whole, r"^(?s)(.*?://[^/?#]*)", 1), _without_dots(path(whole)), F.regexp_extract(whole, r"^[^?#]*(\?[^#]*)", 1))
    return F.when(whole.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), bare)


def best_rule(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = verdict = F.lit(None).cast("string")
    for v, rh, rp in reversed(ordered):
        fits = ((h == rh) | F.endswith(h, F.lit(f".{rh}"))) & F.startswith(p, F.lit(rp))
        rule, verdict = F.when(fits, F.lit(rh + rp)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes that a page's links or a redirect (source, target) call equal."""
    u = F.col(url).cast("string")
    page = F.col(html).cast("string")
    named = pages.where((F.instr(u, "://") > 0) & page.rlike(r"(?i)canonical|og:url|refresh")).select(u.alias("u"), links(page).alias("named")).where(F.size("named") > 0)
    edges = named.select("u", F.explode("named").alias("link")).select(node(F.col("u")).alias("a"), node(resolved(F.col("u"), F.col("link"))).alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(F.col("source")).alias("a"), node(resolved(F.col("source"), F.col("target"))).alias("b")))
    return edges.where("a IS NOT NULL AND b IS NOT NULL")


def blocked_aliases(edges: DataFrame, rules=RULES) -> DataFrame:
    """The nodes (column node) of classes with a blocked URL and no allowed one."""
    classes = connected_components(edges)
    _, verdict = best_rule(host(F.col("node")), path(F.col("node")), rules)
    judged = classes.withColumn("own", verdict).groupBy("component").agg(F.count_if(F.col("own") == "allow").alias("allowed"), F.count_if(F.col("own") == "block").alias("blocked"))
    return classes.join(judged.where("blocked > 0 AND allowed = 0"), "component", "left_semi").select("node")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, host, path, rule, verdict) of each page; redirects: (source, target) URLs."""
    u = F.col(url).cast("string")
    bad = blocked_aliases(alias_edges(pages, redirects, url, html), rules).withColumn("bad", F.lit(True))
    rule, own = best_rule(F.col("host"), F.col("path"), rules)
    base = pages.select(F.col(key).alias(key), host(u).alias("host"), path(u).alias("path"), node(u).alias("node"))
    out = base.join(bad, "node", "left").withColumn("rule", rule)
    return out.select(key, "host", "path", "rule", F.coalesce(own, F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def query(spark, sf_dir):
    from .common import table

    return judge(table(spark, sf_dir, "pages"))


#: The same by string functions, a table of rules and a recursive walk from URL to URL.
SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, coalesce(html, '') AS html, instr(url, '://') > 0 AS whole,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT *, lower(split_part(url, '://', 1)) AS scheme, least(
    CASE WHEN instr(rest, '/') > 0 THEN instr(rest, '/') ELSE length(rest) + 1 END,
    CASE WHEN instr(rest, '?') > 0 THEN instr(rest, '?') ELSE length(rest) + 1 END,
    CASE WHEN instr(rest, '#') > 0 THEN instr(rest, '#') ELSE length(rest) + 1 END) AS cut FROM p
), c AS (
  SELECT page_id, url, html, whole, scheme, translate(substr(rest, 1, cut - 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    split_part(split_part(substr(rest, cut), '#', 1), '?', 1) AS path, split_part(substr(rest, cut), '#', 1) AS tail FROM s
), rules(verdict, h, p) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')
), tag AS (
  SELECT url, scheme, host, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^<>]*')) AS t FROM c WHERE whole AND regexp_matches(html, '(?i)canonical|og:url|refresh')
), link AS (
  SELECT *, replace(trim(CASE
    WHEN regexp_matches(t, '(?is)^<link.*\srel\s*=\s*["'']?(?:[^"'']*\s)?canonical\b') THEN regexp_extract(t, '(?is)\shref\s*=\s*["'']?([^"''\s]*)', 1)
    WHEN regexp_matches(t, '(?is)^<meta.*\sproperty\s*=\s*["'']?og:url\b') THEN regexp_extract(t, '(?is)\scontent\s*=\s*["'']?([^"''\s]*)', 1)
    WHEN regexp_matches(t, '(?is)^<meta.*\shttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(t, '(?is)\scontent\s*=\s*["'']?[^"'']*\burl\s*=\s*["'']?([^"''\s]*)', 1)
    ELSE '' END), '&amp;', '&') AS l FROM tag
), target AS (
  SELECT url, CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN l WHEN l LIKE '//%' THEN scheme || ':' || l WHEN l LIKE '/%' THEN scheme || '://' || host || l
    WHEN l LIKE '?%' THEN scheme || '://' || host || path || l ELSE scheme || '://' || host || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || l END AS l
  FROM link WHERE l <> '' AND l NOT LIKE '#%'
), named AS (
  SELECT url AS source, u, unnest([0, 1]) AS side FROM (SELECT url, l AS u FROM target WHERE l LIKE '%://%')
), parts AS (
  SELECT source, side, lower(split_part(x, '://', 1)) AS scheme, substr(x, instr(x, '://') + 3) AS rest FROM (SELECT source, side, CASE side WHEN 0 THEN source ELSE u END AS x FROM named)
), nodes AS (
  SELECT source, side, host, CASE WHEN tail = '' OR tail LIKE '?%' THEN '/' || tail ELSE tail END AS tail, scheme FROM (
    SELECT source, side, scheme, lower(regexp_extract(rest, '^[^/?#]*')) AS host, split_part(regexp_replace(rest, '^[^/?#]*', ''), '#', 1) AS tail FROM parts)
), edge AS (
  SELECT DISTINCT a.scheme || '://' || a.host || a.tail AS a, b.scheme || '://' || b.host || b.tail AS b FROM nodes a JOIN nodes b ON a.source = b.source AND a.side = 0 AND b.side = 1
), both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge
), reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), said AS (
  SELECT r.a, x.verdict, row_number() OVER (PARTITION BY r.a, r.b ORDER BY length(x.h || x.p) DESC) AS best FROM reach r JOIN rules x
  ON (split_part(split_part(substr(r.b, instr(r.b, '://') + 3), '/', 1), '?', 1) = x.h OR split_part(split_part(substr(r.b, instr(r.b, '://') + 3), '/', 1), '?', 1) LIKE '%.' || x.h)
  AND starts_with(split_part(regexp_replace(r.b, '^.*?://[^/]*', ''), '?', 1), x.p)
), bad AS (SELECT a FROM said WHERE best = 1 GROUP BY a HAVING count(*) FILTER (verdict = 'block') > 0 AND count(*) FILTER (verdict = 'allow') = 0
), own AS (
  SELECT DISTINCT c.host, c.path, first_value(x.h || x.p) OVER w AS rule, first_value(x.verdict) OVER w AS verdict FROM c JOIN rules x
  ON (c.host = x.h OR c.host LIKE '%.' || x.h) AND starts_with(c.path, x.p) WINDOW w AS (PARTITION BY c.host, c.path ORDER BY length(x.h || x.p) DESC)
)
SELECT c.page_id, c.host, c.path, o.rule,
  coalesce(o.verdict, CASE WHEN c.whole AND c.scheme || '://' || c.host || CASE WHEN c.tail = '' OR c.tail LIKE '?%' THEN '/' || c.tail ELSE c.tail END IN (SELECT a FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN own o ON o.host = c.host AND o.path = c.path
"""
