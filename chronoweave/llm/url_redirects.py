"""URL filters with redirect equivalence (DataFrame operations only).

Rules judge urls by host and path. Redirect and canonical-link edges join urls into classes of
aliases; a block found on one alias holds for all, unless an allow rule stands on one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronoweave.llm.graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A rule list up to this length is written into the plan; longer ones are refused.
MOST_RULES = 1000


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null. Ties: longer host, then allow."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} can be written into a plan")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "allow"))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in reversed(ordered):
        on_host = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        fits = on_host & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _without_dots(path: Column) -> Column:
    """A path from the root without its `.` and `..` segments."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    parts = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    kept = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def _absolute(link: Column, url: Column) -> Column:
    """A link as a url, resolved against the page's: null if it has another scheme form (`mailto:x`) or the page's url has no `://`."""
    root = F.concat(F.nullif(F.regexp_extract(url, r"(?s)^(.*?://)", 1), F.lit("")), url_host(url))
    path, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(url_path(url), r"(?s)^/(.*/)", 1))
    return (
        F.when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), link)
        .when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None).cast("string"))
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, _without_dots(path), rest))
        .when(path == "", F.concat(root, url_path(url), rest))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), rest))
    )


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)(?<![\w-]){name}\s*=\s*(?:\"\s*([^\"]*?)\s*\"|'\s*([^']*?)\s*'|([^\"'\s>]+))"
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def page_edges(pages: DataFrame) -> DataFrame:
    """src, dst urls of all canonical links and refresh redirects in html, relative ones by the page's base."""
    tags = lambda name: F.regexp_extract_all("html", F.lit(rf"(?is)<{name}[\s/][^>]*>"), F.lit(0))
    is_canonical = lambda t: F.rlike(_attribute(t, "rel"), F.lit(r"(?i)(?:^|\s)canonical(?:\s|$)"))
    is_refresh = lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh"
    target = lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    canonical = F.transform(F.filter(tags("link"), is_canonical), lambda t: _attribute(t, "href"))
    refresh = F.transform(F.filter(tags("meta"), is_refresh), target)
    base = _attribute(F.regexp_extract("html", r"(?is)<base[\s/][^>]*\bhref\b[^>]*>", 0), "href")
    links = pages.select("url", base.alias("base"), F.explode(F.concat(canonical, refresh)).alias("link")).where("link <> ''")
    links = links.withColumn("base", F.when(F.col("base") != "", _absolute(F.col("base"), F.col("url"))))
    return links.select(F.col("url").alias("src"), _absolute(F.col("link"), F.coalesce("base", "url")).alias("dst")).where("dst is not null")


def judge_pages(pages: DataFrame, edges: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, class_verdict for each row of pages.

    A rule fits its host and all subdomains where the url's path starts with the rule's; the
    longest wins. Without a rule of its own a page takes its class's verdict: allow if any alias
    has an allow rule, else block if any has a block rule, else allow. edges (src, dst urls) are
    the page_edges() of pages and those given. Urls that differ in scheme, query or fragment only
    are one node. Null urls and urls without `://` have an empty host and path and no alias.
    Repeated rows get equal results; columns other than page_id, url and html are passed over.
    """
    links = page_edges(pages) if "html" in pages.columns else None
    if edges is not None:
        given = edges.select("src", "dst")
        links = given if links is None else links.unionByName(given)
    found = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = found.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("node", F.when(F.col("host") != "", F.concat("host", "path")))
    if links is None:
        judged = judged.withColumn("class_verdict", F.lit(None).cast("string"))
    else:
        node = lambda c: F.concat(url_host(F.col(c)), url_path(F.col(c)))
        pairs = links.select(node("src").alias("u"), node("dst").alias("v")).where("u <> '' and v <> ''")
        classes = components(pairs)
        slash = F.instr("node", "/")
        host = F.when(slash > 0, F.expr("substring(node, 1, instr(node, '/') - 1)")).otherwise(F.col("node"))
        path = F.when(slash > 0, F.expr("substring(node, instr(node, '/'))")).otherwise(F.lit(""))
        ruled = classes.withColumn("verdict", best_rule(host, path, rules)["verdict"])
        by_class = ruled.groupBy("component").agg(F.min("verdict").alias("class_verdict"))  # allow sorts before block
        alias = classes.join(by_class, "component").select("node", "class_verdict")
        judged = judged.join(alias, "node", "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.col("class_verdict"), F.lit("allow")).alias("verdict"),
        "class_verdict",
    )


def _attribute_sql(tag: str, name: str) -> str:
    pattern = rf"""'(?is)(?:^|[^\w-]){name}\s*=\s*(?:"\s*([^"]*?)\s*"|''\s*([^'']*?)\s*''|([^"''\s>]+))'"""
    return "(" + " || ".join(f"regexp_extract({tag}, {pattern}, {k})" for k in (1, 2, 3)) + ")"


def _folded_sql(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def _host_sql(url: str) -> str:
    return _folded_sql(f"regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")


def _path_sql(url: str) -> str:
    return f"regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"


def _without_dots_sql(path: str) -> str:
    parts = f"list_concat(string_split({path}, '/')[2:], CASE WHEN string_split({path}, '/')[-1] IN ('.', '..') THEN [''] ELSE [] END)"
    walk = "lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN x = '.' THEN acc ELSE acc || '/' || x END"
    return f"coalesce(nullif(list_reduce(list_concat([''], {parts}), {walk}), ''), '/')"


def _absolute_sql(link: str, url: str) -> str:
    root = f"nullif(regexp_extract({url}, '(?s)^(.*?://)', 1), '') || {_host_sql(url)}"
    path, rest = f"regexp_extract({link}, '(?s)^([^?#]*)', 1)", f"regexp_extract({link}, '(?s)^[^?#]*(.*)$', 1)"
    folder = f"'/' || regexp_extract({_path_sql(url)}, '(?s)^/(.*/)', 1) || {path}"
    return f"""CASE WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {link} WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
      WHEN starts_with({link}, '//') THEN regexp_extract({url}, '(?s)^(.*?:)//', 1) || {link} WHEN starts_with({link}, '/') THEN {root} || {_without_dots_sql(path)} || {rest}
      WHEN {path} = '' THEN {root} || {_path_sql(url)} || {rest} ELSE {root} || {_without_dots_sql(folder)} || {rest} END"""


#: DuckDB text of judge_pages() over pages.
URL_SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, url, html, coalesce({_host_sql('url')}, '') AS host, coalesce({_path_sql('url')}, '') AS path FROM pages),
r(verdict, rh, rp) AS (VALUES {', '.join(f"('{v}', '{h}', '{x}')" for v, h, x in RULES)}),
t AS (SELECT url, html, 'link' AS kind, unnest(regexp_extract_all(html, '(?is)<link[\s/][^>]*>')) AS tag FROM p
  UNION ALL SELECT url, html, 'meta', unnest(regexp_extract_all(html, '(?is)<meta[\s/][^>]*>')) FROM p),
l AS (SELECT url, CASE WHEN kind = 'link' THEN {_attribute_sql('tag', 'href')} ELSE regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS link,
    nullif({_attribute_sql(r"regexp_extract(html, '(?is)<base[\s/][^>]*\bhref\b[^>]*>')", 'href')}, '') AS base FROM t
  WHERE (kind = 'link' AND regexp_matches({_attribute_sql('tag', 'rel')}, '(?i)(?:^|\s)canonical(?:\s|$)')) OR (kind = 'meta' AND lower({_attribute_sql('tag', 'http-equiv')}) = 'refresh')),
a AS (SELECT url, link, coalesce({_absolute_sql('base', 'url')}, url) AS root FROM l WHERE link <> ''),
d AS (SELECT url, {_absolute_sql('link', 'root')} AS dst FROM a),
e AS (SELECT DISTINCT {_host_sql('url')} || {_path_sql('url')} AS u, {_host_sql('dst')} || {_path_sql('dst')} AS v FROM d WHERE dst IS NOT NULL),
b AS (SELECT u, v FROM e WHERE u <> '' AND v <> '' AND u <> v UNION SELECT v, u FROM e WHERE u <> '' AND v <> '' AND u <> v),
c(node, seen) AS (SELECT DISTINCT u, u FROM b UNION SELECT b.v, c.seen FROM c JOIN b ON b.u = c.node),
k AS (SELECT node, min(seen) AS component FROM c GROUP BY node),
n AS (SELECT node, component, regexp_extract(node, '(?s)^([^/]*)', 1) AS host, regexp_extract(node, '(?s)^[^/]*(.*)$', 1) AS path FROM k),
f AS (SELECT host, path FROM p UNION SELECT host, path FROM n),
g AS (SELECT host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(r.verdict, length(rh || rp)) AS verdict
    FROM f JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path),
q AS (SELECT component, min(verdict) AS class_verdict FROM n JOIN g USING (host, path) GROUP BY component)
SELECT page_id, p.host, p.path, rule, coalesce(g.verdict, class_verdict, 'allow') AS verdict, class_verdict
FROM p LEFT JOIN g ON p.host = g.host AND p.path = g.path LEFT JOIN k ON p.host <> '' AND k.node = p.host || p.path LEFT JOIN q USING (component)
"""
