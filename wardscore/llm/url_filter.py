"""URL filter with redirect equivalence: a block reaches every alias of a blocked address.

Pages name aliases by canonical links and by refresh redirects. Both are edges between addresses; connected components over
them are the classes of aliases. A class with an address that a rule blocks is blocked, but a page whose own rule allows it
stays allowed: explicit rules come first.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator, Sequence
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscore.llm.components import connected_components
from wardscore.operators.settle import land

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# An attribute ends as its own quote tells; what is possessive needs no stack in long tags.
ATTRIBUTE = r"[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>))|(?!\s*+=))"
LINK_TAG, META_TAG = (rf"(?i)<{tag}(?=[\s/])(?:[\s/]++|{ATTRIBUTE})*+>" for tag in ("link", "meta"))
NAMED = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)|(?=>)))?", re.ASCII)
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")
REFRESH_URL = re.compile(r"\s*[0-9.]*\s*[;,]\s*url\s*=\s*(?:\"([^\"]*)|'([^']*)|(.*))", re.ASCII | re.IGNORECASE | re.DOTALL)


# Scheme, host, path and query of a URL: the first :// parts scheme and host.
URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)([^#]*)"


def host_of(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z lower-cased; no :// gives an empty host."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 2), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, URL, 3), F.lit(""))


def address_of(url: Column) -> Column:
    """The key of an alias: scheme and host in lower case, then path and query; a fragment names no other document."""
    tail = F.concat(F.regexp_extract(url, URL, 3), F.regexp_extract(url, URL, 4))
    begin = F.translate(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), UPPER, LOWER)
    # A missing first slash is put in by the pattern: it stands before the first sign that is none.
    return F.when(url.contains("://"), F.concat(begin, F.regexp_replace(tail, "^(?!/)", "/")))


def resolved(href: Column, url: Column) -> Column:
    """A link's target as a full URL, seen from the page's own."""
    scheme, root = F.regexp_extract(url, URL, 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(F.regexp_extract(url, URL, 3), "(?s)^(.*/)[^/]*$", 1), "^(?!/)", "/")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.rlike("^([?#]|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(None).cast("string"))
        .otherwise(F.concat(root, folder, href))
    )


def decoded(value: str) -> str:
    """An attribute's value with its character references: a name without ; is none before = or a letter or digit."""

    def sign(found: re.Match) -> str:
        name = found[0][1:]
        if name[0] == "#" or (name in html5 and (name[-1] == ";" or value[found.end() : found.end() + 1] != "=")):
            return markup.unescape(found[0])
        return found[0]

    return REFERENCE.sub(sign, value)


def target_of(tag: str) -> str:
    """The address that a canonical link or a refresh names, trimmed; empty for other tags."""
    named: dict[str, str] = {}
    for name, *values in NAMED.findall(tag, 5):
        named.setdefault(name.lower(), decoded("".join(values)))
    if tag[:5].lower() == "<link":
        href = named.get("href", "") if "canonical" in named.get("rel", "").lower().split() else ""
    else:
        found = REFRESH_URL.match(named.get("content", "")) if named.get("http-equiv", "").strip().lower() == "refresh" else None
        href = "".join(x or "" for x in found.groups()) if found else ""
    # Line breaks and tabs are no part of an address, a space in it is written as its code.
    return re.sub(r"[\t\n\r]", "", href).strip(" \f").replace(" ", "%20")


def _targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hrefs = pa.array([target_of(tag) for tag in batch.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), hrefs], names=["url", "href"])


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) addresses of every canonical link and refresh redirect. Unreadable targets give no edge."""
    tags = [F.regexp_extract_all(F.col(html), F.lit(tag), F.lit(0)) for tag in (LINK_TAG, META_TAG)]
    # Other links and metas go no further.
    telling = F.filter(F.concat(*tags), lambda tag: tag.rlike("(?i)canonical|refresh|&"))
    found = pages.where(F.col(url).contains("://")).select(F.col(url).alias("url"), F.explode(telling).alias("tag")).distinct()
    found = found.mapInArrow(_targets, "url string, href string").where("href <> ''").distinct()
    full = found.select("url", resolved(F.col("href"), F.col("url")).alias("href")).distinct()
    edges = full.where(F.col("href").contains("://"))
    return edges.select(address_of(F.col("url")).alias("source"), address_of(F.col("href")).alias("target")).distinct()


def judged(urls: DataFrame, rules: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """``urls`` with rule and rule_verdict: those of the longest rule that fits, else null.

    Each different host is split into its parent domains once and meets the rules by equality; rows then meet their host's
    rules by equality, too. Equally long rules go by their text, equal rules by block first.
    """
    hosts = urls.select(F.col(host).alias("_host")).distinct()
    labels = F.split("_host", r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fitting = (
        hosts.select("_host", F.explode(domains).alias("_domain"))
        .join(rules.select(F.col("host").alias("_domain"), F.col("path").alias("_prefix"), "verdict", "rule"), "_domain")
        .groupBy("_host")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        (-F.length("rule")).alias("size"), "rule", F.col("verdict").alias("_x"), F.col("_prefix").alias("prefix")
                    )
                )
            ).alias("_rules")
        )
    )
    joined = urls.join(fitting, urls[host] == fitting["_host"], "left")
    best = F.element_at(F.filter("_rules", lambda r: F.col(path).startswith(r["prefix"])), 1)
    best = F.when(F.exists("_rules", lambda r: F.col(path).startswith(r["prefix"])), best)
    return joined.select(*[urls[c] for c in urls.columns], best["rule"].alias("rule"), best["_x"].alias("rule_verdict"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(verdict, host/path) rules as a table; a rule starts with its host, and its path starts at the first slash."""
    rows = [(v, r, r.split("/", 1)[0].lower(), "/" + r.split("/", 1)[1] if "/" in r else "") for v, r in rules]
    # In order, as the first of equal rules is met first: block before allow.
    rows = [row for row in sorted(rows) if row[0] == "block" or ("block", *row[1:]) not in rows]
    return spark.createDataFrame(rows, "verdict string, rule string, host string, path string")


def judge_pages(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, alias_id.

    The verdict is the page's own rule's, if one fits; else block, if any address of its alias class is blocked by a rule of
    its own; else allow. alias_id numbers the class (null: the page has no alias). A null url, or one without ://, has empty
    host and path, no alias and, unless a rule fits, allow. Repeated pages each give a row; other columns are not read.
    """
    rows = pages.select(
        F.col(key).alias("page_id"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        F.xxhash64(address_of(F.col(url))).alias("node"),
        F.when(address_of(F.col(url)).isNotNull(), F.lit(True)).alias("has_node"),
    )
    edges = land(alias_edges(pages, url, html), "aliases")
    node_of = F.xxhash64
    classes = connected_components(edges.select(node_of("source").alias("u"), node_of("target").alias("v")))
    # Every address of a class is judged by the rules, also those that are only linked to.
    ends = edges.select(F.explode(F.array("source", "target")).alias("address")).distinct()
    ends = ends.select(node_of("address").alias("node"), host_of(F.col("address")).alias("host"), path_of(F.col("address")).alias("path"))
    blocked = (
        judged(ends, rules)
        .join(classes, "node")
        .groupBy("component")
        .agg(F.max(F.col("rule_verdict") == "block").alias("blocked"))
    )
    fate = classes.join(blocked, "component").select("node", F.col("component").alias("alias_id"), "blocked")
    told = judged(rows, rules)
    told = told.withColumn("node", F.when(F.col("has_node"), F.col("node")))
    return told.join(fate, "node", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", F.when(F.col("blocked"), F.lit("block")), F.lit("allow")).alias("verdict"),
        "alias_id",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict under the fixed rules."""
    return judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES)).drop("alias_id")


ORACLE = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html, coalesce(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END, '') AS rest
  FROM pages
), cut AS (
  SELECT page_id, url, html, rest, CASE WHEN contains(url, '://') THEN
    translate(split_part(url, '://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS scheme,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail
  FROM parts
), hrefs AS (
  SELECT page_id, regexp_extract(tag, '(?i)\shref\s*=\s*["'']?([^"''\s>]+)', 1) AS href
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<link\s[^>]*>')) AS tag FROM pages)
  WHERE regexp_matches(tag, '(?i)\srel\s*=\s*["'']?canonical["''\s/>]')
  UNION ALL
  SELECT page_id, regexp_extract(tag, '(?i)\scontent\s*=\s*["'']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["'']?([^"''\s>]+)', 1)
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<meta\s[^>]*>')) AS tag FROM pages)
  WHERE regexp_matches(tag, '(?i)\shttp-equiv\s*=\s*["'']?refresh["''\s/>]')
), targets AS (
  SELECT c.scheme || '://' || c.host || CASE WHEN starts_with(c.tail, '/') THEN c.tail ELSE '/' || c.tail END AS source,
    CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN h
      WHEN starts_with(h, '//') THEN c.scheme || ':' || h
      WHEN starts_with(h, '/') THEN c.scheme || '://' || c.host || h
      WHEN regexp_matches(h, '^([?#]|[A-Za-z][A-Za-z0-9+.-]*:)') THEN NULL
      ELSE c.scheme || '://' || c.host || CASE WHEN regexp_extract(c.path, '^(.*/)[^/]*$', 1) = '' THEN '/'
        ELSE regexp_extract(c.path, '^(.*/)[^/]*$', 1) END || h END AS full_url
  FROM cut c JOIN (SELECT page_id, replace(href, '&amp;', '&') AS h FROM hrefs WHERE href <> '') USING (page_id)
  WHERE c.scheme IS NOT NULL
), ends AS (
  SELECT source, translate(split_part(full_url, '://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s,
    substr(full_url, instr(full_url, '://') + 3) AS r FROM targets WHERE full_url IS NOT NULL
), edges AS (
  SELECT source, s || '://' || translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || CASE WHEN starts_with(regexp_extract(r, '^[^/?#]*([^#]*)', 1), '/') THEN '' ELSE '/' END
    || regexp_extract(r, '^[^/?#]*([^#]*)', 1) AS target FROM ends
), both_ways AS (
  SELECT source AS u, target AS v FROM edges UNION SELECT target, source FROM edges
), rules(verdict, rule, rhost, rpath) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
    ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), nodes AS (
  SELECT DISTINCT u AS node, regexp_extract(u, '://([^/?#]*)', 1) AS host, regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path
  FROM both_ways
), node_rules AS (
  SELECT node, arg_max(verdict, length(rule)) AS verdict FROM nodes
  JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY node
), reached AS (
  SELECT node FROM node_rules WHERE verdict = 'block' UNION SELECT b.v FROM reached r JOIN both_ways b ON b.u = r.node
), page_rules AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM cut
  JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT c.page_id, c.host, c.path, p.rule, coalesce(p.verdict, CASE WHEN r.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM cut c LEFT JOIN page_rules p USING (page_id)
LEFT JOIN reached r ON r.node = c.scheme || '://' || c.host || CASE WHEN starts_with(c.tail, '/') THEN c.tail ELSE '/' || c.tail END
"""
