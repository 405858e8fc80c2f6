"""URL filters with redirect equivalence.

A rule is a host and a path, as in `example.org/es/`; it fits its host and all
subdomains where the url's path starts with the rule's, and the longest fitting rule
decides. Urls that redirects or canonical links name as the same page are aliases:
connected components over those links pass decisions on to aliases that no rule of
their own decides. In a component an explicit allow of one member outweighs any block;
else a block of one member blocks the rest; a component without decisions is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hallmark.llm.components import components
from hallmark.llm.tables import step

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_REST = "^[^/?#]*"


def host_of(url: Column) -> Column:
    """From behind the first `://` to `/`, `?`, `#` or the end; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_behind(url), _REST, 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host to `?`, `#` or the end; empty without a `://`."""
    return F.coalesce(F.regexp_extract(_behind(url), _REST + "([^?#]*)", 1), F.lit(""))


def _behind(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_behind(url), "^[^?#]*([?][^#]*)", 1), F.lit(""))


def alias_links(pages: DataFrame) -> DataFrame:
    """(url, target): what the canonical links and refreshing redirects in `html` name."""
    tags = "(?is)<(?:link|meta)\\b[^>]*>"
    tag = F.explode(F.regexp_extract_all("html", F.lit(tags), F.lit(0)))
    marked = pages.where(
        F.col("url").isNotNull() & F.col("html").rlike("(?i)\\bcanonical\\b|http-equiv\\s*=\\s*[\"']?refresh")
    ).select("url", tag.alias("tag"))
    quoted = "\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)')"
    value = lambda name: F.concat(F.regexp_extract("tag", f"(?i)\\b{name}{quoted}", 1), F.regexp_extract("tag", f"(?i)\\b{name}{quoted}", 2))
    found = marked.select(
        "url",
        F.when(F.lower(value("rel")) == "canonical", value("href"))
        .when(F.lower(value("http-equiv")) == "refresh", F.regexp_extract(value("content"), "(?i)url\\s*=\\s*['\"]?([^'\"]*)", 1))
        .alias("named"),
    )
    # Tables in between keep the generated code of each step small.
    found = step(found.select("url", F.replace(F.trim("named"), F.lit("&amp;"), F.lit("&")).alias("named")))
    return step(found.select("url", _resolved(F.col("url"), F.col("named")).alias("target")).where("target is not null"))


def _resolved(base: Column, named: Column) -> Column:
    """An absolute url for a link found on the page `base`; null for an empty one."""
    scheme = F.regexp_extract(base, "^(.*?)://", 1)
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    site = F.concat(scheme, F.lit("://"), host_of(base))
    return (
        F.when(named == "", None)
        .when(F.instr(named, "://") > 0, named)
        .when(named.startswith("//"), F.concat(scheme, F.lit(":"), named))
        .when(named.startswith("/"), F.concat(site, named))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), named))
    )


def matching_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct `places` (host, path) that a rule fits.

    Every ending of the host that begins at a label, followed by every start of the
    path as long as some rule's path, is looked up among the rules; one place meets one
    row a rule, however many rules there are.
    """
    known = (
        rules.where("rule is not null and verdict is not null")
        .withColumn("rule_host", F.regexp_extract("rule", _REST, 0))
        .withColumn("size", F.length("rule") - F.length("rule_host"))
    )
    known = known.groupBy("rule").agg(F.min("verdict").alias("verdict"), F.first("size").alias("size"))
    sizes = known.agg(F.collect_set("size").alias("sizes"))
    labels = F.split("host", "\\.")
    ends = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    spots = places.where("host <> ''").select("host", "path").distinct().join(F.broadcast(sizes))
    spots = spots.select("host", "path", F.explode(F.array_distinct(ends)).alias("end"), "sizes")
    able = F.filter("sizes", lambda n: n <= F.length("path"))
    looked = spots.select("host", "path", "end", F.explode(able).alias("size")).select(
        "host", "path", F.concat("end", F.expr("substring(path, 1, size)")).alias("rule"), F.length("end").alias("depth")
    )
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "depth"))
    return (
        looked.join(known.select("rule", "verdict"), "rule")
        .groupBy("host", "path")
        .agg(best.alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )


def judged(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of `pages`.

    `rules` has (rule, verdict), `links` (url, target); without `links` those in the
    pages' html are used. A url that is null or has no `://` has an empty host and path,
    no rule, no aliases, and is allowed. Scheme and fragment are no part of what makes a
    url the same page; host, path and query are. Rules given twice with both verdicts
    allow. Rows that repeat a page are returned as often.
    """
    links = alias_links(pages) if links is None else links
    node = lambda url: F.concat(host_of(url), path_of(url), _query_of(url))
    ends = links.select(
        *[x for name in ("url", "target") for x in (node(F.col(name)).alias(name), host_of(F.col(name)).alias(f"{name}_host"), path_of(F.col(name)).alias(f"{name}_path"))]
    ).where("url_host <> '' and target_host <> ''")
    ends = step(ends.distinct())
    seen = pages.select(
        F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"), node(F.col("url")).alias("node"),
    )
    sites = ends.select("url", F.col("url_host").alias("host"), F.col("url_path").alias("path")).union(
        ends.select("target", "target_host", "target_path")
    ).distinct().withColumnRenamed("url", "node")
    ruled = step(matching_rules(seen.select("host", "path").union(sites.select("host", "path")), rules))
    named = components(ends.select(F.col("url").alias("a"), F.col("target").alias("b")))
    decided = named.join(sites.join(ruled, ["host", "path"]).select("node", "verdict"), "node")
    passed = decided.groupBy("component").agg(F.min("verdict").alias("passed"))
    aliases = named.join(passed, "component").select("node", "passed")
    return (
        seen.join(ruled, ["host", "path"], "left")
        .join(aliases, "node", "left")
        .select("page_id", "host", "path", "rule", F.coalesce("verdict", "passed", F.lit(ALLOW)).alias("verdict"))
    )
