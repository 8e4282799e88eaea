"""URL filters whose block decisions reach every alias of a url, DataFrame operations only.

A rule (host, path, verdict) fits the urls of its host and of all its subdomains
whose path starts with the rule's.  Of several that fit the longest wins: by its
text, then by its host; of equal ones with both verdicts, allow.  Rules are found by
equi joins: a url has one key for each shape of rules (labels of the host, length of
the path) and meets the rules of that very key, so no url is held against all rules.

Urls are aliases when a chain of redirects and canonical links connects them,
whichever way these point: links are read from the pages (``<link rel=canonical>``
and ``<meta http-equiv=refresh>``) and from a table of redirects.  Connected
components of the links are the classes of aliases.  A url that a rule fits has that
rule's verdict, so an explicit allow precedes whatever its aliases say; any other url
is blocked if an alias of it is blocked by a rule, whether that alias is a page or
just the end of a link, and allowed otherwise.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
A-Z as a-z; the path goes on from there up to ``?``, ``#`` or the end.  A null url,
or one without ``://``, has neither, fits no rule, has no aliases and is allowed.
Urls that differ after ``#`` or in the letter case of scheme and host are one.
Relative links are resolved against their page's url.  Null pages have no links.
Rows stay as they are, repeated ones too; rules with a null in them do not count;
extra columns of pages are ignored, also ones named like the results (these cannot be carried).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locus.llm.components import connected
from locus.sources.shared import materialised, scratch

BROADCAST_ROWS = 100_000


def lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(lower(F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The url without what follows #, scheme and host in lower case; null without ://."""
    bare = F.regexp_extract(url, "^([^#]*)", 1)
    head = F.regexp_extract(bare, "^((?s:.*?)://[^/?]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(lower(head), F.substring(bare, F.length(head) + 1, F.length(bare))))


def resolved(link: Column, url: Column) -> Column:
    """The link as an absolute url, seen from the page at url."""
    scheme, site = F.regexp_extract(url, "^((?s:.*?):)//", 1), F.regexp_extract(url, "^((?s:.*?)://[^/?#]*)", 1)
    path = path_of(url)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "^((?s:.*)/)", 1))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path, link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(site, folder, link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """from_url, to_url of the canonical links and refreshes in the pages' html."""
    tags = F.regexp_extract_all("html", F.lit("(?is)<(?:link|meta)\\s[^<>]*>"), F.lit(0))
    value = "\\s*=\\s*[\"']?\\s*"
    canonical = F.filter(tags, lambda t: t.rlike(f"(?is)^<link.*\\brel{value}canonical\\b"))
    refresh = F.filter(tags, lambda t: t.rlike(f"(?is)^<meta.*\\bhttp-equiv{value}refresh\\b"))
    found = F.concat(
        F.transform(canonical, lambda t: F.regexp_extract(t, f"(?is)\\bhref{value}([^\"'\\s>]+)", 1)),
        F.transform(refresh, lambda t: F.regexp_extract(t, f"(?is)\\burl{value}([^\"'\\s>]+)", 1)),
    )
    marked = pages.where(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|refresh"))
    link = F.replace(F.col("link"), F.lit("&amp;"), F.lit("&"))
    return marked.select("url", F.explode(found).alias("link")).where("link <> ''").select(F.col("url").alias("from_url"), resolved(link, F.col("url")).alias("to_url"))


def edges(pages: DataFrame, redirects: DataFrame | None) -> DataFrame:
    """a, b: distinct links between different urls."""
    found = page_links(pages)
    if redirects is not None:
        found = found.unionByName(redirects.select("from_url", "to_url"))
    ends = found.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"))
    return ends.where("a <> b").distinct()


def ruled(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict of those distinct (host, path) that a rule fits."""
    known = rules.select(lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).dropna()
    known = known.withColumns({"rule": F.concat("rule_host", "rule_path"), "labels": F.size(F.split("rule_host", "\\.")), "length": F.length("rule_path")})
    shapes = [(r.labels, r.length) for r in known.select("labels", "length").distinct().collect()]  # few, however many rules there are
    if not shapes:
        return sites.where("false").select("host", "path", F.lit("").alias("rule"), F.lit("").alias("rule_verdict"))
    few = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    labels = F.size(F.split("host", "\\."))
    keys = F.array_distinct(F.filter(F.array(*(F.when((labels >= n) & (F.length("path") >= size), F.concat(F.substring_index("host", ".", -n), F.left("path", F.lit(size)))) for n, size in shapes)), lambda k: k.isNotNull()))
    # A rule's text tells its host from its path: the path begins at the first slash, or is empty.
    met = sites.select("host", "path", F.explode(keys).alias("rule")).join(few, "rule")
    fits = (F.expr("substring_index(host, '.', -labels)") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path"))
    best = F.max(F.struct(F.length("rule"), F.length("rule_host"), (F.col("rule_verdict") == "allow"), "rule", "rule_verdict"))
    return met.where(fits).groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.rule_verdict")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """host, path, rule (null if none fits), verdict (allow or block) of every row of pages (url, html), after the columns to carry; rules: host, path, verdict; redirects: from_url, to_url."""
    if clash := {"host", "path", "rule", "verdict"} & set(carry):
        raise ValueError(f"named like results: {sorted(clash)}")
    with scratch(pages.sparkSession) as folder:
        return materialised(_judged(pages, rules, redirects, carry, folder))


def _judged(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None, carry: tuple[str, ...], folder: str) -> DataFrame:
    links = materialised(edges(pages.select("url", "html"), redirects), folder)
    ends = links.select(F.col("a").alias("url")).union(links.select("b")).distinct()
    sites = pages.select("url").unionByName(ends).select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> '' or path <> ''").distinct()
    decided = materialised(ruled(sites, rules), folder)

    def name(url: str | Column) -> Column:
        return F.unhex(F.md5(url))

    classes = connected(links.select(name("a").alias("a"), name("b").alias("b")), folder)
    aliases = ends.select(name("url").alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).join(decided, ["host", "path"])
    blocked = aliases.where("rule_verdict = 'block'").select("node").join(classes, "node").select("class").distinct()
    tainted = materialised(classes.join(blocked, "class", "left_semi").select("node", F.lit(True).alias("tainted")), folder)
    tainted = F.broadcast(tainted) if tainted.count() <= BROADCAST_ROWS else tainted

    own = {f"carried_{k}": F.col(c) for k, c in enumerate(carry)}
    rows = pages.select(*(c.alias(n) for n, c in own.items()), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), name(node_of(F.col("url"))).alias("node"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("tainted"), "block"), F.lit("allow"))
    return rows.join(decided, ["host", "path"], "left").join(tainted, "node", "left").select(*(F.col(n).alias(c) for n, c in zip(own, carry, strict=True)), "host", "path", "rule", verdict.alias("verdict"))
