"""URL filters with redirect equivalence.

Block and allow rules name a host (with all its subdomains) and a path prefix; the longest rule that
fits a URL decides. URLs that no rule fits are judged by their aliases: redirects (meta refresh) and
canonical links are edges between URLs, and every connected component passes its members' rule
decisions on. An explicit allow in a component takes precedence over any block; without either the
verdict is allow.

A URL's node is its host in lower case, its path and its query; scheme and fragment don't count.
Null or malformed URLs have empty host and path, no node and no alias. All canonical links and
refreshes of a page count, as an HTML parser sees them: not those in comments, scripts, styles or
quoted attributes, with character references decoded and rel read as a list of words. Targets are
resolved against the page's URL, or its base element, with dot segments; what cannot be resolved is
no link. Only pages that mention either word are parsed; a page is parsed whole, however long.
Repeated rows and URLs give repeated results; null html is empty; an empty table gives an empty
result; further columns are ignored. Edges and components stay distributed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.llm.components import components
from scenespark.session import cut, prepare

#: (verdict, host, path) of the query's rules: fixed values of its contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), CAPITALS, SMALL)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def url_node(url: Column) -> Column:
    """Null where there is no host."""
    path = url_path(url)
    node = F.concat(url_host(url), F.when(path == "", F.lit("/")).otherwise(path), F.coalesce(F.regexp_extract(url, URL, 3), F.lit("")))
    return F.when(url_host(url) != "", node)


def _ranked(rules) -> list:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))


def _fits(host: Column, path: Column, rule) -> Column:
    _, h, p = rule
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as its host and path; null if none does."""
    out = F.lit(None).cast("string")
    for r in reversed(_ranked(rules)):
        out = F.when(_fits(host, path, r), F.lit(r[1] + r[2])).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for v, h, p in rules:
        out = F.when(rule == h + p, F.lit(v)).otherwise(out)
    return out


class _Links(HTMLParser):
    """The targets of a page's canonical links and refreshes, as written, and its base."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.targets: list[str] = []
        self.base: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {}
        for name, value in attrs:  # of repeated attributes the first counts
            own.setdefault(name, value or "")
        if tag == "base" and self.base is None and "href" in own:
            self.base = own["href"].strip()
        elif tag == "link" and "canonical" in own.get("rel", "").lower().split():
            self.targets.append(own.get("href", "").strip())
        elif tag == "meta" and own.get("http-equiv", "").strip().lower() == "refresh":
            found = REFRESH.match(own.get("content", ""))
            if found:
                self.targets.append(next((g for g in found.groups() if g is not None), "").strip())


#: The content of a refresh: seconds, then url= and a target, quoted or not.
REFRESH = re.compile(r"(?is)\s*[0-9.]*\s*[;,]?\s*url\s*=\s*(?:'([^']*)'?|\"([^\"]*)\"?|(.*))")


def alias_targets(url: str, html: str) -> list[str]:
    """The absolute targets of a page's canonical links and refreshes, in order."""
    page = _Links()
    page.feed(html)
    page.close()
    out = []
    for target in page.targets:
        try:
            full = urljoin(urljoin(url, page.base) if page.base else url, target) if target else ""
        except ValueError:  # a malformed host
            continue
        if full:
            out.append(full)
    return out


def alias_edges(pages: DataFrame) -> DataFrame:
    """a, b: nodes of a page and of the target of its canonical link or redirect."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(u, t) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in alias_targets(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], ["url", "to"])

    rows = pages.select("url", "html").filter(url_node(F.col("url")).isNotNull() & F.col("html").rlike("(?i)canonical|refresh")).mapInArrow(run, "url string, to string")
    return rows.select(url_node(F.col("url")).alias("a"), url_node(F.col("to")).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def judge_urls(spark: SparkSession, pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    edges = cut(alias_edges(pages).distinct())
    url = F.col("url")
    judged = pages.select("page_id", url_node(url).alias("node"), url_host(url).alias("host"), url_path(url).alias("path"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    # every node of an edge brings its own rule into its component
    member = components(edges)
    seed = member.withColumn("own", verdict_of(rule_of(url_host(F.concat(F.lit("x://"), F.col("node"))), url_path(F.concat(F.lit("x://"), F.col("node"))), rules)))
    decided = seed.groupBy("component").agg(F.min("own").alias("inherited")).filter("inherited IS NOT NULL")  # allow sorts before block
    inherited = member.join(decided, "component").select("node", "inherited")
    out = judged.join(inherited, "node", "left")
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.col("inherited"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
