"""URL filter with redirect equivalence, with DataFrame functions only.

Rules allow or block a host with its subdomains below a path. Pages that name each other by redirects or canonical
links are one page under several addresses: connected components over those links carry a block from any address to
its aliases, and an explicit allow wins over a block that is only inherited.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexilar.llm.text import LOWER, UPPER, own_columns
from vexilar.operators.components import connected_components
from vexilar.session import materialize


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str


# The contract's rules.
RULES = (
    UrlRule("org", "/", "allow"),
    UrlRule("example.org", "/es/", "block"),
    UrlRule("example.org", "/en/1", "block"),
    UrlRule("com", "/fr/", "allow"),
    UrlRule("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' for null or no ://."""
    rest = F.substring_index(F.regexp_extract(url, r"(?s)://(.*)\z", 1), "/", 1)
    return F.coalesce(F.translate(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; '' for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls; at equal length the longer host, then the first."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), len(r.host)), reverse=False):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        which, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(which), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return which, verdict


def node_of(url: Column) -> Column:
    """An address as a node: without its fragment, scheme and host in lower case."""
    plain = F.substring_index(url, "#", 1)
    root = F.regexp_extract(plain, r"(?s)\A([^/?]*://[^/?]*)", 1)
    return F.concat(F.translate(root, UPPER, LOWER), F.substring(plain, F.length(root) + 1, F.length(plain)))


def without_dots(path: Column) -> Column:
    """A path from / with its . and .. segments worked out."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    step = lambda a, x: F.when(x == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    done = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    return F.concat(F.array_join(done, "/"), F.when(last.isin(".", "..") | (F.size(done) == 1), "/").otherwise(""))


def resolved(url: Column, to: Column) -> Column:
    """The address that a link in a page names: absolute, by scheme, from the root, a query, or relative to the page."""
    scheme = F.regexp_extract(url, r"(?s)\A(.*?:)//", 1)
    root = F.regexp_extract(url, r"(?s)\A(.*?://[^/?#]*)", 1)
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    own, query = F.regexp_extract(to, r"(?s)\A([^?#]*)", 1), F.regexp_extract(to, r"(?s)\A[^?#]*(.*)", 1)
    folder = F.regexp_extract(path, r"(?s)\A(.*/)", 1)
    return (
        F.when(to.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(scheme, to)).when((root == "") | to.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(to.startswith("#"), url).when(own == "", F.concat(root, path, query)).when(own.startswith("/"), F.concat(root, without_dots(own), query))
        .otherwise(F.concat(root, without_dots(F.concat(folder, own)), query))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): all canonical links and meta refreshes of the pages as nodes, relative ones resolved, & unescaped.

    Pages without such a link, with a null address or with a link to themselves give no row.
    """
    own = own_columns(pages, _url=url, _html=html).where("_url is not null and _html is not null")
    some = own.where(F.lower("_html").contains("canonical") | F.lower("_html").contains("refresh"))
    every = lambda pattern: F.regexp_extract_all("_html", F.lit(pattern), F.lit(1))
    tag, meta = every(r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"), every(r"(?is)(<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh\b[^>]*>)")
    href = F.transform(tag, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    to = F.transform(meta, lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    links = some.select("_url", F.explode(F.concat(href, to)).alias("_to")).where("_to <> ''")
    links = links.withColumn("_to", F.replace(F.replace(F.replace("_to", F.lit("&#38;"), F.lit("&")), F.lit("&#x26;"), F.lit("&")), F.lit("&amp;"), F.lit("&")))
    return links.select(node_of(F.col("_url")).alias("src"), node_of(resolved(F.col("_url"), F.col("_to"))).alias("dst")).where("dst is not null and src <> dst").distinct()


def _inherited(urls: DataFrame, links: DataFrame) -> DataFrame:
    """(url, blocked): for addresses in a component of more than one, whether a block reaches them.

    Addresses are numbered, so that two never share a node; only those that a link names are shuffled.
    """
    names = links.select("src").union(links.select("dst")).distinct()
    keyed = materialize(names.select(F.col("src").alias("url"), F.monotonically_increasing_id().alias("node")), "url_nodes")
    edges = links.join(keyed.withColumnsRenamed({"url": "src", "node": "a"}), "src").join(keyed.withColumnsRenamed({"url": "dst", "node": "b"}), "dst")
    member = keyed.join(connected_components(edges, "a", "b"), "node").select("url", "component")
    ruled = member.join(urls, "url", "left")
    per = ruled.groupBy("component").agg(F.max(F.coalesce(F.col("verdict") == "block", F.lit(False))).alias("any_block"), F.max(F.coalesce(F.col("verdict") == "allow", F.lit(False))).alias("any_allow"))
    return member.join(per, "component").select("url", (F.col("any_block") & ~F.col("any_allow")).alias("blocked"))


def judge_urls(pages: DataFrame, links: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict (allow or block), inherited.

    links: further (src, dst) redirects beside those found in the pages. A page's own rule decides; without one, it
    is blocked if its component holds a blocked address and no explicitly allowed one, and is allowed otherwise.
    Null addresses have empty host and path and are allowed. Repeated rows each get a row; other columns are ignored.
    """
    found = page_links(pages, url, html)
    if links is not None:
        found = found.union(links.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")).where("src is not null and dst is not null and src <> dst")).distinct()
    found = materialize(found, "links")
    own = own_columns(pages, page_id=page_id, _url=url)
    parts = own.select("page_id", node_of(F.col("_url")).alias("_key"), host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.withColumn("rule", rule).withColumn("_own", verdict)
    if found.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("_own", F.lit("allow")).alias("verdict"), F.lit(False).alias("inherited"))
    names = found.select(F.col("src").alias("url")).union(found.select(F.col("dst"))).distinct()
    ruled = names.select("url", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)[1].alias("verdict"))
    reach = _inherited(ruled, found)
    ask = F.col("_own").isNull() & F.col("_key").isNotNull()  # only these can inherit; null addresses would meet in one task
    asked = judged.where(ask).join(reach, F.col("_key") == F.col("url"), "left").withColumn("_takes", F.coalesce("blocked", F.lit(False)))
    out = asked.select("page_id", "host", "path", "rule", "_own", "_takes").union(judged.where(~ask).select("page_id", "host", "path", "rule", "_own", F.lit(False)))
    return out.select("page_id", "host", "path", "rule", F.when(F.col("_takes"), F.lit("block")).otherwise(F.coalesce("_own", F.lit("allow"))).alias("verdict"), F.col("_takes").alias("inherited"))
