"""URL filters: longest matching rule, and block decisions carried to aliases, with DataFrame operators only.

A rule is an action on a host and a path prefix; it fits the host and its subdomains. A page without a rule
takes the verdict of its redirect class: the connected component of its url over redirect edges (meta refresh),
canonical links and the plain spellings of a url that servers redirect between (scheme, leading www. or m.,
fragment, tracking parameters, closing slash). A class is blocked if one of its urls is blocked by a rule and
none is explicitly allowed; otherwise it is allowed.

Edge cases: a url that is null or has no `://` has an empty host and path, fits no rule, has no aliases and is
allowed; null html has no links; repeated pages are judged alike; all canonical links and refreshes of a page
count, relative ones against the url of the page (a base element is not read); links whose scheme has no `//`
(mailto:, data:) are ignored; page columns other than the judged ones pass through `judge`, which replaces columns
named host, path, rule and verdict.
"""

from pyspark.sql import functions as F

from ..session import stored
from .components import components

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed rules of the registered query.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Query parameters that do not choose the content.
TRACKING = r"(?:utm_\w+|ref|fbclid|gclid)"
_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _split(url):
    """Host and path of a url column, both empty without `://`."""
    url = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_parts(df, url_col="url"):
    host, path = _split(url_col)
    return df.withColumns({"host": host, "path": path})


def _rule_table(rules):
    """Longest rule first; among equal ones allow goes before block."""
    rows = []
    for action, text in rules:
        if action not in ("allow", "block"):
            raise ValueError(f"unknown action {action!r}")
        host, _, path = text.partition("/")
        rows.append((text, action, host.lower(), "/" + path))
    return sorted(rows, key=lambda r: (-len(r[0]), r[1]))


def with_rule(df, rules):
    """The longest fitting rule and its action as columns; a rule list is a parameter, so it is part of the plan."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what, host, path in reversed(_rule_table(rules)):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return df.withColumns({"rule": rule, "action": action})


def plain_spelling(url):
    """The common spelling of urls that differ in what servers usually redirect, as a column."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    bare = F.regexp_replace(bare, rf"([?&]){TRACKING}=[^&]*", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, "&{2,}", "&"), r"\?&", "?")
    bare = F.regexp_replace(bare, r"[?&]+$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:www\.|m\.)?", "")
    host = F.translate(F.regexp_extract(bare, r"(?s)^([^/?]*)", 1), UPPER, UPPER.lower())
    return F.concat(F.lit("alias://"), host, F.regexp_replace(F.regexp_replace(bare, r"(?s)^[^/?]*", ""), r"/$", ""))


def _without_dots(path):
    """A path column without its segments `.` and `..`."""
    start = F.array().cast("array<string>")

    def step(done, part):
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    # The empty segment before the first slash is no place to go up from.
    kept = F.aggregate(F.split(F.substr(path, F.lit(2)), "/"), start, step)
    closing = F.when(path.rlike(r"(?s)/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), closing)).otherwise(path)


def links_of(pages, url_col="url", html_col="html"):
    """(source, target, kind) of all redirects and canonical links in the pages, as absolute urls."""
    html = F.coalesce(F.col(html_col), F.lit(""))

    def found(kind, pattern):
        return F.transform(F.regexp_extract_all(html, F.lit(pattern), 1), lambda to: F.struct(F.lit(kind).alias("kind"), to.alias("to")))

    both = F.concat(found("canonical", _CANONICAL), found("redirect", _REFRESH))
    rows = pages.filter(F.instr(url_col, "://") > 0).select(F.col(url_col).alias("source"), F.inline(both))
    rows = rows.withColumn("to", F.regexp_replace("to", "&amp;", "&"))
    to = F.col("to")
    scheme = F.regexp_extract("source", r"(?s)^([^:]*:)//", 1)
    origin = F.regexp_extract("source", r"(?s)^([^:]*://[^/?#]*)", 1)
    path = F.regexp_extract("source", r"(?s)^[^:]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract("source", r"(?s)^[^?#]*(\?[^#]*)", 1)
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^(.*/)", 1)).otherwise(F.lit("/"))
    to_path, rest = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    target = (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), to)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
        .when(F.startswith(to, F.lit("//")), F.concat(scheme, to))
        .when(F.startswith(to, F.lit("/")), F.concat(origin, _without_dots(to_path), rest))
        .when(F.startswith(to, F.lit("?")), F.concat(origin, path, to))
        .when(F.startswith(to, F.lit("#")), F.concat(origin, path, query, to))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, to_path)), rest))
    )
    return rows.select("source", target.alias("target"), "kind").filter(F.col("target").isNotNull())


def blocked_aliases(urls, links, rules=RULES):
    """Urls without a rule whose redirect class is blocked, one row each.

    `urls` has a column url; `links` has source and target. Targets count as urls of the class too.
    """
    known = urls.select("url").union(links.select("source")).union(links.select("target"))
    known = known.filter(F.instr("url", "://") > 0).distinct()
    spelling = known.select(F.col("url").alias("a"), plain_spelling(F.col("url")).alias("b"))
    edges = links.select(F.col("source").alias("a"), F.col("target").alias("b")).union(spelling)
    classes = components(edges)
    judged = with_rule(with_parts(classes.filter(~F.startswith("node", F.lit("alias://"))), "node"), rules)
    judged, _ = stored(judged.select(F.col("node").alias("url"), "component", "action"), "url-classes")
    blocked = (
        judged.groupBy("component")
        .agg(F.max(F.col("action") == "block").alias("blocked"), F.max(F.col("action") == "allow").alias("allowed"))
        .filter(F.col("blocked") & ~F.coalesce("allowed", F.lit(False)))
    )
    return judged.filter(F.col("action").isNull()).join(blocked.select("component"), "component").select("url")


def judge(pages, rules=RULES, url_col="url", html_col="html", edges=None):
    """Pages with host, path, rule and verdict. `edges` (source, target) adds redirects known from elsewhere."""
    judged = ("host", "path", "rule", "verdict")
    links = links_of(pages, url_col, html_col).select("source", "target")
    if edges is not None:
        links = links.union(edges.select("source", "target").filter("source is not null and target is not null"))
    links, _ = stored(links.distinct(), "url-links")
    blocked = blocked_aliases(pages.select(F.col(url_col).alias("url")), links, rules)
    blocked = blocked.select(F.col("url").alias("__url"), F.lit(True).alias("__blocked"))
    columns = [c for c in pages.columns if c not in judged]
    rows = with_rule(with_parts(pages.select(*columns), url_col), rules)
    rows = rows.join(blocked, F.col(url_col) == F.col("__url"), "left")
    verdict = F.coalesce("action", F.when(F.col("__blocked"), F.lit("block")), F.lit("allow"))
    return rows.select(*columns, "host", "path", "rule", verdict.alias("verdict"))


def report(pages, **options):
    return judge(pages, **options).select("page_id", "host", "path", "rule", "verdict")
