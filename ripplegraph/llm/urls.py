"""URL filters: host and path rules, spread over aliases by redirect equivalence, with DataFrame functions only.

Redirects (a refresh in the page) and canonical links join addresses to components. An address with a rule of its own
keeps that rule's verdict. For others, one explicitly allowed address allows its component; else one blocked address
blocks it; else it is allowed.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.llm.components import components

# verdict, host, path
Rule = tuple[str, str, str]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_QUOTE = "[\"']?"


def host_of(url: Column) -> Column:
    """From the first :// up to a slash, question mark, number sign or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, number sign or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it is named there."""
    return F.transform(F.array(value), then)[0]


def _folded(path: Column) -> Column:
    """A path without its segments . and .., of which the latter take the one before with them."""
    parts = F.split(F.regexp_replace(path, "(/\\.\\.?)$", "$1/"), "/")
    above = lambda seen: F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(1)))
    step = lambda seen, x: F.when(x == ".", seen).when(x == "..", above(seen)).otherwise(F.concat(seen, F.array(x)))
    kept = _let(parts, lambda p: F.aggregate(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1), step))
    return F.when(F.contains(path, F.lit("/.")), F.array_join(kept, "/")).otherwise(path)


def address_of(url: Column) -> Column:
    """Host, path without dot segments, and query: what names a page, whatever the scheme and the fragment. Null where there is no host."""
    query = F.regexp_extract(url, "(?s)^.*?://[^?#]*(\\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), _let(path_of(url), _folded), query))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule (host and path together; of equal length the longer host) that fits, as a struct; null if none does.

    A rule fits its host and all subdomains, where the path starts with the rule's.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "allow"))
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, name, start in reversed(ranked):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _plain(value: Column) -> Column:
    """An attribute's value with its character references decoded: numbers, and names that end in a semicolon."""
    names = F.str_to_map(F.lit("\2".join(f"&{k}\1{v}" for k, v in html5.items() if k.endswith(";"))), F.lit("\2"), F.lit("\1"))
    parts = F.regexp_extract_all(value, F.lit("(?s)&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"), F.lit(0))

    def plain(x: Column) -> Column:
        digits = F.regexp_extract(x, "^&#[xX]?([0-9A-Fa-f]+);$", 1)
        code = F.when(F.lower(F.substring(x, 3, 1)) == "x", digits).otherwise(F.conv(digits, 10, 16))
        known = F.conv(code, 16, 10).cast("long")
        fits = known.between(1, 0xD7FF) | known.between(0xE000, 0x10FFFF)
        number = F.when(fits, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"))
        return F.when(F.startswith(x, F.lit("&#")), F.coalesce(number, x)).when(F.startswith(x, F.lit("&")), F.coalesce(names[x], x)).otherwise(x)

    return F.when(F.contains(value, F.lit("&")), F.array_join(F.transform(parts, plain), "")).otherwise(value)


def _resolved(url: Column, link: Column) -> Column:
    """The absolute address of a link on a page; null for an empty link and for schemes without //, such as mailto:."""
    path = path_of(url)
    query = F.regexp_extract(url, "(?s)^.*?://[^?#]*(\\?[^#]*)", 1)
    on_host = lambda *parts: F.concat(F.lit("http://"), host_of(url), *parts)
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "(?s)^(.*/)", 1)).otherwise(F.lit("/"))
    return (
        F.when(F.regexp_like(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
        .when((link == "") | F.regexp_like(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), None)
        .when(F.startswith(link, F.lit("/")), on_host(link))
        .when(F.startswith(link, F.lit("?")), on_host(path, link))
        .when(F.startswith(link, F.lit("#")), on_host(path, query, link))
        .otherwise(on_host(folder, link))
    )


def alias_links(pages: DataFrame) -> DataFrame:
    """Pairs of addresses that name one page: a page's own and that of its canonical link or its refresh.

    All tags of a page count. Links are resolved against the page's <base>, if it has one, else against its url. Links
    that lead nowhere (empty, or of a scheme without //), or back to the same address, are left out.
    """
    tag = lambda name, key, value: f"(?is)<{name}\\b[^>]*\\b{key}\\s*=\\s*{_QUOTE}{value}\\b[^>]*>"
    html = F.coalesce("html", F.lit(""))
    canonical = F.transform(
        F.regexp_extract_all(html, F.lit(tag("link", "rel", "canonical")), F.lit(0)),
        lambda t: F.regexp_extract(t, f"(?is)\\bhref\\s*=\\s*{_QUOTE}([^\"'\\s>]+)", 1),
    )
    refresh = F.transform(
        F.regexp_extract_all(html, F.lit(tag("meta", "http-equiv", "refresh")), F.lit(0)),
        lambda t: F.regexp_extract(t, "(?is)\\burl\\s*=\\s*[\"']?([^\"'\\s>]+)", 1),
    )
    base = F.regexp_extract(html, f"(?is)<base\\s[^>]*?\\bhref\\s*=\\s*{_QUOTE}([^\"'\\s>]+)", 1)
    links = pages.where(F.contains(html, F.lit("<"))).select("url", base.alias("base"), F.explode(F.concat(canonical, refresh)).alias("link"))
    url = F.col("url")
    base = F.coalesce(_let(_plain(F.col("base")), lambda x: _resolved(url, x)), url)
    whole = _let(base, lambda u: _let(_plain(F.col("link")), lambda x: _resolved(u, x)))
    a, b = address_of(url), _let(whole, address_of)
    return links.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null and a <> b").distinct()


def judged(pages: DataFrame, rules: list[Rule], links: DataFrame | None = None) -> DataFrame:
    """Every page with host, path, rule and verdict.

    ``pages`` has page_id, url and html; other columns are ignored. ``links`` (a, b: addresses) may come from elsewhere, such as
    a crawl's redirects; else they are read from the pages. A null url, or one without ://, has an empty host and path,
    no rule and no aliases, so it is allowed. Equal rows get equal verdicts; an empty table gives no rows.
    """
    url = F.col("url")
    own = rule_of(host_of(url), path_of(url), rules)
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), own.alias("own"), address_of(url).alias("address"))
    found = components(alias_links(pages) if links is None else links.select("a", "b"))
    bare = F.concat(F.lit("x://"), F.col("node"))
    told = found.withColumn("verdict", rule_of(host_of(bare), path_of(bare), rules)["verdict"])
    verdicts = told.groupBy("component").agg(
        F.when(F.count_if(F.col("verdict") == "allow") > 0, "allow").when(F.count_if(F.col("verdict") == "block") > 0, "block").alias("spread")
    )
    # Only addresses with links are in this table; each is there once.
    aliases = found.join(verdicts, "component").select(F.col("node").alias("address"), "spread")
    joined = rows.join(aliases, "address", "left")
    verdict = F.coalesce(F.col("own.verdict"), F.col("spread"), F.lit("allow"))
    return joined.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))
