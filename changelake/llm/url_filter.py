"""URL verdicts by host and path rules, carried over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelake.llm.common import store
from changelake.llm.graph import components

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
# Query parameters that name where a reader came from, not which page it is.
TRACKING = r"(?i)(?<=[?&])(utm_[a-z]*|gclid|fbclid|ref)=[^&]*(&|$)"
CANONICAL = (r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)",
             r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)")
BASE = r"(?is)<base\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit(""))


def _matching(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], what) -> Column:
    """``what`` of the longest fitting rule; of two of one length the allowing one."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow"))
    return F.coalesce(F.lit(None).cast("string"), *(
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(what((h, p, v))))
        for h, p, v in ranked))


def normal_form(url: Column) -> Column:
    """The address that variants share: one scheme, lower-case host without ``www.`` or ``m.``,
    no tracking parameters, fragment or closing slash. Null without ``://``."""
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, PARTS, 4), TRACKING, ""), "[?&]$", "")
    return F.when(url.contains("://"), F.concat(
        F.lit("https://"), F.regexp_replace(host(url), r"^(www|m)\.", ""),
        F.regexp_replace(path(url), "/+$", ""), query))


def _without_dots(path: Column) -> Column:
    """``path`` with its ``.`` and ``..`` segments carried out."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, part: F.when(
        part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(part == ".", done).otherwise(
        F.concat(done, F.array(part))))
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.contains("/."), F.array_join(closed, "/")).otherwise(path)


def resolved(target: Column, base: Column) -> Column:
    """The address that a target on a page at ``base`` names; null if it is empty or of a scheme without ``//``."""
    scheme, place, query = (F.regexp_extract(base, PARTS, i) for i in (1, 3, 4))
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(base, PARTS, 2))
    joined = F.when(target.startswith("/"), target).otherwise(F.concat(F.regexp_replace(place, r"(?s)[^/]*$", ""), target))
    joined = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when((target == "") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("?"), F.concat(site, place, target))
            .when(target.startswith("#"), F.concat(site, place, query, target))
            .otherwise(F.concat(site, _without_dots(F.regexp_extract(joined, r"(?s)^([^?#]*)(.*)$", 1)),
                                F.regexp_extract(joined, r"(?s)^([^?#]*)(.*)$", 2))))


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst): each page's url to its normal form, canonical link and refresh target.

    Targets are resolved against the page's ``base`` element, if it has one, else against its url;
    ``&amp;`` in them is ``&``.
    """
    def written(pattern):
        return F.regexp_replace(F.regexp_extract(F.col("html"), pattern, 1), r"(?i)&(amp|#38|#x26);", "&")

    on_page = "html" in pages.columns
    targets = [written(p) for p in CANONICAL] if on_page else []
    base = written(BASE) if on_page else F.lit("")
    found = pages.where(F.col("url").contains("://")).select(
        F.col("url").alias("src"), base.alias("base"), F.posexplode(F.array(normal_form(F.col("url")), *targets)).alias(
            "number", "target")).where("target <> ''")
    # The patterns run on the page once, below the explode; what is written there is used in many places.
    pairs = found.withColumn("base", F.coalesce(resolved(F.col("base"), F.col("src")), "src")).select(
        "src", F.when(F.col("number") == 0, F.col("target")).otherwise(
            resolved(F.col("target"), F.col("base"))).alias("dst"))
    # A target's own normal form joins it to the pages that are written like it.
    return pairs.where("dst is not null").select(
        "src", F.explode(F.array("dst", normal_form(F.col("dst")))).alias("dst")).where("src <> dst").distinct()


def judge(pages: DataFrame, links: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict, component and method.

    A url's own rule decides. Without one, the urls that redirects or canonical links join to it
    do: allowed if any of them is explicitly allowed, else blocked if any is blocked, else allowed.
    Rules also fit urls that only links name. ``component`` is the smallest url that is joined to
    it, else the url itself. Null urls and urls without ``://`` have empty host and path and are
    allowed; repeated rows give repeated rows; columns beyond page_id and url are left out, so
    their names cannot clash. An empty table gives an empty one.
    """
    links = store(links.toDF("src", "dst"), "links")
    joined = components(links)
    ruled = joined.withColumn("verdict", _matching(host(F.col("id")), path(F.col("id")), rules, lambda r: r[2]))
    decided = ruled.groupBy("component").agg(
        F.when(F.max(F.col("verdict") == "allow"), "allow").when(F.max(F.col("verdict") == "block"), "block")
        .alias("carried"))
    alias = joined.join(decided, "component").select(F.col("id").alias("url"), "component", "carried")
    own = pages.select("page_id", "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    own = own.withColumns({
        "rule": _matching(F.col("host"), F.col("path"), rules, lambda r: r[0] + r[1]),
        "own": _matching(F.col("host"), F.col("path"), rules, lambda r: r[2])})
    return own.join(alias, "url", "left").select(
        "page_id", "url", "host", "path", "rule",
        F.coalesce("own", "carried", F.lit("allow")).alias("verdict"),
        F.coalesce("component", "url").alias("component"),
        F.when(F.col("own").isNotNull(), "rule").when(F.col("carried").isNotNull(), "alias")
        .otherwise("default").alias("method"))
