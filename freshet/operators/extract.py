"""Pages to article links, one row per page throughout.

All filters, the canonical form and the in-page dedup work on the page's own array of anchors, so a page's result
(links, link count, error) is complete without any shuffle; ``explode_links`` gives the flat form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions import urls
from freshet.functions.text import blank_to_null
from freshet.operators import selectors
from freshet.operators.parse import parse_pages
from freshet.schemas import LINKS, PAGE_SETTINGS, SETTING_DEFAULTS, default_setting
from freshet.session import join_dimension, once_per_application, spread

# What is never an article link.
SKIP_SCHEMES = ["#", "javascript:", "mailto:", "tel:", "data:"]
SKIP_SUFFIXES = [
    "css", "js", "mjs", "json", "xml", "rss", "atom",
    "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "bmp",
    "zip", "gz", "tar", "rar", "7z", "exe", "dmg", "apk",
    "mp3", "mp4", "avi", "mov", "wmv", "m4a", "wav",
    "woff", "woff2", "ttf", "eot",
]
DEFAULT_EXCLUDES = [
    r"/(feed|rss|atom)/?$",
    r"/wp-(json|login|admin)",
    r"/xmlrpc\.php$",
    r"/sitemap(\.xml|/)?$",
    r"/(login|logout|signin|signout|signup|register)/?$",
]
# Messages of a failed page.
FETCH_FAILED = "取得に失敗しました"
PARSE_FAILED = "解析エラー: "
NO_LINKS = "リンクを1件も抽出できませんでした"

_SUFFIX_PATTERN = rf"\.(?:{'|'.join(SKIP_SUFFIXES)})\z"
_EXCLUDE_PATTERN = "(?iu)" + "|".join(f"(?:{p})" for p in DEFAULT_EXCLUDES)


def with_settings(snapshots: DataFrame, sites: DataFrame | None = None, **overrides: object) -> DataFrame:
    """Attach each page's settings: from a ``sites`` table, or one set of settings for all pages.

    With a table, snapshots of unknown or disabled sites drop out here, before any page is parsed.
    """
    if sites is not None:
        wanted = [c for c in PAGE_SETTINGS if c in sites.columns]
        enabled = sites.filter("enabled") if "enabled" in sites.columns else sites
        snapshots = join_dimension(snapshots, enabled.select("site_id", *wanted), "site_id")
    given = {}
    for name in PAGE_SETTINGS:
        if name in overrides:
            value = overrides[name]
            literal = F.array(*[F.lit(v) for v in value]) if isinstance(value, (list, tuple)) else F.lit(value)
            given[name] = literal.cast(SETTING_DEFAULTS[name][0])
        elif name not in snapshots.columns:
            given[name] = default_setting(name)
    return snapshots.withColumns(given)


def _is_candidate(anchor: Column) -> Column:
    href = anchor["href"]
    keep = href != ""
    for prefix in SKIP_SCHEMES:
        keep = keep & ~href.startswith(prefix)
    return keep


def _dedup(links: Column) -> Column:
    """One entry per URL: the position of the first, the title of the first that has one."""

    def shape(x: Column) -> Column:
        return F.struct(x["pos"].alias("pos"), x["url"].alias("url"), x["title"].alias("title"))

    def heads(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["url"] != x["url"]))

    by_position = F.sort_array(F.transform(links, lambda x: F.struct(x["url"].alias("url"), x["pos"].alias("pos"))))
    by_title = F.sort_array(
        F.transform(
            links,
            lambda x: F.struct(
                x["url"].alias("url"), (x["title"] == "").alias("untitled"), x["pos"].alias("pos"), x["title"].alias("title")
            ),
        )
    )
    merged = urls.let(
        F.struct(urls.let(by_position, heads).alias("first"), urls.let(by_title, heads).alias("named")),
        lambda both: F.sort_array(
            F.zip_with(
                both["first"],
                both["named"],
                lambda f, n: F.struct(f["pos"].alias("pos"), f["url"].alias("url"), n["title"].alias("title")),
            )
        ),
    )
    repeats = F.size(F.array_distinct(F.transform(links, lambda x: x["url"]))) < F.size(links)
    return F.when(repeats, merged).otherwise(F.transform(links, shape))


@once_per_application
def _page_steps() -> list[dict[str, Column]]:
    """The columns that lead from a parsed page to its links, in dependency order.

    Each step is its own projection, so that a value used several times is computed once.
    """
    page, base = F.col("_page"), F.col("_base")

    def located(anchor: Column) -> Column:
        return F.struct(anchor["pos"].alias("pos"), anchor["title"].alias("title"), urls.split_url(anchor["href"]).alias("ref"))

    def absolute(link: Column) -> Column:
        return F.struct(
            link["pos"].alias("pos"), link["title"].alias("title"), urls.resolve(base, link["ref"]).alias("parts")
        )

    def canonical(link: Column) -> Column:
        return F.struct(
            link["pos"].alias("pos"),
            link["title"].alias("title"),
            urls.netloc_of(link["parts"]).alias("netloc"),
            urls.canonical_path(link["parts"]).alias("path"),
            urls.compose_canonical(link["parts"]).alias("url"),
        )

    def is_web_link(link: Column) -> Column:
        return urls.scheme_of(link["parts"]).isin("http", "https") & (F.length(link["title"]) >= F.col("min_title_length"))

    def is_article(link: Column) -> Column:
        url, path = link["url"], link["path"]
        return (
            (url != F.col("_key"))
            & (path != "/")
            & ~(path.contains(".") & F.lower(path).rlike(_SUFFIX_PATTERN))
            & (
                F.col("allow_external")
                | (link["netloc"] == urls.netloc_of(page))
                | urls.is_same_site(link["netloc"], urls.netloc_of(page), F.col("allow_hosts"))
            )
            & ~(F.col("use_default_exclude") & path.rlike(_EXCLUDE_PATTERN))
            & ((F.size("include") == 0) | F.exists("include", lambda needle: url.contains(needle)))
            & ~F.exists("exclude", lambda needle: url.contains(needle))
        )

    # One malformed address fails its whole page.
    broken = (
        urls.is_bad_netloc(urls.netloc_of(page))
        | urls.is_bad_netloc(urls.netloc_of(base))
        | F.exists("_refs", lambda r: urls.is_bad_netloc(urls.netloc_of(r["ref"])))
    )
    failed = F.coalesce(
        F.when(F.col("error").isNotNull(), F.coalesce(blank_to_null(F.col("error")), F.lit(FETCH_FAILED))),
        F.when(F.col("parse_error").isNotNull(), F.concat(F.lit(PARSE_FAILED), F.col("parse_error"))),
        F.when(F.col("_unsupported"), F.lit(PARSE_FAILED + "SelectorSyntaxError")),
        F.when(broken, F.lit(PARSE_FAILED + "ValueError")),
    )
    joined_base = urls.resolve(page, urls.split_url(F.col("base_href")))
    selector = F.col("selector")
    chosen = F.filter("anchors", lambda a: selectors.is_selected(a["path"], F.col("_chains")))
    return [
        {"_unsupported": selectors.is_unsupported(selector)},
        {"_chains": F.when(selectors.is_given(selector) & ~F.col("_unsupported"), selectors.chains(selector))},
        {"_chosen": F.when(F.col("_chains").isNotNull(), chosen).otherwise(F.col("anchors"))},
        {"_page": urls.split_url(F.col("page_url")), "_refs": F.transform(F.filter("_chosen", _is_candidate), located)},
        {"_base": F.when(F.col("base_href").isNull(), page).otherwise(joined_base), "_key": urls.compose_canonical(page)},
        {"_failed": failed, "_absolute": F.filter(F.transform("_refs", absolute), is_web_link)},
        {"_articles": F.when(F.col("_failed").isNull(), F.filter(F.transform("_absolute", canonical), is_article))},
        {"links": F.coalesce(_dedup(F.col("_articles")), F.array().cast(LINKS))},
        {"link_count": F.size("links")},
        {"error": F.coalesce("_failed", F.when(F.col("link_count") == 0, F.lit(NO_LINKS)))},
    ]


def links_of(parsed: DataFrame, may_select: bool = True) -> DataFrame:
    """From parsed pages to ``links``, ``link_count`` and ``error`` per page. Without ``may_select`` no page has a selector, and
    nothing of it is planned."""
    page = parsed
    steps = _page_steps() if may_select else [{"_unsupported": F.lit(False), "_chosen": F.col("anchors")}, *_page_steps()[3:]]
    for step in steps:
        page = page.withColumns(step)
    # A generator of one row: Catalyst substitutes no filter on these columns through it. Without it, each later
    # filter (explode adds its own) would evaluate the whole chain above once more.
    result = F.inline(F.array(F.struct("links", "link_count", "error")))
    return page.select("site_id", "run_ts", "page_url", "max_items", result)


def extract(snapshots: DataFrame, sites: DataFrame | None = None, **settings: object) -> DataFrame:
    """Snapshots to pages: site, run, URL, settings for change detection, ``links``, ``link_count``, ``error``."""
    sources = [c for c in ("content", "html", "charset_hint") if c in snapshots.columns]
    error = F.col("error") if "error" in snapshots.columns else F.lit(None).cast("string").alias("error")
    pages = spread(snapshots.select("site_id", "run_ts", "page_url", *sources, error), "site_id", "run_ts")
    pages = with_settings(pages, sites, **settings)
    may_select = settings.get("selector") is not None or ("selector" not in settings and sites is not None and "selector" in sites.columns)
    return links_of(parse_pages(pages), may_select)


def explode_links(pages: DataFrame) -> DataFrame:
    """One row per link of every page without an error."""
    return (
        pages.filter(F.col("error").isNull())
        .select("site_id", "run_ts", F.explode("links").alias("link"))
        .select("site_id", "run_ts", "link.pos", "link.url", "link.title")
    )


def link_sites(snapshots: DataFrame, sites: DataFrame | None = None, **settings: object) -> DataFrame:
    """A row for each web link of each page, whatever else would drop it: site, run, ``pos``, ``link_host`` (with its port),
    ``same_site``, and ``allowed`` (the same site, on the site's list of hosts, or all are).

    Both hosts stand in the page's own row, so that nothing is joined or paired. Pages with malformed addresses have no rows.
    """
    pages = with_settings(snapshots.select("site_id", "run_ts", "page_url", "html"), sites, **settings)
    page, base = F.col("_page"), F.col("_base")
    parsed = parse_pages(pages).withColumns({"_page": urls.split_url(F.col("page_url")), "_refs": F.filter("anchors", _is_candidate)})
    parsed = parsed.withColumn("_base", F.when(F.col("base_href").isNull(), page).otherwise(urls.resolve(page, urls.split_url(F.col("base_href")))))
    refs = F.transform("_refs", lambda a: F.struct(a["pos"].alias("pos"), urls.split_url(a["href"]).alias("ref")))
    parsed = parsed.withColumn("_refs", refs).filter(~F.exists("_refs", lambda r: urls.is_bad_netloc(urls.netloc_of(r["ref"]))))
    links = parsed.select("site_id", "run_ts", "_page", "_base", "allow_hosts", "allow_external", F.inline("_refs"))
    links = links.withColumn("_link", urls.resolve(base, F.col("ref"))).filter(urls.scheme_of(F.col("_link")).isin("http", "https"))
    link_host, page_host = urls.netloc_of(F.col("_link")), urls.netloc_of(page)
    listed = F.col("allow_external") | (link_host == page_host) | urls.is_same_site(link_host, page_host, F.col("allow_hosts"))
    same = (link_host == page_host) | urls.is_same_site(link_host, page_host)
    return links.select("site_id", "run_ts", "pos", F.lower(link_host).alias("link_host"), same.alias("same_site"), listed.alias("allowed"))


def path_prefix_stats(links: DataFrame, by: list[str], depth: int = 2, top: int = 10) -> DataFrame:
    """The ``top`` most frequent directories per group; ties go to the one met first."""
    order = [c for c in ("run_ts", "pos") if c in links.columns]
    counted = (
        links.withColumn("prefix", urls.path_prefix(F.col("url"), depth))
        .groupBy(*by, "prefix")
        .agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    )
    ranked = Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col("_first"))
    return counted.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top).drop("_first")


def same_site_pairs(hosts: DataFrame, host: str = "host") -> DataFrame:
    """Every (page host, link host) pair that counts as one site.

    The subdomain test is an equi-join: a page's base host meets each link host's own base host and proper dotted
    suffixes.
    """
    distinct = hosts.select(F.lower(host).alias("h")).distinct()
    suffixes = urls.parent_hosts(F.col("h"))
    pages = distinct.select(F.col("h").alias("page_host"), urls.base_host(F.col("h")).alias("root"))
    links = distinct.select(
        F.col("h").alias("link_host"),
        F.explode(F.array_distinct(F.array_prepend(suffixes, urls.base_host(F.col("h"))))).alias("root"),
    )
    return pages.join(links, "root").select("page_host", "link_host").distinct()
