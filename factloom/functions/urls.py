"""Hosts, paths and kinds of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.config import DIRECTORY_HOSTS

_PARTS = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]+)?([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without a leading www.; '' if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, _PARTS, 1)), r"^www\.", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """Lower-case path, '/' where the URL has a host only, '' without one."""
    path = F.lower(F.regexp_extract(url, _PARTS, 2))
    return F.coalesce(F.when(host_of(url) == "", "").when(path == "", "/").otherwise(path), F.lit(""))


def normalize_url(raw: Column, scheme: str = "https") -> Column:
    """With a scheme and a path; null if there is no host."""
    u = F.trim(raw)
    full = F.when(u.rlike(r"(?i)^https?://"), u).otherwise(F.concat(F.lit(f"{scheme}://"), u))
    ok = (u != "") & full.rlike(r"(?i)^https?://[^\s/?#]+")
    lower = F.concat(F.lower(F.regexp_extract(full, r"^([A-Za-z]+://[^/?#]+)", 1)), F.regexp_replace(full, r"^[A-Za-z]+://[^/?#]+", ""))
    return F.when(ok, F.when(lower.rlike(r"^[a-z]+://[^/?#]+$"), F.concat(lower, F.lit("/"))).otherwise(lower))


def origin_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))


def raw_path(url: Column) -> Column:
    """Path as it is written, '' where the URL has a host only."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def link_target(base: Column, href: Column) -> Column:
    """Target of a link on the page ``base``, without its fragment, the origin in small
    letters. Leading ./ are dropped; other dot segments stay."""
    stem, origin = F.regexp_replace(base, r"[?#].*$", ""), origin_of(base)
    h = F.regexp_replace(F.regexp_replace(href, r"#.*$", ""), r"^(\./)+", "")
    made = (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(base, r"^([A-Za-z]+:)", 1), h))
        .when(F.startswith(h, F.lit("/")), F.concat(origin, h))
        .when(h == "", F.regexp_replace(base, r"#.*$", ""))
        .when(F.startswith(h, F.lit("?")), F.concat(stem, h))
        .when(stem.rlike(r"^[^/]+//[^/]+/"), F.concat(F.regexp_extract(stem, r"^(.*/)", 1), h))
        .otherwise(F.concat(origin, F.lit("/"), h))
    )
    rest = F.regexp_replace(made, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", "")
    return F.when(origin_of(made) == "", made).otherwise(F.concat(origin_of(made), F.when(rest == "", "/").otherwise(rest)))


def is_directory(url: Column) -> Column:
    """Listing and profile hosts; a URL without a host counts as one."""
    host, hit = host_of(url), F.lit(False)
    for part in DIRECTORY_HOSTS:
        hit = hit | host.contains(part)
    return (host == "") | hit | host.rlike(r"[a-z]churches\.(com|org|net)$")


def source_type(url: Column, official: Column) -> Column:
    """Kind of source of an evidence URL, relative to the official site."""
    host = host_of(url)
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "inference")
        .when(host == "", "unknown")
        .when(F.coalesce((origin_of(official) != "") & F.startswith(F.lower(url), origin_of(official)), F.lit(False)), "official_site")
        .when(host.rlike(r"facebook|instagram|twitter|x\.com|youtube|tiktok|linkedin"), "social")
        .when(host.rlike(r"duckduckgo|google|bing"), "search")
        .otherwise("directory")
    )


# Host and path patterns of search results, in order, with source type and reliability.
RESULT_CLASSES = [
    ("host", r"youtube\.com|youtu\.be", "youtube", 0.55),
    ("host", r"facebook\.com", "facebook", 0.55),
    ("host", r"instagram\.com", "instagram", 0.55),
    ("host", r"linkedin\.com", "linkedin", 0.55),
    ("host", r"zoominfo|rocketreach|apollo\.io|signalhire|leadiq|contactout", "linkedin", 0.35),
    ("host", r"ministryjobs|churchstaffing|indeed\.com|ziprecruiter|vanderbloemen", "job_posting", 0.6),
    ("both", r"maps\.apple|google\.[a-z.]+/maps|mapquest", "maps", 0.6),
    ("host", r"yelp|yellowpages|churchfinder|wheree|uschurch|findachurch", "church_directory", 0.55),
    ("path", r"church-directory|/directory/|find-a-church", "denom_directory", 0.65),
    ("host", r"(naz|nazarene|umc|sbc|district|presbytery|diocese|conference)", "denom_directory", 0.65),
    ("host", r"construct|builder|contractor|architect|engineer|roofing|hvac|consult(ing|ants?)|realty|realestate|signage|millwork|cabinetry|propertie?s", "vendor_reference", 0.2),
    ("host", r"(^|\.)(news|tribune|times|herald|gazette|chronicle|journal|patch|cbs|abc|nbc|fox|communityimpact|press|magazine|reuters|apnews|axios)", "news_media", 0.5),
]


def classify_result(url: Column, official_host: Column) -> Column:
    """source_type, access_level and reliability of a search result."""
    host, path = host_of(url), path_of(url)
    where = {"host": host, "path": path, "both": F.concat(host, path)}
    kind, weight = F.lit("search"), F.lit(0.5)
    for part, pattern, name, reliable in reversed(RESULT_CLASSES):
        hit = where[part].rlike(pattern)
        kind, weight = F.when(hit, F.lit(name)).otherwise(kind), F.when(hit, F.lit(reliable)).otherwise(weight)
    own = F.coalesce((official_host != "") & (host == official_host), F.lit(False))
    kind, weight = F.when(own, F.lit("official_site")).otherwise(kind), F.when(own, F.lit(0.62)).otherwise(weight)
    return F.struct(kind.alias("source_type"), F.when(kind == "vendor_reference", "vendor_reference").otherwise("search_snippets").alias("access_level"), weight.alias("reliability"))


def decode_redirect(href: Column) -> Column:
    """Target of a search engine's redirect; a link without a scheme gets one."""
    target = F.regexp_extract(href, r"[?&]uddg=([^&]+)", 1)
    return F.when(target != "", F.try_url_decode(target)).when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).otherwise(href)


def resolve(href: Column, base: Column) -> Column:
    """Absolute URL of a link on a page, without its fragment."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/(?:[^?#]*/)?)", 1)
    target = F.regexp_replace(href, r"#.*$", "")
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, target))
        .when(F.startswith(target, F.lit("/")), F.concat(origin, target))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), target))
    )


def same_origin(url: Column, base: Column) -> Column:
    return (origin_of(url) != "") & (origin_of(url) == origin_of(base))
