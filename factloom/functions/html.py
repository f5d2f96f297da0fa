"""Text, titles, links and signals of HTML pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.config import PAGE_CATEGORIES
from factloom.functions.extract import says

HIDDEN = ["script", "style", "noscript", "template", "svg"]


def _spaced(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, " ", " "), r"\s+", " "))


def _plain(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"(?i)&[#a-z0-9]+;", " ")


def visible_text(html: Column) -> Column:
    """Text outside hidden elements, comments and tags, with entities as blanks."""
    out = html
    for tag in HIDDEN:
        out = F.regexp_replace(out, rf"(?is)<{tag}.*?</{tag}>", " ")
    return _spaced(_plain(F.regexp_replace(out, r"(?s)<!--.*?-->", " ")))


def inner_text(html: Column) -> Column:
    """Visible text with a line for each block, as a browser shows it."""
    out = html
    for tag in HIDDEN:
        out = F.regexp_replace(out, rf"(?is)<{tag}.*?</{tag}>", " ")
    flat = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"\s+", " ")
    return _plain(F.regexp_replace(flat, r"(?i)<br\b[^>]*>|</?(?:p|div|li|ul|ol|h[1-6]|tr|td|th|table|section|article|header|footer|title|figcaption|dt|dd)\b[^>]*>", "\n"))


def title(html: Column) -> Column:
    return _spaced(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def identity_text(html: Column) -> Column:
    """Title, site name, social title, first heading and description, by ' | '."""
    meta = lambda attr, name: _spaced(F.regexp_extract(html, rf"(?i)<meta[^>]+{attr}=[\"']{name}[\"'][^>]+content=[\"']([^\"']+)[\"']", 1))
    heading = F.regexp_replace(_spaced(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)), r"<[^>]+>", " ")
    parts = [title(html), meta("property", "og:site_name"), meta("property", "og:title"), heading, meta("name", "description")]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit(" | "), p)
    return _spaced(joined)


_LINK = r"(?is)<a\b[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"


def links(html: Column) -> Column:
    """Array of (href, text) in page order, without script and data links."""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(_LINK), 1).alias("href"), F.regexp_extract_all(html, F.lit(_LINK), 2).alias("inner"))
    made = F.transform(pairs, lambda p: F.struct(p["href"].alias("href"), _spaced(_plain(p["inner"])).alias("text")))
    return F.filter(made, lambda p: ~p["href"].rlike(r"(?i)^(javascript:|data:)"))


def categorize(href: Column, text: Column) -> Column:
    """First category that a link's target or text has a keyword of; null if none."""
    hay = F.lower(F.concat(href, F.lit(" "), text))
    out = F.lit(None).cast("string")
    for name, words in reversed(PAGE_CATEGORIES):
        hit = F.lit(False)
        for w in words:
            hit = hit | hay.contains(w)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def addresses(found: Column, scheme: str) -> Column:
    """Targets of mailto: or tel: links, without query and percent signs."""
    own = F.filter(found, lambda p: F.startswith(F.lower(p["href"]), F.lit(f"{scheme}:")))
    # a plus sign is no blank here
    plain = lambda h: F.replace(F.regexp_replace(F.substr(h, F.lit(len(scheme) + 2)), r"\?.*$", ""), F.lit("+"), F.lit("%2B"))
    return F.transform(own, lambda p: F.trim(F.try_url_decode(plain(p["href"]))))


def has_nav_signals(html: Column) -> Column:
    low = F.lower(html)
    words = r"(?<![a-z0-9_])(staff|team|leadership|elders?|pastors?|contact|connect|about|visit|ministr|campus|locations?|sermons?)(?![a-z0-9_])"
    return low.contains("mailto:") | low.contains("tel:") | low.rlike(words)


def is_thin(html: Column, text: Column) -> Column:
    """Does the page need a browser to show its content?"""
    size = F.length(text)
    return (
        (size < 600)
        | (html.rlike(r"(?i)<div[^>]+id=[\"'](root|app|__next|__nuxt)[\"']") & (size < 1500))
        | ((F.regexp_count(html, F.lit(r"(?i)<script\b")) >= 8) & (F.regexp_count(html, F.lit(r"(?i)<a\b")) < 5))
        | html.rlike(r"(?i)please enable javascript|you need to enable javascript|enable js to")
        | ((size < 1500) & ~has_nav_signals(html))
    )


def gain_ratio(rendered: Column, raw: Column) -> Column:
    """How much longer the rendered text is; 99 or 1 if there was no raw text."""
    return F.when(raw > 0, F.floor(rendered / raw * 100 + 0.5) / 100).otherwise(F.when(rendered > 0, 99.0).otherwise(1.0))


# Entities that are decoded.
ENTITIES = [
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&rsquo;", "’"), ("&lsquo;", "‘"),
    ("&mdash;", "—"), ("&ndash;", "–"),
]


def decode_entities(x: Column) -> Column:
    """With the listed entities decoded, in any case; the ampersand comes last, so
    that nothing is decoded twice."""
    for entity, letter in [*ENTITIES[1:], ENTITIES[0]]:
        x = F.regexp_replace(x, f"(?i){entity}", letter.replace("$", r"\$"))
    return x


def extract_text(html: Column) -> Column:
    """Visible text of the body with its entities decoded."""
    body = F.regexp_replace(F.regexp_replace(html, r"(?is)^.*?<body[^>]*>", ""), r"(?is)</body>.*$", "")
    out = F.when(body == "", html).otherwise(body)
    for tag in HIDDEN:
        out = F.regexp_replace(out, rf"(?is)<{tag}.*?</{tag}>", " ")
    return _spaced(decode_entities(F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")))


def strip_tags(x: Column) -> Column:
    """Text of a snippet: tags go without a trace."""
    return _spaced(decode_entities(F.regexp_replace(x, r"<[^>]+>", "")))


def looks_js_only(html: Column, text: Column) -> Column:
    return (F.length(text) <= 400) & html.rlike(r"(?i)enable javascript|please enable js|id=[\"']root[\"']|id=[\"']app[\"']|__NEXT_DATA__")


def has_contact_signal(text: Column) -> Column:
    """Does a text hold an address, a phone number or a pastor's title?"""
    mail = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    phone = r"\(?\b\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}\b"
    return text.rlike(mail) | says(text, phone) | says(text, r"(?i)\b(lead|senior|associate|executive|founding)\s+pastor\b")


def social_links(text: Column) -> Column:
    """Profiles named in a text, as URLs, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)((?:facebook\.com|instagram\.com|youtube\.com|youtu\.be)/[^\s\"'<)]+)"), 1)
    return F.transform(found, lambda x: F.concat(F.lit("https://"), x))


# Navigation that a site has of its own, and first-person phrases.
NAV_ITEMS = r"(?i)\b(give|giving|donate|tithe|sermons?|messages|watch ?(live)?|plan (your|a) visit|i'?m new|im new|ministr(y|ies)|small ?groups?|life ?groups?|connect|next steps|events|prayer requests?|service times|what to expect|our beliefs|new here)\b"
FIRST_PERSON = r"(?i)plan (your|a) visit|service times|what to expect|join us (this )?sunday|our (church|services|pastor)|give online|i'?m new|connect card|weekend services"


def ownership_signals(labels: Column, text: Column) -> Column:
    """Distinct navigation items among the labels of links, and up to three
    first-person phrases of the text."""
    items = F.transform(labels, lambda x: F.lower(_spaced(F.regexp_extract(x, NAV_ITEMS, 0))))
    return F.size(F.array_distinct(F.filter(items, lambda x: x != ""))) + F.least(F.regexp_count(text, F.lit(FIRST_PERSON)), F.lit(3))


def source_type_of_category(category: Column) -> Column:
    """Kind of source that a page of the own site is."""
    return (
        F.when(category.isin("staff", "leadership"), "staff_page")
        .when(category == "contact", "contact_page")
        .when(category == "about", "about_history")
        .when(category.isin("locations", "sermons", "missions"), "sermon_livestream")
        .otherwise("official_site")
    )
