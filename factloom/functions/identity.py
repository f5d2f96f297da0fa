"""Is a site the site of an organisation? Tokens, names, places and the verdict."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.config import SETTINGS, STATES, STOP_WORDS, Settings
from factloom.functions.extract import ascii_bounds


def _accented() -> dict[str, str]:
    """Small letters of the Latin blocks that are an ASCII letter with marks."""
    found = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        first, *marks = unicodedata.normalize("NFKD", c)
        if c.islower() and first.isascii() and all(map(unicodedata.combining, marks)):
            found[c] = first
    return found


ACCENTED = _accented()


def unaccented(lower: Column) -> Column:
    """Latin letters without their marks; a mark ends a word, as it would stand
    behind its letter where letters and marks are taken apart."""
    marked = F.regexp_replace(lower, "([\u00c0-\u024f\u1e00-\u1eff])", "$1 ")
    return F.translate(marked, "".join(ACCENTED), "".join(ACCENTED.values()))


def tokens(name: Column) -> Column:
    """Lower-case words of two letters or more, without accents and stop words."""
    words = F.split(F.regexp_replace(unaccented(F.lower(F.coalesce(name, F.lit("")))), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def distinctive(name: Column) -> Column:
    return F.filter(tokens(name), lambda w: (F.length(w) >= 3) & w.rlike("[a-z]"))


def phrase(text: Column) -> Column:
    """Words of two letters or more between single blanks."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "), " ")
    return F.concat(F.lit(" "), F.array_join(F.filter(words, lambda w: F.length(w) >= 2), " "), F.lit(" "))


def has_phrase(hay: Column, *names: Column) -> Column:
    """Does one of the names, of two words or more, stand in the text as a whole?"""
    out = F.lit(False)
    for n in names:
        p = phrase(n)
        out = out | ((F.size(F.split(F.trim(p), " ")) >= 2) & phrase(hay).contains(p))
    return out


def name_match(identity: Column, host: Column, words: Column) -> Column:
    """Share of the words that begin a word of the text or are in the host."""
    starts = F.concat(F.lit(" "), F.regexp_replace(F.lower(identity), r"[^a-z0-9_]", " "))
    hit = F.filter(words, lambda w: (F.length(w) >= 3) & (starts.contains(F.concat(F.lit(" "), w)) | host.contains(w)))
    return F.when(F.size(words) > 0, F.size(hit) / F.size(words)).otherwise(0.0)


def states_in(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(ascii_bounds(r",\s*([A-Z]{2})\b")), 1), lambda s: s.isin(STATES)))


def location_status(identity: Column, body: Column, city: Column, state: Column) -> Column:
    """match if the city is named as a word, conflict if only other states are."""
    c = F.lower(F.coalesce(city, F.lit("")))
    padded = lambda x: F.concat(F.lit(" "), F.regexp_replace(F.lower(x), r"[^a-z0-9_]", " "), F.lit(" "))
    hay = padded(F.concat(identity, F.lit(" "), body))
    named = (F.length(c) >= 4) & hay.contains(padded(c))
    others = states_in(identity)
    conflict = (F.coalesce(state, F.lit("")) != "") & (F.size(others) > 0) & ~F.array_contains(others, F.upper(state))
    return F.when(named, "match").when(F.coalesce(conflict, F.lit(False)), "conflict").otherwise("unknown")


# Hosts, paths and words that tell what kind of site it is.
RESOURCE_HOSTS = [
    "cbsclass.org", "communitybiblestudy.org", "bsfinternational.org", "biblestudyfellowship.org", "sermonaudio.com", "sermonindex.net",
    "gotquestions.org", "biblegateway.com", "youversion.com", "blogspot.com", "wordpress.com", "patheos.com",
]
VENDOR_HOST = r"construct|builder|contractor|architect|engineer|roofing|hvac|interior|consult(ing|ants?)?|realty|realestate|signage|landscap|plumb|electric|paving|millwork|cabinetry|flooring|concrete|drywall|glass|steel|mechanical|integrat|designbuild|avsystems|soundsystem|propertie?s"
VENDOR_CONTENT = r"portfolio|case stud|our (work|projects)|completed (project|in|the)|general contractor|design[- ]build|scope of work|square feet|sq\.? ?ft|project (gallery|profile|details)|we (built|designed|constructed|completed)|client[:s]|architectural"
VENDOR_PATH = r"/portfolio/|/projects?/|/our-work/|/work/|/case-stud"
MEDIA_HOST = r"(^|\.)(news|tribune|times|herald|gazette|chronicle|journal|patch|cbs|abc|nbc|fox|click2houston|communityimpact|press|magazine|dailymail|guardian|reuters|apnews|axios|patheos)"
MEDIA_CONTENT = r"staff (writer|reporter)|by [a-z]+ [a-z]+, (staff|correspondent)|published (on|at)|read more|subscribe to (our )?newsletter|advertisement|all rights reserved.*(news|media)|originally appeared"
MEDIA_PATH = r"/news/|/article/|/story/|/stories/|/20\d\d/\d\d/"
SOCIAL_HOST = r"(^|\.)(facebook|instagram|twitter|tiktok|linkedin|threads|vimeo)\.com$|(^|\.)x\.com$|(^|\.)(youtube\.com|youtu\.be)$"
LISTING_HOST = r"(oklahomachurches|joinmychurch|faithstreet|churchangel|alluschurches|unitedstateschurches|christianchurchsearch|taxexemptworld|churchfinder|uschurch|findachurch|guidestar|propublica|causeiq|yelp|yellowpages|mapquest|tripadvisor|manta)"
DENOMINATION_HOST = r"(naz|nazarene|umc|sbc|district|presbytery|diocese|conference|assembliesofgod|\bag\.org|\.cog\.)"
DIRECTORY_PATH = r"church-directory|/directory/|find-a-church|/churches?/"
CONTENT_TERMS = r"church|worship|sermon|pastor|ministr|service times|gospel|congregation|nazarene|sunday|small group|discipleship"
PARKED_TERMS = r"domain (is )?for sale|buy this domain|this domain is parked|parked free|godaddy|sedoparking|hugedomains|namecheap|website coming soon|under construction"


def is_parked(text: Column) -> Column:
    return F.lower(text).rlike(PARKED_TERMS) | (F.length(F.regexp_replace(text, r"\s", "")) < 200)


def site_kind(host: Column, path: Column, body: Column, ratio: Column, directory: Column, provided: Column, full: Column, ownership: Column, content: Column) -> Column:
    """Kind of a site, by ordered rules on host, path and content."""
    resource = F.lit(False)
    for h in RESOURCE_HOSTS:
        resource = resource | (host == h) | host.endswith("." + h)
    low = F.lower(body)
    return (
        F.when(resource, "resource")
        .when(host.rlike(VENDOR_HOST) | (low.rlike(VENDOR_CONTENT) & path.rlike(VENDOR_PATH)), "vendor_reference")
        .when(host.rlike(MEDIA_HOST) | (low.rlike(MEDIA_CONTENT) & path.rlike(MEDIA_PATH)), "media_reference")
        .when(host.rlike(SOCIAL_HOST), "social_profile")
        .when(directory | host.rlike(LISTING_HOST) | host.rlike(r"[a-z]churches\.(com|org|net)$"), "general_directory")
        .when(path.rlike(DIRECTORY_PATH) | (host.rlike(DENOMINATION_HOST) & (ratio > 0)), "denom_directory")
        .when(ownership >= 2, "official")
        .when(content & (provided | full), "official")
        .otherwise("unknown")
    )


#: Evidence that a site's kind gives for its identity.
KIND_WEIGHT = {"official": 15, "denom_directory": 25, "general_directory": -10, "social_profile": -8, "resource": -30}


def identity_score(
    reachable: Column, parked: Column, usable_name: Column, kind: Column, provided: Column, strong: Column, ratio: Column, place: Column, content: Column, ownership: Column, settings: Settings = SETTINGS
) -> Column:
    """0 to 100: how sure it is that this is the organisation's own site."""
    name = F.when(strong, 45).when(ratio >= 0.5, 22).otherwise(-40)
    where = F.when(place == "match", 25).when(place == "conflict", -30).otherwise(0)
    weight = F.lit(-5)
    for k, w in KIND_WEIGHT.items():
        weight = F.when(kind == k, F.lit(w)).otherwise(weight)
    total = F.when(provided, 40).otherwise(0) + name + where + weight + F.when(reachable, 5).otherwise(0) + F.when(content, 5).otherwise(0)
    below = F.lit(settings.uncertain_identity - 1)
    anchored = provided | strong | (place == "match") | (ownership >= 2)
    total = F.when((kind != "official") | ~anchored, F.least(total, below)).otherwise(total)
    return (
        F.when(~reachable | parked | ~usable_name, 0)
        .when(kind.isin("vendor_reference", "media_reference"), 15)
        .otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total)))
        .cast("int")
    )


def verdict(score: Column, settings: Settings = SETTINGS) -> Column:
    return F.when(score >= settings.accept_identity, "true_match").when(score >= settings.uncertain_identity, "uncertain").otherwise("no_match")


def domain_guesses(name: Column, city: Column, alternative: Column, most: int = 20) -> Column:
    """Likely sites, in order: slugs of name, city and alternative name by domain."""
    n, c, a = (F.array_join(tokens(x), "") for x in (name, city, alternative))
    first = F.coalesce(F.lower(name).rlike(r"(^|[^a-z0-9_])first([^a-z0-9_]|$)"), F.lit(False))
    slug = lambda base, *more: [F.when(base != "", F.concat(base, F.lit(m))) for m in more]
    slugs = [
        *slug(n, "", "church", "naz", "nazarene"),
        F.when((n != "") & (c != "") & (c != n), F.concat(n, c)),
        *(F.when(first, s) for s in slug(c, "first", "firstnaz")),
        F.when(first & (c != ""), F.concat(F.lit("first"), c)),
        *slug(c, "naz", "nazarene"),
        *slug(a, "", "church"),
    ]
    long_enough = F.filter(F.array_distinct(F.array_compact(F.array(*slugs))), lambda s: F.length(s) >= 4)
    tlds = F.array(*(F.lit(t) for t in ("org", "church", "com", "net")))
    every = F.flatten(F.transform(long_enough, lambda s: F.transform(tlds, lambda t: F.concat(F.lit("https://www."), s, F.lit("."), t))))
    return F.slice(F.array_distinct(every), 1, most)
