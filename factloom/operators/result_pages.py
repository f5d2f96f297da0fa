"""Results from the pages of search engines, by a table of grammars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import html as H
from factloom.functions import urls as U


@dataclass(frozen=True)
class Grammar:
    """Where a provider's records are and what is in them: a mark that parts records, or
    a pattern of whole records; the pattern of a link (groups URL and title); that of a
    snippet, if pages have one; another pattern of records, for pages in which the
    first finds none; whether links are redirects."""

    link: str
    mark: str | None = None
    records: str | None = None
    snippet: str | None = None
    otherwise: tuple[str, str] | None = None
    redirects: bool = False


# The markup of four providers' pages.
GRAMMARS: dict[str, Grammar] = {
    "duckduckgo-html": Grammar(link=r"result__a\"[^>]*href=\"([^\"]+)\"[^>]*>([\s\S]*?)</a>", mark="result__body", snippet=r"result__snippet\"[^>]*>([\s\S]*?)</a>", redirects=True),
    "duckduckgo-lite": Grammar(link=r"(?i)<a[^>]*class=\"result-link\"[^>]*href=\"([^\"]+)\"[^>]*>([\s\S]*?)</a>", records=r"(?i)<a[^>]*class=\"result-link\"[^>]*href=\"[^\"]+\"[^>]*>[\s\S]*?</a>", redirects=True),
    "bing": Grammar(link=r"(?i)<h2>\s*<a[^>]*href=\"([^\"]+)\"[^>]*>([\s\S]*?)</a>", records=r"(?i)<li class=\"b_algo\"[\s\S]*?<h2>\s*<a[^>]*href=\"[^\"]+\"[^>]*>[\s\S]*?</a>"),
    "mojeek": Grammar(
        link=r"(?i)<a[^>]*class=\"ob\"[^>]*href=\"([^\"]+)\"[\s\S]*?<a[^>]*class=\"title\"[^>]*href=\"[^\"]+\"[^>]*>([\s\S]*?)</a>",
        records=r"(?i)<a[^>]*class=\"ob\"[^>]*href=\"[^\"]+\"[\s\S]*?<a[^>]*class=\"title\"[^>]*href=\"[^\"]+\"[^>]*>[\s\S]*?</a>",
        otherwise=(r"(?i)<a class=\"title\"[^>]*href=\"[^\"]+\"[^>]*>[\s\S]*?</a>", r"(?i)<a class=\"title\"[^>]*href=\"([^\"]+)\"[^>]*>([\s\S]*?)</a>"),
    ),
}


def _records(g: Grammar, body: Column) -> Column:
    """The records of a page as structs of URL, title and snippet, in order."""

    def read(link: str):
        def one(r: Column) -> Column:
            href, title = F.regexp_extract(r, link, 1), F.regexp_extract(r, link, 2)
            snippet = H.strip_tags(F.regexp_extract(r, g.snippet, 1)) if g.snippet else F.lit("")
            return F.struct((U.decode_redirect(href) if g.redirects else href).alias("url"), H.strip_tags(title).alias("title"), snippet.alias("snippet"))

        return one

    if g.mark:
        parts = F.split(body, g.mark)
        return F.transform(F.filter(F.slice(parts, 2, F.size(parts)), lambda r: r.rlike(g.link)), read(g.link))
    found = F.transform(F.regexp_extract_all(body, F.lit(g.records), 0), read(g.link))
    if g.otherwise is None:
        return found
    records, link = g.otherwise
    return F.when(body.rlike(g.records), found).otherwise(F.transform(F.regexp_extract_all(body, F.lit(records), 0), read(link)))


def read_pages(pages: DataFrame, grammars: dict[str, Grammar] = GRAMMARS) -> DataFrame:
    """The pages with ``found``, their records, and without their bodies; an unknown
    provider or a null body has none. Pages need provider and body."""
    body = F.coalesce("body", F.lit(""))
    found = F.array().cast("array<struct<url: string, title: string, snippet: string>>")
    for name, g in grammars.items():
        found = F.when(F.col("provider") == name, _records(g, body)).otherwise(found)
    return pages.withColumn("found", found).drop("body")


def results(read: DataFrame) -> DataFrame:
    """A row per result: page_id, provider, result_no (from 0), url, title, snippet."""
    return read.select("page_id", "provider", F.posexplode("found").alias("result_no", "r")).select("page_id", "provider", "result_no", "r.*")


def diagnostics(read: DataFrame) -> DataFrame:
    """A row per page: page_id, provider, status (0 if the request failed), result_count, ok, note."""
    n = F.size("found")
    return read.select("page_id", "provider", F.coalesce("status", F.lit(0)).alias("status"), n.alias("result_count"), (n > 0).alias("ok"), "note")
