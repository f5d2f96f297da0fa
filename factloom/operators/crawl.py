"""What a site's home page links to, what of it was read, and what to try besides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import html as H
from factloom.functions import urls as U
from factloom.operators.ranking import first_per, top_per
from factloom.sources.staging import staged

# Kinds of pages that a site should have, the kinds that count as such, and paths to try.
REQUIRED = [
    ("staff", ["staff", "leadership"], ["/staff", "/team", "/leadership", "/our-team"]),
    ("contact", ["contact"], ["/contact", "/connect"]),
    ("about", ["about"], ["/about", "/about-us", "/who-we-are"]),
]
MOST_PROBES = 6


def link_diagnostics(links: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each target that a home page links to, as first linked: resolved,
    same_origin, category, selected, fetched, text_length.

    links: entity_id, link_seq, href, text, base (the home page's URL); pages:
    entity_id, url, ok, text_length, one row for each URL. Mail and phone links are
    no targets. Only links of the same origin have a category, and of each category
    the first link is selected. Only what was selected can have been fetched.
    """
    c = F.col
    rows = links.where(~c("href").rlike(r"(?i)^(mailto|tel|javascript|data):")).withColumn("resolved", U.link_target(c("base"), c("href")))
    own = U.origin_of(c("resolved")) == U.origin_of(c("base"))
    rows = rows.withColumn("same_origin", own).withColumn("category", F.when(c("same_origin"), H.categorize(U.raw_path(c("resolved")), c("text"))))
    rows = staged(rows, "targets")
    chosen = first_per(rows.where("category is not null"), ["entity_id", "category"], [F.asc("link_seq")]).select("entity_id", "link_seq", F.lit(True).alias("picked"))
    rows = rows.join(chosen, ["entity_id", "link_seq"], "left").withColumn("selected", F.coalesce("picked", F.lit(False)))
    first = first_per(rows, ["entity_id", "resolved"], [F.asc("link_seq")])
    wanted = rows.where("selected").select("entity_id", "resolved").distinct()
    read = pages.withColumnRenamed("url", "resolved").join(wanted, ["entity_id", "resolved"], "left_semi").where("ok").select("entity_id", "resolved", c("text_length").alias("length"), F.lit(True).alias("there"))
    out = first.join(read, ["entity_id", "resolved"], "left")
    return out.select(
        "entity_id", "link_seq", "href", "text", "resolved", "same_origin", "category", "selected",
        F.coalesce("there", F.lit(False)).alias("fetched"), F.coalesce("length", F.lit(0)).cast("int").alias("text_length"),
    )


def probes(sites: DataFrame, pages: DataFrame, most: int = MOST_PROBES) -> DataFrame:
    """Paths to try at each site for required kinds of pages that it gave none of:
    entity_id, probe_no (from 1), url, category; ``most`` of a site, in order.

    sites: entity_id, origin; pages: entity_id, url, final_url, ok, category. A URL
    that was visited, or that a visit ended at, isn't tried again.
    """
    have = pages.where("ok and category is not null").select("entity_id", "category").distinct()
    tries = F.array(*(
        F.struct(F.lit(10 * i + j).alias("place"), F.lit(kind).alias("kind"), F.lit(path).alias("path"), F.array(*map(F.lit, counted)).alias("counted"))
        for i, (kind, counted, paths) in enumerate(REQUIRED) for j, path in enumerate(paths)
    ))
    kinds = F.broadcast(sites.sparkSession.createDataFrame([(kind, name) for kind, counted, _ in REQUIRED for name in counted], "kind string, category string"))
    covered = have.join(kinds, "category").select("entity_id", "kind").distinct()
    rows = sites.select("entity_id", "origin", F.inline(tries)).withColumn("url", F.concat("origin", "path"))
    seen = pages.select("entity_id", F.explode(F.array("url", "final_url")).alias("url")).distinct()
    left = rows.join(covered, ["entity_id", "kind"], "left_anti").join(seen, ["entity_id", "url"], "left_anti")
    ranked = top_per(left, ["entity_id"], [F.asc("place")], most, "probe_no")
    category: Column = F.coalesce(H.categorize(F.col("path"), F.lit("")), F.col("kind"))
    return ranked.select("entity_id", "probe_no", "url", category.alias("category"))
