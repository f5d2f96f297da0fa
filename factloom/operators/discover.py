"""Which site belongs to which organisation: seeds, candidates, choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.config import SETTINGS, Settings
from factloom.functions import html as H
from factloom.functions import identity as I
from factloom.functions import urls as U
from factloom.operators.ranking import first_per
from factloom.operators.search import choose_site


def seeds(targets: DataFrame, results: DataFrame, most_guesses: int = 12) -> DataFrame:
    """Sites to look at per entity, one per host: the one that was given, a site
    named as alternative name, search results in order, then guessed domains.

    targets: entity_id, name, city, state, website, alternative; results:
    entity_id, rank, url.
    """
    other = F.trim("alternative")
    looks = other.rlike(r"(?i)\.[a-z]{2,}(/|$)") & other.rlike(r"^[A-Za-z0-9_.\-/:]+$")
    given = targets.select("entity_id", F.lit(0).alias("step"), F.lit(0).alias("place"), F.lit("original").alias("source"), U.normalize_url(F.col("website")).alias("url"))
    named = targets.where(looks).select("entity_id", F.lit(1), F.lit(0), F.lit("urlname"), U.normalize_url(other))
    found = results.select("entity_id", F.lit(2), "rank", F.lit("search"), U.normalize_url(F.col("url")))
    told = given.union(named).union(found).withColumn("host", U.host_of(F.col("url"))).where("host <> ''")
    told = first_per(told, ["entity_id", "host"], [F.asc("step"), F.asc("place")])
    guesses = targets.select("entity_id", F.posexplode(I.domain_guesses(F.col("name"), F.col("city"), F.col("alternative"))).alias("place", "url"))
    guesses = guesses.withColumn("host", U.host_of(F.col("url"))).join(told.select("entity_id", "host"), ["entity_id", "host"], "left_anti")
    at = F.row_number().over(Window.partitionBy("entity_id").orderBy("place"))
    kept = guesses.withColumn("n", at).where(F.col("n") <= most_guesses).select("entity_id", F.lit(3).alias("step"), "place", F.lit("domain_guess").alias("source"), "url", "host")
    seq = F.row_number().over(Window.partitionBy("entity_id").orderBy("step", "place"))
    return told.select(*kept.columns).unionByName(kept).withColumn("seq", seq)


def inspect(pages: DataFrame) -> DataFrame:
    """What a page shows of its owner, per host. Pages: host, status, html."""
    raw = F.substring("html", 1, 80_000)
    seen = pages.withColumns({"text": H.visible_text(raw), "labels": F.transform(H.links(raw), lambda x: x["text"]), "identity_text": H.identity_text(raw)})
    return seen.select(
        "host",
        F.col("status").between(200, 299).alias("reachable"),
        "identity_text",
        F.lower(F.substring("text", 1, 20_000)).alias("body"),
        I.is_parked(F.col("text")).alias("parked"),
        F.lower("text").rlike(I.CONTENT_TERMS).alias("content"),
        H.ownership_signals(F.col("labels"), F.col("text")).alias("ownership"),
    )


def candidates(targets: DataFrame, found: DataFrame, sites: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Every seed with its kind, identity and verdict.

    found: as from ``seeds``; sites: as from ``inspect``. A host without a page
    can't be reached.
    """
    c = F.col
    joined = found.join(targets.select("entity_id", "name", "city", "state", "alternative"), "entity_id").join(sites, "host", "left")
    reachable = F.coalesce("reachable", F.lit(False))
    joined = joined.withColumns({k: F.coalesce(k, F.lit("")) for k in ("identity_text", "body")} | {"reachable": reachable} | {k: F.coalesce(k, F.lit(False)) for k in ("parked", "content")} | {"ownership": F.coalesce("ownership", F.lit(0))})
    joined = joined.withColumns({"words": I.distinctive(c("name")), "other_words": I.distinctive(c("alternative"))})
    shown = F.when(c("identity_text") == "", c("host")).otherwise(c("identity_text"))
    joined = joined.withColumns({"own_ratio": I.name_match(shown, c("host"), c("words")), "other_ratio": I.name_match(shown, c("host"), c("other_words"))})
    whole = lambda r, w, n: (c(r) == 1) & (F.size(w) >= n)
    phrase = c("reachable") & I.has_phrase(F.concat_ws(" ", "identity_text", "body"), c("name"), c("alternative"))
    joined = joined.withColumns(
        {
            "name_ratio": F.greatest("own_ratio", "other_ratio"),
            "name_full": whole("own_ratio", "words", 1) | whole("other_ratio", "other_words", 1),
            "name_strong": whole("own_ratio", "words", 2) | whole("other_ratio", "other_words", 2) | phrase,
            "place": F.when(c("reachable"), I.location_status(c("identity_text"), c("body"), c("city"), c("state"))).otherwise("unknown"),
            "provided": c("source").isin("original", "urlname"),
            "usable_name": F.size("words") + F.size("other_words") > 0,
        }
    )
    kind = I.site_kind(c("host"), U.path_of(c("url")), c("body"), c("name_ratio"), U.is_directory(c("url")), c("provided"), c("name_full"), c("ownership"), c("content"))
    joined = joined.withColumn("kind", F.when(c("reachable"), kind).otherwise("unknown"))
    score = I.identity_score(c("reachable"), c("parked"), c("usable_name"), c("kind"), c("provided"), c("name_strong"), c("name_ratio"), c("place"), c("content"), c("ownership"), settings)
    return joined.withColumn("identity", score).withColumn("verdict", I.verdict(c("identity"), settings)).select(
        "entity_id", "seq", "url", "host", "source", "reachable", "kind", "name_ratio", "name_full", "name_strong", "place", "ownership", "identity", "verdict"
    )


def official_sites(targets: DataFrame, every: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Per entity: the site that was chosen, or null, and the best identity."""
    best = every.groupBy("entity_id").agg(F.max("identity").alias("best_identity"), F.count(F.lit(1)).alias("n_candidates"))
    won = choose_site(every, settings).select("entity_id", F.col("url").alias("official_site"), F.col("identity").alias("site_identity"))
    return targets.select("entity_id").join(best, "entity_id", "left").join(won, "entity_id", "left")
