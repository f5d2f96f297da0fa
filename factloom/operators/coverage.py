"""What the research covered, and how far its scores can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.extract import OPEN_END, divided_bits, signal_bits, signal_summary, signals_of_bits
from factloom.functions.urls import host_of
from factloom.sources.staging import staged

ROLE_FACTS = ["lead_pastor", "executive_pastor", "operations_leader", "communications_leader"]
TIER_CONFIDENCE = {"Low": 38, "Medium": 55, "High": 76}


#: A pattern that blanks may divide has so many words at most; a word that no pattern crosses.
SPAN, BREAK = 4, "\x01"


def _joined_ends(pieces: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """entity_id and the end of each piece with what follows it, as far as a pattern goes."""
    at = Window.partitionBy(*by).orderBy(*order)
    following = [F.lead("short", k).over(at) for k in range(1, SPAN)]
    return pieces.select("entity_id", F.concat_ws(" \n ", "last", *following).alias("hay"))


def _over_ends(own: DataFrame) -> DataFrame:
    """entity_id and bits of the patterns that run over the ends of findings: the last
    words of each are read with the first of those that follow it, in ranges of
    (entity, seq) and then over the ends of ranges; no entity's findings meet in one
    row or task."""
    # ends are cut at words; a finding of few words is kept whole
    first = F.regexp_extract("low", rf"^\s*(\S+(?:\s+\S+){{0,{SPAN - 1}}})", 1)
    last = F.regexp_extract("low", rf"(?<!\S)(\S+(?:\s+\S+){{0,{SPAN - 1}}})\s*$", 1)
    few = F.trim(F.regexp_replace("low", r"\s+", " "))
    whole = ~F.col("low").rlike(rf"^\s*(?:\S+\s+){{{2 * SPAN}}}\S")
    ends = own.where(F.col("low").rlike(r"\S")).select("entity_id", "seq", F.when(whole, few).otherwise(last).alias("last"), F.when(whole, few).otherwise(F.concat_ws(f" {BREAK} ", first, last)).alias("short"))
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once, so that what is near and what is far see the same ranges
    ranged = staged(ends.repartitionByRange(n, "entity_id", "seq", "short").withColumn("range", F.spark_partition_id()), "ranges")
    near = _joined_ends(ranged, ["entity_id", "range"], ["seq", "short"])
    up = Window.partitionBy("entity_id", "range").orderBy("seq", "short")
    down = Window.partitionBy("entity_id", "range").orderBy(F.desc("seq"), F.desc("short"))
    placed = ranged.withColumns({"up": F.row_number().over(up), "down": F.row_number().over(down)}).where((F.col("up") < SPAN) | (F.col("down") < SPAN))
    # what is between the first and the last of a range is left out here
    gap = (F.col("up") == SPAN - 1) & (F.col("down") > SPAN)
    closed = placed.withColumns({c: F.when(gap, F.concat_ws(" ", c, F.lit(BREAK))).otherwise(F.col(c)) for c in ("last", "short")})
    far = _joined_ends(closed, ["entity_id"], ["range", "seq", "short"])
    return near.unionByName(far).select("entity_id", divided_bits(F.col("hay")).alias("bits"))


def signals_by_entity(findings: DataFrame) -> DataFrame:
    """Digital signals over all of an entity's findings, in order.

    Patterns are matched per finding and combined. Some may also run over the ends of
    findings, but only where one ends with the words that begin such a pattern; the
    other entities' findings are read once, and only bits leave a task. Each entity's
    signals are written, as several plans may start from them.
    Needs entity_id, seq, title, body, url.
    """
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")), "url")
    own = findings.select("entity_id", "seq", F.lower(text).alias("low"))
    bits = own.select("entity_id", signal_bits(F.col("low")).alias("bits"), F.col("low").rlike(OPEN_END).alias("open"))
    named = staged(bits.groupBy("entity_id").agg(F.bit_or("bits").alias("bits"), F.bool_or("open").alias("open")), "signals")
    open_ = named.where("open").select(F.col("entity_id").alias("open_id"))
    if not open_.isEmpty():
        over = _over_ends(own.join(open_, F.col("entity_id").eqNullSafe(F.col("open_id")), "left_semi"))
        named = staged(named.select("entity_id", "bits").unionByName(over).groupBy("entity_id").agg(F.bit_or("bits").alias("bits")), "signals")
    made = signals_of_bits(F.col("bits"))
    out = named.select("entity_id", *(c.alias(k) for k, c in made.items()))
    return out.withColumn("evidence_summary", signal_summary({k: F.col(k) for k in made}))


def coverage_rows(findings: DataFrame, links: DataFrame, facts: DataFrame, signals: DataFrame) -> DataFrame:
    """Eight rows per entity: category, required, found, fetched, rendered, useful.

    findings: entity_id, seq, category, fetched, rendered, text_length. links:
    entity_id, category. facts: entity_id, field_name, value. signals as above.
    """
    groups = {"homepage": ["home"], "staff": ["staff", "leadership"], "contact": ["contact"], "about": ["about"], "ministries": ["ministries"], "sermons": ["sermons", "locations", "missions"]}
    usable = {k: F.col("category").isin(v) & (F.lit(True) if k == "homepage" else F.col("fetched")) for k, v in groups.items()}
    page = findings.groupBy("entity_id").agg(
        *(F.min_by(F.when(ok, F.struct("rendered", "text_length")), F.when(ok, F.col("seq"))).alias(k) for k, ok in usable.items())
    )
    linked = links.groupBy("entity_id").agg(*(F.bool_or(F.col("category").isin(v)).alias(f"link_{k}") for k, v in groups.items()))
    has = lambda *names: F.coalesce(F.bool_or(F.col("field_name").isin(*names) & (F.coalesce("value", F.lit("")) != "")), F.lit(False))
    known = facts.groupBy("entity_id").agg(
        F.count_if(F.col("field_name").isin(ROLE_FACTS) & (F.coalesce("value", F.lit("")) != "")).cast("int").alias("roles"),
        has("staff_count").alias("staff_known"),
        has("office_email", "office_phone").alias("contact_known"),
        has("founded_year").alias("founded_known"),
    )
    wide = page.join(linked, "entity_id", "left").join(known, "entity_id", "left").join(signals, "entity_id", "left")
    yes = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))
    there = lambda k: F.col(k).isNotNull()
    size = lambda k: F.coalesce(F.col(f"{k}.text_length"), F.lit(0))
    media = yes("youtube") | yes("livestream") | yes("podcast")

    def row(category: str, required: bool, fetched: Column, found: Column, useful: Column) -> Column:
        rendered = yes(f"{category}.rendered") if category in groups else F.lit(False)
        return F.struct(
            F.lit(category).alias("category"), F.lit(required).alias("required"), (fetched | found).alias("found"), fetched.alias("fetched"), rendered.alias("rendered"), useful.alias("useful")
        )

    rows = F.array(
        row("homepage", True, there("homepage"), F.lit(False), there("homepage") & (size("homepage") > 200)),
        row("staff", True, there("staff"), yes("link_staff"), there("staff") & ((F.coalesce("roles", F.lit(0)) > 0) | yes("staff_known"))),
        row("contact", True, there("contact"), yes("link_contact"), yes("contact_known")),
        row("about", True, there("about"), yes("link_about"), there("about") & (yes("founded_known") | (size("about") > 300))),
        row("ministries", False, there("ministries"), yes("link_ministries"), there("ministries")),
        row("giving", False, F.lit(False), yes("online_giving"), yes("online_giving")),
        row("sermons", False, there("sermons"), media, media),
        row("app", False, F.lit(False), yes("church_app"), yes("church_app")),
    )
    return wide.select("entity_id", F.inline(rows))


def score_confidences(coverage: DataFrame, signals: DataFrame) -> DataFrame:
    """Tier and confidence of each strategic score: entity_id, metric, tier, confidence."""
    of = lambda c, what: F.coalesce(F.bool_or((F.col("category") == c) & F.col(what)), F.lit(False))
    facts = coverage.groupBy("entity_id").agg(
        of("staff", "useful").alias("staff_useful"),
        of("staff", "rendered").alias("staff_rendered"),
        of("contact", "useful").alias("contact_useful"),
        F.count_if(F.col("required") & F.col("fetched")).alias("required_fetched"),
    )
    both = facts.join(signals.select("entity_id", "signals_detected"), "entity_id", "left")
    n = F.coalesce("signals_detected", F.lit(0))
    pages = F.when(F.col("required_fetched") >= 3, "High").when(F.col("required_fetched") == 2, "Medium").otherwise("Low")
    tiers = {
        "staff_depth_score": F.when(F.col("staff_useful") & F.col("staff_rendered"), "High").when(F.col("staff_useful"), "Medium").otherwise("Low"),
        "digital_maturity_score": F.when(n >= 4, "High").when(n >= 2, "Medium").otherwise("Low"),
        "growth_orientation_score": pages,
        "change_readiness_score": pages,
        "contactability": F.when(F.col("contact_useful") & F.col("staff_useful"), "High").when(F.col("contact_useful") | F.col("staff_useful"), "Medium").otherwise("Low"),
    }
    level = F.create_map(*(F.lit(x) for pair in TIER_CONFIDENCE.items() for x in pair))
    rows = both.select("entity_id", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), t.alias("tier")) for m, t in tiers.items()))))
    return rows.withColumn("confidence", level[F.col("tier")])


# Source categories and the source types that belong to them.
SOURCE_CATEGORIES = [
    ("staff page", ["staff_page"]), ("social", ["facebook", "instagram", "linkedin"]), ("video/sermons", ["youtube", "sermon_livestream"]),
    ("jobs", ["job_posting"]), ("directory/network", ["denom_directory", "church_directory"]), ("news/articles", ["news_media"]),
]


def source_coverage(findings: DataFrame, signals: DataFrame) -> DataFrame:
    """Eight rows per entity: category, present, count, hosts (at most four, in order).

    Needs entity_id, seq, source_type, access_level, fetched, url.
    """
    tests = {"official site": (F.col("access_level") == "live_official_site") & F.col("fetched")}
    tests |= {name: F.col("source_type").isin(types) for name, types in SOURCE_CATEGORIES}
    # hosts are first reduced to the earliest finding of each, and those to the first four
    once = findings.select("entity_id", F.inline(F.array(*(F.struct(F.lit(k).alias("category"), t.alias("hit")) for k, t in tests.items()))), "seq", "url").where("hit")
    per_host = once.groupBy("entity_id", "category", host_of(F.col("url")).alias("h")).agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    at = F.row_number().over(Window.partitionBy("entity_id", "category").orderBy("seq", "h"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("at") <= 4, F.struct("seq", "h")))), lambda x: x["h"])
    counts = per_host.withColumn("at", at).groupBy("entity_id", "category").agg(F.sum("n").alias("count"), listed.alias("hosts"))
    names = [*tests, "app/platform"]
    every = findings.select("entity_id").distinct().select("entity_id", F.explode(F.array(*(F.lit(n) for n in names))).alias("category"))
    full = every.join(counts, ["entity_id", "category"], "left").join(signals, "entity_id", "left")
    app, video = F.col("category") == "app/platform", F.col("category") == "video/sermons"
    platforms = F.coalesce(F.size("platforms"), F.lit(0))
    count = F.when(app, platforms.cast("long")).otherwise(F.coalesce("count", F.lit(0)))
    extra = (video & F.coalesce(F.col("youtube") | F.col("livestream") | F.col("podcast"), F.lit(False))) | (app & F.coalesce(F.col("church_app"), F.lit(False)))
    return full.select("entity_id", "category", ((count > 0) | extra).alias("present"), count.alias("count"), F.coalesce(F.array_join("hosts", ", "), F.lit("")).alias("hosts"))


def source_breadth(sources: DataFrame) -> DataFrame:
    """How many kinds of source beside the official site each entity has."""
    return sources.groupBy("entity_id").agg(F.count_if(F.col("present") & (F.col("category") != "official site")).alias("breadth"))
