"""Search results, robots rules, links and candidates of sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.config import SETTINGS, Settings
from factloom.functions import urls as U
from factloom.operators.ranking import first_per
from factloom.sources.staging import staged


def meta_search(results: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Merged results of several providers per query: each URL from the first that
    has it, providers only until enough hosts are found, and a limited number.

    Needs query_id, provider_rank, pos, url.
    """
    web = results.where(F.startswith("url", F.lit("http"))).withColumn("host", U.host_of(F.col("url")))
    once = first_per(web, ["query_id", "url"], [F.asc("provider_rank"), F.asc("pos")])
    # a host counts where it is first seen; later providers are cut off behind the sum
    hosts = first_per(once, ["query_id", "host"], [F.asc("provider_rank"), F.asc("pos")])
    found = hosts.groupBy("query_id", "provider_rank").agg(F.count(F.lit(1)).alias("new_hosts"))
    ranks = results.select("query_id", "provider_rank").distinct().join(found, ["query_id", "provider_rank"], "left")
    before = Window.partitionBy("query_id").orderBy("provider_rank").rowsBetween(Window.unboundedPreceding, -1)
    asked = ranks.withColumn("hosts_before", F.coalesce(F.sum(F.coalesce("new_hosts", F.lit(0))).over(before), F.lit(0))).where(F.col("hosts_before") < settings.min_hosts)
    kept = once.join(asked.select("query_id", "provider_rank"), ["query_id", "provider_rank"])
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("provider_rank", "pos"))
    return kept.withColumn("rank", at).where(F.col("rank") <= settings.search_limit)


def robots_rules(lines: DataFrame, agent: str) -> DataFrame:
    """Allow and disallow rules that hold for an agent: origin, kind, path_rule.

    ``lines`` has origin, line_no, line. A group begins with user-agent lines; the
    last one before a rule decides.
    """
    clean = F.trim(F.regexp_replace("line", r"#.*$", ""))
    parts = lines.select("origin", "line_no", F.lower(F.trim(F.substring_index(clean, ":", 1))).alias("kind"), F.trim(F.regexp_extract(clean, r"^[^:]*:(.*)$", 1)).alias("value"))
    name = F.lower("value")
    mine = (name == "*") | F.lit(agent.lower()).contains(name)
    upto = Window.partitionBy("origin").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = F.last(F.when(F.col("kind") == "user-agent", mine), ignorenulls=True).over(upto)
    return parts.withColumn("active", active).where(F.col("active") & F.col("kind").isin("allow", "disallow") & (F.col("value") != "")).select("origin", "kind", F.col("value").alias("path_rule"))


def rule_pattern(rule: Column) -> Column:
    """Regular expression of a rule, in which * stands for anything and $ for the end."""
    anchored = rule.endswith("$")
    body = F.when(anchored, F.expr("substring(path_rule, 1, length(path_rule) - 1)")).otherwise(rule)
    quoted = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(anchored, F.lit("$")).otherwise(F.lit("")))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether each URL may be fetched: the longest matching rule decides, allow
    wins ties. ``urls`` has origin and url; rules are joined by origin."""
    path = urls.withColumn("path", F.coalesce(F.nullif(F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/")))
    hit = path.join(rules.withColumn("pattern", rule_pattern(F.col("path_rule"))), "origin", "left").withColumn("hit", F.expr("path rlike pattern"))
    longest = lambda kind: F.coalesce(F.max(F.when(F.col("hit") & (F.col("kind") == kind), F.length("path_rule"))), F.lit(-1))
    out = hit.groupBy("origin", "url").agg(longest("allow").alias("allow_length"), longest("disallow").alias("disallow_length"))
    return out.withColumn("allowed", (F.col("disallow_length") == -1) | (F.col("allow_length") >= F.col("disallow_length")))


def choose_site(candidates: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """The accepted official site of each entity: highest identity, first of equal
    ones, among those of the official kind that reach the threshold.

    Needs entity_id, seq, kind, identity.
    """
    fit = candidates.where((F.col("kind") == "official") & (F.col("identity") >= settings.accept_identity))
    return first_per(fit, ["entity_id"], [F.desc("identity"), F.asc("seq")])


def contamination(candidates: DataFrame) -> DataFrame:
    """Sites of namesakes elsewhere, once per entity and URL."""
    other = candidates.where(F.col("name_full") & (F.col("place") == "conflict") & ((F.col("kind") == "official") | (F.col("source") == "search")))
    return first_per(other, ["entity_id", "url"], [F.asc("seq")])


#: Shingles of phrases (8 bytes each) that are broadcast; more are joined by a shuffle.
MOST_ANCHORS = 1_000_000


def phrase_hits(documents: DataFrame, phrases: DataFrame, words: int = 5) -> DataFrame:
    """Documents that contain a phrase as a whole: doc_id, item_id, both as given.

    Every phrase has an anchor, its rarest shingle of ``words`` words in the
    documents (a shorter phrase is its own anchor); documents meet it by that
    anchor, then the whole phrase is compared. Documents and phrases need
    (doc_id, text) and (item_id, text).
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    hashes = lambda c: F.transform(F.split(c, " "), lambda w: F.xxhash64(w))
    # a shingle is the hash of its words' hashes: numbers only, and what meets by chance fails the comparison
    shingles = lambda ws, n: F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.xxhash64(F.slice(ws, i, n)))
    items = phrases.select("item_id", norm(F.col("text")).alias("phrase")).where("phrase <> ''").withColumn("ws", hashes(F.col("phrase")))
    items = items.withColumn("n", F.least(F.size("ws"), F.lit(words)))
    docs = documents.select("doc_id", norm(F.col("text")).alias("body")).withColumn("ws", hashes(F.col("body")))
    anchors = items.select("item_id", "phrase", "n", F.explode(shingles(F.col("ws"), F.col("n"))).alias("anchor"))
    named = anchors.select("anchor", "n").distinct()
    # the phrases are the query set: their shingles are counted before they are broadcast
    sizes = {r["n"]: r["count"] for r in named.groupBy("n").count().collect()}
    if not sizes:
        return documents.select("doc_id").join(phrases.select("item_id"), F.lit(False))
    few = sum(sizes.values()) <= MOST_ANCHORS
    met = None
    for n in sorted(sizes):
        grams = docs.where(F.size("ws") >= n).select("doc_id", F.explode(F.array_distinct(shingles(F.col("ws"), F.lit(n)))).alias("anchor"))
        wanted = named.where(F.col("n") == n).select("anchor")
        part = grams.join(F.broadcast(wanted) if few else wanted, "anchor", "left_semi")
        met = part if met is None else met.unionByName(part)
    met = staged(met, "met")
    counts = met.groupBy("anchor").agg(F.count(F.lit(1)).alias("seen"))
    rarest = first_per(anchors.join(counts, "anchor"), ["item_id"], [F.asc("seen"), F.asc("anchor")])
    pairs = staged(met.join(rarest, "anchor").select("doc_id", "item_id", "phrase").distinct(), "pairs")
    whole = F.concat(F.lit(" "), F.col("body"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    return pairs.join(docs.select("doc_id", "body"), "doc_id").where(whole).select("doc_id", "item_id")
