"""Findings as text for a question, within a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a context, and of a finding's text on a page of staff and elsewhere.
MOST_CHARS, STAFF_CHARS, BODY_CHARS = 8000, 1500, 400
#: A line has at least so many characters, the words that all lines have.
LEAST_LINE = len("- [ | access= | fetched=true | rel=0] ")


def finding_line(staff_chars: int = STAFF_CHARS, body_chars: int = BODY_CHARS) -> Column:
    """One finding as lines: source type, access, reliability and URL, then title, text
    and fields, as far as it has them. Needs source_type, access_level, fetched,
    reliability, url, title, text, snippet and fields (field_name, value)."""
    body = F.coalesce(F.when(F.col("fetched"), F.col("text")).otherwise(F.col("snippet")), F.lit(""))
    cut = F.when(F.col("source_type") == "staff_page", F.substring(body, 1, staff_chars)).otherwise(F.substring(body, 1, body_chars))
    part = lambda there, label, value: F.when(there, F.concat(F.lit(f"\n   {label}: "), value)).otherwise("")
    told = F.array_join(F.transform("fields", lambda f: F.concat(f["field_name"], F.lit("="), F.coalesce(f["value"], F.lit("null")))), "; ")
    head = F.concat(
        F.lit("- ["), F.coalesce("source_type", F.lit("")), F.lit(" | access="), F.coalesce("access_level", F.lit("")), F.lit(" | fetched="), F.coalesce("fetched", F.lit(False)).cast("string"),
        F.lit(" | rel="), F.regexp_replace(F.coalesce("reliability", F.lit(0.0)).cast("string"), r"\.0$", ""), F.lit("] "), F.coalesce("url", F.lit("")),
    )
    return F.concat(head, part(F.coalesce("title", F.lit("")) != "", "title", F.col("title")), part(body != "", "text", cut), part(F.coalesce(F.size("fields"), F.lit(0)) > 0, "extracted", told))


def findings_context(findings: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """entity_id, context, n_findings: the lines of an entity's findings in order of seq,
    joined by line ends and cut off at ``most_chars`` characters.

    A line has LEAST_LINE characters, so only so many findings of an entity can be within
    the budget; the others go before their entity's rows meet, by a limit that each
    partition applies to what it has.
    """
    lines = findings.select("entity_id", "seq", finding_line().alias("line"))
    order = Window.partitionBy("entity_id").orderBy("seq", "line")
    few = lines.withColumn("no", F.row_number().over(order)).where(F.col("no") <= -(-most_chars // LEAST_LINE))
    # where each line begins, with the line ends before it
    ends = F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begun = few.withColumn("begin", ends - F.length("line") - 1).where(F.col("begin") < most_chars)
    fits = begun.withColumn("line", F.substring("line", F.lit(1), (F.lit(most_chars) - F.col("begin")).cast("int")))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n")
    # the line end that just doesn't fit is the last character that goes
    return fits.groupBy("entity_id").agg(F.substring(whole, 1, most_chars).alias("context"), F.count(F.lit(1)).alias("n_findings"))
