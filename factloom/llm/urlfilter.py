"""URL lists over time: every capture is judged by the list entries that were active when it was fetched.

Dated list entries become validity intervals: an addition holds until the next dated entry of the same list
and key. Captures meet entries on their keys (the host, its parent domains, the host with the first path
segment) and on the month; an interval stands in each month it touches, so that the captures of one very
common host spread over the months. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialize

#: Where an entry has no later one.
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """The lowered host of an absolute URL, without user and port; null where there is none."""
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":[0-9]*$", "")), F.lit(""))


def keys_of(url: Column) -> Column:
    """The keys an entry may name: host/segment, host, and the parent domains of two labels and more; an address has no parents."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    segment = F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1), F.lit(""))
    parents = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: (i == 1) | (i <= F.size(labels) - 1)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    parents = F.when(host.rlike(r"^[0-9.]+$|^\["), F.array(host)).otherwise(parents)
    return F.array_distinct(F.array_compact(F.concat(F.array(F.concat(host, F.lit("/"), segment)), parents)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Entries (key, list, action 'add' or 'remove', dated) as rows key, list, active_from, active_to (exclusive).

    Of several entries of a key and list on one day a removal counts last. Entries with a null in any of the
    four columns name nothing and are left out.
    """
    entries = entries.select("key", "list", "action", "dated").dropna().distinct()
    order = Window.partitionBy("key", "list").orderBy("dated", "action")
    ends = F.coalesce(F.lead("dated").over(order), F.lit(FOREVER).cast("date"))
    spans = entries.withColumn("active_to", ends).where("action = 'add' AND active_to > dated")
    return spans.select("key", "list", F.col("dated").alias("active_from"), "active_to")


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, fetched_on) with host, decision, list key and its interval.

    Of the entries active on the day of the fetch the longest key decides, then the latest start, then deny
    before allow. ``decision`` is 'deny', 'allow' or 'none'; the key and interval are null where it is 'none',
    as it is for a null or relative url and for a null day. Repeated rows are judged alike; further columns
    stay, but for those with the names of results. Empty captures give an empty result, empty entries 'none'.
    """
    captures = captures.drop("host", "decision", "matched_key", "active_from", "active_to")
    spans = validity_intervals(entries)
    # Only months with captures, of which there are few, whatever single days lie far off.
    months = captures.where("fetched_on IS NOT NULL").select(F.trunc("fetched_on", "month").alias("m")).distinct().orderBy("m").collect()
    touched = F.filter(
        F.array(*[F.lit(r["m"]) for r in months]).cast("array<date>"), lambda m: (m >= F.trunc("active_from", "month")) & (m < F.col("active_to"))
    )
    spans = spans.withColumn("month", F.explode(touched))
    asked = captures.select("url", "fetched_on").where("url IS NOT NULL AND fetched_on IS NOT NULL").distinct()
    asked = asked.withColumn("key", F.explode(keys_of(F.col("url")))).withColumn("month", F.trunc("fetched_on", "month"))
    met = asked.join(spans, ["key", "month"]).where("active_from <= fetched_on AND fetched_on < active_to")
    best = met.groupBy("url", "fetched_on").agg(
        F.max(F.struct(F.length("key").alias("n"), "active_from", (F.col("list") == "deny").alias("deny"), "key", "list", "active_to")).alias("b")
    )
    best = materialize(best, "judged")
    judged = captures.withColumn("host", host_of(F.col("url"))).join(best, ["url", "fetched_on"], "left")
    return judged.select(
        *[c for c in captures.columns],
        "host",
        F.coalesce("b.list", F.lit("none")).alias("decision"),
        F.col("b.key").alias("matched_key"),
        F.col("b.active_from").alias("active_from"),
        F.col("b.active_to").alias("active_to"),
    )
