"""Preferences and reports from interaction events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from heddle.functions.numbers import noisy_or

FIELDS = ("red_flags", "appearance", "hygiene")
DEFAULT_SEVERITY, REPORTS_NEEDED = 0.6, 3


def routed(events: DataFrame, extracted: str = "gold_extracted") -> DataFrame:
    """(event_id, from_user, about_user, event_ts, field, id, severity): one row per extracted item.

    A severity of null or 0 is the default. Null structs and arrays have no items.
    """
    def marked(field: str) -> Column:
        return F.transform(F.col(f"{extracted}.{field}"), lambda x: F.struct(F.lit(field).alias("field"), x["id"].alias("id"), x["severity"].alias("severity")))

    items = F.array(*[marked(f) for f in FIELDS])
    rows = events.select("event_id", "from_user", "about_user", "event_ts", F.explode(F.flatten(F.filter(items, lambda a: a.isNotNull()))).alias("x"))
    severity = F.coalesce(F.when(F.col("x.severity") != 0, F.col("x.severity")), F.lit(DEFAULT_SEVERITY))
    return rows.filter("x.id is not null").select("event_id", "from_user", "about_user", "event_ts", "x.field", "x.id", severity.alias("severity"))


def accumulate(items: DataFrame, user: str = "from_user") -> DataFrame:
    """(user_id, id, weight, n, last_event): noisy-OR of severities, order-free, with the latest event as source."""
    return items.filter(F.col(user).isNotNull()).groupBy(F.col(user).alias("user_id"), "id").agg(
        F.round(noisy_or(F.col("severity")), 6).alias("weight"), F.count("*").alias("n"), F.max_by("event_id", F.struct("event_ts", "event_id")).alias("last_event")
    )


def report_counts(items: DataFrame) -> DataFrame:
    """(user_id, id, report_count, usable) of what was said about users: usable from REPORTS_NEEDED different speakers on."""
    said = items.filter("about_user is not null and field = 'red_flags'").groupBy(F.col("about_user").alias("user_id"), "id").agg(F.countDistinct("from_user").alias("report_count"))
    return said.withColumn("usable", F.col("report_count") >= REPORTS_NEEDED)


def latest_status(events: DataFrame) -> DataFrame:
    """(from_user, about_user, status, since, n_events): the last event of a directed pair; ties go to the larger event_id."""
    known = events.filter("from_user is not null and about_user is not null")
    order = F.struct("event_ts", "event_id")
    return known.groupBy("from_user", "about_user").agg(F.max_by("event_type", order).alias("status"), F.max("event_ts").alias("since"), F.count("*").alias("n_events"))


def both_ways(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b) in both directions, from one scan."""
    return pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.explode(F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b")))).alias("p")).select("p.a", "p.b").distinct()
