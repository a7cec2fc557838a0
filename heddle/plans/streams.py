"""Streaming queries, drained over all input, against the SQL of the batch."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from heddle.operators.feedback import routed
from heddle.plans.interactions import ITEMS
from heddle.operators.references import clean_key
from heddle.plans.tables import CHUNKS, EVENTS, USERS, WS, chunks, users
from heddle.session import settle
from heddle.sources import files
from heddle.streaming import events as S


def stm02_preferences(spark: SparkSession, d: str):
    """Noisy-OR state per (user, id)."""
    return S.drain(S.preference_stream(spark, d), "update", ["user_id", "id"], "n")


def stm03_report_counts(spark: SparkSession, d: str):
    """Reports per (user, id) with the threshold of three."""
    items = routed(S.clean_parties(S.once(S.stream(spark, d, "match_events")))).filter("about_user is not null and field = 'red_flags'")
    return S.drain(items.groupBy(F.col("about_user").alias("user_id"), "id").agg(F.count("*").alias("n")).withColumn("usable", F.col("n") >= 3), "complete")


def stm13_daily_counts(spark: SparkSession, d: str):
    """Daily windows by event type."""
    e = S.stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    w = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return S.drain(w.select(F.col("w.start").alias("window_start"), "event_type", "n"), "complete")


def stm01_events_once(spark: SparkSession, d: str):
    """Events without repeated deliveries."""
    return S.drain(S.once(S.stream(spark, d, "match_events")).select("event_id", "event_type"), "append")


def stm06_live_profiles(spark: SparkSession, d: str):
    """The latest state of each profile, kept up to date as states stream in."""
    u = S.stream(spark, d, "users").select(clean_key("user_id").alias("user_id"), "updated_at", "display_name").filter("user_id is not null and updated_at is not null")
    latest = u.groupBy("user_id").agg(F.max("updated_at").alias("updated_at"), F.max_by("display_name", "updated_at").alias("display_name"))
    return S.drain(latest, "complete")


def stm07_events_with_profiles(spark: SparkSession, d: str):
    """Streamed events joined with the profiles at hand, counted by the faculty of whom they are about."""
    p = users(spark, d, "demographic").select(F.col("user_id").alias("about_user"), F.coalesce("demographic.faculty", F.lit("-")).alias("faculty"))
    e = S.clean_parties(S.once(S.stream(spark, d, "match_events"))).join(p, "about_user")
    return S.drain(e.groupBy("faculty", "event_type").agg(F.count("*").alias("n")), "complete")


def stm12_resumed_extraction(spark: SparkSession, d: str):
    """An extraction that broke off half-way goes on with what the cache lacks, and is published as a whole or not at all."""
    work = lambda df: df.select("chunk_id", "digest", F.length("text").alias("n_chars"))
    c = chunks(spark, d, "text").filter("text is not null").select("chunk_id", F.sha2("text", 256).alias("digest"), "text")
    before = settle(work(c.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == 0)))
    folder = files.scratch(spark, "extraction")
    files.write_snapshot(files.cached(c, before, "chunk_id", "digest", work), folder)
    return files.read_snapshot(spark, folder)


QUERIES = {f.__name__: f for f in (stm01_events_once, stm02_preferences, stm03_report_counts, stm06_live_profiles, stm07_events_with_profiles, stm12_resumed_extraction, stm13_daily_counts)}
SQL = {
    "stm01_events_once": "select distinct event_id, event_type from match_events",
    "stm02_preferences": f"with {EVENTS}, {ITEMS} select from_user user_id, id, round(1 - product(1 - severity), 6) weight, count(*) n from x where from_user is not null group by all",
    "stm03_report_counts": f"with {EVENTS}, {ITEMS} select about_user user_id, id, count(*) n, count(*) >= 3 usable from x where about_user is not null and field = 'red_flags' group by all",
    "stm06_live_profiles": f"select user_id, updated_at, display_name from (select lower(trim(user_id, {WS})) user_id, updated_at, display_name, row_number() over (partition by lower(trim(user_id, {WS})) order by updated_at desc) r from users where trim(user_id, {WS}) <> '' and updated_at is not null) where r = 1",
    "stm07_events_with_profiles": f"with {EVENTS}, {USERS} select coalesce(u.demographic.faculty, '-') faculty, event_type, count(*) n from e join u on u.user_id = e.about_user group by all",
    "stm12_resumed_extraction": f"with {CHUNKS} select chunk_id, sha256(text) digest, length(text) n_chars from c where text is not null",
    "stm13_daily_counts": "select date_trunc('day', ts) window_start, event_type, count(*) n from events group by all",
}
