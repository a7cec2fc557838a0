"""Queries of the orphan-reference operator over the domain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from heddle.operators.references import clean_key, current_rows, orphans
from heddle.session import table


def _deliveries(df: DataFrame, record: str, key_fields: list[str], time: str) -> DataFrame:
    """One row per record: rows delivered again agree in keys and time."""
    return df.groupBy(record).agg(F.min(time).alias(time), *[F.min(clean_key(f)).alias(f) for f in key_fields])


def _found(spark: SparkSession, d: str) -> DataFrame:
    users = current_rows(
        table(spark, d, "users").select(clean_key("user_id").alias("user_id"), "created_at", "updated_at", "deleted_at").filter("user_id is not null"),
        "user_id",
        "updated_at",
    )
    chunks = table(spark, d, "book_chunks").select(clean_key("chunk_id").alias("chunk_id"), "ingested_at", "removed_at").filter("chunk_id is not null")
    events = _deliveries(table(spark, d, "match_events").select("event_id", "from_user", "about_user", "event_ts"), "event_id", ["from_user", "about_user"], "event_ts")
    claims = _deliveries(table(spark, d, "love_claims").select("claim_id", "chunk_id", "extracted_at"), "claim_id", ["chunk_id"], "extracted_at")
    both = events.select("event_id", "event_ts", F.explode(F.map_from_arrays(F.array(F.lit("from_user"), F.lit("about_user")), F.array("from_user", "about_user"))).alias("ref_field", "key"))
    parts = [
        orphans(both, users, ["key"], ["user_id"], at="event_ts", valid_from="created_at", valid_to="deleted_at").select(
            F.lit("match_events").alias("ref_table"), "ref_field", F.col("event_id").alias("record_id"), F.col("event_ts").alias("at")
        ),
        orphans(claims, chunks, ["chunk_id"], at="extracted_at", valid_from="ingested_at", valid_to="removed_at").select(
            F.lit("love_claims").alias("ref_table"), F.lit("chunk_id").alias("ref_field"), F.col("claim_id").alias("record_id"), F.col("extracted_at").alias("at")
        ),
    ]
    return reduce(DataFrame.unionByName, parts).select("ref_table", "ref_field", "record_id", F.date_format("at", "yyyy-MM").alias("period"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d)


def p7_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).groupBy("ref_table", "ref_field", "period").agg(F.count("*").alias("n_orphans"))


QUERIES = {"p7_found": p7_found, "p7_orphan_report": p7_orphan_report}

_CASES = """
with u as (
  select lower(trim(user_id, E' \\t\\n\\r')) k, arg_max(created_at, updated_at) c, arg_max(coalesce(deleted_at, timestamptz '9999-01-01'), updated_at) x
  from users where trim(user_id, E' \\t\\n\\r') <> '' group by 1),
e as (select event_id, min(event_ts) t, min(lower(trim(from_user, E' \\t\\n\\r'))) f, min(lower(trim(about_user, E' \\t\\n\\r'))) a from match_events group by 1),
r as (select 'from_user' ref_field, event_id, t, f k from e union all select 'about_user', event_id, t, a from e),
c as (select distinct lower(trim(chunk_id, E' \\t\\n\\r')) k, ingested_at i, coalesce(removed_at, timestamptz '9999-01-01') x from book_chunks),
l as (select claim_id, min(extracted_at) t, min(lower(trim(chunk_id, E' \\t\\n\\r'))) k from love_claims group by 1),
cases as (
  select 'match_events' ref_table, ref_field, event_id record_id, strftime(t at time zone 'UTC', '%Y-%m') period from r
  where k <> '' and not exists (select 1 from u where u.k = r.k and u.c <= r.t and r.t < u.x)
  union all
  select 'love_claims', 'chunk_id', claim_id, strftime(t at time zone 'UTC', '%Y-%m') from l
  where k <> '' and not exists (select 1 from c where c.k = l.k and c.i <= l.t and l.t < c.x))
"""

SQL = {
    "p7_found": _CASES + "select ref_table, ref_field, record_id, period from cases",
    "p7_orphan_report": _CASES + "select ref_table, ref_field, period, count(*) n_orphans from cases group by all",
}
