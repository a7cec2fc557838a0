"""Clean views of the domain tables, for Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heddle.operators.references import clean_key, current_rows
from heddle.session import table

WS = r"E' \t\n\r'"


def users(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The current row of each user that is not deleted; only the columns asked for are read."""
    need = ["updated_at", "deleted_at", *[c for c in columns if c not in ("updated_at", "deleted_at")]]
    rows = table(spark, d, "users").select(clean_key("user_id").alias("user_id"), *need).filter("user_id is not null")
    return current_rows(rows, "user_id", "updated_at").filter("deleted_at is null").select("user_id", *columns)


USERS = f"u as (select * from (select * exclude(user_id), lower(trim(user_id, {WS})) user_id, row_number() over (partition by lower(trim(user_id, {WS})) order by updated_at desc) rn from users where trim(user_id, {WS}) <> '') where rn = 1 and deleted_at is null)"


def match_events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each event once, as first delivered, with clean parties (null where blank)."""
    rest = [c for c in columns if c not in ("from_user", "about_user")]
    rows = table(spark, d, "match_events").select("event_id", clean_key("from_user").alias("from_user"), clean_key("about_user").alias("about_user"), "ingested_at", *rest)
    first = F.min_by(F.struct("from_user", "about_user", *rest), "ingested_at").alias("r")
    return rows.groupBy("event_id").agg(first).select("event_id", "r.*")


EVENTS = f"e as (select * exclude(rn, from_user, about_user), nullif(lower(trim(from_user, {WS})), '') from_user, nullif(lower(trim(about_user, {WS})), '') about_user from (select *, row_number() over (partition by event_id order by ingested_at) rn from match_events) where rn = 1)"


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each chunk once; rows delivered again agree."""
    rest = [c for c in columns if c != "source_id"]
    rows = table(spark, d, "book_chunks").select(clean_key("chunk_id").alias("chunk_id"), clean_key("source_id").alias("source_id"), *rest).filter("chunk_id is not null")
    return rows.groupBy("chunk_id").agg(F.first(F.struct("source_id", *rest)).alias("r")).select("chunk_id", "r.*")


CHUNKS = f"c as (select * exclude(rn, source_id, chunk_id), lower(trim(chunk_id, {WS})) chunk_id, nullif(lower(trim(source_id, {WS})), '') source_id from (select *, row_number() over (partition by lower(trim(chunk_id, {WS}))) rn from book_chunks where trim(chunk_id, {WS}) <> '') where rn = 1)"


def claims(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    rest = [c for c in columns if c != "chunk_id"]
    rows = table(spark, d, "love_claims").select("claim_id", clean_key("chunk_id").alias("chunk_id"), *rest)
    return rows.groupBy("claim_id").agg(F.min_by(F.struct("chunk_id", *rest), F.coalesce("chunk_id", F.lit("~"))).alias("r")).select("claim_id", "r.*")


CLAIMS = f"l as (select * exclude(rn, chunk_id), nullif(lower(trim(chunk_id, {WS})), '') chunk_id from (select *, row_number() over (partition by claim_id order by lower(trim(chunk_id, {WS})) nulls last) rn from love_claims) where rn = 1)"


def messages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    rest = [c for c in columns if c not in ("user_id", "ts")]
    ts = F.when(F.abs("ts") >= 1e14, F.col("ts") / 1e6).when(F.abs("ts") >= 1e11, F.col("ts") / 1e3).otherwise(F.col("ts"))
    rows = table(spark, d, "messages").select("id", clean_key("user_id").alias("user_id"), ts.alias("ts"), *rest)
    return rows.groupBy("id").agg(F.first(F.struct("user_id", "ts", *rest)).alias("r")).select("id", "r.*")


MESSAGES = f"m as (select * exclude(rn, user_id, ts), nullif(lower(trim(user_id, {WS})), '') user_id, case when ts >= 1e14 then ts / 1e6 when ts >= 1e11 then ts / 1e3 else ts end ts from (select *, row_number() over (partition by id) rn from messages) where rn = 1)"
