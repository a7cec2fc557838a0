"""Queries of state that grows with events: merged profiles, cursors, revisions, ids, statuses; and seeded synthetic data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from heddle.operators import feedback, ranking
from heddle.operators.references import clean_key, current_rows
from heddle.plans.interactions import ITEMS
from heddle.plans.tables import EVENTS, MESSAGES, USERS, WS, match_events, messages, users
from heddle.session import settle, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _items(spark, d):
    return feedback.routed(match_events(spark, d, "event_type", "event_ts", "gold_extracted"))


@query(f"with {EVENTS}, {ITEMS} select from_user user_id, id, count(*) n, round(least(0.95, 0.6 + 0.15 * (count(*) - 1)), 4) confidence, max(event_ts) last_ts from x where from_user is not null group by all")
def stm04_merged_profiles(spark: SparkSession, d: str):
    """What each user mentioned: every further mention bumps the confidence. The fold has a closed form, so it is a partial aggregate, whatever the order."""
    x = _items(spark, d).filter("from_user is not null").groupBy(F.col("from_user").alias("user_id"), "id")
    g = x.agg(F.count("*").alias("n"), F.max("event_ts").alias("last_ts"))
    return g.select("user_id", "id", "n", F.round(F.least(F.lit(0.95), 0.6 + 0.15 * (F.col("n") - 1)), 4).alias("confidence"), "last_ts")


@query(f"with {EVENTS}, {ITEMS}, g as (select from_user user_id, id, least(0.95, 0.6 + 0.15 * (count(*) - 1)) c, max(event_ts) t from x where from_user is not null group by all), t as (select max(event_ts) now from e) select user_id, id, round(c * pow(0.5, greatest(0, date_diff('day', t::date, now::date)) / 60.0), 4) confidence from g, t where c * pow(0.5, greatest(0, date_diff('day', t::date, now::date)) / 60.0) >= 0.3")
def stm05_faded_profiles(spark: SparkSession, d: str):
    """Merged profiles as they stand at the newest event: confidences halve in 60 days, the faded go."""
    from heddle.functions import numbers as N

    p = stm04_merged_profiles(spark, d)
    now = match_events(spark, d, "event_ts").agg(F.max("event_ts").alias("now"))  # one row
    c = N.half_life(F.least(F.lit(0.95), 0.6 + 0.15 * (F.col("n") - 1)), F.datediff(F.col("now").cast("date"), F.col("last_ts").cast("date")))
    return p.join(F.broadcast(now), F.lit(True)).filter(c >= 0.3).select("user_id", "id", F.round(c, 4).alias("confidence"))


@query(f"with {MESSAGES}, k as (select user_id, (min(id) + max(id)) // 2 through from m where user_id is not null group by 1), n as (select m.user_id, m.id, row_number() over (partition by m.user_id order by m.id desc) r from m join k on k.user_id = m.user_id where m.id > through) select user_id, list_sort(list(id)) ids from n where r <= 12 group by 1")
def stm08_pending_messages(spark: SparkSession, d: str):
    """Behind each user's cursor the newest twelve messages, in order: the limit acts before the shuffle."""
    m = messages(spark, d).filter("user_id is not null").select("user_id", "id")
    cursor = m.groupBy("user_id").agg(F.expr("(min(id) + max(id)) div 2").alias("through"))
    new = m.join(cursor, "user_id").filter("id > through").withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("id")))).filter("r <= 12")
    return new.groupBy("user_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))


@query(f"with s as (select lower(trim(user_id, {WS})) user_id, updated_at from users where trim(user_id, {WS}) <> ''), r as (select user_id, count(distinct updated_at) revision from s group by 1), ch as (select user_id, 1 + (regexp_extract(user_id, '([0-9]+)$', 1)::bigint % 3) expected from r) select user_id, revision, expected, revision = expected applied, revision + (revision = expected)::int \"after\" from r join ch using (user_id)")
def stm09_compare_and_set(spark: SparkSession, d: str):
    """Changes that expect a revision: applied, and the revision raised, only where it still holds."""
    s = table(spark, d, "users").select(clean_key("user_id").alias("user_id"), "updated_at").filter("user_id is not null")
    have = s.groupBy("user_id").agg(F.countDistinct("updated_at").alias("revision"))
    changes = have.select("user_id", (1 + F.regexp_extract("user_id", r"(\d+)$", 1).cast("long") % 3).alias("expected"))
    ok = F.col("revision") == F.col("expected")
    return have.join(changes, "user_id").select("user_id", "revision", "expected", ok.alias("applied"), (F.col("revision") + ok.cast("int")).alias("after"))


@query(f"with s as (select distinct lower(trim(user_id, {WS})) user_id from users where trim(user_id, {WS}) <> ''), t as (select max(regexp_extract(user_id, '([0-9]+)$', 1)::bigint) top from s), e2 as (select distinct event_id from match_events) select event_id, top + row_number() over (order by event_id) new_id from e2, t")
def stm14_allocated_ids(spark: SparkSession, d: str):
    """New numbers above all that were ever given, deleted ones too: ranks by range partitions with offsets, not in one task."""
    s = table(spark, d, "users").select(clean_key("user_id").alias("user_id")).filter("user_id is not null")
    top = s.agg(F.max(F.regexp_extract("user_id", r"(\d+)$", 1).cast("long")).alias("top"))  # one row
    e = table(spark, d, "match_events").select("event_id").distinct().withColumn("g", F.lit(1)).withColumn("s", F.lit(0))
    return ranking.rank_all(e, ["g"], "s", "event_id").join(F.broadcast(top), F.lit(True)).select("event_id", (F.col("top") + F.col("rank")).alias("new_id"))


@query(f"with {EVENTS}, {MESSAGES} select user_id, sum(a) n_said, sum(b) n_about, sum(c) n_messages from (select from_user user_id, 1 a, 0 b, 0 c from e union all select about_user, 0, 1, 0 from e union all select user_id, 0, 0, 1 from m) where user_id is not null group by 1")
def stm17_interactions(spark: SparkSession, d: str):
    """All that happened with a user, from three scans, counted before they meet."""
    e, m = match_events(spark, d), messages(spark, d)
    parts = [e.select(F.col("from_user").alias("user_id"), F.lit("n_said").alias("k")), e.select(F.col("about_user").alias("user_id"), F.lit("n_about").alias("k")), m.select("user_id", F.lit("n_messages").alias("k"))]
    x = reduce(DataFrame.unionByName, parts).filter("user_id is not null")
    return x.groupBy("user_id").agg(*[F.sum((F.col("k") == k).cast("int")).alias(k) for k in ("n_said", "n_about", "n_messages")])


@query(f"with {EVENTS}, p as (select least(from_user, about_user) a, greatest(from_user, about_user) b, event_type, event_ts, event_id from e where from_user is not null and about_user is not null), l as (select a, b, arg_max(event_type, (event_ts, event_id)) status, max(event_ts) since from p group by all), s as (select a u, * from l union all select b, * from l), r as (select *, row_number() over (partition by u order by case status when 'matched' then 1 when 'pass' then 2 else 3 end, since desc, a, b) n from s) select u user_id, a, b, status, since from r where n = 1")
def agg27_current_partner(spark: SparkSession, d: str):
    """For each user the pair that stands: matched before passed before unmatched, the newest of these."""
    e = match_events(spark, d, "event_type", "event_ts").filter("from_user is not null and about_user is not null")
    pair = e.groupBy(F.least("from_user", "about_user").alias("a"), F.greatest("from_user", "about_user").alias("b")).agg(F.max_by("event_type", F.struct("event_ts", "event_id")).alias("status"), F.max("event_ts").alias("since"))
    both = pair.withColumn("user_id", F.explode(F.array("a", "b")))
    first = F.when(F.col("status") == "matched", 1).when(F.col("status") == "pass", 2).otherwise(3)
    best = both.groupBy("user_id").agg(F.min_by(F.struct("a", "b", "status", "since"), F.struct(first.alias("p"), (-F.unix_micros("since")).alias("t"), "a", "b")).alias("r"))
    return best.select("user_id", "r.*")


@query(f"with {EVENTS}, {ITEMS} select about_user user_id, list_transform(list_sort(list({{'t': event_ts, 'e': event_id, 'i': id}})), lambda z: z.i)[1:5] replay from x where about_user is not null and event_ts is not null group by 1")
def dat03_replay(spark: SparkSession, d: str):
    """The first five things said about a user in order of time: each task keeps five a user before the shuffle."""
    x = _items(spark, d).filter("about_user is not null and event_ts is not null")
    first = x.withColumn("r", F.row_number().over(W.partitionBy("about_user").orderBy("event_ts", "event_id", "id"))).filter("r <= 5")
    return first.groupBy(F.col("about_user").alias("user_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda z: z["id"]).alias("replay"))


@query(f"with {EVENTS} select from_user, about_user, arg_max(event_id, (event_ts, event_id)) latest, count(*) n from e where from_user is not null and about_user is not null and event_type = 'matched' group by all")
def sup28_latest_of_pair(spark: SparkSession, d: str):
    """The newest event of each directed pair."""
    e = match_events(spark, d, "event_type", "event_ts").filter("from_user is not null and about_user is not null and event_type = 'matched'")
    return e.groupBy("from_user", "about_user").agg(F.max_by("event_id", F.struct("event_ts", "event_id")).alias("latest"), F.count("*").alias("n"))


@query(f"with {USERS}, {MESSAGES}, z as (select user_id, id, row_number() over (partition by user_id order by ts desc, id desc) r from m where user_id is not null), l as (select user_id, list_sort(list(id)) ids from z where r <= 20 group by 1) select user_id, demographic.campus campus, coalesce(len(ids), 0) n, ids[-1] highest from u left join l using (user_id)")
def sup41_user_detail(spark: SparkSession, d: str):
    """A profile with the ids of its newest twenty messages."""
    new = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id"))
    m = messages(spark, d).filter("user_id is not null").withColumn("r", F.row_number().over(new)).filter("r <= 20").groupBy("user_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    u = users(spark, d, "demographic").select("user_id", F.col("demographic.campus").alias("campus")).join(m, "user_id", "left")
    return u.select("user_id", "campus", F.coalesce(F.when(F.col("ids").isNotNull(), F.size("ids")), F.lit(0)).alias("n"), F.try_element_at("ids", F.lit(-1)).alias("highest"))


@query(f"with {USERS} select user_id, concat_ws('; ', 'likes ' || nullif(array_to_string(list_sort(list_transform(persona.hobbies, lambda x: split_part(x.id, ':', 2))), ', '), ''), 'is ' || nullif(array_to_string(list_sort(list_transform(persona.traits, lambda x: split_part(x.id, ':', 2))), ', '), ''), 'sleeps ' || persona.lifestyle.sleep) summary from u")
def str61_profile_summaries(spark: SparkSession, d: str):
    """A profile as a line of text; looks are left out."""
    named = lambda c: F.nullif(F.array_join(F.sort_array(F.transform(c, lambda x: F.split_part(x["id"], F.lit(":"), F.lit(2)))), ", "), F.lit(""))
    parts = [F.concat(F.lit("likes "), named("persona.hobbies")), F.concat(F.lit("is "), named("persona.traits")), F.concat(F.lit("sleeps "), F.col("persona.lifestyle.sleep"))]
    return users(spark, d, "persona").select("user_id", F.concat_ws("; ", *parts).alias("summary"))


@query(f"with {USERS} select user_id, array_to_string(list_sort(list_filter(coalesce(list_transform(preferences.wants, lambda w: w.id), []), lambda i: not starts_with(i, 'trait:p'))), ',') kept, len(list_filter(coalesce(list_transform(preferences.wants, lambda w: w.id), []), lambda i: starts_with(i, 'trait:p'))) n_pending from u")
def flt15_consent_routing(spark: SparkSession, d: str):
    """Items of a sensitive prefix wait for consent, the others are kept."""
    ids = F.coalesce(F.transform("preferences.wants", lambda w: w["id"]), F.array().cast("array<string>"))
    waits = lambda i: F.startswith(i, F.lit("trait:p"))
    return users(spark, d, "preferences").select("user_id", F.array_join(F.sort_array(F.filter(ids, lambda i: ~waits(i))), ",").alias("kept"), F.size(F.filter(ids, waits)).alias("n_pending"))


# --- seeded synthetic data -------------------------------------------------------------------------------------------


def uniform(key: Column, draw: int, seed: int = 42) -> Column:
    """A number in [0, 1) that the key, the draw and the seed alone decide: the same on every run and in every task."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", key.cast("string"), F.lit(str(draw)), F.lit(str(seed))), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _uniform(key: str, draw: int, seed: int = 42) -> str:
    return f"(('0x' || substr(sha256({key}::varchar || ':{draw}:{seed}'), 1, 8))::bigint / 4294967296.0)"


def categorical(u: Column, shares: list[tuple[str, float]]) -> Column:
    """Inverse distribution: the value whose share of [0, 1) holds u."""
    at, out = 0.0, None
    for value, share in shares[:-1]:
        at += share
        out = F.when(u < round(at, 9), value) if out is None else out.when(u < round(at, 9), value)
    return out.otherwise(shares[-1][0])


def _categorical(u: str, shares: list[tuple[str, float]]) -> str:
    at, parts = 0.0, []
    for value, share in shares[:-1]:
        at += share
        parts.append(f"when {u} < {round(at, 9)} then '{value}'")
    return f"case {' '.join(parts)} else '{shares[-1][0]}' end"


GENDERS, SLEEP, TRAITS = [("F", 0.48), ("M", 0.45), ("NB", 0.07)], [("early", 0.4), ("late", 0.45), ("unknown", 0.15)], ["warm", "tidy", "candid", "playful", "steady", "curious"]
N_USERS = 2000
_G0 = f"g as (select i id, {_categorical(_uniform('i', 1), GENDERS)} gender, 18 + floor({_uniform('i', 2)} * 12)::int age, {_categorical(_uniform('i', 3), SLEEP)} sleep, list_filter([{', '.join(f'case when {_uniform(chr(105), 10 + k)} < 0.35 then {chr(39)}{t}{chr(39)} end' for k, t in enumerate(TRAITS))}], lambda t: t is not null) traits from range({N_USERS}) r(i))"


def generated_users(spark: SparkSession, n: int = N_USERS) -> DataFrame:
    """(id, gender, age, sleep, traits) of n users: each column a draw of its own, generated in parallel from the number alone."""
    i = F.col("id")
    traits = F.filter(F.array(*[F.when(uniform(i, 10 + k) < 0.35, t) for k, t in enumerate(TRAITS)]), lambda t: t.isNotNull())
    return spark.range(n).select("id", categorical(uniform(i, 1), GENDERS).alias("gender"), (18 + F.floor(uniform(i, 2) * 12)).cast("int").alias("age"), categorical(uniform(i, 3), SLEEP).alias("sleep"), traits.alias("traits"))


@query(f"with {_G0} select id, gender, age, sleep, array_to_string(traits, ',') traits from g")
def gen01_users(spark: SparkSession, d: str):
    return generated_users(spark).withColumn("traits", F.array_join("traits", ","))


@query(f"with {_G0} select id, array_to_string(list_filter(traits, lambda t: {_uniform('(id::varchar || t)', 30)} >= 0.2), ',') observed, case when {_uniform('id', 31)} < 0.1 then 'unknown' else sleep end sleep from g")
def gen02_observed(spark: SparkSession, d: str):
    """What is seen of the generated users: a fifth of the traits is missed, a tenth of the habits unknown."""
    seen = F.filter("traits", lambda t: uniform(F.concat(F.col("id").cast("string"), t), 30) >= 0.2)
    return generated_users(spark).select("id", F.array_join(seen, ",").alias("observed"), F.when(uniform(F.col("id"), 31) < 0.1, "unknown").otherwise(F.col("sleep")).alias("sleep"))


@query(f"with {_G0}, ev as (select id, unnest(range(1 + floor({_uniform('id', 40)} * 3)::int)) k from g) select id from_id, k, floor({_uniform('(id::varchar || chr(45) || k::varchar)', 41)} * {N_USERS})::bigint about_id, case when {_uniform('(id::varchar || chr(45) || k::varchar)', 42)} < 0.3 then 'matched' else 'unmatch' end kind, floor({_uniform('(id::varchar || chr(45) || k::varchar)', 43)} * 365)::int day_offset from ev")
def gen03_events(spark: SparkSession, d: str):
    """One to three events a generated user, each with a partner, a kind and a day."""
    e = generated_users(spark).select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(uniform(F.col("id"), 40) * 3))).alias("k"))
    key = F.concat(F.col("id").cast("string"), F.lit("-"), F.col("k").cast("string"))
    return e.select(F.col("id").alias("from_id"), "k", F.floor(uniform(key, 41) * N_USERS).alias("about_id"), F.when(uniform(key, 42) < 0.3, "matched").otherwise("unmatch").alias("kind"), F.floor(uniform(key, 43) * 365).cast("int").alias("day_offset"))


@query(f"with {_G0}, q as (select * from g where id % 100 = 0), p as (select q.id a, g.id b, round(len(list_intersect(q.traits, g.traits)) / greatest(1, len(list_distinct(list_concat(q.traits, g.traits)))) - abs(q.age - g.age) / 20.0, 6) s from q join g on g.id <> q.id and g.sleep = q.sleep) select a, b, s score, row_number() over (partition by a order by s desc, b) rank from p qualify rank <= 5")
def gen07_gold_pairs(spark: SparkSession, d: str):
    """The five best partners of each stated query user by a known score: the gold of an evaluation."""
    from heddle.functions import text as T

    g = settle(generated_users(spark))
    q = g.filter("id % 100 = 0").select(F.col("id").alias("a"), F.col("age").alias("x"), "sleep", F.col("traits").alias("t"))
    p = q.join(g.select(F.col("id").alias("b"), "age", "sleep", "traits"), "sleep").filter("a <> b")
    s = F.round(T.jaccard(F.col("t"), F.col("traits")) - F.abs(F.col("x") - F.col("age")) / 20.0, 6)
    return ranking.top_k(p.select("a", "b", s.alias("score")), ["a"], "score", "b", 5)


@query("select event_id, ts + to_days((('0x' || substr(sha256(event_id::varchar || ':50:42'), 1, 8))::bigint % 30)::int) moved from events")
def dat02_day_offsets(spark: SparkSession, d: str):
    """Times moved by a drawn number of days."""
    n = (F.conv(F.substring(F.sha2(F.concat(F.col("event_id").cast("string"), F.lit(":50:42")), 256), 1, 8), 16, 10).cast("long") % 30).cast("int")
    return table(spark, d, "events").select("event_id", F.timestamp_add("DAY", n, "ts").alias("moved"))
