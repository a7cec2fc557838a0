"""Queries over users, match events and messages."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window as W, functions as F

from heddle.functions import numbers as N
from heddle.functions import text as T
from heddle.operators import feedback, ranking
from heddle.plans.tables import EVENTS, MESSAGES, USERS, match_events, messages, users
from heddle.session import table

ITEMS = """x as (select event_id, from_user, about_user, event_ts, f field, i.id id, coalesce(nullif(i.severity, 0), 0.6) severity from (
  select event_id, from_user, about_user, event_ts, 'red_flags' f, unnest(gold_extracted.red_flags) i from e
  union all select event_id, from_user, about_user, event_ts, 'appearance', unnest(gold_extracted.appearance) from e
  union all select event_id, from_user, about_user, event_ts, 'hygiene', unnest(gold_extracted.hygiene) from e) where i.id is not null)"""

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark, d):
    return match_events(spark, d, "event_type", "event_ts", "gold_extracted")


@query(f"with {USERS} select user_id, demographic.gender gender, demographic.age age, demographic.faculty faculty from u where demographic.gender is not null and demographic.faculty is not null")
def flt01_profile_projection(spark: SparkSession, d: str):
    """Allow-listed fields of current profiles, without nulls; the nested columns are pruned in the scan."""
    p = users(spark, d, "demographic").select("user_id", F.col("demographic.gender").alias("gender"), F.col("demographic.age").alias("age"), F.col("demographic.faculty").alias("faculty"))
    return p.dropna(subset=["gender", "faculty"])


@query(f"with {USERS} select user_id, r.id id, r.report_count report_count, (r.usable and r.report_count >= 3) kept from (select user_id, unnest(reported_traits) r from u)")
def flt07_usable_reports(spark: SparkSession, d: str):
    r = users(spark, d, "reported_traits").select("user_id", F.explode("reported_traits").alias("r"))
    return r.select("user_id", "r.id", "r.report_count", (F.col("r.usable") & (F.col("r.report_count") >= 3)).alias("kept"))


@query(f"with {EVENTS}, {ITEMS} select event_id, field, id, severity from x")
def flt14_routed_items(spark: SparkSession, d: str):
    return feedback.routed(_events(spark, d)).select("event_id", "field", "id", "severity")


@query(f"with {EVENTS} select distinct a, b from (select from_user a, about_user b from e where event_type in ('unmatch', 'pass') union all select about_user, from_user from e where event_type in ('unmatch', 'pass')) where a is not null and b is not null")
def jn02_blocked_pairs(spark: SparkSession, d: str):
    e = match_events(spark, d, "event_type").filter("event_type in ('unmatch', 'pass')")
    return feedback.both_ways(e, "from_user", "about_user")


@query(f"with {EVENTS}, {USERS} select from_user, about_user, count(*) n from e where event_type = 'unmatch' and from_user is not null and about_user in (select user_id from u) group by all")
def jn03_negatives(spark: SparkSession, d: str):
    e = match_events(spark, d, "event_type").filter("event_type = 'unmatch' and from_user is not null")
    return e.join(users(spark, d), e["about_user"] == F.col("user_id"), "left_semi").groupBy("from_user", "about_user").agg(F.count("*").alias("n"))


_PAIRS = f"""with {USERS}, {EVENTS},
q as (select * from u where try_cast(regexp_extract(user_id, '([0-9]+)$', 1) as bigint) % 100 = 0),
b as (select distinct from_user a, about_user b from e where event_type in ('unmatch', 'pass') union select about_user, from_user from e where event_type in ('unmatch', 'pass'))
select q.user_id a, u.user_id b from q join u on list_contains(q.demographic.seeking, u.demographic.gender) and list_contains(u.demographic.seeking, q.demographic.gender) and q.user_id <> u.user_id
where q.consent.matching and u.consent.matching and not exists (select 1 from b where b.a = q.user_id and b.b = u.user_id)"""


SALT = 16


def _candidate_pairs(spark, d):
    """(a, b): the stated query users (number divisible by 100) against all, both in each other's sought genders.

    An equi-join on (gender of one, sought gender of the other) in both
    directions; every sought gender is a row of its own. A handful of genders
    holds everybody, so the larger side is spread over SALT parts of each, and
    the query users are repeated in all of them.
    """
    u = users(spark, d, "demographic", "consent").filter("consent.matching and demographic.gender is not null").select("user_id", F.col("demographic.gender").alias("g"), F.array_distinct("demographic.seeking").alias("s"))
    q = u.filter(F.regexp_extract("user_id", r"(\d+)$", 1).try_cast("long") % 100 == 0)
    left = q.select(F.col("user_id").alias("a"), F.col("g").alias("ga"), F.explode("s").alias("gb")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    right = u.select(F.col("user_id").alias("b"), F.col("g").alias("gb"), F.explode("s").alias("ga")).withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int"))
    pairs = left.join(right, ["ga", "gb", "salt"]).filter("a <> b").select("a", "b")
    e = match_events(spark, d, "event_type").filter("event_type in ('unmatch', 'pass')")
    return pairs.join(feedback.both_ways(e, "from_user", "about_user"), ["a", "b"], "left_anti")


@query(_PAIRS)
def jn01_candidate_pairs(spark: SparkSession, d: str):
    return _candidate_pairs(spark, d)


@query(f"""with p as ({_PAIRS}), {USERS},
w as (select user_id, t.id id, t.weight weight from (select user_id, unnest(preferences.wants) t from u)),
h as (select user_id, unnest(list_distinct(list_transform(persona.traits, lambda x: x.id))) id from u),
s as (select p.a, p.b, sum(case when h.id is not null then w.weight else 0 end) / sum(w.weight) f from p join w on w.user_id = p.a left join h on h.user_id = p.b and h.id = w.id group by all),
r as (select p.a, p.b, sum(case when h.id is not null then w.weight else 0 end) / sum(w.weight) f from p join w on w.user_id = p.b left join h on h.user_id = p.a and h.id = w.id group by all)
select p.a, p.b, round((coalesce(s.f, 0) + coalesce(r.f, 0)) / 2, 4) prefers from p left join s on s.a = p.a and s.b = p.b left join r on r.a = p.a and r.b = p.b""")
def jn06_preference_overlap(spark: SparkSession, d: str):
    """Weighted share of what each wants that the other has, both directions averaged."""
    p = _candidate_pairs(spark, d)
    u = users(spark, d, "persona", "preferences")
    wants = u.select("user_id", F.explode("preferences.wants").alias("w")).select("user_id", "w.id", "w.weight")
    has = u.select("user_id", F.explode(F.array_distinct(F.transform("persona.traits", lambda x: x["id"]))).alias("id"), F.lit(True).alias("hit"))

    def side(x: str, y: str, name: str):
        w = wants.withColumnRenamed("user_id", x)
        h = has.withColumnRenamed("user_id", y)
        met = p.join(w, x).join(h, [y, "id"], "left")
        return met.groupBy("a", "b").agg((F.sum(F.when(F.col("hit"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias(name))

    both = p.join(side("a", "b", "f"), ["a", "b"], "left").join(side("b", "a", "r"), ["a", "b"], "left")
    return both.select("a", "b", F.round((F.coalesce("f", F.lit(0.0)) + F.coalesce("r", F.lit(0.0))) / 2, 4).alias("prefers"))


@query(f"""with p as ({_PAIRS}), {USERS},
v as (select user_id, unnest(list_distinct(list_transform(preferences.avoids, lambda x: x.id))) id from u),
r as (select user_id, t.id id, t.report_count n from (select user_id, unnest(reported_traits) t from u) where t.usable and t.report_count >= 3)
select distinct p.a, p.b, v.user_id avoider, r.user_id reported, v.id id from p join v on v.user_id in (p.a, p.b) join r on r.user_id in (p.a, p.b) and r.user_id <> v.user_id and r.id = v.id""")
def jn07_red_flags(spark: SparkSession, d: str):
    """What one of a pair avoids and the other is reported for."""
    p = _candidate_pairs(spark, d)
    u = users(spark, d, "preferences", "reported_traits")
    avoids = u.select(F.col("user_id").alias("avoider"), F.explode(F.array_distinct(F.transform("preferences.avoids", lambda x: x["id"]))).alias("id"))
    reported = u.select(F.col("user_id").alias("reported"), F.explode("reported_traits").alias("t")).filter("t.usable and t.report_count >= 3").select("reported", F.col("t.id").alias("id"))
    directed = p.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("s")).select("a", "b", F.col("s.x").alias("avoider"), F.col("s.y").alias("reported"))
    return directed.join(avoids, "avoider").join(reported, ["reported", "id"]).select("a", "b", "avoider", "reported", "id").distinct()


@query(f"""with p as ({_PAIRS}), {USERS}, h as (select user_id, list_distinct(list_transform(persona.hobbies, lambda x: x.id)) s from u)
select p.a, p.b, round(case when len(list_distinct(list_concat(coalesce(x.s, []), coalesce(y.s, [])))) = 0 then 0 else len(list_intersect(coalesce(x.s, []), coalesce(y.s, []))) / len(list_distinct(list_concat(coalesce(x.s, []), coalesce(y.s, [])))) end, 4) hobby from p join h x on x.user_id = p.a join h y on y.user_id = p.b""")
def set01_hobby_jaccard(spark: SparkSession, d: str):
    h = users(spark, d, "persona").select("user_id", F.coalesce(F.array_distinct(F.transform("persona.hobbies", lambda x: x["id"])), F.array().cast("array<string>")).alias("s"))
    p = _candidate_pairs(spark, d)
    both = p.join(h.select(F.col("user_id").alias("a"), F.col("s").alias("x")), "a").join(h.select(F.col("user_id").alias("b"), F.col("s").alias("y")), "b")
    return both.select("a", "b", F.round(T.jaccard(F.col("x"), F.col("y")), 4).alias("hobby"))


@query(f"""with p as ({_PAIRS}), {USERS}, y as (select user_id, nullif(persona.lifestyle.sleep, 'unknown') s, nullif(persona.lifestyle.weekend, 'unknown') w from u)
select p.a, p.b, (case when x.s = z.s then 1 else 0 end + case when x.w = z.w then 1 else 0 end) / 2 lifestyle from p join y x on x.user_id = p.a join y z on z.user_id = p.b""")
def jn11_lifestyle(spark: SparkSession, d: str):
    y = users(spark, d, "persona").select("user_id", F.nullif(F.col("persona.lifestyle.sleep"), F.lit("unknown")).alias("s"), F.nullif(F.col("persona.lifestyle.weekend"), F.lit("unknown")).alias("w"))
    p = _candidate_pairs(spark, d)
    both = p.join(y.toDF("a", "sa", "wa"), "a").join(y.toDF("b", "sb", "wb"), "b")
    same = [F.coalesce((F.col(f"{k}a") == F.col(f"{k}b")).cast("int"), F.lit(0)) for k in "sw"]
    return both.select("a", "b", ((same[0] + same[1]) / 2).alias("lifestyle"))


@query(f"with {EVENTS}, {ITEMS} select from_user user_id, id, round(1 - product(1 - severity), 6) weight, count(*) n, arg_max(event_id, (event_ts, event_id)) last_event from x where from_user is not null group by all")
def agg04_noisy_or_preferences(spark: SparkSession, d: str):
    return feedback.accumulate(feedback.routed(_events(spark, d)))


@query(f"with {EVENTS}, {ITEMS} select about_user user_id, id, count(distinct from_user) report_count, count(distinct from_user) >= 3 usable from x where about_user is not null and field = 'red_flags' group by all")
def agg07_report_counts(spark: SparkSession, d: str):
    return feedback.report_counts(feedback.routed(_events(spark, d)))


@query(f"with {EVENTS} select from_user, about_user, arg_max(event_type, (event_ts, event_id)) status, max(event_ts) since, count(*) n_events from e where from_user is not null and about_user is not null group by all")
def agg26_latest_status(spark: SparkSession, d: str):
    return feedback.latest_status(match_events(spark, d, "event_type", "event_ts"))


@query(f"""with {MESSAGES}, {EVENTS}, a as (select user_id, count(*) n_messages, max(ts) last_ts from m where user_id is not null group by 1), b as (select from_user user_id, count(*) n_events from e where from_user is not null group by 1)
select coalesce(a.user_id, b.user_id) user_id, coalesce(n_messages, 0) n_messages, last_ts, coalesce(n_events, 0) n_events from a full join b on a.user_id = b.user_id""")
def agg33_user_activity(spark: SparkSession, d: str):
    """The correlated counts of an admin list as two partial aggregates and one join."""
    a = messages(spark, d).filter("user_id is not null").groupBy("user_id").agg(F.count("*").alias("n_messages"), F.max("ts").alias("last_ts"))
    b = match_events(spark, d).filter("from_user is not null").groupBy(F.col("from_user").alias("user_id")).agg(F.count("*").alias("n_events"))
    return a.join(b, "user_id", "full_outer").fillna(0, ["n_messages", "n_events"])


@query(f"with {MESSAGES} select 'intent' kind, coalesce(intent, '-') value, count(*) n from m group by all union all (with {EVENTS} select 'event_type', coalesce(event_type, '-'), count(*) from e group by all)")
def agg34_admin_stats(spark: SparkSession, d: str):
    a = messages(spark, d, "intent").groupBy(F.coalesce("intent", F.lit("-")).alias("value")).agg(F.count("*").alias("n")).select(F.lit("intent").alias("kind"), "value", "n")
    b = match_events(spark, d, "event_type").groupBy(F.coalesce("event_type", F.lit("-")).alias("value")).agg(F.count("*").alias("n")).select(F.lit("event_type").alias("kind"), "value", "n")
    return a.unionByName(b)


@query(f"with {MESSAGES} select user_id, id, text, n pos from (select *, row_number() over (partition by user_id order by ts, id) n from (select *, row_number() over (partition by user_id order by ts desc, id desc) r from m where user_id is not null) where r <= 20)")
def win09_last_messages(spark: SparkSession, d: str):
    """The newest 20 messages of a user in ascending order; the group limit acts before the shuffle."""
    new = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id"))
    m = messages(spark, d, "text").filter("user_id is not null").withColumn("r", F.row_number().over(new)).filter("r <= 20")
    return m.select("user_id", "id", "text", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "id")).alias("pos"))


@query(f"""with {MESSAGES}, z as (select *, row_number() over (partition by user_id order by ts desc, id desc) r from m where user_id is not null),
s as (select *, sum(length(coalesce(text, ''))) over (partition by user_id order by r rows unbounded preceding) c from z where r <= 12) select user_id, count(*) n, max(c) n_chars from s where c <= 200 group by 1""")
def win25_newest_prefix(spark: SparkSession, d: str):
    """Newest first, at most 12 rows and 200 characters, up to the first that overflows."""
    new = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id"))
    m = messages(spark, d, "text").filter("user_id is not null").withColumn("r", F.row_number().over(new)).filter("r <= 12")
    run = F.sum(F.length(F.coalesce("text", F.lit("")))).over(W.partitionBy("user_id").orderBy("r").rowsBetween(W.unboundedPreceding, 0))
    return m.withColumn("c", run).filter("c <= 200").groupBy("user_id").agg(F.count("*").alias("n"), F.max("c").alias("n_chars"))


@query(f"with {USERS}, h as (select user_id, t.id id, t.confidence c, date_diff('day', updated_at::date, date '2026-01-01') age from (select user_id, updated_at, unnest(persona.hobbies) t from u)) select user_id, id, round(c * pow(0.5, greatest(0, age) / 60.0), 6) confidence from h where c * pow(0.5, greatest(0, age) / 60.0) >= 0.0001")
def mth05_decayed_hobbies(spark: SparkSession, d: str):
    """Half-life decay of confidences to a given day, the faded ones dropped."""
    h = users(spark, d, "persona", "updated_at").select("user_id", F.datediff(F.lit("2026-01-01").cast("date"), F.col("updated_at").cast("date")).alias("days"), F.explode("persona.hobbies").alias("t"))
    c = N.half_life(F.col("t.confidence"), F.col("days"))
    return h.filter(c >= 0.0001).select("user_id", F.col("t.id").alias("id"), F.round(c, 6).alias("confidence"))


@query(f"with {USERS} select user_id, list_transform(list_slice(list_sort(list_transform(persona.hobbies, lambda x: {{'c': -x.confidence, 'id': x.id}})), 1, 2), lambda x: x.id) top from u where len(persona.hobbies) > 0")
def srt07_top_by_confidence(spark: SparkSession, d: str):
    best = F.array_sort(F.transform("persona.hobbies", lambda x: F.struct((-x["confidence"]).alias("c"), x["id"].alias("id"))))
    return users(spark, d, "persona").filter("size(persona.hobbies) > 0").select("user_id", F.transform(F.slice(best, 1, 2), lambda x: x["id"]).alias("top"))


@query(f"with {USERS} select user_id, list_filter(list_transform(preferences.wants, lambda x: x.id), lambda i: not list_contains(coalesce(list_transform(preferences.avoids, lambda x: x.id), []), i)) wants from u where preferences.wants is not null")
def set10_wants_without_avoids(spark: SparkSession, d: str):
    ids = lambda f: F.transform(f"preferences.{f}", lambda x: x["id"])
    avoided = F.coalesce(ids("avoids"), F.array().cast("array<string>"))
    return users(spark, d, "preferences").filter("preferences.wants is not null").select("user_id", F.filter(ids("wants"), lambda i: ~F.coalesce(F.array_contains(avoided, i), F.lit(False))).alias("wants"))


@query("select date_trunc('day', ts) window_start, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def win_tumbling_events(spark: SparkSession, d: str):
    e = table(spark, d, "events").select("ts", "event_type", "value")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query("""with a as (select *, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minute then 0 else 1 end s from events),
b as (select *, sum(s) over (partition by user_id order by ts, event_id rows unbounded preceding) g from a) select user_id, min(ts) session_start, max(ts) + interval 30 minute session_end, count(*) n from b group by user_id, g""")
def win_session_events(spark: SparkSession, d: str):
    e = table(spark, d, "events").select("ts", "user_id")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


@query("select cast(json_extract(props, '$.k') as integer) k, count(*) n, round(avg(value), 4) mean from events group by 1")
def jsn03_event_props(spark: SparkSession, d: str):
    e = table(spark, d, "events").select(F.from_json("props", "k int")["k"].alias("k"), "value")
    return e.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value, event_id) rn, count(*) over (partition by event_type) n from events),
q as (select event_type, n, k, (n + 1) * k / 4.0 p from (select distinct event_type, n from r), (values (1), (2), (3)) t(k)),
j as (select q.event_type, k, least(greatest(floor(p), 1), n - 1) i, p, n from q)
select j.event_type, k quartile, round(max(case when r.rn = i then r.value end) + (max(case when r.rn = i + 1 then r.value end) - max(case when r.rn = i then r.value end)) * (p - i), 4) value from j join r on r.event_type = j.event_type and r.rn in (i, i + 1) group by j.event_type, k, p, i""")
def agg10_exclusive_quartiles(spark: SparkSession, d: str):
    """Quartiles by the exclusive rule: interpolated at (n + 1) k / 4, between two order statistics."""
    e = table(spark, d, "events").select("event_type", "value")
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    want = n.select("event_type", "n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("quartile")).withColumn("p", (F.col("n") + 1) * F.col("quartile") / 4)
    want = want.withColumn("i", F.least(F.greatest(F.floor("p"), F.lit(1)), F.col("n") - 1))
    ends = want.select("event_type", "quartile", "p", "i", F.explode(F.array(F.col("i"), F.col("i") + 1)).alias("pos"))
    met = ranking.order_statistics(e, ["event_type"], "value", ends.select("event_type", "pos").distinct()).join(ends, ["event_type", "pos"])
    low, high = F.max(F.when(F.col("pos") == F.col("i"), F.col("value"))), F.max(F.when(F.col("pos") == F.col("i") + 1, F.col("value")))
    return met.groupBy("event_type", "quartile", "p", "i").agg(F.round(low + (high - low) * (F.first("p") - F.first("i")), 4).alias("value")).select("event_type", "quartile", "value")


@query("select event_type, list_sort(list(value))[1 + round_even(0.95 * (count(*) - 1), 0)::int] p95 from events group by 1")
def agg15_nearest_rank(spark: SparkSession, d: str):
    """Nearest-rank percentile, index rounded half to even."""
    e = table(spark, d, "events").select("event_type", "value")
    at = e.groupBy("event_type").agg((1 + F.bround(0.95 * (F.count("*") - 1), 0)).cast("long").alias("pos"))
    return ranking.order_statistics(e, ["event_type"], "value", at).select("event_type", F.col("value").alias("p95"))


@query("""with r as (select event_type, event_id, value, row_number() over (partition by event_type order by value desc, event_id) k from events) select event_type, event_id, value, k rank from r where k <= 10""")
def win01_ranked_events(spark: SparkSession, d: str):
    return ranking.top_k(table(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], "value", "event_id", 10)


@query("""with s as (select value, event_type = 'purchase' y from events), r as (select y, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0 k from s)
select round((sum(case when y then k end) - count(*) filter (y) * (count(*) filter (y) + 1) / 2.0) / (count(*) filter (y) * count(*) filter (not y)), 6) auroc, count(*) filter (y) n_pos, count(*) filter (not y) n_neg from r""")
def agg23_auroc(spark: SparkSession, d: str):
    e = table(spark, d, "events").select("value", (F.col("event_type") == "purchase").cast("int").alias("y"))
    return ranking.auroc(e, "value", "y")
