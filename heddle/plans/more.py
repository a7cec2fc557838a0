"""Margins, head reranking, n-gram TF-IDF, drawn values, message bounds and erasure."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window as W, functions as F

from heddle.functions import text as T
from heddle.operators import ranking
from heddle.plans.knowledge import _L, _bm25, mth07_bm25_top
from heddle.plans.tables import CHUNKS, EVENTS, MESSAGES, USERS, WS, chunks, match_events, messages, users
from heddle.operators.references import clean_key, current_rows
from heddle.session import settle, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(_L + ", w as (select qid, max(case when rank = 1 then chunk_id end) chunk_id, max(score) best, max(case when rank = 2 then score end) \"second\" from top group by 1) select * from w where best - coalesce(\"second\", 0) >= 0.1 * best")
def win21_clear_winners(spark: SparkSession, d: str):
    """Questions whose best chunk leads the runner-up by at least a tenth of its score."""
    top = mth07_bm25_top(spark, d).filter("rank <= 2").groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("chunk_id"))).alias("chunk_id"), F.max("score").alias("best"), F.min(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    return top.filter("best - coalesce(second, 0) >= 0.1 * best").select("qid", "chunk_id", "best", "second")


@query(_L + "select qid, chunk_id, score from (select *, max(score) over (partition by qid) best from bm) where score >= best * 0.92")
def win22_near_best(spark: SparkSession, d: str):
    """All within 0.08 of the best score, relative to it."""
    scored = settle(_bm25(spark, d))
    best = scored.groupBy("qid").agg(F.max("score").alias("best"))
    return scored.join(best, "qid").filter("score >= best * 0.92D").select("qid", "chunk_id", "score")


_TRI = "list_distinct(list_transform(range(1, greatest(1, length({0}) - 1)), lambda i: substr({0}, i::int, 3)))"


@query(_L + f""", x as (select top.*, regexp_replace(question, '\\s+', '', 'g') q, regexp_replace(coalesce(title, ''), '\\s+', '', 'g') t, max(score) over w hi, min(score) over w lo from top join rag_questions using (qid) join c using (chunk_id) window w as (partition by qid)),
y as (select qid, chunk_id, rank, round(0.7 * (case when hi > lo then (score - lo) / (hi - lo) else 0.5 end) + 0.3 * len(list_intersect({_TRI.format('q')}, {_TRI.format('t')})) / greatest(1, len({_TRI.format('q')})), 6) m from x)
select qid, chunk_id, rank, row_number() over (partition by qid order by (rank > 5)::int, case when rank <= 5 then m end desc, rank) pos from y""")
def srt05_head_rerank(spark: SparkSession, d: str):
    """The five best of a question are reordered by a mix of their scaled score and title overlap; the tail stays."""
    top = mth07_bm25_top(spark, d)
    q = table(spark, d, "rag_questions").select("qid", "question")
    titles = chunks(spark, d, "title").select("chunk_id", F.coalesce("title", F.lit("")).alias("title"))
    scored = ranking.min_max(top.join(q, "qid").join(titles, "chunk_id"), ["qid"], "score", "scaled")
    mixed = 0.7 * F.col("scaled") + 0.3 * T.overlap(T.grams(F.col("question")), T.grams(F.col("title")))
    order = W.partitionBy("qid").orderBy((F.col("rank") > 5).cast("int"), F.desc(F.when(F.col("rank") <= 5, F.round(mixed, 6))), "rank")
    return scored.select("qid", "chunk_id", "rank", F.row_number().over(order).alias("pos"))


_CHARS = " union all ".join(f"select {{0}}, unnest(list_transform(range(1, greatest(1, length({{1}}) - {n - 2})), lambda i: substr(lower({{1}}), i::int, {n}))) g from {{2}}" for n in (2, 3, 4))
_TFIDF = f"""{CHUNKS}, tt as (select distinct title from c where length(trim(title)) > 0), nt as (select count(*) n from tt),
ga as (select title, g, 1 + ln(count(*)) tf from ({_CHARS.format('title', 'title', 'tt')}) group by all), gd as (select g, ln((1 + n) / (1 + count(*))) + 1 idf from ga, nt group by g, n having count(*) >= 2 and count(*) <= 0.8 * n),
va as (select title, g, tf * idf w from ga join gd using (g)), la as (select title, sqrt(sum(w * w)) l from va group by 1),
gq as (select qid, g, (1 + ln(count(*))) * idf w from ({_CHARS.format('qid', 'question', 'rag_questions')}) join gd using (g) group by qid, g, idf), lq as (select qid, sqrt(sum(w * w)) l from gq group by 1),
sc as (select qid, title, round(sum(va.w * gq.w) / any_value(la.l) / any_value(lq.l), 6) score from va join gq using (g) join la using (title) join lq using (qid) group by all)"""


@query(f"with {_TFIDF} select qid, title, score, row_number() over (partition by qid order by score desc, title) rank from sc qualify rank <= 3")
def mth08_title_tfidf(spark: SparkSession, d: str):
    """Cosine of TF-IDF vectors of pieces of 2 to 4 characters of questions and chunk titles, the three best titles of each question.

    Terms of a single title and those of four fifths of all are left out.
    """
    t = chunks(spark, d, "title").filter("length(trim(title)) > 0").select("title").distinct()
    n = t.agg(F.count("*").alias("n"))
    pieces = lambda text: F.concat(*[F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(" + "." * k + "))"), F.lit(1)) for k in (2, 3, 4)])
    grams = lambda df, text, key: df.select(key, F.explode(pieces(text)).alias("g")).groupBy(key, "g").agg((1 + F.log(F.count("*"))).alias("tf"))
    a = grams(t, "title", "title")
    idf = a.groupBy("g").agg(F.count("*").alias("df")).join(F.broadcast(n), F.lit(True)).filter("df >= 2 and df <= 0.8 * n").select("g", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    a = a.join(idf, "g").select("title", "g", (F.col("tf") * F.col("idf")).alias("w"))
    b = grams(table(spark, d, "rag_questions"), "question", "qid").join(idf, "g").select("qid", "g", (F.col("tf") * F.col("idf")).alias("v"))
    la, lb = a.groupBy("title").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("la")), b.groupBy("qid").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("lb"))
    s = a.join(b, "g").groupBy("qid", "title").agg(F.sum(F.col("w") * F.col("v")).alias("s"))
    scored = s.join(la, "title").join(lb, "qid").select("qid", "title", F.round(F.col("s") / F.col("la") / F.col("lb"), 6).alias("score"))
    return ranking.top_k(scored, ["qid"], "score", "title", 3)


@query("select event_id, event_type, case when u < 0.5 then 'a' when u < 0.8 then 'b' else 'c' end drawn from (select event_id, event_type, ('0x' || substr(sha256(event_id::varchar || ':1'), 1, 8))::bigint / 4294967296.0 u from events)")
def mth16_weighted_draw(spark: SparkSession, d: str):
    """A categorical draw by inverse distribution over a uniform value hashed from the id: the same on every run."""
    u = F.conv(F.substring(F.sha2(F.concat(F.col("event_id").cast("string"), F.lit(":1")), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    e = table(spark, d, "events").select("event_id", "event_type")
    return e.select("event_id", "event_type", F.when(u < 0.5, "a").when(u < 0.8, "b").otherwise("c").alias("drawn"))


@query(f"with {MESSAGES}, t as (select user_id, id, ts from m where user_id is not null and ts is not null and lower(trim(role, {WS})) in ('user', 'human')) select user_id, id, lead(id) over (partition by user_id order by ts, id) next_id from t")
def stm10_next_user_turn(spark: SparkSession, d: str):
    """Where the reply to a user's message must end: the user's next message. A user may have very many, so days are ordered apart and joined by their first."""
    m = messages(spark, d, "role").filter(clean_key("role").isin("user", "human") & F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    m = m.select("user_id", "id", "ts", F.floor(F.col("ts") / 86_400).alias("day"))
    inside = m.withColumn("next", F.lead("id").over(W.partitionBy("user_id", "day").orderBy("ts", "id")))
    first = m.groupBy("user_id", "day").agg(F.min(F.struct("ts", "id")).alias("f"))
    later = first.select("user_id", "day", F.lead("f.id").over(W.partitionBy("user_id").orderBy("day")).alias("later"))
    return inside.join(later, ["user_id", "day"]).select("user_id", "id", F.coalesce("next", "later").alias("next_id"))


@query(f"with {EVENTS}, {MESSAGES}, z as (select k from (select lower(trim(user_id, {WS})) k, arg_max(coalesce(deleted_at, timestamptz '9999-01-01'), updated_at) x from users where trim(user_id, {WS}) <> '' group by 1) where x < timestamptz '9999-01-01') select 'match_events' tbl, count(*) n from e where coalesce(from_user, '') not in (select k from z) and coalesce(about_user, '') not in (select k from z) union all select 'messages', count(*) from m where coalesce(user_id, '') not in (select k from z)")
def stm15_rows_after_erasure(spark: SparkSession, d: str):
    """What remains of each table once the rows of deleted users are erased."""
    rows = table(spark, d, "users").select(clean_key("user_id").alias("user_id"), "updated_at", "deleted_at").filter("user_id is not null")
    gone = current_rows(rows, "user_id", "updated_at").filter("deleted_at is not null").select("user_id")
    e = match_events(spark, d)
    e = e.join(gone.withColumnRenamed("user_id", "from_user"), "from_user", "left_anti").join(gone.withColumnRenamed("user_id", "about_user"), "about_user", "left_anti")
    m = messages(spark, d).join(gone, "user_id", "left_anti")
    return e.agg(F.count("*").alias("n")).select(F.lit("match_events").alias("tbl"), "n").unionByName(m.agg(F.count("*").alias("n")).select(F.lit("messages").alias("tbl"), "n"))


@query(f"with {USERS} select demographic.faculty faculty, count(*) n, round(avg(profile_completeness), 4) mean_completeness, count(*) filter (consent.matching) n_consent from u group by 1")
def agg11_user_distributions(spark: SparkSession, d: str):
    u = users(spark, d, "demographic", "profile_completeness", "consent")
    return u.groupBy(F.col("demographic.faculty").alias("faculty")).agg(F.count("*").alias("n"), F.round(F.avg("profile_completeness"), 4).alias("mean_completeness"), F.coalesce(F.sum(F.col("consent.matching").cast("int")), F.lit(0)).alias("n_consent"))
