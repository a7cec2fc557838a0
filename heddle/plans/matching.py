"""Ranking of candidate pairs: two-way vector scores, graph features, fusion, adjustment, evaluation.

The tables have no vectors of users. User n (the number in the key) is given
the embedding n mod N as persona and (7 n + 3) mod N as preference, N being
their number; the SQL does the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from heddle.functions import numbers as N
from heddle.functions import text as T
from heddle.operators import feedback, ranking
from heddle.plans.interactions import _PAIRS, _candidate_pairs
from heddle.plans.tables import EVENTS, USERS, match_events, users
from heddle.session import settle, table

QUERIES, SQL = {}, {}
K, PENALTY = 10, 0.15
# fixed values: rules between traits, their signs and the weights of the pair features
RULES = [
    ("trait:warm", "trait:playful", "COMPATIBLE_WITH", 0.6), ("trait:tidy", "trait:dreamy", "CONFLICTS_WITH", 0.5),
    ("trait:steady", "trait:curious", "COMPATIBLE_WITH", 0.4), ("trait:candid", "trait:reserved", "OPPOSITE_OF", 0.3),
    ("trait:punctual", "trait:stubborn", "CONFLICTS_WITH", 0.7), ("trait:warm", "trait:reserved", "COMPATIBLE_WITH", 0.2),
]
SIGNS = {"COMPATIBLE_WITH": 1.0, "CONFLICTS_WITH": -1.0, "OPPOSITE_OF": -1.0}
WEIGHTS = {"prefers": 0.35, "theory": 0.25, "hobby": 0.20, "lifestyle": 0.10}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- two-way vector scores -------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, persona, preference): two equi-joins with the embeddings, whose number comes as one row."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    n = F.regexp_extract("user_id", r"(\d+)$", 1).try_cast("long")
    u = users(spark, d).select("user_id", n.alias("n")).filter("n is not null").join(F.broadcast(e.agg(F.count("*").alias("k"))), F.lit(True))
    u = u.filter("k > 0").select("user_id", (F.col("n") % F.col("k")).alias("p"), ((F.col("n") * 7 + 3) % F.col("k")).alias("w"))
    both = u.join(e.select(F.col("vec_id").alias("p"), F.col("v").alias("persona")), "p").join(e.select(F.col("vec_id").alias("w"), F.col("v").alias("preference")), "w")
    return both.select("user_id", "persona", "preference")


def _two_way(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, persona_b, forward, reverse, base) of the candidate pairs; pairs without vectors fall out."""
    v = _vectors(spark, d)
    side = lambda x: v.select(F.col("user_id").alias(x), F.col("persona").alias(f"persona_{x}"), F.col("preference").alias(f"preference_{x}"))
    both = _candidate_pairs(spark, d).join(side("a"), "a").join(side("b"), "b")
    floor = lambda c: F.greatest(F.lit(0.0), c)
    both = both.select("a", "b", "persona_b", floor(N.dot(F.col("preference_a"), F.col("persona_b"))).alias("forward"), floor(N.dot(F.col("preference_b"), F.col("persona_a"))).alias("reverse"))
    return both.withColumn("base", N.harmonic(F.col("forward"), F.col("reverse")))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, base, penalty, forward, reverse, score): the two-way score less the likeness to whom a once unmatched."""
    s = settle(_two_way(spark, d))
    e = match_events(spark, d, "event_type").filter("event_type = 'unmatch'").select(F.col("from_user").alias("a"), F.col("about_user").alias("user_id")).distinct()
    past = e.join(_vectors(spark, d).select("user_id", F.col("persona").alias("past")), "user_id").select("a", "past")
    worst = s.select("a", "b", "persona_b").join(past, "a").groupBy("a", "b").agg(F.max(F.greatest(F.lit(0.0), N.dot(F.col("persona_b"), F.col("past")))).alias("penalty"))
    all_ = s.drop("persona_b").join(worst, ["a", "b"], "left").fillna(0.0, ["penalty"])
    return all_.withColumn("score", F.round(F.col("base") - PENALTY * F.col("penalty"), 6))


_DOT = "list_sum(list_transform(list_zip({}, {}), lambda p: p[1]::double * p[2]::double))"
_V = f"""{USERS}, k as (select count(*) k from embeddings), n as (select user_id, try_cast(regexp_extract(user_id, '([0-9]+)$', 1) as bigint) n from u),
v as (select user_id, p.embedding persona, w.embedding preference from n, k join embeddings p on p.vec_id = n.n % k.k join embeddings w on w.vec_id = (n.n * 7 + 3) % k.k)"""
_TWO = f"""with pr as ({_PAIRS}), {_V}, {EVENTS},
t0 as (select pr.a, pr.b, y.persona pb, greatest(0, {_DOT.format('x.preference', 'y.persona')}) f, greatest(0, {_DOT.format('y.preference', 'x.persona')}) r from pr join v x on x.user_id = pr.a join v y on y.user_id = pr.b),
t as (select *, case when f + r > 0 then 2 * f * r / (f + r) else 0 end base from t0),
neg as (select distinct from_user a, about_user n from e where event_type = 'unmatch'),
pen as (select t.a, t.b, max(greatest(0, {_DOT.format('t.pb', 'v.persona')})) penalty from t join neg on neg.a = t.a join v on v.user_id = neg.n group by all),
dense as (select t.a, t.b, base, f, r, coalesce(penalty, 0) penalty, round(base - {PENALTY} * coalesce(penalty, 0), 6) score from t left join pen on pen.a = t.a and pen.b = t.b)
"""


@query(_TWO + "select a, b, round(f, 6) forward, round(r, 6) reverse, round(base, 6) base from t")
def jn04_two_way_scores(spark: SparkSession, d: str):
    """Preference of one with persona of the other, both ways, and their harmonic mean."""
    return _two_way(spark, d).select("a", "b", *[F.round(c, 6).alias(c) for c in ("forward", "reverse", "base")])


@query(_TWO + "select a, b, round(penalty, 6) penalty from dense")
def jn05_negative_penalty(spark: SparkSession, d: str):
    """The candidate's greatest likeness to anyone the user unmatched."""
    return _dense(spark, d).select("a", "b", F.round("penalty", 6).alias("penalty"))


@query(_TWO + f"select a, b, score, round(base, 6) base, round(penalty, 6) penalty, row_number() over (partition by a order by score desc, b) rank from dense qualify rank <= {K}")
def srt01_dense_match(spark: SparkSession, d: str):
    """The best candidates of each query user by two-way score less penalty."""
    s = _dense(spark, d).select("a", "b", "score", F.round("base", 6).alias("base"), F.round("penalty", 6).alias("penalty"))
    return ranking.top_k(s, ["a"], "score", "b", K)


# --- graph features --------------------------------------------------------------------------------------------------


def _rules(spark: SparkSession) -> DataFrame:
    """(x, y, relation, weight, sign) in both directions: a parameter of a few rows."""
    rows = [(x, y, rel, w, SIGNS[rel]) for a, b, rel, w in RULES for x, y in ((a, b), (b, a))]
    return spark.createDataFrame(rows, "x string, y string, relation string, weight double, sign double")


def _ids(c: str) -> Column:
    return F.coalesce(F.array_distinct(F.filter(F.transform(c, lambda x: x["id"]), lambda i: i.isNotNull())), F.array().cast("array<string>"))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, traits, hobbies, wants, avoids, reported, sleep, weekend) of current users."""
    u = users(spark, d, "persona", "preferences", "reported_traits")
    usable = F.filter("reported_traits", lambda t: t["usable"] & (t["report_count"] >= feedback.REPORTS_NEEDED))
    known = lambda f: F.nullif(F.col(f"persona.lifestyle.{f}"), F.lit("unknown"))
    pairs = lambda c: F.coalesce(F.transform(c, lambda x: F.struct(x["id"].alias("id"), x["weight"].cast("double").alias("weight"))), F.array().cast("array<struct<id:string,weight:double>>"))
    reported = F.coalesce(F.transform(usable, lambda x: x["id"]), F.array().cast("array<string>"))
    return u.select("user_id", _ids("persona.traits").alias("traits"), _ids("persona.hobbies").alias("hobbies"), pairs("preferences.wants").alias("wants"), pairs("preferences.avoids").alias("avoids"), reported.alias("reported"), known("sleep").alias("sleep"), known("weekend").alias("weekend"))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)


def _features(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, prefers, theory, hobby, lifestyle, redflags): arrays of two profiles per row, no further join than the two.

    The rules are expanded on the side of a, per user, before pairs exist: a
    pair only sums what its b has of them.
    """
    p = _profiles(spark, d)
    rules = F.broadcast(_rules(spark))  # twice len(RULES) rows
    reach = p.select("user_id", F.explode("traits").alias("x")).join(rules, "x").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("y", (F.col("sign") * F.col("weight")).alias("w")))).alias("reach"))
    p = p.join(reach, "user_id", "left").withColumn("reach", F.coalesce("reach", F.array().cast("array<struct<y:string,w:double>>")))
    side = lambda x: p.select(F.col("user_id").alias(x), F.struct(*[c for c in p.columns if c != "user_id"]).alias("p" + x))
    both = _candidate_pairs(spark, d).join(side("a"), "a").join(side("b"), "b")

    def wanted(x: str, y: str) -> Column:
        total = _sum(F.transform(F.col(x)["wants"], lambda w: w["weight"]))
        met = _sum(F.transform(F.filter(F.col(x)["wants"], lambda w: F.array_contains(F.col(y)["traits"], w["id"])), lambda w: w["weight"]))
        return F.when(total > 0, met / total).otherwise(F.lit(0.0))

    def flags(x: str, y: str) -> Column:
        return F.transform(F.filter(F.col(x)["avoids"], lambda w: F.array_contains(F.col(y)["reported"], w["id"])), lambda w: w["weight"])

    theory = N.clamp(_sum(F.transform(F.filter(F.col("pa.reach"), lambda r: F.array_contains(F.col("pb.traits"), r["y"])), lambda r: r["w"])) / 2, -1.0, 1.0)
    same = [F.coalesce((F.col(f"pa.{k}") == F.col(f"pb.{k}")).cast("int"), F.lit(0)) for k in ("sleep", "weekend")]
    return both.select(
        "a", "b", ((wanted("pa", "pb") + wanted("pb", "pa")) / 2).alias("prefers"), theory.alias("theory"), T.jaccard(F.col("pa.hobbies"), F.col("pb.hobbies")).alias("hobby"),
        ((same[0] + same[1]) / 2).alias("lifestyle"), F.concat(flags("pa", "pb"), flags("pb", "pa")).alias("flags"),
    )


def _graph(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, the features, graph, n_flags, flag_weight)."""
    f = _features(spark, d)
    score = sum(w * F.col(k) for k, w in WEIGHTS.items())
    return f.withColumn("graph", F.round(score, 4)).withColumn("n_flags", F.size("flags")).withColumn("flag_weight", _sum(F.col("flags"))).drop("flags")


_RULE_ROWS = ", ".join(f"('{x}', '{y}', '{rel}', {w}, {SIGNS[rel]})" for a, b, rel, w in RULES for x, y in ((a, b), (b, a)))
_FEATURES = f"""pf as (select user_id, coalesce(list_distinct(list_transform(persona.traits, lambda x: x.id)), []) traits, coalesce(list_distinct(list_transform(persona.hobbies, lambda x: x.id)), []) hobbies,
 nullif(persona.lifestyle.sleep, 'unknown') sleep, nullif(persona.lifestyle.weekend, 'unknown') weekend from u),
ru(x, y, rel, w, sg) as (values {_RULE_ROWS}),
tr as (select user_id, unnest(traits) t from pf),
wn as (select user_id, t.id id, t.weight w from (select user_id, unnest(preferences.wants) t from u)),
av as (select user_id, t.id id, t.weight w from (select user_id, unnest(preferences.avoids) t from u)),
rp as (select distinct user_id, t.id id from (select user_id, unnest(reported_traits) t from u) where t.usable and t.report_count >= 3),
di as (select a, b, a x, b y from pr union all select a, b, b, a from pr),
wf as (select a, b, x, sum(case when tr.t is not null then w else 0 end) / sum(w) f from di join wn on wn.user_id = x left join tr on tr.user_id = y and tr.t = wn.id group by all),
wp as (select a, b, sum(f) / 2 f from wf group by all),
th as (select a, b, greatest(-1, least(1, sum(sg * w) / 2)) f from pr join tr s on s.user_id = a join ru on ru.x = s.t join tr o on o.user_id = b and o.t = ru.y group by all),
rf as (select a, b, count(*) n, sum(w) f from di join av on av.user_id = x join rp on rp.user_id = y and rp.id = av.id group by all),
ft as (select pr.a, pr.b, coalesce(wp.f, 0) prefers, coalesce(th.f, 0) theory,
 case when len(list_distinct(list_concat(x.hobbies, y.hobbies))) = 0 then 0 else len(list_intersect(x.hobbies, y.hobbies)) / len(list_distinct(list_concat(x.hobbies, y.hobbies))) end hobby,
 (case when x.sleep = y.sleep then 1 else 0 end + case when x.weekend = y.weekend then 1 else 0 end) / 2 lifestyle, coalesce(rf.n, 0) n_flags, coalesce(rf.f, 0) flag_weight
 from pr join pf x on x.user_id = pr.a join pf y on y.user_id = pr.b left join wp on wp.a = pr.a and wp.b = pr.b left join th on th.a = pr.a and th.b = pr.b left join rf on rf.a = pr.a and rf.b = pr.b),
gr as (select *, round({' + '.join(f'{w} * {k}' for k, w in WEIGHTS.items())}, 4) graph from ft)
"""
_G = f"with pr as ({_PAIRS}), {USERS}, {_FEATURES}"
_H = _TWO.rstrip() + ",\n" + _FEATURES


@query(_G + "select a, b, round(theory, 4) theory from ft where theory <> 0")
def jn08_rule_paths(spark: SparkSession, d: str):
    """Two-hop paths trait, rule, trait between two users: the signed weights, halved and clamped."""
    return _features(spark, d).filter("theory <> 0").select("a", "b", F.round("theory", 4).alias("theory"))


@query(_G + "select x.user_id a, x.rel, count(*) n from (select user_id, 'HAS_TRAIT' rel, unnest(traits) c from pf union all select user_id, 'LIKES', unnest(hobbies) from pf) x join (select distinct a from pr) q on q.a = x.user_id join (select user_id, 'HAS_TRAIT' rel, unnest(traits) c from pf union all select user_id, 'LIKES', unnest(hobbies) from pf) y on y.c = x.c and y.rel = x.rel and y.user_id <> x.user_id group by all")
def jn09_shared_concepts(spark: SparkSession, d: str):
    """How often others share a query user's concepts in the same relation: counted per concept before the join."""
    p = _profiles(spark, d)
    edges = p.select("user_id", F.explode(F.map_from_arrays(F.array(F.lit("HAS_TRAIT"), F.lit("LIKES")), F.array("traits", "hobbies"))).alias("rel", "cs")).select("user_id", "rel", F.explode("cs").alias("c"))
    held = edges.groupBy("rel", "c").agg((F.count("*") - 1).alias("others"))
    mine = edges.join(_candidate_pairs(spark, d).select(F.col("a").alias("user_id")).distinct(), "user_id", "left_semi")
    return mine.join(held, ["rel", "c"]).groupBy(F.col("user_id").alias("a"), "rel").agg(F.sum("others").alias("n")).filter("n > 0")


@query(_G + "select a, b, round(prefers, 4) prefers, round(theory, 4) theory, round(hobby, 4) hobby, round(lifestyle, 4) lifestyle, n_flags from ft")
def jn26_pair_features(spark: SparkSession, d: str):
    """All features of a pair from one join of profiles: no fan-out."""
    return _graph(spark, d).select("a", "b", *[F.round(c, 4).alias(c) for c in ("prefers", "theory", "hobby", "lifestyle")], "n_flags")


@query(_G + "select a, b, graph from gr")
def agg02_graph_score(spark: SparkSession, d: str):
    return _graph(spark, d).select("a", "b", "graph")


@query(_G + "select x relation_from, rel relation, y relation_to, w weight, (select count(*) from tr where t = ru.x) n_from from ru")
def jn23_rule_listing(spark: SparkSession, d: str):
    """The rules with both ends and how many users have the first trait."""
    n = _profiles(spark, d).select(F.explode("traits").alias("x")).groupBy("x").agg(F.count("*").alias("n_from"))
    r = _rules(spark).join(n, "x", "left").fillna(0, ["n_from"])
    return r.select(F.col("x").alias("relation_from"), "relation", F.col("y").alias("relation_to"), "weight", "n_from")


@query(f"with {USERS} select t.id id, count(*) n_users, sum(t.report_count) n_reports, max(t.report_count) most from (select unnest(reported_traits) t from u) where t.usable and t.report_count >= 3 group by 1")
def jn24_reported_behaviours(spark: SparkSession, d: str):
    r = users(spark, d, "reported_traits").select(F.explode("reported_traits").alias("t")).filter(f"t.usable and t.report_count >= {feedback.REPORTS_NEEDED}")
    return r.groupBy(F.col("t.id").alias("id")).agg(F.count("*").alias("n_users"), F.sum("t.report_count").alias("n_reports"), F.max("t.report_count").alias("most"))


# --- fusion and adjustment -------------------------------------------------------------------------------------------


def _fused(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, graph, dense, n_flags, flag_weight, base): reciprocal-rank fusion of both scores; what the dense side lacks ranks last."""
    g = settle(_graph(spark, d))
    s = settle(_dense(spark, d).select("a", "b", F.col("score").alias("dense")))
    ra = ranking.rank_all(s, ["a"], "dense", "b")
    rb = ranking.rank_all(g.select("a", "b", "graph"), ["a"], "graph", "b")
    base = ranking.reciprocal_rank_fusion(ra, rb, ["a"], "b").withColumnRenamed("score", "base")
    return g.join(base, ["a", "b"]).join(s, ["a", "b"], "left")


def _spread(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """``spread``: largest less smallest score of the group, 1 where that is 0; by a partial aggregate, not a window."""
    s = df.groupBy(*group).agg((F.max(score) - F.min(score)).alias("spread")).withColumn("spread", F.when(F.col("spread") > 0, F.col("spread")).otherwise(F.lit(1.0)))
    return df.join(s, group)


LAMBDA_FLAGS = 0.3
_FUSED = (
    _H
    + f""", rd as (select a, b, row_number() over (partition by a order by score desc, b) r from dense), rg as (select a, b, row_number() over (partition by a order by graph desc, b) r from gr),
wo as (select a, count(*) + 1 w from gr group by a),
fu as (select gr.*, dense.score dense, 1 / (60 + coalesce(rd.r, w)) + 1 / (60 + rg.r) base from gr join rg on rg.a = gr.a and rg.b = gr.b join wo on wo.a = gr.a left join rd on rd.a = gr.a and rd.b = gr.b left join dense on dense.a = gr.a and dense.b = gr.b),
sp as (select a, case when max(base) > min(base) then max(base) - min(base) else 1.0 end spread from fu group by a)
"""
)


@query(_FUSED + "select a, round(spread, 8) spread from sp")
def win07_spread(spark: SparkSession, d: str):
    """Range of the fused scores of each query user, taken before anything is removed."""
    return _spread(_fused(spark, d).select("a", "base"), ["a"], "base").select("a", F.round("spread", 8).alias("spread")).distinct()


@query(_FUSED + f"select fu.a, fu.b, round(base - spread * {LAMBDA_FLAGS} * flag_weight, 8) soft, (n_flags = 0) kept from fu join sp on sp.a = fu.a")
def flt13_flag_adjustment(spark: SparkSession, d: str):
    """Flagged pairs are removed (kept false) or, softly, lose a share of the spread by their weight."""
    s = _spread(_fused(spark, d), ["a"], "base")
    return s.select("a", "b", F.round(F.col("base") - F.col("spread") * LAMBDA_FLAGS * F.col("flag_weight"), 8).alias("soft"), (F.col("n_flags") == 0).alias("kept"))


@query(_FUSED + f"select a, b, round(base, 8) score, round(coalesce(dense, 0), 4) dense, graph, row_number() over (partition by a order by round(base, 8) desc, b) rank from fu where n_flags = 0 qualify rank <= {K}")
def srt02_hybrid_match(spark: SparkSession, d: str):
    """The best candidates by fused rank, flagged ones removed."""
    s = _fused(spark, d).filter("n_flags = 0").select("a", "b", F.round("base", 8).alias("score"), F.round(F.coalesce("dense", F.lit(0.0)), 4).alias("dense"), "graph")
    return ranking.top_k(s, ["a"], "score", "b", K)


@query(_FUSED + ", me as (select from_user a, about_user b from e where event_type = 'matched' and from_user is not null and about_user is not null) select fu.a, count(*) n_left, max(graph) best from fu where not exists (select 1 from me where me.a = fu.a and me.b = fu.b) group by 1")
def jn37_without_suggested(spark: SparkSession, d: str):
    """Candidates that were not matched with the user before."""
    seen = match_events(spark, d, "event_type").filter("event_type = 'matched'").select(F.col("from_user").alias("a"), F.col("about_user").alias("b")).distinct()
    return _graph(spark, d).join(seen, ["a", "b"], "left_anti").groupBy("a").agg(F.count("*").alias("n_left"), F.max("graph").alias("best"))


@query(_G + "select a, b from gr where n_flags = 0 order by sha256(a || ':' || b || ':3'), a, b limit 15")
def srt11_pair_sample(spark: SparkSession, d: str):
    """A sample of 15 pairs that the seed alone decides."""
    p = _graph(spark, d).filter("n_flags = 0").select("a", "b", F.sha2(F.concat_ws(":", "a", "b", F.lit("3")), 256).alias("h"))
    return p.orderBy("h", "a", "b").limit(15).select("a", "b")


# --- evaluation over a grid ------------------------------------------------------------------------------------------

GRID = [("dense", 5), ("dense", 10), ("graph", 5), ("graph", 10), ("hybrid", 5), ("hybrid", 10)]
_GOLD = ", og as (select a, b, row_number() over (partition by a order by round(prefers + hobby + lifestyle, 6) desc, b) r from gr where n_flags = 0), go as (select a, b from og where r <= 5)"
_GRIDS = (
    _FUSED
    + _GOLD
    + """, mo as (select 'dense' mode, a, b, row_number() over (partition by a order by score desc, b) r from dense union all select 'graph', a, b, row_number() over (partition by a order by graph desc, b) r from gr
 union all select 'hybrid', a, b, row_number() over (partition by a order by round(base, 8) desc, b) r from fu),
ks(k) as (values (5), (10)), md(mode) as (values ('dense'), ('graph'), ('hybrid')), qn as (select a, count(*) n from go group by a),
hi as (select mode, k, mo.a, count(*) h, min(r) f, sum(1 / log2(r + 1)) g from mo, ks, go where r <= k and go.a = mo.a and go.b = mo.b group by all),
vi as (select mode, k, mo.a, count(*) v from mo, ks, gr where r <= k and gr.a = mo.a and gr.b = mo.b and n_flags > 0 group by all),
id as (select k, n, sum(1 / log2(i + 1)) z from ks, (select distinct n from qn), (select unnest(range(1, 11)) i) where i <= least(k, n) group by all),
pe as (select md.mode, ks.k, qn.a, coalesce(h, 0) / ks.k p, coalesce(h, 0) / qn.n rc, coalesce(1 / f, 0) m, coalesce(g, 0) / z nd, coalesce(v, 0) / ks.k vio from md, ks, qn join id on id.k = ks.k and id.n = qn.n
 left join hi on hi.mode = md.mode and hi.k = ks.k and hi.a = qn.a left join vi on vi.mode = md.mode and vi.k = ks.k and vi.a = qn.a)
"""
)


@query(_GRIDS + "select mode, k, count(*) n, round(avg(round(p, 4)), 4) p_at_k, round(avg(round(rc, 4)), 4) r_at_k, round(avg(round(m, 4)), 4) mrr, round(avg(round(nd, 4)), 4) ndcg, round(avg(round(vio, 4)), 4) violation from pe group by all")
def agg20_match_grid(spark: SparkSession, d: str):
    """Precision, recall, MRR, nDCG and violations at 5 and 10 of three ways to rank, against the five best by stated wishes and habits; flagged pairs are violations."""
    f = settle(_fused(spark, d))
    wish = f.filter("n_flags = 0").select("a", "b", F.round(F.col("prefers") + F.col("hobby") + F.col("lifestyle"), 6).alias("s"))
    gold = settle(ranking.top_k(wish, ["a"], "s", "b", 5).select("a", "b"))
    bad = f.filter("n_flags > 0").select("a", "b")
    scores = {"dense": F.col("dense"), "graph": F.col("graph"), "hybrid": F.round("base", 8)}
    tops = {m: settle(ranking.top_k(f.select("a", "b", c.alias("s")).filter("s is not null"), ["a"], "s", "b", 10)) for m, c in scores.items()}
    names = ["p_at_k", "r_at_k", "mrr", "ndcg", "violation"]
    parts = []
    for mode, k in GRID:
        m = ranking.ranking_metrics(tops[mode], gold, "a", "b", k, bad)
        parts.append(m.agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce(c, F.lit(0.0))), 4).alias(c) for c in names]).select(F.lit(mode).alias("mode"), F.lit(k).alias("k"), "n", *names))
    return reduce(DataFrame.unionByName, parts)


@query(_GRIDS + "select mode, k, round(avg(least(h_, 1)), 4) hit, round(avg(case when h_ = 0 then 1 else 0 end), 4) miss from (select md.mode, ks.k, qn.a, coalesce(h, 0) h_ from md, ks, qn left join hi on hi.mode = md.mode and hi.k = ks.k and hi.a = qn.a) group by all")
def agg21_hit_grid(spark: SparkSession, d: str):
    """Share of query users with at least one of their five gold candidates among the first k: ranked once at the largest k, then cut."""
    f = settle(_fused(spark, d))
    wish = f.filter("n_flags = 0").select("a", "b", F.round(F.col("prefers") + F.col("hobby") + F.col("lifestyle"), 6).alias("s"))
    gold = settle(ranking.top_k(wish, ["a"], "s", "b", 5).select("a", "b"))
    scores = {"dense": F.col("dense"), "graph": F.col("graph"), "hybrid": F.round("base", 8)}
    long = reduce(DataFrame.unionByName, [f.select(F.lit(m).alias("mode"), "a", "b", c.alias("s")).filter("s is not null") for m, c in scores.items()])
    first = ranking.top_k(long, ["mode", "a"], "s", "b", 10).join(gold, ["a", "b"]).groupBy("mode", "a").agg(F.min("rank").alias("first"))
    grid = gold.select("a").distinct().select("a", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(k).alias("k")) for m, k in GRID])).alias("g")).select("a", "g.mode", "g.k")
    hit = (F.coalesce(F.col("first"), F.lit(99)) <= F.col("k")).cast("int")
    return grid.join(first, ["mode", "a"], "left").groupBy("mode", "k").agg(F.round(F.avg(hit), 4).alias("hit"), F.round(F.avg(1 - hit), 4).alias("miss"))


@query(f"with {USERS} select user_id, list_sort(list_concat(coalesce(list_transform(persona.hobbies, lambda x: 'LIKES ' || x.id), []), coalesce(list_transform(persona.traits, lambda x: 'HAS_TRAIT ' || x.id), []), coalesce(list_transform(preferences.wants, lambda x: 'PREFERS ' || x.id), []))) edges from u")
def jn21_profile_neighbourhood(spark: SparkSession, d: str):
    """Every user with the edges to its concepts; users without any stay."""
    u = users(spark, d, "persona", "preferences")
    named = lambda c, rel: F.coalesce(F.transform(c, lambda x: F.concat(F.lit(rel + " "), x["id"])), F.array().cast("array<string>"))
    return u.select("user_id", F.sort_array(F.concat(named("persona.hobbies", "LIKES"), named("persona.traits", "HAS_TRAIT"), named("preferences.wants", "PREFERS"))).alias("edges"))


@query(_G + "select a, b, round(100 * least(1, (graph + greatest(0, prefers)) / 1.2)) shown from gr")
def mth13_display_percentage(spark: SparkSession, d: str):
    return _graph(spark, d).select("a", "b", F.round(100 * F.least(F.lit(1.0), (F.col("graph") + F.greatest(F.lit(0.0), F.col("prefers"))) / 1.2)).alias("shown"))


@query(_G + """, fa as (select a, b, 'shared' kind, list_sort(list_intersect(x.hobbies, y.hobbies)) items from pr join pf x on x.user_id = a join pf y on y.user_id = b
 union all select a, b, 'wants', list_sort(list_intersect(list_transform(u.preferences.wants, lambda w: w.id), y.traits)) from pr join u on u.user_id = a join pf y on y.user_id = b)
select a, b, kind, array_to_string(items, ', ') fact from fa where len(items) > 0""")
def agg03_facts(spark: SparkSession, d: str):
    """Facts of a pair as text: hobbies both have, and what a wants that b has."""
    p = _profiles(spark, d)
    side = lambda x: p.select(F.col("user_id").alias(x), F.struct("traits", "hobbies", F.array_distinct(F.transform("wants", lambda w: w["id"])).alias("wants")).alias("p" + x))
    both = _candidate_pairs(spark, d).join(side("a"), "a").join(side("b"), "b")
    facts = F.array(F.struct(F.lit("shared").alias("kind"), F.array_intersect("pa.hobbies", "pb.hobbies").alias("items")), F.struct(F.lit("wants").alias("kind"), F.array_intersect("pa.wants", "pb.traits").alias("items")))
    x = both.select("a", "b", F.explode(facts).alias("f")).filter("size(f.items) > 0")
    return x.select("a", "b", "f.kind", F.array_join(F.sort_array("f.items"), ", ").alias("fact"))
