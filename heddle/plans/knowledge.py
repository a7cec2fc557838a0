"""Queries over chunks, claims and the graph."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window as W, functions as F

from heddle.functions import text as T
from heddle.operators import graph, lexical, ranking, vectors
from heddle.plans.tables import CHUNKS, CLAIMS, EVENTS, USERS, chunks, claims, match_events, users
from heddle.session import settle, small, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _edges(spark, d):
    u = users(spark, d, "persona", "preferences", "reported_traits")
    e = match_events(spark, d)
    c = chunks(spark, d, "concept_counts")
    l = claims(spark, d, "subject_id", "object_concept_id", "concept_ids")
    edges = graph.user_edges(u).unionByName(graph.event_edges(e)).unionByName(graph.chunk_edges(c)).unionByName(graph.claim_edges(l))
    return u, e, c, l, edges


_GRAPH = f"""with {USERS}, {EVENTS}, {CHUNKS}, {CLAIMS},
n0 as (select chunk_id, regexp_replace(chunk_id, '_c[0-9]+$', '') s, try_cast(regexp_extract(chunk_id, '_c([0-9]+)$', 1) as int) o from c),
ed as (
 select user_id source, 'LIKES' type, x.id target, x.confidence weight from (select user_id, unnest(persona.hobbies) x from u)
 union all select user_id, 'HAS_TRAIT', x.id, x.confidence from (select user_id, unnest(persona.traits) x from u)
 union all select user_id, 'PREFERS', x.id, x.weight from (select user_id, unnest(preferences.wants) x from u)
 union all select user_id, 'AVOIDS', x.id, x.weight from (select user_id, unnest(preferences.avoids) x from u)
 union all select user_id, 'REPORTED_AS', x.id, x.report_count from (select user_id, unnest(reported_traits) x from u) where x.usable and x.report_count >= 3
 union all select event_id, 'FROM_USER', from_user, 1 from e
 union all select event_id, 'ABOUT_USER', about_user, 1 from e
 union all select chunk_id, 'IN_SOURCE', source_id, 1 from c
 union all select a.chunk_id, 'NEXT_CHUNK', b.chunk_id, 1 from n0 a join n0 b on a.s = b.s and a.o + 1 = b.o
 union all select chunk_id, 'ABOUT', x.key, x.value from (select chunk_id, unnest(map_entries(concept_counts)) x from c)
 union all select claim_id, 'SUPPORTED_BY', chunk_id, 1 from l
 union all select claim_id, 'SUBJECT', case when trim(subject_id) <> '' then subject_id end, 1 from l
 union all select claim_id, 'OBJECT', case when trim(object_concept_id) <> '' then object_concept_id end, 1 from l
 union all select claim_id, 'MENTIONS', unnest(concept_ids), 1 from l),
ge as (select 'edge:' || substr(sha256(source || chr(31) || type || chr(31) || target || chr(31)), 1, 24) id, source, type, target, cast(weight as double) weight from ed where source is not null and target is not null),
gn as (select user_id id, 'User' label from u union all select event_id, 'Event' from e union all select chunk_id, 'Chunk' from c
 union all select distinct source_id, 'Source' from c where source_id is not null union all select claim_id, 'Claim' from l
 union all select distinct target, 'Concept' from ge where type in ('LIKES','HAS_TRAIT','PREFERS','AVOIDS','REPORTED_AS','ABOUT','SUBJECT','OBJECT','MENTIONS'))
"""


@query(_GRAPH + "select id, source, type, target, weight from ge")
def src24_graph_edges(spark: SparkSession, d: str):
    return _edges(spark, d)[-1]


@query(_GRAPH + "select id, label, case when label = 'Concept' then split_part(id, ':', 1) end grp from gn")
def src24_graph_nodes(spark: SparkSession, d: str):
    return graph.nodes(*_edges(spark, d))


@query(_GRAPH + "select 'node' kind, label name, count(*) n from gn group by all union all select 'edge', type, count(*) from ge group by all")
def agg29_graph_counts(spark: SparkSession, d: str):
    parts = _edges(spark, d)
    n = graph.nodes(*parts).groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    return n.unionByName(parts[-1].groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "name", "n"))


@query(
    _GRAPH
    + """, o(type, s, t) as (values ('LIKES','User','Concept'),('HAS_TRAIT','User','Concept'),('PREFERS','User','Concept'),('AVOIDS','User','Concept'),('REPORTED_AS','User','Concept'),('FROM_USER','Event','User'),('ABOUT_USER','Event','User'),('IN_SOURCE','Chunk','Source'),('NEXT_CHUNK','Chunk','Chunk'),('ABOUT','Chunk','Concept'),('SUPPORTED_BY','Claim','Chunk'),('SUBJECT','Claim','Concept'),('OBJECT','Claim','Concept'),('MENTIONS','Claim','Concept'))
select rule, type, count(*) n from (
 select 'source missing' rule, type from ge join o using (type) where not exists (select 1 from gn where gn.id = ge.source and gn.label = o.s)
 union all select 'target missing', type from ge join o using (type) where not exists (select 1 from gn where gn.id = ge.target and gn.label = o.t)
 union all select 'weight', type from ge where weight is null
 union all select 'repeated id', min(type) from ge group by id having count(*) > 1) group by all"""
)
def flt03_graph_violations(spark: SparkSession, d: str):
    parts = _edges(spark, d)
    edges = settle(parts[-1])  # read five times
    return graph.violations(settle(graph.nodes(*parts[:-1], edges)), edges)


@query(f"with {CHUNKS}, n0 as (select chunk_id, regexp_replace(chunk_id, '_c[0-9]+$', '') s, try_cast(regexp_extract(chunk_id, '_c([0-9]+)$', 1) as int) o from c) select a.chunk_id, b.chunk_id next_id from n0 a join n0 b on a.s = b.s and a.o + 1 = b.o")
def win08_next_chunks(spark: SparkSession, d: str):
    return graph.next_chunks(chunks(spark, d))


@query(f"with {CHUNKS} select k.key concept, chunk_id, k.value n, round(0.05 * least(1, k.value / 5.0), 6) bonus from (select chunk_id, unnest(map_entries(concept_counts)) k from c)")
def jn12_concept_chunks(spark: SparkSession, d: str):
    x = chunks(spark, d, "concept_counts").select("chunk_id", F.explode("concept_counts").alias("concept", "n"))
    return x.select("concept", "chunk_id", "n", F.round(0.05 * F.least(F.lit(1.0), F.col("n") / 5), 6).alias("bonus"))


@query(f"""with {CLAIMS}, x as (select distinct claim_id, chunk_id, unnest(list_filter(list_distinct(list_concat(coalesce(concept_ids, []), [subject_id, object_concept_id])), lambda i: trim(i) <> '')) concept from l where chunk_id is not null)
select concept, chunk_id, count(*) n_claims from x where concept is not null group by all""")
def jn13_concept_claim_chunks(spark: SparkSession, d: str):
    """Chunks that support a claim about a concept, as mention, subject or object, with the number of such claims."""
    ids = F.array_distinct(F.concat(F.coalesce("concept_ids", F.array().cast("array<string>")), F.array("subject_id", "object_concept_id")))
    x = claims(spark, d, "concept_ids", "subject_id", "object_concept_id").filter("chunk_id is not null").select("chunk_id", F.explode(F.filter(ids, lambda i: F.trim(i) != "")).alias("concept"))
    return x.groupBy("concept", "chunk_id").agg(F.count("*").alias("n_claims"))


@query(f"""with {CLAIMS}, a as (select object_concept_id via, predicate "first", count(*) na, count(distinct subject_id) n_subjects from l where polarity = 'affirmed' and trim(object_concept_id) <> '' group by all),
b as (select subject_id via, predicate "second", count(*) nb, count(distinct object_concept_id) n_objects from l where polarity = 'affirmed' and trim(subject_id) <> '' group by all)
select a.via, "first", "second", na * nb n_chains, n_subjects, n_objects from a join b on a.via = b.via""")
def jn14_claim_chains(spark: SparkSession, d: str):
    return graph.claim_chains(claims(spark, d, "subject_id", "object_concept_id", "predicate", "polarity"))


@query(f"with {CHUNKS}, {CLAIMS} select l.claim_id, l.predicate, l.polarity, c.chunk_id, c.source_id, c.title from l join c on l.chunk_id = c.chunk_id where contains(c.text, l.quote) and length(l.quote) > 0")
def jn35_grounded_claims(spark: SparkSession, d: str):
    """Claims whose quote stands verbatim in their chunk."""
    l, c = claims(spark, d, "predicate", "polarity", "quote"), chunks(spark, d, "title", "text")
    return l.filter("length(quote) > 0").join(c, "chunk_id").filter(F.contains("text", "quote")).select("claim_id", "predicate", "polarity", "chunk_id", "source_id", "title")


@query(f"""with {CLAIMS} select claim_id, (length(trim(coalesce(quote, ''))) > 0) has_quote, (polarity in ('affirmed', 'negated', 'hedged')) known_polarity, (trim(coalesce(subject_id, '')) <> '') has_subject, (trim(coalesce(object_concept_id, '')) <> '' or trim(coalesce(object_text, '')) <> '') has_object,
(length(trim(coalesce(quote, ''))) > 0 and coalesce(polarity in ('affirmed', 'negated', 'hedged'), false) and trim(coalesce(subject_id, '')) <> '' and (trim(coalesce(object_concept_id, '')) <> '' or trim(coalesce(object_text, '')) <> '')) valid from l""")
def flt26_claim_structure(spark: SparkSession, d: str):
    some = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    l = claims(spark, d, "quote", "polarity", "subject_id", "object_concept_id", "object_text")
    flags = l.select("claim_id", (F.length(F.trim(F.coalesce("quote", F.lit("")))) > 0).alias("has_quote"), F.col("polarity").isin("affirmed", "negated", "hedged").alias("known_polarity"), some(F.col("subject_id")).alias("has_subject"), (some(F.col("object_concept_id")) | some(F.col("object_text"))).alias("has_object"))
    return flags.withColumn("valid", F.col("has_quote") & F.coalesce("known_polarity", F.lit(False)) & F.col("has_subject") & F.col("has_object"))


@query(f"with {CHUNKS}, r as (select chunk_id, source_id, row_number() over (partition by source_id order by chunk_id) n from c) select source_id, chunk_id from r where n = 1")
def jn17_source_introductions(spark: SparkSession, d: str):
    return chunks(spark, d).groupBy("source_id").agg(F.min("chunk_id").alias("chunk_id"))


@query(f"with {CHUNKS} select source_id, count(*) n_chunks, count(distinct chapter_title) n_chapters, sum(length(text)) n_chars, round(100.0 * count(*) filter (len(concepts) > 0) / count(*), 1) tagged_pct, round(avg(length(text)), 2) mean_chars from c group by 1")
def agg09_source_report(spark: SparkSession, d: str):
    c = chunks(spark, d, "chapter_title", "text", "concepts")
    tagged = F.round(100 * F.sum((F.size("concepts") > 0).cast("int")) / F.count("*"), 1)
    return c.groupBy("source_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("chapter_title").alias("n_chapters"), F.sum(F.length("text")).alias("n_chars"), tagged.alias("tagged_pct"), F.round(F.avg(F.length("text")), 2).alias("mean_chars"))


@query(f"with {CHUNKS} select k.key concept, sum(k.value) n, count(*) n_chunks, row_number() over (order by sum(k.value) desc, k.key) rank from (select chunk_id, unnest(map_entries(concept_counts)) k from c) group by 1 qualify rank <= 15")
def agg31_top_concepts(spark: SparkSession, d: str):
    x = chunks(spark, d, "concept_counts").select(F.explode("concept_counts").alias("concept", "n"))
    counted = x.groupBy("concept").agg(F.sum("n").alias("n"), F.count("*").alias("n_chunks")).orderBy(F.desc("n"), "concept").limit(15)
    return counted.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "concept")))


@query(f"with {USERS}, {CHUNKS}, k as (select distinct unnest(concepts) id from c) select id, count(*) n_users from (select user_id, unnest(list_transform(persona.traits, lambda x: x.id)) id from u) where id not in (select id from k where id is not null) group by 1")
def agg28_concepts_without_chunks(spark: SparkSession, d: str):
    t = users(spark, d, "persona").select(F.explode(F.transform("persona.traits", lambda x: x["id"])).alias("id"))
    known = chunks(spark, d, "concepts").select(F.explode("concepts").alias("id")).distinct()
    return t.groupBy("id").agg(F.count("*").alias("n_users")).join(known, "id", "left_anti")


@query(f"with {CHUNKS}, t as (select chunk_id, source_id, regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g') k from c where text is not null) select chunk_id from (select chunk_id, row_number() over (partition by source_id, k order by chunk_id) n from t) where n > 1")
def set02_repeated_chunks(spark: SparkSession, d: str):
    """Chunks whose text, white space apart, an earlier one of the source has: hashes are grouped, not texts."""
    t = chunks(spark, d, "text").filter("text is not null").select("chunk_id", "source_id", F.sha2(F.regexp_replace("text", r"[ \t\n\r\f\x0b]+", ""), 256).alias("k"))
    first = t.groupBy("source_id", "k").agg(F.min("chunk_id").alias("first"))
    return t.join(first, (t["k"] == first["k"]) & t["source_id"].eqNullSafe(first["source_id"])).filter("chunk_id <> first").select("chunk_id")


@query(f"with {CHUNKS} select chunk_id, count(*) over (partition by source_id) n_in_source, row_number() over (partition by source_id order by len(text) desc nulls last, chunk_id) pos from c qualify pos <= 3")
def win04_source_cap(spark: SparkSession, d: str):
    """At most three chunks of a source, the longest first."""
    c = chunks(spark, d, "text").select("chunk_id", "source_id", F.length("text").alias("n"))
    per = c.groupBy("source_id").agg(F.count("*").alias("n_in_source"))
    w = W.partitionBy("source_id").orderBy(F.desc_nulls_last("n"), "chunk_id")
    capped = c.withColumn("pos", F.row_number().over(w)).filter("pos <= 3")
    return capped.join(per, capped["source_id"].eqNullSafe(per["source_id"])).select("chunk_id", "n_in_source", "pos")


@query(f"with {CHUNKS}, x as (select chunk_id, text, unnest(generate_series(0, greatest(1, length(text) - 150) - 1, 450)) s from c where text is not null) select chunk_id, s // 450 window_no, s start, length(substr(text, s::int + 1, 600)) size, substr(sha256(substr(text, s::int + 1, 600)), 1, 16) digest from x")
def win16_char_windows(spark: SparkSession, d: str):
    """Windows of 600 characters every 450."""
    c = chunks(spark, d, "text").filter("text is not null")
    last = (F.greatest(F.lit(1), F.length("text") - 150) - 1).cast("long")
    x = c.select("chunk_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(450).cast("long"))).alias("start"))
    piece = F.substring(F.col("text"), (F.col("start") + 1).cast("int"), F.lit(600))
    return x.select("chunk_id", F.expr("start div 450").alias("window_no"), "start", F.length(piece).alias("size"), F.substring(F.sha2(piece, 256), 1, 16).alias("digest"))


@query(f"""with {CHUNKS}, x as (select source_id, chunk_id, floor(length(coalesce(text, '')) / 1.6)::bigint + 1 cost from c),
g as (select source_id, list({{'id': chunk_id, 'cost': cost}} order by cost desc, chunk_id) items from x where source_id is not null group by 1),
f as (select source_id, list_reduce(items, lambda a, i: case when a.used + i.cost <= 2000 then {{'used': a.used + i.cost, 'kept': list_append(a.kept, i)}} else a end, {{'used': 0::bigint, 'kept': []::struct(id varchar, "cost" bigint)[]}}) r from g)
select source_id, k.id chunk_id, k.cost "cost" from (select source_id, unnest(r.kept) k from f)""")
def win18_packed_contexts(spark: SparkSession, d: str):
    """Per source, chunk ids by falling length that fit 2,000 estimated tokens; one too large is skipped.

    Only chunks that may fit a budget can be taken, so the ordered list of a
    source that is folded stops at the longest prefix whose smallest members
    fill the budget: candidates beyond it cannot fit. The sum of the smallest
    costs bounds the list.
    """
    c = chunks(spark, d, "text").select("chunk_id", "source_id", T.token_estimate(F.coalesce("text", F.lit(""))).cast("long").alias("cost"))
    return _packed(c, 2000)


def _packed(c, budget: int):
    """Greedy by falling cost, ids rising among equals, on counts of costs: bounded state per group whatever its size."""
    counts = c.filter(F.col("cost") <= budget).groupBy("source_id", "cost").agg(F.count("*").alias("n"))
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<cost:bigint,take:bigint>>").alias("plan"))

    def step(acc, x):
        take = F.least(x["n"], F.floor((budget - acc["used"]) / x["cost"]))
        return F.struct((acc["used"] + take * x["cost"]).alias("used"), F.when(take > 0, F.concat(acc["plan"], F.array(F.struct(x["cost"].alias("cost"), take.alias("take"))))).otherwise(acc["plan"]).alias("plan"))

    lists = counts.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("cost", "n")), asc=False).alias("x"))
    plan = lists.select("source_id", F.explode(F.aggregate("x", state, step, lambda a: a["plan"])).alias("p")).select("source_id", "p.cost", "p.take")
    ranked = c.withColumn("r", F.row_number().over(W.partitionBy("source_id", "cost").orderBy("chunk_id")))
    met = ranked.join(plan.withColumnRenamed("source_id", "s").withColumnRenamed("cost", "k"), F.col("source_id").eqNullSafe(F.col("s")) & (F.col("cost") == F.col("k")))
    return met.filter("r <= take").select("source_id", "chunk_id", "cost")


@query("select qid, chunk_id, hits, n_keywords from (with " + CHUNKS + ", q as (select qid, list_distinct(list_filter(expected_keywords, lambda k: k <> '')) ks from rag_questions) select qid, chunk_id, len(list_filter(ks, lambda k: contains(lower(text), lower(k)))) hits, len(ks) n_keywords from q, c where text is not null and len(ks) > 0) where hits >= ceil(n_keywords / 2.0)")
def jn32_gold_chunks(spark: SparkSession, d: str):
    """Chunks that hold at least half of a question's keywords.

    The questions are the stated query set. Each chunk is matched against the
    distinct keywords (their number is checked) within its row; what it holds is
    exploded and counted per question by an equi-join.
    """
    q = table(spark, d, "rag_questions").select("qid", F.explode(F.array_distinct(F.filter("expected_keywords", lambda k: k != ""))).alias("keyword"))
    words = [r["keyword"] for r in q.select("keyword").distinct().orderBy("keyword").limit(MAX_KEYWORDS + 1).collect()]
    if len(words) > MAX_KEYWORDS:
        raise ValueError("more keywords than one pass takes; split the questions into blocks")
    c = chunks(spark, d, "text").filter("text is not null").select("chunk_id", F.lower("text").alias("t"))
    held = F.filter(F.array(*[F.lit(w) for w in words]), lambda k: F.contains(F.col("t"), F.lower(k)))
    met = c.select("chunk_id", F.explode(held).alias("keyword")).join(small(q, 100_000), "keyword")
    need = q.groupBy("qid").agg(F.count("*").alias("n_keywords"))
    return met.groupBy("qid", "chunk_id").agg(F.count("*").alias("hits")).join(small(need, 100_000), "qid").filter(F.col("hits") >= F.ceil(F.col("n_keywords") / 2)).select("qid", "chunk_id", "hits", "n_keywords")


MAX_KEYWORDS = 2000

# --- lexical retrieval and fusion --------------------------------------------------------------------------------------

_REST = r"regexp_replace({0}, '[a-zà-ÿ0-9\s\p{{P}}\p{{S}}]+', '', 'g')"
_TERMS = "list_concat(regexp_extract_all(t, '[a-zà-ÿ0-9]+'), list_transform(range(1, greatest(1, length(r) - 1)), lambda i: substr(r, i::int, 3)))"
LEXICAL = f"""{CHUNKS},
tm as (select chunk_id, {_TERMS} terms from (select chunk_id, lower(text) t, {_REST.format('lower(text)')} r from c where text is not null)),
po as (select chunk_id, len(terms) size, term, count(*) tf from (select chunk_id, terms, unnest(terms) term from tm) group by all),
qt as (select distinct qid, unnest({_TERMS}) term from (select qid, lower(question) t, {_REST.format('lower(question)')} r from rag_questions)),
fr as (select term, count(*) df from po group by 1), nn as (select count(*) n, avg(len(terms)) m from tm where len(terms) > 0),
bm as (select qid, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * size / m))), 6) score from po join qt using (term) join fr using (term), nn group by all),
ov as (select qid, chunk_id, round(count(*) / k, 6) score from po join qt using (term) join (select qid, count(*) k from qt group by 1) using (qid) group by qid, chunk_id, k),
top as (select qid, chunk_id, score, row_number() over (partition by qid order by score desc, chunk_id) rank from bm qualify rank <= 10)
"""
_L = f"with {LEXICAL}"


def _hits(spark, d):
    return lexical.hits(table(spark, d, "rag_questions").select("qid", "question"), "qid", "question", chunks(spark, d, "text"), "chunk_id", "text")


def _bm25(spark, d):
    return lexical.bm25(_hits(spark, d))


def _overlaps(spark, d):
    return lexical.overlaps(_hits(spark, d))


def _two_lists(spark, d, k):
    """(qid, list, chunk_id, score, rank): the first k by BM25 and by overlap, found in one pass; a few rows a question, written once."""
    both = F.explode(F.array(F.struct(F.lit("bm25").alias("list"), "score"), F.struct(F.lit("overlap").alias("list"), F.col("overlap").alias("score")))).alias("x")
    x = lexical.scores(_hits(spark, d)).select("qid", "chunk_id", both).select("qid", "x.list", "chunk_id", "x.score")
    return settle(ranking.top_k(x, ["qid", "list"], "score", "chunk_id", k))


@query(_L + "select term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) idf from fr, nn")
def agg24_bm25_statistics(spark: SparkSession, d: str):
    """Document frequency and idf of every term."""
    c = chunks(spark, d, "text").filter("text is not null")
    n = c.filter(F.size(lexical.terms_of(F.col("text"))) > 0).agg(F.count("*").alias("n"))  # one row
    return lexical.term_frequencies(c, "chunk_id", "text").join(F.broadcast(n), F.lit(True)).select("term", "df", F.round(lexical.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(_L + "select qid, chunk_id, score, rank from top")
def mth07_bm25_top(spark: SparkSession, d: str):
    """The ten best chunks of each question."""
    return ranking.top_k(_bm25(spark, d), ["qid"], "score", "chunk_id", 10)


@query(_L + ", se as (select qid, round(sum(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))), 6) best from qt left join fr using (term), nn group by 1) select qid, chunk_id, round(score / best, 6) share from top join se using (qid) where rank = 1")
def mth07_self_scores(spark: SparkSession, d: str):
    """The best score of each question relative to what a text with all its terms would have."""
    h = _hits(spark, d)
    return ranking.top_k(lexical.bm25(h), ["qid"], "score", "chunk_id", 1).join(lexical.self_scores(h), "qid").select("qid", "chunk_id", F.round(F.col("score") / F.col("best"), 6).alias("share"))


_RANKED = ", ra as (select *, row_number() over (partition by qid order by score desc, chunk_id) r from bm), rb as (select *, row_number() over (partition by qid order by score desc, chunk_id) r from ov)"


@query(_L + _RANKED + ", wo as (select qid, count(*) + 1 w from (select qid, chunk_id from bm union select qid, chunk_id from ov) group by 1), fu as (select qid, chunk_id, 1 / (60 + coalesce(ra.r, w)) + 1 / (60 + coalesce(rb.r, w)) s from ra full join rb using (qid, chunk_id) join wo using (qid)) select qid, chunk_id, round(s, 6) score, row_number() over (partition by qid order by s desc, chunk_id) rank from fu qualify rank <= 10")
def win02_reciprocal_fusion(spark: SparkSession, d: str):
    """Reciprocal-rank fusion of the complete lists by BM25 and by overlap, the best ten of it."""
    h = _hits(spark, d)
    a = ranking.rank_all(lexical.bm25(h), ["qid"], "score", "chunk_id")
    b = ranking.rank_all(lexical.overlaps(h), ["qid"], "score", "chunk_id")
    fused = ranking.reciprocal_rank_fusion(a, b, ["qid"], "chunk_id")
    return ranking.top_k(fused, ["qid"], "score", "chunk_id", 10).withColumn("score", F.round("score", 6))


@query(_L + _RANKED + ", u as (select qid, chunk_id, 1 l, r, 1.0 / (60 + r) s from ra where r <= 16 union all select qid, chunk_id, 2, r, 0.5 / (60 + r) from rb where r <= 16), f as (select qid, chunk_id, round(sum(s), 5) score, min(l * 1000 + r) first from u group by all) select qid, chunk_id, score, row_number() over (partition by qid order by score desc, first) rank from f qualify rank <= 8")
def win03_weighted_fusion(spark: SparkSession, d: str):
    """Weighted reciprocal ranks of the first 16 of two lists: what a list lacks adds nothing, ties go to what was seen first."""
    top = _two_lists(spark, d, 16)
    lists = [top.filter(F.col("list") == n).drop("list") for n in ("bm25", "overlap")]
    return ranking.weighted_reciprocal_ranks(lists, [1.0, 0.5], ["qid"], "chunk_id", 8)


@query(_L + ", mx as (select *, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 0.5 end s from bm window w as (partition by qid)), my as (select *, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 0.5 end s from ov window w as (partition by qid)), fu as (select qid, chunk_id, 0.3 * coalesce(mx.s, 0) + 0.7 * coalesce(my.s, 0) s from mx full join my using (qid, chunk_id)) select qid, chunk_id, round(s, 6) score, row_number() over (partition by qid order by round(s, 9) desc, chunk_id) rank from fu qualify rank <= 10")
def agg01_weighted_fusion(spark: SparkSession, d: str):
    """Weighted fusion of all scores by BM25 and by overlap, the best ten of it."""
    h = _hits(spark, d)
    fused = ranking.weighted_fusion(settle(lexical.bm25(h)), settle(lexical.overlaps(h)), ["qid"], "chunk_id", 0.3)
    return ranking.top_k(fused.withColumn("score", F.round("score", 9)), ["qid"], "score", "chunk_id", 10).withColumn("score", F.round("score", 6))


@query(_L + ", s as (select * from ov where score >= 0.1) select qid, chunk_id, score from (select *, max(score) over (partition by qid) best from s) where score >= 0.3 * best")
def flt12_relevance_gate(spark: SparkSession, d: str):
    """Rows of at least 0.1, and of those the ones of at least 0.3 of the question's best."""
    s = settle(lexical.overlaps(_hits(spark, d)).filter("score >= 0.1"))
    best = s.groupBy("qid").agg(F.max("score").alias("best"))
    return s.join(best, "qid").filter("score >= 0.3 * best").drop("best")


_GOLD = """, gk as (select qid, list_distinct(list_filter(expected_keywords, lambda k: k <> '')) ks from rag_questions),
go as (select qid, chunk_id from gk, c where text is not null and len(ks) > 0 and len(list_filter(ks, lambda k: contains(lower(text), lower(k)))) >= ceil(len(ks) / 2.0)), gn as (select qid, count(*) n from go group by 1)"""


@query(_L + _GOLD + ", hi as (select qid, count(*) h, min(rank) f, sum(1 / log2(rank + 1)) g from top join go using (qid, chunk_id) group by 1), id as (select n, sum(1 / log2(i + 1)) z from (select distinct n from gn), (select unnest(range(1, 11)) i) where i <= n group by 1) select qid, round(coalesce(h, 0) / 10, 4) p_at_k, round(coalesce(h, 0) / n, 4) r_at_k, round(coalesce(1 / f, 0), 4) mrr, round(coalesce(g, 0) / z, 4) ndcg from gn join id using (n) left join hi using (qid)")
def agg22_hit_and_mrr(spark: SparkSession, d: str):
    """Precision, recall, MRR and nDCG at 10 of the BM25 search against the keyword gold."""
    return ranking.ranking_metrics(mth07_bm25_top(spark, d), jn32_gold_chunks(spark, d), "qid", "chunk_id", 10)


@query(_L + _GOLD + ", fi as (select qid, min(rank) f from top join go using (qid, chunk_id) group by 1), em as (select distinct qid from ov where score >= 0.1), le as (select distinct qid from top join c using (chunk_id) where category in ('lifestyle', 'breakup')) select coalesce(style, '-') style, count(*) n, round(avg(case when answerable and qid in (select qid from gn) then (qid in (select qid from fi))::int end), 4) hit, round(avg(case when answerable and qid in (select qid from gn) then coalesce(1 / f, 0) end), 4) mrr, round(avg((qid not in (select qid from em))::int), 4) empty, round(avg((qid in (select qid from le))::int), 4) leak from rag_questions left join fi using (qid) group by 1")
def agg22_rates_by_style(spark: SparkSession, d: str):
    """Hit and MRR of answerable questions, and the shares of all that find nothing above the gate or see a restricted category, by style of question."""
    h = _hits(spark, d)
    top = settle(ranking.top_k(lexical.bm25(h), ["qid"], "score", "chunk_id", 10).select("qid", "chunk_id", "rank"))
    gold = settle(jn32_gold_chunks(spark, d).select("qid", "chunk_id"))
    first = top.join(gold, ["qid", "chunk_id"]).groupBy("qid").agg(F.min("rank").alias("f"))
    some = lexical.overlaps(h).filter("score >= 0.1").select("qid").distinct().withColumn("some", F.lit(1))
    leak = top.join(chunks(spark, d, "category").filter("category in ('lifestyle', 'breakup')"), "chunk_id").select("qid").distinct().withColumn("leak", F.lit(1))
    q = table(spark, d, "rag_questions").select("qid", "style", "answerable").join(first, "qid", "left").join(gold.select("qid").distinct().withColumn("gold", F.lit(1)), "qid", "left").join(some, "qid", "left").join(leak, "qid", "left")
    judged = F.col("answerable") & F.col("gold").isNotNull()
    rate = lambda c: F.round(F.avg(c), 4)
    return q.groupBy(F.coalesce("style", F.lit("-")).alias("style")).agg(
        F.count("*").alias("n"), rate(F.when(judged, F.col("f").isNotNull().cast("int"))).alias("hit"), rate(F.when(judged, F.coalesce(1 / F.col("f"), F.lit(0.0)))).alias("mrr"),
        rate(F.col("some").isNull().cast("int")).alias("empty"), rate(F.col("leak").isNotNull().cast("int")).alias("leak"),
    )


@query(_L + ", rk as (select bm.*, row_number() over (partition by qid order by score desc, chunk_id) rank, coalesce(source_id, '') source_id from bm join c using (chunk_id)), rs as (select *, row_number() over (partition by qid, source_id order by rank) n from rk) select qid, chunk_id, rank, row_number() over (partition by qid order by n > 2, rank) pos from rs qualify pos <= 8")
def win05_deferred_refill(spark: SparkSession, d: str):
    """Eight chunks per question: at most two of a source while others last, the rest refilled by rank."""
    ranked = ranking.rank_all(_bm25(spark, d), ["qid"], "score", "chunk_id")
    sources = chunks(spark, d).select("chunk_id", F.coalesce("source_id", F.lit("")).alias("source_id"))
    return ranking.cap_with_refill(settle(ranked.join(sources, "chunk_id")), ["qid"], "source_id", "rank", 2, 8).select("qid", "chunk_id", "rank", "pos")


@query(_L + ", tb as (select qid, chunk_id, row_number() over (partition by qid order by score desc, chunk_id) r from ov qualify r <= 10) select qid, chunk_id, 'bm25' only_in from top anti join tb using (qid, chunk_id) union all select qid, chunk_id, 'overlap' from tb anti join top using (qid, chunk_id)")
def set12_disagreement(spark: SparkSession, d: str):
    """What one of two searches has among its ten best and the other has not."""
    top = _two_lists(spark, d, 10)
    a, b = (top.filter(F.col("list") == n).select("qid", "chunk_id") for n in ("bm25", "overlap"))
    only = lambda x, y, n: x.exceptAll(y).withColumn("only_in", F.lit(n))
    return only(a, b, "bm25").unionByName(only(b, a, "overlap"))


@query("""with q as (select * from embeddings where vec_id % 100 = 0), s as (select q.vec_id query_id, e.vec_id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::double * p[2]::double)), 6) score from q join embeddings e on e.vec_id <> q.vec_id)
select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) rank from s qualify rank <= 10""")
def srt03_vector_search(spark: SparkSession, d: str):
    """Exact top ten by dot product of the stated query vectors (id divisible by 100) against all.

    Queries go out in blocks of at most QUERY_BLOCK vectors; each block meets
    every row in one pass, ten rows per query and task reach the shuffle.
    """
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.search(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 10)


@query("""with c as (select label, i, avg(x) m from (select label, unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings) group by all)
select label, round(sqrt(sum(m * m)), 6) norm from c group by 1""")
def mth02_centroids(spark: SparkSession, d: str):
    """The length of each label's mean vector."""
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = x.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("norm"))


