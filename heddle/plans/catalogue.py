"""Further queries of the operator inventory: fills, interleaving, priorities, set scores, paths, arrays, dates."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window as W, functions as F

from heddle.functions import numbers as N
from heddle.operators import graph, vectors
from heddle.operators.references import clean_key
from heddle.plans.knowledge import _L, mth07_bm25_top
from heddle.plans.tables import CHUNKS, CLAIMS, EVENTS, MESSAGES, USERS, WS, chunks, claims, match_events, messages, users
from heddle.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {CHUNKS} select chunk_id, last_value(chapter_title ignore nulls) over (partition by regexp_replace(chunk_id, '_c[0-9]+$', '') order by chunk_id rows unbounded preceding) chapter from c")
def win11_filled_chapters(spark: SparkSession, d: str):
    """The last chapter title at or before each chunk of its section, in order of ids."""
    c = chunks(spark, d, "chapter_title")
    w = W.partitionBy(F.regexp_replace("chunk_id", r"_c\d+$", "")).orderBy("chunk_id").rowsBetween(W.unboundedPreceding, 0)
    return c.select("chunk_id", F.last("chapter_title", ignorenulls=True).over(w).alias("chapter"))


@query(f"with {CHUNKS}, x as (select chunk_id, regexp_replace(chunk_id, '_c[0-9]+$', '') s, section_title t from c), y as (select *, case when t is distinct from lag(t) over (partition by s order by chunk_id) then 1 else 0 end m from x) select chunk_id, sum(m) over (partition by s order by chunk_id rows unbounded preceding) section_no from y")
def win12_running_sections(spark: SparkSession, d: str):
    c = chunks(spark, d, "section_title").withColumn("s", F.regexp_replace("chunk_id", r"_c\d+$", ""))
    w = W.partitionBy("s").orderBy("chunk_id")
    mark = (~F.col("section_title").eqNullSafe(F.lag("section_title").over(w))).cast("int")
    first = F.when(F.row_number().over(w) == 1, F.col("section_title").isNotNull().cast("int")).otherwise(mark)
    return c.withColumn("m", first).select("chunk_id", F.sum("m").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("section_no"))


@query(f"""with {CHUNKS}, a as (select source_id, chunk_id, row_number() over (partition by source_id order by length(text) desc nulls last, chunk_id) p, 1 v from c), b as (select source_id, chunk_id, row_number() over (partition by source_id order by len(concepts) desc nulls last, chunk_id) p, 2 v from c),
u as (select * from a where p <= 5 union all select * from b where p <= 5), f as (select source_id, chunk_id, p, v, row_number() over (partition by source_id, chunk_id order by p, v) r from u)
select source_id, chunk_id, row_number() over (partition by source_id order by p, v) pos from f where r = 1""")
def win06_interleaved(spark: SparkSession, d: str):
    """Two lists of a source, the longest and the most tagged chunks, interleaved; the first place of a chunk counts."""
    c = chunks(spark, d, "text", "concepts").select(F.coalesce("source_id", F.lit("\u0000")).alias("source_id"), "chunk_id", F.length("text").alias("a"), F.size("concepts").alias("n")).withColumn("b", F.when(F.col("n") >= 0, F.col("n")))

    def best(by: str, variant: int):
        w = W.partitionBy("source_id").orderBy(F.desc_nulls_last(by), "chunk_id")
        return c.withColumn("p", F.row_number().over(w)).filter("p <= 5").select("source_id", "chunk_id", "p", F.lit(variant).alias("v"))

    first = best("a", 1).unionByName(best("b", 2)).groupBy("source_id", "chunk_id").agg(F.min(F.struct("p", "v")).alias("f"))
    pos = F.row_number().over(W.partitionBy("source_id").orderBy("f.p", "f.v"))
    return first.select(F.nullif(F.col("source_id"), F.lit("\u0000")).alias("source_id"), "chunk_id", pos.alias("pos"))


@query(f"with r as (select lower(trim(user_id, {WS})) user_id, display_name, deleted_at, profile_completeness from users where trim(user_id, {WS}) <> '') select user_id, count(distinct (display_name, deleted_at, profile_completeness)) n_contents from r group by 1 having count(distinct (display_name, deleted_at, profile_completeness)) > 1")
def set06_conflicting_users(spark: SparkSession, d: str):
    """Users with several contents."""
    u = table(spark, d, "users").select(clean_key("user_id").alias("user_id"), "display_name", "deleted_at", "profile_completeness").filter("user_id is not null")
    return graph.conflicts(u, "user_id")


@query(f"with {CLAIMS} select claim_id, model, extractor_version from (select *, row_number() over (partition by chunk_id, quote order by (model = 'source-curation') desc nulls last, claim_id) p from l where chunk_id is not null and quote is not null) where p = 1")
def set05_curated_first(spark: SparkSession, d: str):
    """One claim per chunk and quote; curated ones win."""
    l = claims(spark, d, "quote", "model", "extractor_version").filter("chunk_id is not null and quote is not null")
    order = F.struct((1 - F.coalesce((F.col("model") == "source-curation").cast("int"), F.lit(0))).alias("k"), "claim_id")
    best = l.groupBy("chunk_id", F.sha2("quote", 256).alias("q")).agg(F.min_by(F.struct("claim_id", "model", "extractor_version"), order).alias("b"))
    return best.select("b.claim_id", "b.model", "b.extractor_version")


@query(f"with {CHUNKS}, s as (select chunk_id, coalesce(list_distinct(concepts), []) p, coalesce(map_keys(concept_counts), []) g from c) select sum(len(list_intersect(p, g))) tp, sum(len(p) - len(list_intersect(p, g))) fp, sum(len(g) - len(list_intersect(p, g))) fn, round(sum(len(list_intersect(p, g))) / nullif(sum(len(p)), 0), 4) prec, round(sum(len(list_intersect(p, g))) / nullif(sum(len(g)), 0), 4) rec from s")
def agg13_micro_scores(spark: SparkSession, d: str):
    """Micro precision and recall of tagged concepts against counted ones."""
    empty = F.array().cast("array<string>")
    s = chunks(spark, d, "concepts", "concept_counts").select(F.coalesce(F.array_distinct("concepts"), empty).alias("p"), F.coalesce(F.map_keys("concept_counts"), empty).alias("g"))
    n = s.select(F.size(F.array_intersect("p", "g")).alias("t"), F.size("p").alias("np"), F.size("g").alias("ng"))
    r = n.agg(F.sum("t").alias("tp"), F.sum(F.col("np") - F.col("t")).alias("fp"), F.sum(F.col("ng") - F.col("t")).alias("fn"))
    return r.select("tp", "fp", "fn", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 4).alias("prec"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 4).alias("rec"))


@query(f"with {CLAIMS}, {CHUNKS} select l.claim_id, c.chunk_id, c.source_id, l.subject_id, l.predicate from l join c using (chunk_id) where trim(l.subject_id) <> '' and list_contains(c.concepts, l.subject_id)")
def jn19_claim_evidence(spark: SparkSession, d: str):
    """Claim, chunk and source where the chunk carries the claim's subject."""
    l, c = claims(spark, d, "subject_id", "predicate").filter("trim(subject_id) <> ''"), chunks(spark, d, "concepts")
    return l.join(c, "chunk_id").filter(F.array_contains("concepts", F.col("subject_id"))).select("claim_id", "chunk_id", "source_id", "subject_id", "predicate")


@query(f"with {CLAIMS} select subject_id, count(*) n, count(distinct chunk_id) n_chunks, list_sort(list(distinct predicate)) predicates from l where trim(subject_id) <> '' group by 1")
def jn20_claims_by_subject(spark: SparkSession, d: str):
    l = claims(spark, d, "subject_id", "predicate").filter("trim(subject_id) <> ''")
    return l.groupBy("subject_id").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("n_chunks"), F.sort_array(F.collect_set("predicate")).alias("predicates"))


@query(f"with {EVENTS} select u user_id, count(*) n, count(*) filter (event_type = 'unmatch') n_unmatch, min(event_ts) first_ts, max(event_ts) last_ts from (select from_user u, * from e union all select about_user, * from e where about_user is distinct from from_user) where u is not null group by 1")
def jn22_events_of_users(spark: SparkSession, d: str):
    """Events that touch a user from either side: one scan, exploded, aggregated partially."""
    e = match_events(spark, d, "event_type", "event_ts").select("event_type", "event_ts", F.explode(F.array_distinct(F.array("from_user", "about_user"))).alias("user_id")).filter("user_id is not null")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "unmatch").cast("int")).alias("n_unmatch"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))


@query(_L + ", n0 as (select chunk_id, regexp_replace(chunk_id, '_c[0-9]+$', '') s, try_cast(regexp_extract(chunk_id, '_c([0-9]+)$', 1) as int) o from c), nb as (select a.chunk_id, b.chunk_id n from n0 a join n0 b on a.s = b.s and abs(a.o - b.o) = 1), se as (select * from top where rank <= 3) select qid, n chunk_id, max(score * 0.5) score from se join nb using (chunk_id) where not exists (select 1 from se x where x.qid = se.qid and x.chunk_id = n) group by all")
def jn15_seed_neighbours(spark: SparkSession, d: str):
    """Chunks next to the three best of each question, at half of their score, unless they are seeds."""
    top = mth07_bm25_top(spark, d).filter("rank <= 3").select("qid", "chunk_id", "score")
    n = graph.next_chunks(chunks(spark, d))
    both = n.unionByName(n.select(F.col("next_id").alias("chunk_id"), F.col("chunk_id").alias("next_id")))
    near = top.join(both, "chunk_id").groupBy("qid", F.col("next_id").alias("chunk_id")).agg(F.max(F.col("score") * 0.5).alias("score"))
    return near.join(top.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")


@query(f"with {CHUNKS}, x as (select chunk_id, list_transform(list_slice(list_sort(list_transform(map_entries(concept_counts), lambda e: {{'n': -e.value, 'k': e.key}})), 1, 3), lambda e: e.k) top from c) select * from x where len(top) > 0")
def arr02_top_concepts(spark: SparkSession, d: str):
    c = chunks(spark, d, "concept_counts").select("chunk_id", F.transform(F.slice(N.most_common(F.col("concept_counts")), 1, 3), lambda e: e["key"]).alias("top"))
    return c.filter("size(top) > 0")


@query(f"with {CHUNKS} select chunk_id, list_filter(concepts, lambda k: split_part(k, ':', 1) = 'trait') traits from c where len(list_filter(concepts, lambda k: split_part(k, ':', 1) = 'trait')) > 0")
def arr03_trait_concepts(spark: SparkSession, d: str):
    traits = F.filter("concepts", lambda k: N.prefix(k) == "trait")
    return chunks(spark, d, "concepts").select("chunk_id", traits.alias("traits")).filter("size(traits) > 0")


@query(f"with {MESSAGES} select case when s < 60 then 'now' when s < 3600 then 'minutes' when s < 86400 then 'hours' else 'days' end age, count(*) n from (select (select max(ts) from m) - ts s from m where ts is not null) group by 1")
def dat01_age_buckets(spark: SparkSession, d: str):
    """Messages by age against the newest: a one-row aggregate joined to all."""
    m = messages(spark, d).filter("ts is not null")
    s = F.col("top") - F.col("ts")
    age = F.when(s < 60, "now").when(s < 3600, "minutes").when(s < 86400, "hours").otherwise("days")
    return m.join(F.broadcast(m.agg(F.max("ts").alias("top"))), F.lit(True)).groupBy(age.alias("age")).agg(F.count("*").alias("n"))


@query(f"with {CHUNKS} select chunk_id from c order by sha256(chunk_id || '7'), chunk_id limit 40")
def srt10_audit_sample(spark: SparkSession, d: str):
    """A sample of 40 chunks that the seed alone decides."""
    return chunks(spark, d).select("chunk_id", F.sha2(F.concat("chunk_id", F.lit("7")), 256).alias("h")).orderBy("h", "chunk_id").limit(40).select("chunk_id")


@query("""with q as (select * from embeddings where vec_id % 100 = 0), s as (select q.vec_id query_id, e.vec_id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::double * p[2]::double)), 6) score from q join embeddings e on e.vec_id <> q.vec_id and e.label in (1, 3, 5))
select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) rank from s qualify rank <= 5""")
def flt06_filtered_search(spark: SparkSession, d: str):
    """Vector search over rows of some labels; the filter reaches the scan."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return vectors.search(e.filter("vec_id % 100 = 0"), e.filter(F.col("label").isin(1, 3, 5)), "vec_id", "embedding", 5)


@query(f"with {USERS} select user_id, round((case when demographic.gender is not null then 1 else 0 end + case when demographic.faculty is not null then 1 else 0 end + case when len(persona.hobbies) > 0 then 1 else 0 end + case when len(persona.traits) > 0 then 1 else 0 end + case when len(preferences.wants) > 0 then 1 else 0 end) / 5.0, 2) completeness from u")
def agg41_completeness(spark: SparkSession, d: str):
    u = users(spark, d, "demographic", "persona", "preferences")
    have = [F.col("demographic.gender").isNotNull(), F.col("demographic.faculty").isNotNull(), *[F.coalesce(F.size(c) > 0, F.lit(False)) for c in ("persona.hobbies", "persona.traits", "preferences.wants")]]
    return u.select("user_id", F.round(sum(h.cast("int") for h in have) / 5, 2).alias("completeness"))


@query(f"with {CLAIMS}, {CHUNKS} select c.source_id, count(distinct c.chunk_id) n_chunks, count(distinct l.chunk_id) n_covered, count(l.claim_id) n_claims from c left join l on l.chunk_id = c.chunk_id group by 1")
def agg30_claim_coverage(spark: SparkSession, d: str):
    """Claims are counted per chunk before the join, so a chunk with many claims stays one row."""
    per = claims(spark, d).filter("chunk_id is not null").groupBy("chunk_id").agg(F.count("*").alias("k"))
    c = chunks(spark, d).join(per, "chunk_id", "left")
    return c.groupBy("source_id").agg(F.count("*").alias("n_chunks"), F.count("k").alias("n_covered"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_claims"))
