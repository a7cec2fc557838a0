"""Queries over answers, evidence and structured output: clauses, echoes, support, salvage, validation, scores."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from heddle.functions import text as T
from heddle.plans.knowledge import _L, _hits
from heddle.operators import lexical, ranking
from heddle.plans.tables import CHUNKS, CLAIMS, EVENTS, MESSAGES, chunks, claims, match_events, messages
from heddle.operators.references import clean_key
from heddle.plans.tables import WS
from heddle.session import settle, table

QUERIES, SQL = {}, {}
LEAST, SUPPORT = 40, 0.1
RED_FLAGS = ["rf:keeps_score", "rf:lies_small", "rf:snoops", "rf:shouts", "rf:vanishes"]  # fixed values: ids that an extraction may use


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def clauses(c: Column, least: int = LEAST) -> Column:
    """Stretches between blanks put together until they hold ``least`` characters; a short end joins the last. Bounded by one text."""
    pieces = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(s, x):
        cur = F.when(s["cur"] == "", x).otherwise(F.concat(s["cur"], F.lit(" "), x))
        full = F.length(cur) >= least
        return F.struct(F.when(full, F.concat(s["done"], F.array(cur))).otherwise(s["done"]).alias("done"), F.when(full, F.lit("")).otherwise(cur).alias("cur"))

    def end(s):
        n = F.size(s["done"])
        joined = F.concat(F.slice(s["done"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(s["done"], -1), F.lit(" "), s["cur"])))
        return F.when(s["cur"] == "", s["done"]).when(n > 0, joined).otherwise(F.array(s["cur"]))

    return F.aggregate(pieces, empty, step, end)


_FOLD = f"list_reduce(list_filter(regexp_split_to_array({{0}}, '\\s+'), lambda x: x <> ''), lambda s, x: case when length(case when s.cur = '' then x else s.cur || ' ' || x end) >= {LEAST} then {{{{'done': list_append(s.done, case when s.cur = '' then x else s.cur || ' ' || x end), 'cur': ''}}}} else {{{{'done': s.done, 'cur': case when s.cur = '' then x else s.cur || ' ' || x end}}}} end, {{{{'done': []::varchar[], 'cur': ''}}}})"
_CLAUSES = f"ca as (select qid, {_FOLD.format('gold_answer')} s from rag_questions where gold_answer is not null), cl as (select qid, case when s.cur = '' then s.done when len(s.done) > 0 then list_concat(s.done[1:len(s.done) - 1], [s.done[-1] || ' ' || s.cur]) else [s.cur] end cs from ca)"


@query(f"with {_CLAUSES} select qid, array_to_string(cs, ' | ') clauses, len(list_filter(cs, lambda c: length(c) >= 8)) n_verifiable from cl")
def str31_clauses(spark: SparkSession, d: str):
    """Answers in clauses of at least 40 characters, and how many are long enough to be checked."""
    q = table(spark, d, "rag_questions").filter("gold_answer is not null").select("qid", clauses(F.col("gold_answer")).alias("cs"))
    return q.select("qid", F.array_join("cs", " | ").alias("clauses"), F.size(F.filter("cs", lambda c: F.length(c) >= 8)).alias("n_verifiable"))


def echo(question: str, body: str) -> bool:
    """Hardly anything new over the question: fewer than five characters inserted or replaced, no digit among them."""
    new = "".join(body[a:b] for tag, _, _, a, b in SequenceMatcher(None, question, body).get_opcodes() if tag in ("insert", "replace"))
    return len(new.strip()) < 5 and not any(ch.isdigit() for ch in new)


@query()
def str30_echoes(spark: SparkSession, d: str):
    """Messages of the bot that only repeat what the user said right before; pairs meet by the next id of the user."""
    m = messages(spark, d, "role", "text").filter("user_id is not null and text is not null and ts is not null")
    q = m.filter(clean_key("role").isin("user", "human")).select("user_id", F.col("ts").alias("t0"), F.col("text").alias("question"))
    a = m.filter(clean_key("role").isin("bot", "assistant", "ai_bot")).select("id", "user_id", "ts", "text").withColumn("minute", F.floor(F.col("ts") / 60))
    near = q.withColumn("minute", F.explode(F.sequence(F.floor(F.col("t0") / 60), F.floor(F.col("t0") / 60) + 2)))
    pairs = a.join(near, ["user_id", "minute"]).filter("t0 <= ts").groupBy("id", "text").agg(F.max_by("question", "t0").alias("question"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "echo": [echo(q, t) for q, t in zip(b["question"], b["text"])]})

    return pairs.mapInPandas(run, "id long, echo boolean")


def support(clause: Column, passage: Column) -> Column:
    """Share of a clause's letter triples that a passage has: the lexical stand-in for a model's score."""
    return T.overlap(T.grams(clause), T.grams(passage))


_G3 = "list_distinct(list_transform(range(1, greatest(1, length({0}) - 1)), lambda i: substr({0}, i::int, 3)))"


@query(_L + f", {_CLAUSES}, p3 as (select qid, chunk_id, text from top join c using (chunk_id) where rank <= 3), x as (select qid, unnest(cs) clause, generate_subscripts(cs, 1) i from cl), s as (select x.qid, i, max(len(list_intersect({_G3.format('k')}, {_G3.format('t')})) / greatest(1, len({_G3.format('k')}))) s from (select *, regexp_replace(clause, '\\s+', '', 'g') k from x) x join (select qid, regexp_replace(text, '\\s+', '', 'g') t from p3) p on p.qid = x.qid group by all) select qid, count(*) n, sum((s >= 0.5)::int) n_kept, round(avg(s), 4) support from s group by 1")
def str32_supported_clauses(spark: SparkSession, d: str):
    """Clauses of an answer with the best support among the three passages found for the question, and how many would be kept."""
    top = ranking.top_k(lexical.bm25(_hits(spark, d)), ["qid"], "score", "chunk_id", 3).select("qid", "chunk_id")
    p = top.join(chunks(spark, d, "text"), "chunk_id").select("qid", "text")
    x = table(spark, d, "rag_questions").filter("gold_answer is not null").select("qid", F.posexplode(clauses(F.col("gold_answer"))).alias("i", "clause"))
    s = x.join(p, "qid").groupBy("qid", "i").agg(F.max(support(F.col("clause"), F.col("text"))).alias("s"))
    return s.groupBy("qid").agg(F.count("*").alias("n"), F.sum((F.col("s") >= 0.5).cast("int")).alias("n_kept"), F.round(F.avg("s"), 4).alias("support"))


@query(f"with {CLAIMS}, {CHUNKS}, x as (select claim_id, replace(replace(replace(lower(coalesce(quote, '')), ' ', ''), chr(10), ''), chr(9), '') q, replace(replace(replace(lower(text), ' ', ''), chr(10), ''), chr(9), '') t, list_filter(list_transform(regexp_split_to_array(coalesce(quote, ''), '\\s*[,，、/]\\s*'), lambda p: replace(replace(replace(lower(p), ' ', ''), chr(10), ''), chr(9), '')), lambda p: p <> '') ps from l join c using (chunk_id) where text is not null) select claim_id, contains(t, q) whole, len(ps) > 1 and len(list_filter(ps, lambda p: not contains(t, p))) = 0 parts from x")
def str34_evidence(spark: SparkSession, d: str):
    """Whether a claim's quote stands in its chunk, white space and case apart: as a whole, or in each of its parts."""
    plain = lambda c: F.translate(F.lower(c), " \n\t", "")
    q = F.coalesce("quote", F.lit(""))
    ps = F.filter(F.transform(F.split(q, r"\s*[,，、/]\s*"), plain), lambda p: p != "")
    x = claims(spark, d, "quote").join(chunks(spark, d, "text").filter("text is not null"), "chunk_id").select("claim_id", plain(q).alias("q"), plain(F.col("text")).alias("t"), ps.alias("ps"))
    return x.select("claim_id", F.contains("t", "q").alias("whole"), ((F.size("ps") > 1) & F.forall("ps", lambda p: F.contains(F.col("t"), p))).alias("parts"))


_CUT = "'```json {\"red_flags\": [' || array_to_string(list_transform(gold_extracted.red_flags, lambda x: '{\"id\": \"' || x.id || '\"}'), ', ')"


@query(f"with {EVENTS}, x as (select event_id, {_CUT} t from e where len(gold_extracted.red_flags) > 0), y as (select event_id, left(t, length(t) - 3) t from x) select event_id, array_to_string(regexp_extract_all(t, '\\{{[^{{}}]*?\"id\"\\s*:\\s*\"([^\"]+)\"[^{{}}]*\\}}', 1), ',') ids from y where len(regexp_extract_all(t, '\\{{[^{{}}]*?\"id\"\\s*:\\s*\"([^\"]+)\"[^{{}}]*\\}}', 1)) > 0")
def str35_salvaged_items(spark: SparkSession, d: str):
    """Items of JSON that broke off: those whose brackets close are kept."""
    ids = F.transform("gold_extracted.red_flags", lambda x: F.concat(F.lit('{"id": "'), x["id"], F.lit('"}')))
    e = match_events(spark, d, "gold_extracted").filter("size(gold_extracted.red_flags) > 0")
    t = e.select("event_id", F.concat(F.lit('```json {"red_flags": ['), F.array_join(ids, ", ")).alias("t")).withColumn("t", F.expr("left(t, length(t) - 3)"))
    found = F.regexp_extract_all("t", F.lit(r'\{[^{}]*?"id"\s*:\s*"([^"]+)"[^{}]*\}'), F.lit(1))
    return t.select("event_id", found.alias("f")).filter("size(f) > 0").select("event_id", F.array_join("f", ",").alias("ids"))


@query(f"with x as (select id, input_text, unnest(gold.red_flags) rf from unmatch_heldout) select rf, count(*) n, count(*) filter (rf in ({', '.join(repr(r) for r in RED_FLAGS)})) n_allowed, count(distinct id) n_items from x group by 1")
def flt25_validated_items(spark: SparkSession, d: str):
    """Extracted items against the ids that are allowed."""
    x = table(spark, d, "unmatch_heldout").select("id", F.explode("gold.red_flags").alias("rf"))
    return x.groupBy("rf").agg(F.count("*").alias("n"), F.sum(F.col("rf").isin(RED_FLAGS).cast("int")).alias("n_allowed"), F.countDistinct("id").alias("n_items"))


@query(_L + ", t1 as (select qid, text from top join c using (chunk_id) where rank = 1) select qid, round(len(list_filter(list_distinct(expected_keywords), lambda k: contains(lower(coalesce(text, '')), lower(k)))) / len(list_distinct(expected_keywords)), 4) score from rag_questions left join t1 using (qid) where len(expected_keywords) > 0")
def agg14_keyword_scores(spark: SparkSession, d: str):
    """Share of a question's keywords that the best passage holds."""
    top = ranking.top_k(lexical.bm25(_hits(spark, d)), ["qid"], "score", "chunk_id", 1).select("qid", "chunk_id")
    t = top.join(chunks(spark, d, "text"), "chunk_id").select("qid", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    q = table(spark, d, "rag_questions").filter("size(expected_keywords) > 0").select("qid", F.array_distinct("expected_keywords").alias("ks")).join(t, "qid", "left").fillna("", ["t"])
    return q.select("qid", F.round(F.size(F.filter("ks", lambda k: F.contains(F.col("t"), F.lower(k)))) / F.size("ks"), 4).alias("score"))


@query("select event_type, count(*) n, round(avg(value), 4) mean, round(min(value), 4) least, round(max(value), 4) most, row_number() over (order by avg(value) desc) pos from events group by 1")
def agg17_grouped_summary(spark: SparkSession, d: str):
    """Runs by kind, the best mean first."""
    from pyspark.sql import Window as W

    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.min("value").alias("a"), F.max("value").alias("z"))
    return g.select("event_type", "n", F.round("m", 4).alias("mean"), F.round("a", 4).alias("least"), F.round("z", 4).alias("most"), F.row_number().over(W.orderBy(F.desc("m"))).alias("pos"))  # a row a kind


@query(f"with {CLAIMS}, {CHUNKS}, j as (select model, polarity, contains(text, quote) and length(quote) > 0 ok, text is not null answered from l left join c using (chunk_id)) select model, count(*) n, round(avg(answered::int), 4) answered, round(avg(coalesce(ok, false)::int), 4) supported, round(avg((polarity = 'negated')::int), 4) negated from j group by 1")
def agg19_support_ratios(spark: SparkSession, d: str):
    """By model: claims with a passage, with a quote that stands in it, and negated ones."""
    j = claims(spark, d, "model", "polarity", "quote").join(chunks(spark, d, "text").select("chunk_id", "text"), "chunk_id", "left")
    ok = F.coalesce(F.contains("text", "quote") & (F.length("quote") > 0), F.lit(False))
    rate = lambda c: F.round(F.avg(c.cast("int")), 4)
    return j.groupBy("model").agg(F.count("*").alias("n"), rate(F.col("text").isNotNull()).alias("answered"), rate(ok).alias("supported"), rate(F.col("polarity") == "negated").alias("negated"))


@query(f"with {CHUNKS}, x as (select category, unnest(concepts) k, concept_counts m from c) select category, count(*) n, round(avg((map_contains(m, k))::int), 4) tag_precision from x where m is not null group by 1")
def agg35_tag_precision(spark: SparkSession, d: str):
    """Share of a category's tags that the counts confirm."""
    x = chunks(spark, d, "category", "concepts", "concept_counts").filter("concept_counts is not null").select("category", F.explode("concepts").alias("k"), "concept_counts")
    return x.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg(F.map_contains_key("concept_counts", F.col("k")).cast("int")), 4).alias("tag_precision"))


CUES = [("unmatch", ["เลิกคุย", "unmatch"]), ("advice", ["ควรทำ", "ยังไง", "should"]), ("profile_update", ["อายุ", "ชอบ"])]
_INTENT = "case " + " ".join(f"when {' or '.join(f'contains(text, {chr(39)}{w}{chr(39)})' for w in ws)} then '{k}'" for k, ws in CUES) + " else 'small_talk' end"


@query(f"with {MESSAGES}, x as (select intent, {_INTENT} guess from m where intent is not null and text is not null and lower(trim(role, {WS})) in ('user', 'human')), y as (select intent, guess, count(*) n from x group by all) select intent, guess, n, round(n / sum(n) over (partition by intent), 4) share from y")
def agg42_intent_confusion(spark: SparkSession, d: str):
    """Intents against those that a rule of cues gives: counts, and shares of the intent."""
    guess = F.coalesce(*[F.when(T.any_of(F.col("text"), ws), F.lit(k)) for k, ws in CUES], F.lit("small_talk"))
    m = messages(spark, d, "intent", "text", "role").filter(F.col("intent").isNotNull() & F.col("text").isNotNull() & clean_key("role").isin("user", "human"))
    n = m.groupBy("intent", guess.alias("guess")).agg(F.count("*").alias("n"))
    return n.join(n.groupBy("intent").agg(F.sum("n").alias("t")), "intent").select("intent", "guess", "n", F.round(F.col("n") / F.col("t"), 4).alias("share"))


@query(f"with {MESSAGES} select id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[*_`#>]+', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '([A-Za-z0-9-]+)\\.(com|org|net)', '\\1 \\2', 'g'), '^ +| +$', '', 'g') plain from m where text is not null")
def str44_plain_text(spark: SparkSession, d: str):
    """Without marks of Markdown, links as their text, domains taken apart."""
    c = F.regexp_replace("text", "[*_`#>]+", "")
    c = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return messages(spark, d, "text").filter("text is not null").select("id", F.trim(F.regexp_replace(c, r"([A-Za-z0-9-]+)\.(com|org|net)", "$1 $2")).alias("plain"))


@query(_L + ", a as (select qid, chunk_id, score from top where rank <= 5), b as (select qid, chunk_id, score from ov where score >= 0.2), u as (select * from a union all select * from b), f as (select qid, chunk_id, max(score) score from u group by all) select qid, count(*) n, sum(round(score * 1000000)::bigint)::bigint total from f group by 1")
def set04_context_dedupe(spark: SparkSession, d: str):
    """Contexts of two searches, each passage once with its larger score."""
    s = settle(lexical.scores(_hits(spark, d)))
    a = ranking.top_k(s, ["qid"], "score", "chunk_id", 5).select("qid", "chunk_id", "score")
    u = a.unionByName(s.filter("overlap >= 0.2").select("qid", "chunk_id", F.col("overlap").alias("score"))).groupBy("qid", "chunk_id").agg(F.max("score").alias("score"))
    return u.groupBy("qid").agg(F.count("*").alias("n"), F.sum(F.round(F.col("score") * 1000000).cast("long")).alias("total"))


@query(f"with {CLAIMS} select claim_id, case when polarity = 'hedged' then 'affirmed' else polarity end polarity, predicate from l where predicate <> 'part_of'")
def set08_corrected_claims(spark: SparkSession, d: str):
    """Claims without the excluded ones, some corrected by a table of corrections."""
    l = claims(spark, d, "polarity", "predicate")
    excluded = l.filter("predicate = 'part_of'").select("claim_id")
    fixes = l.filter("polarity = 'hedged'").select("claim_id", F.lit("affirmed").alias("fix"))
    kept = l.join(excluded, "claim_id", "left_anti").filter("predicate is not null").join(fixes, "claim_id", "left")
    return kept.select("claim_id", F.coalesce("fix", "polarity").alias("polarity"), "predicate")


@query(f"with {CLAIMS} select claim_id, array_to_string(list_slice(list_reduce(list_concat([['']], list_transform(list_filter(list_concat(coalesce(concept_ids, []), [subject_id, object_concept_id]), lambda x: trim(x) <> ''), lambda x: [x])), lambda a, x: case when list_contains(a, x[1]) then a else list_concat(a, x) end), 2, 6), ',') ids from l")
def set03_ordered_distinct(spark: SparkSession, d: str):
    """A claim's concepts, each once in order of appearance, at most five."""
    ids = F.filter(F.concat(F.coalesce("concept_ids", F.array().cast("array<string>")), F.array("subject_id", "object_concept_id")), lambda x: F.trim(x) != "")
    return claims(spark, d, "concept_ids", "subject_id", "object_concept_id").select("claim_id", F.array_join(F.slice(F.array_distinct(ids), 1, 5), ",").alias("ids"))
