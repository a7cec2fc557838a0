"""A controlled vocabulary as a parameter table: lookups, integrity, tagging, normalisation, routing, query variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from heddle.functions import text as T
from heddle.operators import ranking
from heddle.plans.tables import CHUNKS, CLAIMS, EVENTS, USERS, chunks, claims, match_events, users
from heddle.session import table

QUERIES, SQL = {}, {}
# fixed values: a small vocabulary (id, label, aliases); a user's own takes its place
CONCEPTS = [
    ("idea:loneliness", "ความเหงา", ["ความเหงา", "ความโดดเดี่ยว", "loneliness"]),
    ("idea:hope", "ความหวัง", ["ความหวัง", "hope"]),
    ("idea:forgiveness", "การให้อภัย", ["การให้อภัย", "ให้อภัย", "forgiveness", "le pardon"]),
    ("idea:anxiety", "ความวิตกกังวล", ["ความวิตกกังวล", "วิตกกังวล", "anxiety"]),
    ("idea:honesty", "ความซื่อสัตย์", ["ความซื่อสัตย์", "honesty", "honest apology"]),
    ("idea:listening", "การรับฟัง", ["การรับฟัง", "รับฟัง", "active listening"]),
    ("idea:bond", "ความผูกพัน", ["ความผูกพัน", "ผูกพัน", "Bindungsangst", "long-term commitment"]),
    ("idea:respect", "ความเคารพ", ["ความเคารพพื้นที่ส่วนตัว", "mutual respect"]),
    ("idea:humour", "อารมณ์ขัน", ["อารมณ์ขัน", "shared humour"]),
    ("idea:patience", "ความอดทน", ["ความอดทน", "Geduld", "patience"]),
    ("idea:jealousy", "ความหึงหวง", ["ความหึงหวง", "jealousy", "la jalousie"]),
    ("idea:expectation", "ความคาดหวัง", ["ความคาดหวัง", "คาดหวัง", "unspoken expectation"]),
]
RULES = [("idea:hope", "idea:patience"), ("idea:jealousy", "idea:anxiety"), ("idea:honesty", "idea:trust")]  # the last names an id that is not there
EXTRA = [("idea:hope", "Hope again", ["hope", "optimism"]), ("theme:work", "งาน", ["งาน"])]  # planted faults for the check
NEAR = {"ความหวัง": ["คู่", "รัก"], "hope": ["couples", "friends"]}
FACULTIES = ["บัญชีชุมชน", "ดนตรีทดลอง", "วิศวกรรมศาสตร์", "วิทยาศาสตร์", "ศิลปกรรม"]
RELATION_CUES, HEALTH_CUES, RESTRICTED = ["เกี่ยวข้องกับ", "relate to", "เข้ากับ"], ["นอนหลับ", "สุขภาพ", "sleep", "health"], ["lifestyle", "breakup"]
PARTNERS = ["คนที่คุยกัน", "คู่รักต่างคณะ", "คนคุย", "คู่รัก", "แฟน", "เพื่อน"]
COLLOQUIAL = {"ทักแชท": ["เริ่มคุย", "เริ่มต้นความสัมพันธ์"], "เกี่ยวข้องกับ": ["สัมพันธ์กับ", "ผูกติดกับ"], "relate to": ["depend on"]}
CANON = ["แฟน", "อีกฝ่าย"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(_text(v) if isinstance(v, str) else "[" + ", ".join(map(_text, v)) + "]" for v in r) + ")" for r in rows)


def _dimension(spark: SparkSession, rows=CONCEPTS) -> DataFrame:
    return spark.createDataFrame(rows, "id string, label string, aliases array<string>")


def _aliases(spark: SparkSession, rows=CONCEPTS) -> DataFrame:
    """(alias, id, label): bounded by the parameter table."""
    return _dimension(spark, rows).select(F.explode("aliases").alias("alias"), "id", "label")


_TAX = f"cn(id, label, aliases) as (values {_rows(CONCEPTS)}), al as (select unnest(aliases) alias, id, label from cn)"
_BAD = f"cn(id, label, aliases) as (values {_rows(CONCEPTS + EXTRA)}), rl(a, b) as (values {_rows(RULES)})"


@query(f"with {_TAX} select split_part(id, ':', 1) grp, count(*) n, sum(len(aliases)) n_aliases from cn group by 1")
def src05_taxonomy(spark: SparkSession, d: str):
    t = _dimension(spark)
    return t.groupBy(F.split_part("id", F.lit(":"), F.lit(1)).alias("grp")).agg(F.count("*").alias("n"), F.sum(F.size("aliases")).alias("n_aliases"))


@query(f"with {_TAX} select alias, id, label from al")
def src06_taxonomy_aliases(spark: SparkSession, d: str):
    return _aliases(spark)


@query(f"with {_BAD} select 'repeated id' fault, id item from cn group by id having count(*) > 1 union all select 'prefix', id from cn where split_part(id, ':', 1) <> 'idea' union all select 'rule', x from (select unnest([a, b]) x from rl) where x not in (select id from cn) union all select 'shared alias', a from (select lower(unnest(aliases)) a, id, label from cn) group by a having count(distinct label) > 1")
def src07_taxonomy_faults(spark: SparkSession, d: str):
    """Repeated ids, foreign prefixes, rules with unknown ends, aliases of several concepts."""
    t = _dimension(spark, CONCEPTS + EXTRA)
    named = lambda df, fault: df.select(F.lit(fault).alias("fault"), F.col("item"))
    repeated = named(t.groupBy(F.col("id").alias("item")).agg(F.count("*").alias("n")).filter("n > 1"), "repeated id")
    prefix = named(t.filter(F.split_part("id", F.lit(":"), F.lit(1)) != "idea").withColumn("item", F.col("id")), "prefix")
    ends = spark.createDataFrame(RULES, "a string, b string").select(F.explode(F.array("a", "b")).alias("item"))
    rule = named(ends.join(t.select(F.col("id").alias("item")), "item", "left_anti"), "rule")
    shared = named(_aliases(spark, CONCEPTS + EXTRA).groupBy(F.lower("alias").alias("item")).agg(F.countDistinct("label").alias("n")).filter("n > 1"), "shared alias")
    return repeated.unionByName(prefix).unionByName(rule).unionByName(shared)


# --- tagging ---------------------------------------------------------------------------------------------------------

_SPLIT = "string_split({text}, {kw})"
# occurrences of a keyword by the pieces between them: what stands left and right of each is known
_AT = "(list_sum(list_transform(p[1:i], lambda z: length(z))) + (i - 1) * length(kw))::bigint"
_LEFT, _RIGHT = f"substr(t, 1, {_AT})", f"substr(t, {_AT} + length(kw) + 1)"
_WORD = r"(not regexp_matches(kw, '^[\x00-\x7f]+$') or (not regexp_matches(right(" + _LEFT + r", 1), '[A-Za-z0-9_]') and not regexp_matches(left(" + _RIGHT + r", 1), '[A-Za-z0-9_]')))"
_NOT = r"not regexp_matches(replace(right(" + _LEFT + r", 8), 'ไม่ว่า', '~~~~~'), 'ไม่\S{0,4}$')"
_SHORT = {c: [a for a in al if len(a) >= 4] for c, _, al in CONCEPTS}


@query(f"with {CHUNKS}, {_TAX}, kw as (select id, lower(alias) kw from al where length(alias) >= 4), x as (select chunk_id, id, kw, lower(text) t, string_split(lower(text), kw) p from c, kw where text is not null and contains(lower(text), kw)) select chunk_id, id concept, sum(len(list_filter(range(1, len(p)), lambda i: {_WORD} and {_NOT})))::bigint n from x group by all having n > 0")
def agg08_concept_tags(spark: SparkSession, d: str):
    """How often each concept's keywords stand in a chunk, not negated: one row holds all counts, nothing is shuffled for them."""
    patterns = {c: [T.keyword_pattern(a) for a in al] for c, al in _SHORT.items()}
    c = chunks(spark, d, "text").filter("text is not null")
    return c.select("chunk_id", F.explode(T.keyword_counts(F.col("text"), patterns)).alias("concept", "n"))


_NEAR_ROWS = ", ".join(f"({_text(k)}, [{', '.join(map(_text, v))}])" for k, v in NEAR.items())


@query(rf"with {CHUNKS}, nr(kw, near) as (values {_NEAR_ROWS}), x as (select chunk_id, kw, near, lower(text) t, string_split(lower(text), kw) p from c, nr where text is not null and contains(lower(text), kw)) select chunk_id, kw keyword, len(list_filter(range(1, len(p)), lambda i: {_WORD} and len(list_filter(near, lambda w: contains(right({_LEFT}, 60 + length(w)), w) or contains(left({_RIGHT}, 60 + length(w)), w))) > 0)) n from x where n > 0")
def str22_context_counts(spark: SparkSession, d: str):
    """Ambiguous keywords, counted where one of their companions stands within 60 characters."""
    patterns = {k: [T.keyword_pattern(k, negation=False, near=v)] for k, v in NEAR.items()}
    c = chunks(spark, d, "text").filter("text is not null")
    return c.select("chunk_id", F.explode(T.keyword_counts(F.lower("text"), patterns)).alias("keyword", "n")).withColumn("n", F.col("n").cast("long"))


@query(f"with {CHUNKS}, {_TAX}, x as (select source_id, chunk_id, id, count(*) n from c, al where contains(lower(text), lower(alias)) group by all) select source_id, id concept, count(*) n_chunks from x group by all")
def jn25_source_concepts(spark: SparkSession, d: str):
    """Source to chunk to concept: how many chunks of a source name it."""
    held = F.filter(F.array(*[F.when(T.any_of(F.lower("text"), [a.lower() for a in al]), F.lit(c)) for c, _, al in CONCEPTS]), lambda x: x.isNotNull())
    return chunks(spark, d, "text").select("source_id", F.explode(held).alias("concept")).groupBy("source_id", "concept").agg(F.count("*").alias("n_chunks"))


@query(f"with {CHUNKS}, {_TAX} select source_id, count(*) n, count(*) filter (exists (select 1 from al where contains(lower(text), lower(alias)))) n_eligible from c group by 1")
def flt17_claim_eligible(spark: SparkSession, d: str):
    """Chunks from which claims can be drawn: those that name any concept."""
    words = [a.lower() for _, _, al in CONCEPTS for a in al]
    hit = F.coalesce(T.any_of(F.lower("text"), words).cast("int"), F.lit(0))
    return chunks(spark, d, "text").groupBy("source_id").agg(F.count("*").alias("n"), F.sum(hit).alias("n_eligible"))


@query(f"with {_TAX} select distinct qid, id concept from rag_questions, al where length(alias) >= 3 and contains(lower(question), lower(alias))")
def str54_alias_concepts(spark: SparkSession, d: str):
    """Concepts that a question names by an alias: the vocabulary is matched within the row."""
    held = F.filter(F.array(*[F.when(T.any_of(F.lower("question"), [a.lower() for a in al if len(a) >= 3]), F.lit(c)) for c, _, al in CONCEPTS]), lambda x: x.isNotNull())
    return table(spark, d, "rag_questions").select("qid", F.explode(held).alias("concept"))


_KWIC = "instr(t, kw)"


@query(f"with {CHUNKS}, {_TAX}, kw as (select id, lower(alias) kw from al where length(alias) >= 4), x as (select chunk_id, id, kw, lower(text) t from c, kw where contains(lower(text), kw)), y as (select *, row_number() over (partition by chunk_id, id order by instr(t, kw), kw) r from x) select chunk_id, id concept, substr(t, greatest(1, {_KWIC} - 60)::bigint, ({_KWIC} - greatest(1, {_KWIC} - 60) + length(kw) + 60)::bigint) evidence from y where r = 1")
def sup12_evidence_in_context(spark: SparkSession, d: str):
    """The first place where a chunk names a concept, with 60 characters on either side."""
    t = F.col("t")
    hits = F.array(*[F.struct(F.lit(c).alias("concept"), F.array_min(F.filter(F.array(*[F.struct(F.instr(t, F.lit(a.lower())).alias("at"), F.lit(a.lower()).alias("kw")) for a in al]), lambda h: h["at"] > 0)).alias("h")) for c, al in _SHORT.items()])
    x = chunks(spark, d, "text").filter("text is not null").select("chunk_id", F.lower("text").alias("t")).select("chunk_id", "t", F.explode(F.filter(hits, lambda h: h["h"].isNotNull())).alias("x"))
    at = F.col("x.h.at")
    first = F.greatest(F.lit(1), at - 60)
    return x.select("chunk_id", "x.concept", F.substring(t, first, at - first + F.length("x.h.kw") + 60).alias("evidence"))


# --- normalisation ---------------------------------------------------------------------------------------------------


@query(f"""with {CLAIMS}, {_TAX}, t as (select distinct object_text term, replace(lower(object_text), ' ', '') k from l where trim(object_text) <> ''), a as (select replace(lower(alias), ' ', '') a, id from al),
ex as (select term, min(id) id from t join a on a.a = t.k group by 1), co as (select term, arg_min(id, (-length(a), a)) id, max(length(a)) n from t join a on contains(t.k, a.a) and length(a.a) >= 3 group by 1)
select t.term, coalesce(ex.id, co.id) id, case when ex.id is not null then 'exact' when co.id is not null then 'contains' else 'unmapped' end "method", case when ex.id is not null then 1.0 when co.id is not null then round(co.n / length(t.k), 2) else 0.0 end score from t left join ex using (term) left join co using (term)""")
def str20_normalised_terms(spark: SparkSession, d: str):
    """Terms of claims: an alias exactly, else the longest alias they contain, else unmapped. Distinct terms are looked up, each within its row."""
    plain = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
    t = claims(spark, d, "object_text").filter("trim(object_text) <> ''").select(F.col("object_text").alias("term")).distinct().withColumn("k", plain(F.col("term")))
    names = sorted(((a.lower().replace(" ", ""), c) for c, _, al in CONCEPTS for a in al), key=lambda x: (-len(x[0]), x[0]))
    exact = F.coalesce(*[F.when(F.col("k") == a, F.lit(c)) for a, c in names])
    held = F.coalesce(*[F.when(F.contains("k", F.lit(a)), F.struct(F.lit(c).alias("id"), F.lit(len(a)).alias("n"))) for a, c in names if len(a) >= 3])
    t = t.withColumn("e", exact).withColumn("h", held)
    method = F.when(F.col("e").isNotNull(), "exact").when(F.col("h").isNotNull(), "contains").otherwise("unmapped")
    score = F.when(F.col("e").isNotNull(), 1.0).when(F.col("h").isNotNull(), F.round(F.col("h.n") / F.length("k"), 2)).otherwise(0.0)
    return t.select("term", F.coalesce("e", "h.id").alias("id"), method.alias("method"), score.alias("score"))


@query(f"with {CLAIMS}, {_TAX}, t as (select object_text term from l where trim(object_text) <> '') select term, count(*) n from t where not exists (select 1 from al where length(alias) >= 3 and contains(replace(lower(term), ' ', ''), replace(lower(alias), ' ', ''))) group by 1")
def src32_unmapped_terms(spark: SparkSession, d: str):
    """The dead letters: terms without a concept, with how often they came."""
    words = [a.lower().replace(" ", "") for _, _, al in CONCEPTS for a in al]
    t = claims(spark, d, "object_text").filter("trim(object_text) <> ''").select(F.col("object_text").alias("term"))
    return t.filter(~T.any_of(F.replace(F.lower("term"), F.lit(" "), F.lit("")), words)).groupBy("term").agg(F.count("*").alias("n"))


_BIG = "list_distinct(list_transform(range(1, greatest(2, length({0}))), lambda i: substr(lower({0}), i::int, 2)))"


@query(f"with {USERS}, f(name) as (values {_rows([(x,) for x in FACULTIES])}), t as (select distinct demographic.faculty term from u where length(demographic.faculty) >= 2), g as (select term, replace(replace(term, ' ', ''), chr(9), '') k from t), s as (select term, name, round(len(list_intersect({_BIG.format('k')}, {_BIG.format('name')})) / len(list_distinct(list_concat({_BIG.format('k')}, {_BIG.format('name')}))), 4) sim from g, f) select term, arg_max(name, (sim, name)) name, max(sim) sim from s where sim >= 0.3 group by 1")
def str17_fuzzy_faculties(spark: SparkSession, d: str):
    """The most alike name of a list for each faculty as written, by letter pairs; names are a parameter."""
    t = users(spark, d, "demographic").select(F.col("demographic.faculty").alias("term")).filter("length(term) >= 2").distinct()
    best = F.array_max(F.array(*[F.struct(F.round(T.bigram_jaccard(F.col("term"), F.lit(x)), 4).alias("sim"), F.lit(x).alias("name")) for x in FACULTIES]))
    return t.select("term", best.alias("b")).filter("b.sim >= 0.3").select("term", "b.name", "b.sim")


_LONG = sorted(((a.lower(), c) for c, _, al in CONCEPTS for a in al), key=lambda x: (-len(x[0]), x[0]))


@query(f"with {EVENTS}, {_TAX} select event_id, arg_min(id, (-length(alias), lower(alias))) concept, arg_min(lower(alias), (-length(alias), lower(alias))) alias from e, al where contains(lower(raw_reason), lower(alias)) group by 1")
def str36_longest_alias(spark: SparkSession, d: str):
    """The concept of a reason by the longest alias in it."""
    hit = F.coalesce(*[F.when(F.contains(F.lower("raw_reason"), F.lit(a)), F.struct(F.lit(c).alias("concept"), F.lit(a).alias("alias"))) for a, c in _LONG])
    return match_events(spark, d, "raw_reason").select("event_id", hit.alias("h")).filter("h is not null").select("event_id", "h.concept", "h.alias")


# --- questions -------------------------------------------------------------------------------------------------------

_CUE = lambda xs: "(" + " or ".join(f"contains(question, {_text(x)})" for x in xs) + ")"
_ROUTE = f"{_TAX}, n as (select qid, count(distinct id) n from rag_questions, al where length(alias) >= 3 and contains(lower(question), lower(alias)) group by 1), ro as (select q.*, coalesce(n, 0) n, case when coalesce(n, 0) = 0 then 'dense' when {_CUE(RELATION_CUES)} or n >= 2 then 'graph' else 'hybrid' end route, {_CUE(HEALTH_CUES)} health from rag_questions q left join n using (qid))"


def _routed(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "rag_questions")
    n = sum(T.any_of(F.lower("question"), [a.lower() for a in al if len(a) >= 3]).cast("int") for _, _, al in CONCEPTS)
    q = q.withColumn("n", F.coalesce(n, F.lit(0)))
    route = F.when(F.col("n") == 0, "dense").when(T.any_of(F.col("question"), RELATION_CUES) | (F.col("n") >= 2), "graph").otherwise("hybrid")
    return q.withColumn("route", route).withColumn("health", T.any_of(F.col("question"), HEALTH_CUES))


@query(f"with {_ROUTE} select qid, n n_concepts, route from ro")
def flt10_routes(spark: SparkSession, d: str):
    """Where a question goes: without concepts to the vectors, about relations or several concepts to the graph, else to both."""
    return _routed(spark, d).select("qid", F.col("n").cast("long").alias("n_concepts"), "route")


@query(f"with {_ROUTE} select qid, health from ro where question is not null")
def flt11_health_cues(spark: SparkSession, d: str):
    return _routed(spark, d).filter("question is not null").select("qid", "health")


@query(f"with {_ROUTE}, {CHUNKS} select qid, count(*) n_left from ro, (select category, expected.k keyword, chunk_id from c, (select distinct unnest(expected_keywords) k from rag_questions) expected where contains(text, expected.k)) h where list_contains(expected_keywords, keyword) and (health or category is null or category not in ({', '.join(map(_text, RESTRICTED))})) group by 1")
def flt09_restricted_categories(spark: SparkSession, d: str):
    """Keyword hits of a question in chunks of categories that it may see: some are for questions with a cue only."""
    q = _routed(spark, d).select("qid", "health", F.explode(F.array_distinct("expected_keywords")).alias("keyword"))
    words = [r["keyword"] for r in q.select("keyword").distinct().orderBy("keyword").collect()]  # of the fixed question table
    held = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("text"), w)) if words else F.array().cast("array<string>")
    c = chunks(spark, d, "text", "category").filter("text is not null").select("category", F.explode(held).alias("keyword")).groupBy("keyword", "category").agg(F.count("*").alias("n"))
    met = c.join(q, "keyword").filter(F.col("health") | F.col("category").isNull() | ~F.col("category").isin(RESTRICTED))
    return met.groupBy("qid").agg(F.sum("n").alias("n_left"))


_PARTNER = "coalesce(" + ", ".join(f"case when contains(question, {_text(p)}) then {_text(p)} end" for p in sorted(PARTNERS, key=lambda p: (p == "เพื่อน", -len(p)))) + ")"
_SLANG = "coalesce(" + ", ".join(f"case when contains(question, {_text(k)}) then [{', '.join(f'replace(question, {_text(k)}, {_text(v)})' for v in vs)}] end" for k, vs in COLLOQUIAL.items()) + ", [])"


@query(f"with v as (select qid, question, {_PARTNER} term from rag_questions where question is not null) select qid, array_to_string(list_slice(list_reduce(list_concat([['']], list_transform(list_concat([question], case when term is not null then list_transform(list_filter([{', '.join(map(_text, CANON))}], lambda c: c <> term), lambda c: replace(question, term, c)) else [] end, {_SLANG}), lambda x: [x])), lambda a, x: case when list_contains(a, x[1]) then a else list_concat(a, x) end), 2, 6), ' | ') variants from v")
def str26_query_variants(spark: SparkSession, d: str):
    """The question, then with its word for the partner replaced, then with colloquial words replaced: distinct, in order, at most five."""
    q = F.col("question")
    term = T.first_of(q, sorted(PARTNERS, key=lambda p: (p == "เพื่อน", -len(p))))
    canon = F.when(term.isNotNull(), F.transform(F.filter(F.array(*[F.lit(c) for c in CANON]), lambda c: c != term), lambda c: F.replace(q, term, c))).otherwise(F.array().cast("array<string>"))
    slang = F.coalesce(*[F.when(F.contains(q, F.lit(k)), F.array(*[F.replace(q, F.lit(k), F.lit(v)) for v in vs])) for k, vs in COLLOQUIAL.items()], F.array().cast("array<string>"))
    return table(spark, d, "rag_questions").filter("question is not null").select("qid", F.array_join(F.slice(F.array_distinct(F.concat(F.array(q), canon, slang)), 1, 5), " | ").alias("variants"))


@query(f"with {CHUNKS} select distinct trim(regexp_replace(section_title, '\\s*\\([^()]*\\)\\s*$', '')) title from c where trim(section_title) <> ''")
def str56_topic_titles(spark: SparkSession, d: str):
    """Distinct section titles without a trailing parenthesis."""
    c = chunks(spark, d, "section_title").filter("trim(section_title) <> ''")
    return c.select(F.trim(F.regexp_replace("section_title", r"\s*\([^()]*\)\s*$", "")).alias("title")).distinct()


@query(f"with {CHUNKS}, x as (select chunk_id, chapter_title, section_title, pages, text from c where text is not null), y as (select chunk_id, len(list_filter(string_split(text, chr(10)), lambda s: length(s) < 90 and (trim(s) = section_title or regexp_matches(s, '^[฀-๿]+ \\([A-Za-z][A-Za-z ,\\-’''.]+\\)$')))) heads, len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '^บทที่\\s*[0-9]+$'))) chapters from x) select * from y where heads + chapters > 0")
def str66_headings(spark: SparkSession, d: str):
    """Lines that are chapter marks, the section's title, or headings with an English gloss."""
    lines = F.split("text", "\n")
    heads = F.size(F.filter(lines, lambda s: (F.length(s) < 90) & (F.coalesce(F.trim(s) == F.col("section_title"), F.lit(False)) | s.rlike(r"^[฀-๿]+ \([A-Za-z][A-Za-z ,\-’'.]+\)$"))))
    chapters = F.size(F.filter(lines, lambda s: s.rlike(r"^บทที่\s*[0-9]+$")))
    return chunks(spark, d, "text", "section_title").filter("text is not null").select("chunk_id", heads.alias("heads"), chapters.alias("chapters")).filter("heads + chapters > 0")


@query(f"with {USERS}, {_TAX} select ranking.a alias, ranking.id, ranking.pos from (select lower(alias) a, id, row_number() over (order by length(alias) desc, lower(alias)) pos from al) ranking")
def srt09_longest_first(spark: SparkSession, d: str):
    """The order in which aliases are tried: the longest first."""
    a = _aliases(spark).select(F.lower("alias").alias("alias"), "id")
    return a.withColumn("pos", F.row_number().over(W.orderBy(F.desc(F.length("alias")), "alias")))  # a parameter table


@query("""with q as (select * from embeddings where vec_id % 100 = 0), s as (select q.vec_id query_id, e.label, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::double * p[2]::double)), 6) score, e.vec_id from q join embeddings e on e.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id, label order by score desc, vec_id) k from s), m as (select query_id, label, round(avg(score), 6) score from r where k <= 2 group by all)
select query_id, label, score, row_number() over (partition by query_id order by score desc, label) rank from m qualify rank <= 3""")
def agg25_label_top_two(spark: SparkSession, d: str):
    """Labels of a query vector by the mean of their two nearest: a search per label, the two best reach the shuffle."""
    from heddle.operators import vectors

    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    near = vectors.search(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 2, within="label")
    m = near.groupBy("query_id", "label").agg(F.round(F.avg("score"), 6).alias("score"))
    return ranking.top_k(m, ["query_id"], "score", "label", 3)
