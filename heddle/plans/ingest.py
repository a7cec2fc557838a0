"""Queries of sources, sinks and cleaning: round trips, overlays, corrections, indexes, snapshots, caches."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window as W, functions as F

from heddle.functions import text as T
from heddle.operators import sections
from heddle.operators.references import clean_key
from heddle.plans.tables import CHUNKS, USERS, WS, chunks, users
from heddle.session import scratch, settle, table
from heddle.sources import files

QUERIES, SQL = {}, {}
# fixed values: Thai glyphs that fonts move to the private use area, and what they stand for
PUA = {0xF701: "ิ", 0xF702: "ี", 0xF705: "่", 0xF706: "้", 0xF70A: "่", 0xF70B: "้", 0xF70E: "์", 0xF710: "ั", 0xF712: "็", 0xF713: "่", 0xF714: "้"}
RULES = [("WarmIndex", "Warm Index"), ("BondScan", "Bond Scan"), ("ToneCheck", "Tone Check"), ("NoSuchWord", "x")]
REDACT = [(r"(?:Dr|Prof|Mr|Mrs|Fr)\. [A-Z][a-z]+", "[name]"), (r"[0-9]{4}", "[year]")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query(f"with {USERS} select user_id, demographic.faculty faculty, profile_completeness from u")
def src04_jsonl_round_trip(spark: SparkSession, d: str):
    """Profiles written as JSON lines and read again under an explicit schema."""
    path = scratch(spark, "jsonl")
    files.write_jsonl(users(spark, d, "demographic", "profile_completeness").select("user_id", F.col("demographic.faculty").alias("faculty"), "profile_completeness"), path)
    return files.read_jsonl(spark, path, "user_id string, faculty string, profile_completeness double")


@query(f"with {CHUNKS} select source_id, round(avg(length(trim(text))), 2) mean_chars, avg(length(trim(text))) < 900 thin from c group by 1")
def src09_thin_sources(spark: SparkSession, d: str):
    """Sources whose pages hold so little text that they must be scans."""
    mean = F.avg(F.length(F.trim("text")))
    return chunks(spark, d, "text").groupBy("source_id").agg(F.round(mean, 2).alias("mean_chars"), (mean < 900).alias("thin"))


@query(f"with {CHUNKS}, p as (select coalesce(source_id, '-') g, chunk_id, coalesce(len(pages), 0) n from c), q as (select g, chunk_id, n, coalesce(sum(n) over (partition by g order by chunk_id rows between unbounded preceding and 1 preceding), 0) + 1 first_page from p) select g, chunk_id, n, first_page from q where first_page between 3 and 40")
def src13_page_offsets(spark: SparkSession, d: str):
    """First running page of each part of a source, restricted to a range of pages."""
    p = chunks(spark, d, "pages").select(F.coalesce("source_id", F.lit("-")).alias("g"), "chunk_id", F.coalesce(F.when(F.size("pages") >= 0, F.size("pages")), F.lit(0)).alias("n"))
    return files.running_pages(p, "g", "chunk_id", "n").filter("first_page between 3 and 40")


@query(f"with {CHUNKS} select case when doc_type = 'thesis' and section_title is not null then 'verified' else 'read' end source, count(*) n, sum(length(case when doc_type = 'thesis' and section_title is not null then section_title else text end)) n_chars from c group by 1")
def src15_verified_overlay(spark: SparkSession, d: str):
    """Verified texts (here the titles of sections of theses) in place of what was read."""
    c = chunks(spark, d, "doc_type", "section_title", "text")
    verified = c.filter("doc_type = 'thesis' and section_title is not null").select("chunk_id", F.col("section_title").alias("text"))
    return files.overlay(c.select("chunk_id", "text"), verified, ["chunk_id"], "text").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


_REPLACED = "text"
for _old, _new in RULES:
    _REPLACED = f"replace({_REPLACED}, {_text(_old)}, {_text(_new)})"


@query(f"with {CHUNKS} select chunk_id, length({_REPLACED}) size, {' + '.join(f'contains(text, {_text(o)})::int' for o, _ in RULES)} n_applied from c where text is not null")
def src16_corrections(spark: SparkSession, d: str):
    """Find and replace in order, with the number of rules that found something."""
    made, n = files.corrected(F.col("text"), RULES)
    return chunks(spark, d, "text").filter("text is not null").select("chunk_id", F.length(made).alias("size"), n.alias("n_applied"))


@query(f"with {CHUNKS}, x as (select chunk_id, string_split(text, chr(10)) ls from c where text is not null) select chunk_id, len(ls) n_lines, len(list_filter(ls, lambda s: regexp_matches(s, '^\\s*[-–—]?\\s*[0-9]+\\s*[-–—]?\\s*$') or trim(s) = '')) n_meta from x")
def src17_meta_lines(spark: SparkSession, d: str):
    """Lines that say something about the page and not on it."""
    lines = F.split("text", "\n")
    meta = F.filter(lines, lambda s: s.rlike(r"^\s*[-–—]?\s*[0-9]+\s*[-–—]?\s*$") | (F.trim(s) == ""))
    return chunks(spark, d, "text").filter("text is not null").select("chunk_id", F.size(lines).alias("n_lines"), F.size(meta).alias("n_meta"))


@query(f"with {USERS}, x as (select user_id, 'persona' kind, array_to_string(list_sort(list_transform(persona.traits, lambda t: t.id)), ' ') text from u where consent.matching union all select user_id, 'preference', array_to_string(list_sort(list_transform(preferences.wants, lambda t: t.id)), ' ') from u where consent.matching) select * from x where trim(text) <> ''")
def src19_collection(spark: SparkSession, d: str):
    """A document per user and kind for an index; users without consent and blank texts are left out."""
    u = users(spark, d, "persona", "preferences", "consent").filter("consent.matching")
    said = lambda c: F.array_join(F.sort_array(F.transform(c, lambda t: t["id"])), " ")
    x = u.select("user_id", F.explode(F.map_from_arrays(F.array(F.lit("persona"), F.lit("preference")), F.array(said("persona.traits"), said("preferences.wants")))).alias("kind", "text"))
    return x.filter("trim(text) <> ''")


@query("select label, count(*) n, true complete from embeddings group by 1")
def src20_vector_index(spark: SparkSession, d: str):
    """An index by label with a manifest of counts; loading it checks what is there against the manifest."""
    path = scratch(spark, "index")
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    e.write.partitionBy("label").parquet(f"{path}/rows")
    e.groupBy("label").agg(F.count("*").alias("n")).write.parquet(f"{path}/manifest")
    there = spark.read.parquet(f"{path}/rows").groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("m"))
    return spark.read.parquet(f"{path}/manifest").join(there, "label", "left").select("label", "n", F.coalesce(F.col("n") == F.col("m"), F.lit(False)).alias("complete"))


@query(f"with {CHUNKS} select doc_type, count(*) n from c group by 1")
def src25_snapshot(spark: SparkSession, d: str):
    """A snapshot written twice; the pointer names the later one, whose rows are counted."""
    folder = scratch(spark, "snapshot")
    c = chunks(spark, d, "doc_type")
    files.write_snapshot(c.limit(3), folder)
    files.write_snapshot(c, folder)
    return files.read_snapshot(spark, folder).groupBy("doc_type").agg(F.count("*").alias("n"))


@query(f"select user_id, updated_at, display_name from (select lower(trim(user_id, {WS})) user_id, updated_at, display_name, row_number() over (partition by lower(trim(user_id, {WS})) order by updated_at desc) r from users where trim(user_id, {WS}) <> '' and updated_at is not null) where r = 1")
def src30_upsert(spark: SparkSession, d: str):
    """Rows of one half of the users' states upserted with the other half: the latest of each key stays."""
    u = table(spark, d, "users").select(clean_key("user_id").alias("user_id"), "updated_at", "display_name").filter("user_id is not null and updated_at is not null")
    half = F.pmod(F.xxhash64("user_id", "updated_at"), F.lit(2)) == 0
    return files.upsert(u.filter(half), u.filter(~half), ["user_id"], "updated_at")


@query(f"with {CHUNKS} select chunk_id, sha256(text) digest, length(text) size from c where text is not null")
def src31_cached_results(spark: SparkSession, d: str):
    """Results by (key, digest): half come from a cache, one of whose digests is stale, the rest is worked out."""
    c = chunks(spark, d, "text").filter("text is not null").select("chunk_id", F.sha2("text", 256).alias("digest"), "text")
    work = lambda df: df.select("chunk_id", "digest", F.length("text").alias("size"))
    half = work(c.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == 0))
    stale = half.limit(1).select("chunk_id", F.lit("old").alias("digest"), F.lit(-1).alias("size"))
    return files.cached(c, settle(half.unionByName(stale)), "chunk_id", "digest", work)


@query(f"with {CHUNKS}, x as (select case when length(coalesce(text, '')) < 400 then 'short' when length(regexp_replace(text, '[^ก-ฮ]', '', 'g')) < 0.6 * length(regexp_replace(text, '[^A-Za-zก-ฮ]', '', 'g')) then 'other language' else 'ok' end status from c) select status, count(*) n from x group by 1")
def src35_quality_status(spark: SparkSession, d: str):
    thai, letters = (F.length(F.regexp_replace("text", p, "")) for p in (r"[^ก-ฮ]", r"[^A-Za-zก-ฮ]"))
    status = F.when(F.length(F.coalesce("text", F.lit(""))) < 400, "short").when(thai < 0.6 * letters, "other language").otherwise("ok")
    return chunks(spark, d, "text").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("select needs, count(*) n, sum(len(expected_keywords)) n_keywords from rag_questions where answerable and not coalesce(retired, false) group by 1")
def src36_benchmark_items(spark: SparkSession, d: str):
    """The items of an evaluation set that still hold."""
    q = table(spark, d, "rag_questions").filter("answerable and not coalesce(retired, false)")
    return q.groupBy("needs").agg(F.count("*").alias("n"), F.sum(F.size("expected_keywords")).alias("n_keywords"))


@query(f"with {CHUNKS} select chunk_id, text restored, length(text) - length(translate(text, 'ิี่้ั', '')) n from c where text is not null")
def str01_private_glyphs(spark: SparkSession, d: str):
    """Private-use glyphs, put into the texts for this, become their characters again and are counted."""
    moved = F.translate("text", "ิี่้ั", "")
    back = F.translate(F.col("m"), "".join(map(chr, PUA)), "".join(PUA.values()))
    n = F.length("m") - F.length(F.regexp_replace("m", "[-]", ""))
    return chunks(spark, d, "text").filter("text is not null").select("chunk_id", moved.alias("m")).select("chunk_id", back.alias("restored"), n.alias("n"))


@query(f"with {CHUNKS} select chunk_id, length(regexp_replace(text, '[Î·]([฀-๿])', '\\1', 'g')) size from c where text is not null")
def str02_stray_glyphs(spark: SparkSession, d: str):
    return chunks(spark, d, "text").filter("text is not null").select("chunk_id", F.length(T.drop_stray_glyphs(F.col("text"))).alias("size"))


@query(f"with {CHUNKS} select chunk_id, regexp_replace(regexp_replace(text, '{REDACT[0][0]}', '[name]', 'g'), '{REDACT[1][0]}', '[year]', 'g') redacted, len(regexp_extract_all(text, '{REDACT[0][0]}')) n_names from c where text is not null")
def str07_redacted(spark: SparkSession, d: str):
    return chunks(spark, d, "text").filter("text is not null").select("chunk_id", T.redact(F.col("text"), REDACT).alias("redacted"), F.regexp_count("text", F.lit(REDACT[0][0])).alias("n_names"))


@query(f"with {CHUNKS}, n as (select distinct source_id, unnest(regexp_extract_all(text, '(?:Dr|Prof|Mr|Mrs|Fr)\\. ([A-Z][a-z]+)', 1)) name from c), o as (select source_id, list(name order by length(name) desc, name) names from n group by 1) select source_id, array_to_string(names, ',') names from o")
def str08_discovered_names(spark: SparkSession, d: str):
    """Names that a source gives with a title, the longest first: the rules by which they are redacted in it elsewhere."""
    n = chunks(spark, d, "text").select("source_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:Dr|Prof|Mr|Mrs|Fr)\. ([A-Z][a-z]+)"), F.lit(1)))).alias("name")).distinct()
    order = F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("n"), "name")))
    return n.groupBy("source_id").agg(F.array_join(F.transform(order, lambda x: x["name"]), ",").alias("names"))


@query(f"with {CHUNKS}, f as (select source_id, arg_min(text, chunk_id) t from c where text is not null and source_id is not null group by 1) select source_id, left(t, 400) before, left(regexp_replace(t, '[ \\t\\xA0]+', ' ', 'g'), 400) after from f")
def sup13_before_and_after(spark: SparkSession, d: str):
    """A sample of cleaning: the head of each source's first chunk before and after."""
    c = chunks(spark, d, "text").filter("text is not null and source_id is not null").groupBy("source_id").agg(F.min_by("text", "chunk_id").alias("t"))
    return c.select("source_id", F.left("t", F.lit(400)).alias("before"), F.left(F.regexp_replace("t", r"[ \t ]+", " "), F.lit(400)).alias("after"))


@query(f"""with {CHUNKS}, x as (select chunk_id, length(text) n, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from c where text is not null),
y as (select *, sum(length(line) + 1) over (partition by chunk_id order by i) - length(line) - 1 p from x), z as (select chunk_id, min(i) cut from y where p >= 0.6 * n and regexp_matches(line, '[0-9]') group by 1) select chunk_id, cut from z""")
def win19_tail_cut(spark: SparkSession, d: str):
    """The first line beyond three fifths of a text that looks like an appendix (here: holds a digit): positions add up within the row."""
    lines = F.split("text", "\n")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("cut"))

    def step(s, x):
        i = s["i"] + 1
        hit = s["cut"].isNull() & (s["at"] >= 0.6 * F.length("text")) & x.rlike("[0-9]")
        return F.struct(i.alias("i"), (s["at"] + F.length(x) + 1).alias("at"), F.when(hit, i).otherwise(s["cut"]).alias("cut"))

    return chunks(spark, d, "text").filter("text is not null").select("chunk_id", F.aggregate(lines, start, step, lambda s: s["cut"]).alias("cut")).filter("cut is not null")


# --- sections and chunks: folds over the lines of one text, tested against brute force --------------------------------


@query()
def win13_merged_sections(spark: SparkSession, d: str):
    """Sections of a source, the small ones carried into the next of their chapter."""
    c = chunks(spark, d, "chapter", "section_title", "text").filter("text is not null and source_id is not null")
    return sections.merge_small(c, ["source_id"], "chunk_id", "chapter", "section_title", "text", 60)


@query()
def win14_packed_chunks(spark: SparkSession, d: str):
    """Documents packed into chunks of at most 300 words that share a tail of phrases."""
    return sections.pack(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query(f"with {CHUNKS}, x as (select chunk_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') ps from c where text is not null) select chunk_id, len(ps) n_paragraphs, list_sum(list_transform(ps, lambda p: len(list_filter(string_split(p, ' '), lambda w: w <> ''))))::bigint n_phrases from x where len(ps) > 0")
def str11_units(spark: SparkSession, d: str):
    """Paragraphs of a text and the phrases between blanks in them."""
    ps = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    n = F.aggregate(F.transform("ps", lambda p: F.size(F.filter(F.split(p, " "), lambda w: w != ""))), F.lit(0), lambda s, x: s + x)
    return chunks(spark, d, "text").filter("text is not null").select("chunk_id", ps.alias("ps")).filter("size(ps) > 0").select("chunk_id", F.size("ps").alias("n_paragraphs"), n.cast("long").alias("n_phrases"))


@query(f"with {CHUNKS}, x as (select source_id, chunk_id, (section_title is not null and regexp_matches(section_title, '^ความ'))::int m from c where source_id is not null) select chunk_id, sum(m) over (partition by source_id order by chunk_id) section_no from x")
def win12_marked_sections(spark: SparkSession, d: str):
    """Sections that begin at each chunk whose title matches a marker."""
    m = F.coalesce(F.col("section_title").rlike("^ความ"), F.lit(False)).cast("int")
    c = chunks(spark, d, "section_title").filter("source_id is not null").withColumn("m", m)
    return c.select("chunk_id", F.sum("m").over(W.partitionBy("source_id").orderBy("chunk_id").rowsBetween(W.unboundedPreceding, 0)).alias("section_no"))
