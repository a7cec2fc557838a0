"""Queries of the scalar text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from heddle.functions import text as T
from heddle.plans.tables import CHUNKS, CLAIMS, MESSAGES, chunks, claims, messages
from heddle.session import table

QUERIES, SQL = {}, {}
NOISE = r"\d+$|- ?\d+ ?-$|— ?\d+ ?—$"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {CHUNKS} select chunk_id, regexp_replace(text, '([ก-ฮ][่-๋]?)[ \\t]+า', '\\1ำ', 'g') <> text repaired, length(regexp_replace(text, '([ก-ฮ][่-๋]?)[ \\t]+า', '\\1ำ', 'g')) size from c where text is not null")
def str03_sara_am(spark: SparkSession, d: str):
    made = T.fix_sara_am(F.col("text"))
    return chunks(spark, d, "text").filter("text is not null").select("chunk_id", (made != F.col("text")).alias("repaired"), F.length(made).alias("size"))


@query(f"with {CHUNKS} select chunk_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\xA0]+', ' ', 'g'))), lambda x: x <> '' and not regexp_matches(x, '^(?:\\d+$|- ?\\d+ ?-$|— ?\\d+ ?—$)'))) n_lines from c where text is not null")
def str04_clean_lines(spark: SparkSession, d: str):
    return chunks(spark, d, "text").filter("text is not null").select("chunk_id", F.size(T.clean_lines(F.col("text"), NOISE)).alias("n_lines"))


@query(f"with {CHUNKS}, x as (select chunk_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\xA0]+', ' ', 'g'))), lambda x: x <> '' and not regexp_matches(x, '^(?:\\d+$|- ?\\d+ ?-$|— ?\\d+ ?—$)')) ls from c where text is not null) select chunk_id, coalesce(list_reduce(case when len(ls) > 0 then ls else [''] end, lambda a, x: a || case when regexp_matches(a, '[฀-๿]$') and regexp_matches(x, '^[฀-๿]') then '' else ' ' end || x), '') paragraph from x")
def str05_joined_paragraphs(spark: SparkSession, d: str):
    """All lines of a chunk as one paragraph."""
    return chunks(spark, d, "text").filter("text is not null").select("chunk_id", T.join_lines(T.clean_lines(F.col("text"), NOISE)).alias("paragraph"))


@query("select doc_id, length(regexp_replace(regexp_replace(regexp_replace(text, '\\(\\d{1,2}(?:\\s*[,\\-–]\\s*\\d{1,2})*\\)', '', 'g'), '[ \\t\\xA0]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) size, len(regexp_extract_all(text, '\\(\\d{1,2}(?:\\s*[,\\-–]\\s*\\d{1,2})*\\)')) n_removed from documents where text is not null")
def str06_without_citations(spark: SparkSession, d: str):
    n = F.regexp_count("text", F.lit(r"\(\d{1,2}(?:\s*[,\-–]\s*\d{1,2})*\)"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.length(T.strip_citations(F.col("text"))).alias("size"), n.alias("n_removed"))


@query(f"with {CHUNKS} select chunk_id, case when length(regexp_replace(text, '[^A-Za-zก-ฮ]', '', 'g')) > 0 then round(length(regexp_replace(text, '[^ก-ฮ]', '', 'g')) / length(regexp_replace(text, '[^A-Za-zก-ฮ]', '', 'g')), 2) else 0 end ratio from c where text is not null")
def str09_thai_ratio(spark: SparkSession, d: str):
    return chunks(spark, d, "text").filter("text is not null").select("chunk_id", T.thai_ratio(F.col("text")).alias("ratio"))


@query("select doc_id, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) n_words from documents where text is not null")
def str10_word_count(spark: SparkSession, d: str):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.word_count(F.col("text")).alias("n_words"))


_TRI = "list_distinct(list_transform(range(1, greatest(1, length({0}) - 1)), lambda i: substr({0}, i::int, 3)))"


@query(f"with {CHUNKS}, x as (select chunk_id, {_TRI.format('a')} q, {_TRI.format('b')} t from (select chunk_id, regexp_replace(title, '\\s+', '', 'g') a, regexp_replace(text, '\\s+', '', 'g') b from c where title is not null and text is not null)) select chunk_id, round(len(list_intersect(q, t)) / greatest(1, len(q)), 4) share from x")
def str13_title_overlap(spark: SparkSession, d: str):
    """Share of a title's character trigrams that the chunk's text has."""
    c = chunks(spark, d, "title", "text").filter("title is not null and text is not null")
    return c.select("chunk_id", F.round(T.overlap(T.grams(F.col("title")), T.grams(F.col("text"))), 4).alias("share"))


@query(f"with {CHUNKS} select chunk_id, case when length(text) <= 300 then text else substr(text, 1, 148) || ' … ' || right(text, 149) end short from c where text is not null")
def str42_elided(spark: SparkSession, d: str):
    return chunks(spark, d, "text").filter("text is not null").select("chunk_id", T.elide(F.col("text"), 300).alias("short"))


@query(f"with {MESSAGES} select id, regexp_replace(regexp_replace(regexp_replace(text, 'https?://\\S+|www\\.\\S+', '[url]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[email]', 'g'), '@[A-Za-z0-9_]{{3,}}', '[handle]', 'g') clean from m where text is not null")
def str41_redacted_messages(spark: SparkSession, d: str):
    return messages(spark, d, "text").filter("text is not null").select("id", T.redact_contacts(F.col("text")).alias("clean"))


@query("select doc_id, cast(floor(length(text) / 1.6) as int) + 1 n from documents where text is not null")
def str43_token_estimates(spark: SparkSession, d: str):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.token_estimate(F.col("text")).alias("n"))


@query(f"with {CLAIMS} select claim_id, sha256(coalesce(subject_id, '') || chr(31) || coalesce(predicate, '') || chr(31) || coalesce(object_text, '') || chr(31) || coalesce(quote, '')) digest from l")
def str45_claim_digests(spark: SparkSession, d: str):
    l = claims(spark, d, "subject_id", "predicate", "object_text", "quote")
    return l.select("claim_id", T.digest(F.col("subject_id"), F.col("predicate"), F.col("object_text"), F.col("quote")).alias("digest"))


@query()
def str39_character_error_rate(spark: SparkSession, d: str):
    """Edit distance in characters (the SQL engine at hand counts bytes), and its share of the answer."""
    q = table(spark, d, "rag_questions").filter("question is not null and gold_answer is not null")
    n = F.levenshtein("question", "gold_answer")
    return q.select("qid", n.alias("distance"), F.round(n / F.greatest(F.lit(1), F.length("gold_answer")), 4).alias("cer"))


_REFS = "list_transform(flatten(list_transform(regexp_extract_all(text, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda g: string_split(g, ','))), lambda x: trim(x)::int)"


@query(f"with x as (select doc_id, {_REFS} r from documents where text is not null), y as (select doc_id, list_reduce(list_concat([[]::int[]], list_transform(r, lambda v: [v])), lambda a, v: case when list_contains(a, v[1]) then a else list_concat(a, v) end) refs from x where len(r) > 0) select doc_id, array_to_string(refs, ',') refs, len(list_filter(refs, lambda v: v < 1 or v > 20)) n_invalid from y")
def str33_citation_numbers(spark: SparkSession, d: str):
    """Distinct citation numbers of each document in order of appearance, and how many name no reference of 1 to 20."""
    x = table(spark, d, "documents").filter("text is not null").select("doc_id", T.citations(F.col("text")).alias("r")).filter("size(r) > 0")
    return x.select("doc_id", F.array_join(F.transform("r", lambda v: v.cast("string")), ",").alias("refs"), F.size(F.filter("r", lambda v: (v < 1) | (v > 20))).alias("n_invalid"))


@query("with x as (select qid, gold_answer t, list_min(list_filter(list_transform(list_filter(regexp_split_to_array(question, '\\s+'), lambda w: length(w) >= 3), lambda w: instr(gold_answer, w)), lambda i: i > 0)) p from rag_questions where question is not null and gold_answer is not null) select qid, substr(t, greatest(1, coalesce(p, 1) - 60)::bigint, 120) excerpt from x")
def str16_question_excerpts(spark: SparkSession, d: str):
    """120 characters of the gold answer around the first word it shares with the question."""
    q = table(spark, d, "rag_questions").filter("question is not null and gold_answer is not null")
    return q.select("qid", T.excerpt(F.col("question"), F.col("gold_answer"), 120).alias("excerpt"))
