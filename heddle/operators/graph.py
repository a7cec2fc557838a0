"""Property graph: nodes and edges built from tables, validation, traversals of at most two hops.

An edge's id is a hash of its ends, relation and discriminator, so that a
rebuild gives the same ids and an upsert is a distinct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from heddle.functions import text as T
from heddle.functions.numbers import prefix

NODE_LABELS = ("User", "Event", "Source", "Chunk", "Claim", "Concept")
# relation -> (label of the source, label of the target)
ONTOLOGY = {
    "LIKES": ("User", "Concept"),
    "HAS_TRAIT": ("User", "Concept"),
    "PREFERS": ("User", "Concept"),
    "AVOIDS": ("User", "Concept"),
    "REPORTED_AS": ("User", "Concept"),
    "FROM_USER": ("Event", "User"),
    "ABOUT_USER": ("Event", "User"),
    "IN_SOURCE": ("Chunk", "Source"),
    "NEXT_CHUNK": ("Chunk", "Chunk"),
    "ABOUT": ("Chunk", "Concept"),
    "SUPPORTED_BY": ("Claim", "Chunk"),
    "SUBJECT": ("Claim", "Concept"),
    "OBJECT": ("Claim", "Concept"),
    "MENTIONS": ("Claim", "Concept"),
}


def edge(df: DataFrame, source: Column, relation: str, target: Column, weight: Column | None = None, discriminator: Column | None = None) -> DataFrame:
    """Edges (id, source, type, target, weight); rows with a null end give none."""
    rows = df.select(source.alias("source"), F.lit(relation).alias("type"), target.alias("target"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"), (F.lit("") if discriminator is None else discriminator).alias("d"))
    rows = rows.filter("source is not null and target is not null")
    return rows.select(T.edge_id(F.col("source"), F.col("type"), F.col("target"), F.col("d")).alias("id"), "source", "type", "target", "weight")


def user_edges(users: DataFrame) -> DataFrame:
    u = F.col("user_id")

    def exploded(path: str) -> DataFrame:
        return users.select("user_id", F.explode(path).alias("x"))

    return reduce(
        DataFrame.unionByName,
        [
            edge(exploded("persona.hobbies"), u, "LIKES", F.col("x.id"), F.col("x.confidence")),
            edge(exploded("persona.traits"), u, "HAS_TRAIT", F.col("x.id"), F.col("x.confidence")),
            edge(exploded("preferences.wants"), u, "PREFERS", F.col("x.id"), F.col("x.weight")),
            edge(exploded("preferences.avoids"), u, "AVOIDS", F.col("x.id"), F.col("x.weight")),
            edge(exploded("reported_traits").filter("x.usable and x.report_count >= 3"), u, "REPORTED_AS", F.col("x.id"), F.col("x.report_count")),
        ],
    )


def event_edges(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return edge(events, e, "FROM_USER", F.col("from_user")).unionByName(edge(events, e, "ABOUT_USER", F.col("about_user")))


def chunk_ordinal(c: Column) -> Column:
    """The number after the last ``_c`` of a chunk id; null without one."""
    return F.regexp_extract(c, r"_c(\d+)$", 1).try_cast("int")


def next_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, next_id): consecutive ordinals within a section. An equi-join on (prefix, ordinal), no window over a source."""
    base = chunks.select("chunk_id", F.regexp_replace("chunk_id", r"_c\d+$", "").alias("section"), chunk_ordinal(F.col("chunk_id")).alias("n")).filter("n is not null")
    after = base.select(F.col("chunk_id").alias("next_id"), "section", (F.col("n") - 1).alias("n"))
    return base.join(after, ["section", "n"]).select("chunk_id", "next_id")


def chunk_edges(chunks: DataFrame) -> DataFrame:
    c = F.col("chunk_id")
    counted = chunks.select("chunk_id", F.explode("concept_counts").alias("concept", "n"))
    return reduce(
        DataFrame.unionByName,
        [
            edge(chunks, c, "IN_SOURCE", F.col("source_id")),
            edge(next_chunks(chunks), c, "NEXT_CHUNK", F.col("next_id")),
            edge(counted, c, "ABOUT", F.col("concept"), F.col("n")),
        ],
    )


def claim_edges(claims: DataFrame) -> DataFrame:
    k = F.col("claim_id")
    blank = lambda c: F.when(F.trim(c) != "", c)
    return reduce(
        DataFrame.unionByName,
        [
            edge(claims, k, "SUPPORTED_BY", F.col("chunk_id")),
            edge(claims, k, "SUBJECT", blank(F.col("subject_id"))),
            edge(claims, k, "OBJECT", blank(F.col("object_concept_id"))),
            edge(claims.select("claim_id", F.explode("concept_ids").alias("x")), k, "MENTIONS", F.col("x")),
        ],
    )


def nodes(users: DataFrame, events: DataFrame, chunks: DataFrame, claims: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, grp): one row each; concepts are the ends of concept edges, grouped by their prefix."""
    concept = [r for r, (_, t) in ONTOLOGY.items() if t == "Concept"]
    parts = [
        users.select(F.col("user_id").alias("id"), F.lit("User").alias("label")),
        events.select(F.col("event_id").alias("id"), F.lit("Event").alias("label")),
        chunks.select(F.col("chunk_id").alias("id"), F.lit("Chunk").alias("label")),
        chunks.select(F.col("source_id").alias("id"), F.lit("Source").alias("label")).filter("id is not null").distinct(),
        claims.select(F.col("claim_id").alias("id"), F.lit("Claim").alias("label")),
        edges.filter(F.col("type").isin(concept)).select(F.col("target").alias("id"), F.lit("Concept").alias("label")).distinct(),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("grp", F.when(F.col("label") == "Concept", prefix(F.col("id"))))


def violations(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, type, n): unknown relations, ends that are no node or of the wrong label, repeated ids, non-finite weights.

    Ends are checked by joins on (id, label): a left anti-join per end, on the
    expected label that the ontology gives the relation.
    """
    known = F.create_map(*[x for r, (s, t) in ONTOLOGY.items() for x in (F.lit(r), F.struct(F.lit(s).alias("s"), F.lit(t).alias("t")))])
    rows = edges.select("id", "source", "target", "type", "weight", known[F.col("type")].alias("o"))
    have = nodes_.select("id", "label")
    out = [
        rows.filter("o is null").select(F.lit("unknown relation").alias("rule"), "type"),
        rows.filter("o is not null").join(have, (F.col("source") == have["id"]) & (F.col("o.s") == have["label"]), "left_anti").select(F.lit("source missing").alias("rule"), "type"),
        rows.filter("o is not null").join(have, (F.col("target") == have["id"]) & (F.col("o.t") == have["label"]), "left_anti").select(F.lit("target missing").alias("rule"), "type"),
        rows.filter("weight is null or isnan(weight) or abs(weight) = double('inf')").select(F.lit("weight").alias("rule"), "type"),
        rows.groupBy("id").agg(F.count("*").alias("n"), F.first("type").alias("type")).filter("n > 1").select(F.lit("repeated id").alias("rule"), "type"),
    ]
    return reduce(DataFrame.unionByName, out).groupBy("rule", "type").agg(F.count("*").alias("n"))


def claim_chains(claims: DataFrame) -> DataFrame:
    """(first, second, via): affirmed claims whose object is the subject of another one.

    A hub concept may have very many claims on both sides, and all their pairs
    would be emitted; chains are therefore returned per concept and predicate
    pair with counts, from which no chain is lost.
    """
    a = claims.filter("polarity = 'affirmed' and trim(object_concept_id) <> ''").groupBy(F.col("object_concept_id").alias("via"), F.col("predicate").alias("first")).agg(F.count("*").alias("na"), F.countDistinct("subject_id").alias("n_subjects"))
    b = claims.filter("polarity = 'affirmed' and trim(subject_id) <> ''").groupBy(F.col("subject_id").alias("via"), F.col("predicate").alias("second")).agg(F.count("*").alias("nb"), F.countDistinct("object_concept_id").alias("n_objects"))
    return a.join(b, "via").select("via", "first", "second", (F.col("na") * F.col("nb")).alias("n_chains"), "n_subjects", "n_objects")


def merge(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def conflicts(df: DataFrame, key: str) -> DataFrame:
    """(key, n_contents): keys whose rows differ in anything."""
    rest = [F.col(c) for c in df.columns if c != key]
    return df.groupBy(key).agg(F.countDistinct(F.xxhash64(*rest)).alias("n_contents")).filter("n_contents > 1")
