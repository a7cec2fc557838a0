"""Packing and merging of sections against brute force; snapshots, corrections, keyword patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators import sections
from heddle.sources import files


def brute_pack(paragraphs, size, share, least):
    """The same rules, written down once more: units, greedy filling, tail of phrases, small end joined."""
    todo = []
    for p in paragraphs:
        todo += [(p, True)] if len(p.split()) <= size else [(x, k == 0) for k, x in enumerate(p.split(" "))]
    chunks, now = [], []
    for u in todo:
        if now and sum(len(x.split()) for x, _ in now) + len(u[0].split()) > size:
            chunks.append(now)
            phrases = " ".join(x for x, _ in now).split(" ")
            keep = 0
            while keep < len(phrases) and sum(len(x.split()) for x in phrases[len(phrases) - keep :]) < int(size * share):
                keep += 1
            now = [(" ".join(phrases[len(phrases) - keep :]), False)] if keep else []
        now.append(u)
    if now:
        if chunks and sum(len(x.split()) for x, _ in now) < least:
            chunks[-1] = chunks[-1] + [u for u in now if u not in chunks[-1]]
        else:
            chunks.append(now)
    return [re.sub(r"^\s+|\s+$", "", "".join(("\n" if b else " ") + x for x, b in c)[1:]) for c in chunks]


def test_packing_against_brute_force():
    r = random.Random(8)
    for _ in range(80):
        ps = [" ".join(f"w{r.randint(0, 99)}" for _ in range(r.randint(1, 40))) for _ in range(r.randint(0, 9))]
        assert sections.pack_units(ps, 20, 0.2, 6) == brute_pack(ps, 20, 0.2, 6)


def test_pack_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "a b\nc"), (3, "a b\nc")], "chunk long, text string")
    assert [(r.chunk, r.chunk_no) for r in sections.pack(df.withColumnRenamed("chunk", "id"), "id", "text").withColumnRenamed("id", "chunk").collect()] == [(3, 0), (3, 0)]
    assert sections.pack(df.limit(0), "chunk", "text").count() == 0


def test_small_sections_are_carried_within_a_chapter(spark):
    data = [("s", 1, 1, "a", "x x"), ("s", 2, 1, "b", "x x"), ("s", 3, 1, None, "x x x x"), ("s", 4, 2, "d", "x"), ("s", 5, 3, "e", "x x x x x"), ("t", 6, 3, "f", None)]
    df = spark.createDataFrame(data, "src string, n int, chapter int, title string, text string")
    got = {(r.src, r.first): (r.n_merged, r.title, r.n_words) for r in sections.merge_small(df, ["src"], "n", "chapter", "title", "text", 5).collect()}
    assert got == {("s", 1): (3, "a / b", 8), ("s", 4): (1, "d", 1), ("s", 5): (1, "e", 5), ("t", 6): (1, "f", 0)}


def test_snapshot_pointer_moves_in_one_step(spark, tmp_path):
    folder = f"file://{tmp_path}/snap"
    files.write_snapshot(spark.range(5), folder)
    files.write_snapshot(spark.range(7), folder)
    assert files.read_snapshot(spark, folder).count() == 7
    files.publish(spark, f"{folder}/ACTIVE", open(f"{tmp_path}/snap/ACTIVE").read())
    assert files.read_snapshot(spark, folder).count() == 7


def test_corrections_and_overlay(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "k int, t string")
    made, n = files.corrected(F.col("t"), [("a", "c"), ("c", "d"), ("z", "y")])
    assert [tuple(r) for r in df.select("k", made.alias("t"), n.alias("n")).collect()] == [(1, "d b", 2), (2, None, None)]
    v = spark.createDataFrame([(2, "seen")], "k int, t string")
    assert sorted(tuple(r) for r in files.overlay(df, v, ["k"], "t").select("k", "t", "source").collect()) == [(1, "a b", "read"), (2, "seen", "verified")]


@pytest.mark.parametrize("text,kw,options,n", [
    ("hope hopeful Hope", "hope", {}, 2),
    ("ไม่มั่นคง มั่นคง ไม่ว่ามั่นคง", "มั่นคง", {}, 2),
    ("bank of a river; a bank", "bank", {"near": ["river"]}, 2),
    ("bank" + " x" * 60 + " river", "bank", {"near": ["river"]}, 0),
    ("guilty feelings", "guilty", {"not_before": [" feelings"]}, 0),
])
def test_keyword_patterns(spark, text, kw, options, n):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.regexp_count("t", F.lit(T.keyword_pattern(kw, **options))).alias("n")).first().n == n
