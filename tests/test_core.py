"""Core operators on small tables: nulls, ties, repeats, empty input, clashing names."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from heddle.functions import numbers as N
from heddle.functions import text as T
from heddle.operators import feedback, graph, lexical, ranking, vectors
from heddle.operators.references import clean_key, current_rows, orphans
from heddle.sources import files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_orphans_composite_keys_with_partial_nulls(spark):
    refs = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, None, 9), (4, None, None), (5, "z", 1), (5, "z", 1)], "id int, x string, y int")
    targets = spark.createDataFrame([("a", 1, 7), ("a", 1, 7), ("b", 2, 7), (None, 3, 7)], "x string, y int, id int")
    ids = lambda m: sorted(r.id for r in orphans(refs, targets, ["x", "y"], match=m).collect())
    assert ids("simple") == [5, 5]
    assert ids("partial") == [3, 5, 5]
    assert ids("full") == [2, 3, 5, 5]
    with pytest.raises(ValueError):
        orphans(refs, targets, ["x"], match="other")


def test_orphans_against_brute_force_in_time(spark):
    r = random.Random(3)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    refs = [(i, r.choice(["a", "b", "c", None]), day(r.randint(0, 30))) for i in range(200)]
    targets = [(r.choice("ab"), day(r.randint(0, 20)), day(r.randint(10, 40)) if r.random() < 0.7 else None) for _ in range(4)]
    got = orphans(spark.createDataFrame(refs, "id int, k string, t timestamp"), spark.createDataFrame(targets, "k string, lo timestamp, hi timestamp"), ["k"], at="t", valid_from="lo", valid_to="hi", salts=4)
    want = [i for i, k, t in refs if k is not None and not any(k == a and lo <= t and (hi is None or t < hi) for a, lo, hi in targets)]
    assert sorted(x.id for x in got.collect()) == want


def test_orphans_of_a_hot_key_and_of_empty_tables(spark):
    hot = spark.range(120_000).select(F.lit("h").alias("k"), "id").unionByName(spark.createDataFrame([("o", -1)], "k string, id long"))
    targets = spark.createDataFrame([("h",)], "k string")
    assert [r.id for r in orphans(hot, targets, ["k"]).collect()] == [-1]
    none = targets.limit(0)
    assert orphans(targets, none, ["k"]).count() == 1 and orphans(none, targets, ["k"]).count() == 0


def test_clean_key_and_current_rows(spark):
    df = spark.createDataFrame([(" U1\t", 1, "x"), ("u1", None, "y"), ("  ", 3, "z"), (None, 4, "w")], "k string, v int, s string")
    k = df.select(clean_key("k").alias("k"), "v", "s")
    assert sorted(map(str, (r.k for r in k.collect()))) == ["None", "None", "u1", "u1"]
    assert [r.s for r in current_rows(k.filter("k is not null"), "k", "v").collect()] == ["x"]


def test_text_functions(spark):
    df = spark.createDataFrame([("ค า", "see (1) and (2, 3–5) (1) or (1999)", "mail a.b@c.de or https://x.y @someone", "see [1] and [2, 3] [1]"), (None, None, None, None)], "a string, b string, c string, d string")
    r = df.select(T.fix_sara_am(F.col("a")).alias("a"), T.citations(F.col("d")).alias("n"), T.strip_citations(F.col("b")).alias("b"), T.redact_contacts(F.col("c")).alias("c"), T.grams(F.lit("ab cd")).alias("g"), T.elide(F.lit("x" * 50), 20).alias("e"), T.join_lines(F.array(F.lit("ไทย"), F.lit("ไทย"), F.lit("x"))).alias("j")).collect()
    assert r[0].a == "คำ" and r[0].n == [1, 2, 3] and r[0].b == "see and or (1999)" and r[0].c == "mail [email] or [url] [handle]"
    assert sorted(r[0].g) == ["abc", "bcd"] and len(r[0].e) == 20 and r[0].j == "ไทยไทย x"
    assert r[1].a is None and r[1].n is None and r[1].b is None and r[1].c is None


def test_numbers(spark):
    r = spark.range(1).select(N.harmonic(F.lit(0.5), F.lit(1.0)).alias("h"), N.harmonic(F.lit(-1.0), F.lit(0.0)).alias("z"), N.clamp(F.lit(3.0), -1, 1).alias("c"), N.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("o"), N.most_common(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(2), F.lit("c"), F.lit(5))).alias("m")).first()
    assert abs(r.h - 2 / 3) < 1e-12 and r.z == 0 and r.c == 1 and r.o == 0 and [x.key for x in r.m] == ["c", "a", "b"]
    x = spark.createDataFrame([(0.5,), (0.5,), (1.0,)], "s double").agg(N.noisy_or(F.col("s")).alias("w")).first()
    assert x.w == 1.0


def test_fusion_and_caps(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "q string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "q string, id string, rank int")
    got = {r.id: r.score for r in ranking.reciprocal_rank_fusion(a, b, ["q"], "id").collect()}
    assert got == {"x": 1 / 61 + 1 / 64, "y": 1 / 62 + 1 / 61, "z": 1 / 64 + 1 / 62}
    items = spark.createDataFrame([("q", f"i{k}", "s" if k < 4 else "t", k) for k in range(1, 7)], "q string, id string, src string, rank int")
    assert [r.id for r in ranking.cap_with_refill(items, ["q"], "src", "rank", 2, 5).orderBy("pos").collect()] == ["i1", "i2", "i4", "i5", "i3"]
    same = spark.createDataFrame([("q", 1.0), ("q", 1.0)], "q string, s double")
    assert [r.n for r in ranking.min_max(same, ["q"], "s", "n").collect()] == [0.5, 0.5]


def test_greedy_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([([("a", 5), ("b", 9), ("c", 3)],)], "x array<struct<id:string,cost:long>>")
    assert df.select(ranking.greedy_budget(F.col("x"), 8).alias("k")).first().k == ["a", "c"]


def test_metrics_and_auroc(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "q string, id string, rank int")
    gold = spark.createDataFrame([("q", "b"), ("q", "c"), ("r", "a")], "q string, id string")
    got = {r.q: (r.p_at_k, r.r_at_k, r.mrr) for r in ranking.ranking_metrics(ranked, gold, "q", "id", 5).collect()}
    assert got == {"q": (0.2, 0.5, 0.5), "r": (0.0, 0.0, 0.0)}
    r = random.Random(1)
    data = [(float(r.randint(0, 9)), r.randint(0, 1)) for _ in range(300)] + [(None, 1)]
    pos, neg = [s for s, y in data if y and s is not None], [s for s, y in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(ranking.auroc(spark.createDataFrame(data, "s double, y int"), "s", "y").first().auroc - want) < 1e-6


def test_bm25_against_brute_force(spark):
    import math
    from collections import Counter

    docs = {"a": "red fish blue fish", "b": "one fish", "c": "red red wine", "d": ""}
    words = {k: v.split() for k, v in docs.items()}
    h = lexical.hits(spark.createDataFrame([("q", "Red fish")], "q string, t string"), "q", "t", spark.createDataFrame(list(docs.items()), "id string, t string"), "id", "t")
    got = {(r.q, r.id): r.score for r in lexical.bm25(h).collect()}
    have = {k: w for k, w in words.items() if w}
    mean = sum(map(len, have.values())) / len(have)
    for k, w in have.items():
        s = 0.0
        for term in ("red", "fish"):
            df = sum(term in x for x in have.values())
            tf = Counter(w)[term]
            s += math.log(1 + (len(have) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
        assert abs(got[("q", k)] - s) < 1e-5


def test_vector_search_against_brute_force(spark):
    r = random.Random(5)
    data = [(i, [r.random() for _ in range(4)]) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(data, "id long, v array<float>")
    got = rows(vectors.search(df.filter("id % 10 = 0"), df, "id", "v", 3).select("query_id", "id", "rank"))
    vs = {i: [float(x) for x in v] for i, v in ((r.id, r.v) for r in df.collect()) if v}
    want = []
    for q in (i for i in vs if i % 10 == 0):
        best = sorted(((-round(sum(a * b for a, b in zip(vs[q], v)), 6), i) for i, v in vs.items() if i != q))[:3]
        want += [(q, i, n + 1) for n, (_, i) in enumerate(best)]
    assert got == sorted(want, key=str)


def test_feedback_defaults_and_ties(spark):
    e = spark.createDataFrame(
        [("e1", "a", "b", dt.datetime(2024, 1, 1), {"red_flags": [("rf:x", 0.0), ("rf:y", None)], "appearance": None, "hygiene": []}), ("e2", "a", "b", dt.datetime(2024, 1, 1), None)],
        "event_id string, from_user string, about_user string, event_ts timestamp, gold_extracted struct<red_flags:array<struct<id:string,severity:double>>,appearance:array<struct<id:string,severity:double>>,hygiene:array<struct<id:string,severity:double>>>",
    )
    assert rows(feedback.routed(e).select("id", "severity")) == [("rf:x", 0.6), ("rf:y", 0.6)]
    s = e.withColumn("event_type", F.lit("pass")).select("event_id", "event_type", "from_user", "about_user", "event_ts")
    assert feedback.latest_status(s).first().n_events == 2


def test_graph_helpers(spark):
    c = spark.createDataFrame([("s_c00",), ("s_c01",), ("s_c03",), ("t_c00",), ("x",)], "chunk_id string")
    assert rows(graph.next_chunks(c)) == [("s_c00", "s_c01")]
    assert rows(graph.conflicts(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "id int, v string"), "id")) == [(1, 2)]


def test_sources(spark, tmp_path):
    assert files.html_to_text("<nav>x</nav><p>a &amp; b<br>c</p><script>var s='</p>'</script>") == "a & b\nc"
    assert files.html_to_text(None) is None and files.html_to_text("") == ""
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert rows(files.read_jsonl(spark, str(tmp_path / "j"), "id int, v string")) == [(1, "a"), (2, "b")]
    folder = f"file://{tmp_path}/snap"
    files.write_snapshot(df, folder)
    files.write_snapshot(df.filter("id = 1"), folder)
    assert rows(files.read_snapshot(spark, folder)) == [(1, "a")]
    new = spark.createDataFrame([(2, "z"), (3, "c")], "id int, v string")
    assert rows(files.upsert(df.withColumn("t", F.lit(1)), new.withColumn("t", F.lit(1)), ["id"], "t").select("id", "v")) == [(1, "a"), (2, "z"), (3, "c")]
    good, dead = files.split_mapped(df, spark.createDataFrame([(1,)], "id int"), "id")
    assert good.count() == 1 and dead.count() == 1
    assert files.to_markdown(df.orderBy("id")).splitlines()[2] == "| 1 | a |"


def test_entry_names_match(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
