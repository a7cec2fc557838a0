"""Text operators against brute force, round trips and planted cases; nulls, empty and long texts, ties, repeats, empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heddle.llm import budget, conversations, encoding, leaks, packing, prose, quality, scans, sentences, splitting, tokens
from heddle.llm.languages import detect


# --- 1 ---------------------------------------------------------------------------------------------------------------

MESSAGES = "id long, user_id string, role string, text string, intent string, ts double"


def found(spark, data):
    m = conversations.messages(spark.createDataFrame(data, MESSAGES))
    return {(r.user, r.first_id, r.last_id): r.why for r in conversations.conversations(conversations.link_replies(m)).collect()}


def test_conversations_of_one_user(spark):
    t = 1_700_000_000.0
    data = [
        (1, "U1", "user", "hi", None, t),
        (2, " u1", "assistant", "hello", None, t + 5),
        (2, " u1", "assistant", "hello", None, t + 5),
        (3, "U1", "system", "note", None, t + 6),
        (4, "U1", "user", "bye", None, (t + 3000) * 1000),  # milliseconds; no reply
        (5, "U1", "0x1", "?", None, t + 9000),
        (6, "U1", "bot", "first", None, t + 20000),
        (7, "U1", "user", "x", None, t + 20001),
        (8, "U1", "bot", "y", None, t + 20001),
        (9, "U1", "user", "[photo]", None, t + 40000),
        (10, None, "user", "x", None, t),
        (11, "U2", "user", None, None, None),
    ]
    assert found(spark, data) == {("u1", 1, 3): None, ("u1", 4, 4): "no reply", ("u1", 5, 5): "role", ("u1", 6, 8): "start", ("u1", 9, 9): "empty"}
    assert found(spark, []) == {}


def test_conversations_against_brute_force_across_buckets(spark):
    r = random.Random(7)
    data = [(i, r.choice(["U1", "u1 ", "U2"]), r.choice(["user", "bot", "system"]), r.choice(["a b", "", "[x]"]), None, 1.7e9 + r.choice([r.uniform(0, 4e4), r.uniform(0, 4e5)])) for i in range(400)]
    got = found(spark, data)
    want = set()
    for u in ("u1", "u2"):
        mine = sorted((d[5], d[0]) for d in data if d[1].strip().lower() == u)
        start = 0
        for k in range(1, len(mine) + 1):
            if k == len(mine) or mine[k][0] - mine[k - 1][0] > 1800:
                want.add((u, mine[start][1], mine[k - 1][1]))
                start = k
    assert set(got) == want


def test_parents_are_the_best_of_all_candidates():
    r = random.Random(2)
    ts = sorted(r.uniform(0, 4000) for _ in range(80))
    ids, roles, texts = list(range(80)), [r.choice(["user", "bot"]) for _ in ts], [" ".join(r.choices(["red", "fish", "blue", "wine", "@user"], k=3)) for _ in ts]
    parent, score = conversations._parents(ts, ids, roles, texts)
    import math
    import re

    for i in range(80):
        best = -math.inf
        for j in range(i):
            if ts[i] - ts[j] <= conversations.GAP:
                a, b = conversations._grams(texts[i]), conversations._grams(texts[j])
                lap = len(a & b) / math.sqrt(len(a) * len(b)) if a & b else 0.0
                names = {w[1:] for w in re.findall(r"@\w+", texts[i])}
                best = max(best, conversations.link_score(ts[i] - ts[j], roles[i] != roles[j], bool(names & {roles[j], str(j)}), lap))
        assert (score[i] is None and best == -math.inf) or abs(score[i] - best) < 1e-12


# --- 2 ---------------------------------------------------------------------------------------------------------------


def brute_unigram(segment, vocabulary, unknown):
    best = [(0, 0)] + [(-(10**18), 0)] * len(segment)
    for i in range(len(segment)):
        for j in range(i + 1, len(segment) + 1):
            if segment[i:j] in vocabulary:
                best[j] = max(best[j], (best[i][0] + round(vocabulary[segment[i:j]] * tokens.SCALE), best[i][1] - 1))
        w = len(segment[i].encode())
        best[i + 1] = max(best[i + 1], (best[i][0] + unknown * w, best[i][1] - w))
    return -best[-1][1]


def test_unigram_counts_against_brute_force():
    r = random.Random(4)
    pieces = list({"".join(r.choices("abกข▁", k=r.randint(1, 4))) for _ in range(60)})
    scores = [-float(r.randint(1, 40)) for _ in pieces]
    counter = tokens.UnigramCounter(pieces, scores)
    texts = ["".join(r.choices("abกขx🙂 ", k=r.randint(0, 30))) for _ in range(200)] + ["", " ", "x" * 9000]
    got = counter(texts)
    v = dict(zip(pieces, scores))
    for t, n in zip(texts[:200], got):
        want = sum(brute_unigram(s, v, counter.unknown) for s in tokens.SEGMENT.findall("▁" + t.replace(" ", "▁"))) if t else 0
        assert n == want
    assert got[200] == 0
    long, tokens.LONG = tokens.LONG, 0  # score and count as two numbers
    try:
        assert counter(texts).tolist() == got.tolist()
    finally:
        tokens.LONG = long


def test_double_array_finds_exactly_its_words():
    import numpy as np

    words = [w.encode() for w in ("a", "ab", "abc", "b", "ก", "กา")]
    trie = tokens.DoubleArray(words)
    data = "abcกา".encode()
    s, e, w = trie.matches(np.frombuffer(data, np.uint8).astype(np.int32), np.array([0, 1, 3]), np.array([len(data)] * 3))
    assert sorted(zip(s.tolist(), e.tolist(), w.tolist())) == [(0, 1, 0), (0, 2, 1), (0, 3, 2), (1, 2, 3), (3, 6, 4), (3, 9, 5)]


def test_token_budget_of_null_and_clashing_columns(spark):
    df = spark.createDataFrame([("x", None, None), ("x", "hello world", "EN"), ("y", "", None)], "text_ string, text string, lang string").withColumnRenamed("text_", "__k")
    got = budget.count_tokens(df, keep=("__k",)).collect()
    assert sorted(r.n_tokens > 0 for r in got) == [False, False, True]


def test_language():
    assert detect("The cat and the dog were here", None) == "en" and detect("Der Hund und die Katze", "en") == "de"
    assert detect("それは本です", None) == "ja" and detect("这是书", None) == "zh" and detect("นี่คือ", "en") == "th" and detect("123", "fr") == "fr" and detect(None, None) is None


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_page_faults_and_repair(spark):
    body = "The careful listeners wrote letters about patience and friendship every morning"
    plain = [(f"p{i}", "src", "book", "Another title of a book", None, [i], f"{body}\n{body}\n{body} number {i}") for i in range(40)]
    page = "the author advises careful listeners\n12\nThe careful listeners wrote let-\nters about paticnce and friendship every\nmorning near the third-\nfloor library\n- 13 -"
    more = [("w", "s3", "book", None, None, None, "third-floor library\nthird-floor library\nthird-floor library")]
    data = [*plain, *more, ("c1", "s2", "book", "the author advises careful listeners to", None, [12, 13], page), ("c2", "s2", "book", None, None, None, None)]
    df = spark.createDataFrame(data, "chunk_id string, source_id string, doc_type string, title string, section_title string, pages array<int>, text string")
    got = {(r.line_no, r.fault) for r in scans.page_faults(df).filter("chunk_id = 'c1'").collect()}
    assert got == {(1, "furniture"), (2, "furniture"), (3, "cut"), (4, "misread"), (7, "furniture")}
    text = {r.chunk_id: r.repaired for r in scans.page_faults(df, repaired=True).collect()}
    assert text["c1"] == "The careful listeners wrote letters about patience and friendship every morning near the third-floor library"
    assert scans.page_faults(df.limit(0)).count() == 0


def test_page_numbers():
    assert [scans.page_number(t) for t in ("12", "l3", "๔๕", "xiv", "2O")] == [12, 13, 45, 14, 20]
    assert scans.fold("บทที่ 5 ความ") == scans.fold("บทที 7 ความ".replace("ม", "ม"))


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_pieces_against_the_walk_and_their_bounds():
    r = random.Random(1)
    for _ in range(60):
        texts = ["".join(r.choices("abcde  .\n!?。", k=r.randint(0, 3000))) if r.random() < 0.7 else "x" * r.randint(0, 4000) for _ in range(4)]
        limit, overlap = r.choice([(1500, 150), (60, 20), (40, 19), (30, 0)])
        for t, spans in zip(texts, splitting._pieces(texts, limit, overlap)):
            if len(t) <= limit:
                assert spans == [(0, len(t))]
                continue
            rank = splitting.boundary_classes(t)
            nxt, cuts = splitting.successors(rank, limit, overlap), [splitting.first_cut(rank, limit, overlap)]
            while cuts[-1] < len(t):
                cuts.append(int(nxt[cuts[-1]]))
            assert spans == list(zip([0] + [c - overlap for c in cuts[:-1]], cuts))
            assert all(b - a <= limit for a, b in spans) and all(x[1] - y[0] == overlap for x, y in zip(spans, spans[1:])) and spans[-1][1] == len(t)


def test_split_texts_of_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([("a", "p", None), ("b", "q", ""), ("c", "r", "w " * 2000)], "piece_ string, section_title string, text string").withColumnRenamed("piece_", "start_key")
    got = splitting.split_texts(df, "start_key", carry=("section_title",)).collect()
    assert Counter(r.start_key for r in got) == {"b": 1, "c": 3} and all(r.section_title == "r" for r in got if r.start_key == "c")
    with pytest.raises(ValueError):
        splitting.split_texts(df, "start_key", limit=10, overlap=9)


# --- 5 ---------------------------------------------------------------------------------------------------------------

CLEAN = ["ความรักเป็นสิ่งที่ดี และการรอคอยก็เช่นกัน", "Für die Prüfung übt sie täglich größere Stücke.", "L’été, les élèves âgés préfèrent le théâtre.", "JOÂO & É. : fine", "± ½ and 20 °C", "每天写日记能帮助志愿者安心入睡。", "毎日の散歩が早く謝る助けになる。", "When asked “Do you miss me?” it’s fine…", "", "ความกลัวถูกทิ้ง” ในยามดึก"]


@pytest.mark.parametrize("wrong,right", [("latin-1", "utf-8"), ("cp1252", "utf-8"), ("cp874", "utf-8"), ("mac_roman", "utf-8"), ("latin-1", "tis-620")])
def test_round_trips(wrong, right):
    done = 0
    for t in CLEAN[:3] + CLEAN[5:8]:
        try:
            raw = t.encode(right)
            bad = "".join(encoding._byte_chars(wrong).get(b, chr(b)) if b >= 128 else chr(b) for b in raw)
        except UnicodeEncodeError:
            continue
        if bad == t:
            continue
        assert encoding.garbled_spans(bad), (wrong, right, bad)
        done += encoding.restore(bad) == t
    assert done >= 1


def test_clean_texts_stay():
    for t in CLEAN + [None]:
        assert not encoding.garbled_spans(t), t
    assert encoding.garbled_spans("Vers�hnung")


def test_twins_teach_transformations(spark):
    clean = "The BondScan score of item 12345 rose, said „Größe“ and über"
    bad = clean.encode().decode("latin-1")
    df = spark.createDataFrame([("a", clean), ("b", bad), ("c", None), ("d", "")], "chunk_id string, text string")
    assert encoding.learn_transformations(encoding.mark_suspects(df))[0][0] == ("latin-1", "utf-8")
    got = encoding.restore_garbled(df).collect()
    assert [(r.chunk_id, r.restored, r.complete) for r in got] == [("b", clean, True)]
    assert encoding.restore_garbled(df.limit(0)).count() == 0


# --- 6 ---------------------------------------------------------------------------------------------------------------


def cut(text, model=None):
    out, a = [], 0
    for e in sentences.sentence_ends(text, model or sentences.ThaiModel()):
        out.append(text[a:e].strip())
        a = e
    return out


def test_signs_in_five_languages():
    assert cut("Prof. Vell (cf. p. 3) met Mr. Osk at 7 p.m. to talk, e.g. about 2.5 points. It ended... and on. Did it?! Yes.") == [
        "Prof. Vell (cf. p. 3) met Mr. Osk at 7 p.m. to talk, e.g. about 2.5 points.", "It ended... and on.", "Did it?!", "Yes."]
    assert cut("„Ich warte. Wirklich!“, sagte Fr. Vell am 12. Mai. Z. B. für ca. 5 Min. und mehr.") == ["„Ich warte. Wirklich!“, sagte Fr. Vell am 12. Mai.", "Z. B. für ca. 5 Min. und mehr."]
    assert cut("她说：“我需要。不想等！”然后走了。好吗？") == ["她说：“我需要。不想等！”然后走了。", "好吗？"]
    assert cut("彼女は「待てない。もう」と言った。はい！") == ["彼女は「待てない。もう」と言った。", "はい！"]
    assert cut("“Do you?” most asked. « Oui ! » dit-il.") == ["“Do you?” most asked.", "« Oui ! » dit-il."]
    assert cut("") == [] and cut("  ") == [] and sentences.sentence_ends(None, sentences.ThaiModel()) == []
    assert sentences.sentence_ends(" a b \n", sentences.ThaiModel()) == [4]


def test_thai_is_learned_from_quotes():
    r = random.Random(3)
    who, what, place = ["นักเรียน", "คนขี้อาย", "พี่รหัส", "เพื่อนบ้าน"], ["ความรัก", "ความหวัง", "การรอคอย", "ความเหงา"], ["ตลาดเช้า", "ห้องสมุด", "สวนดาดฟ้า"]
    make = [
        lambda: f"ดังนั้น{r.choice(who)}จึงพูดถึง{r.choice(what)}ที่{r.choice(place)}",
        lambda: f"หาก{r.choice(who)}ไม่มาที่{r.choice(place)} ก็ยากที่จะเข้าใจ{r.choice(what)}",
        lambda: f"คะแนน{r.choice(what)}ลดจาก {r.randint(1, 9)} เหลือ {r.randint(1, 9)} สำหรับ{r.choice(who)}เสมอ",
    ]
    quotes = [[r.choice(make)() for _ in range(r.randint(1, 3))] for _ in range(900)]
    model = sentences.fit_thai([" ".join(q) for q in quotes[:700]])
    right = sum(cut(" ".join(q), model) == q for q in quotes[700:])
    assert right >= 190
    assert sentences.fit_thai([]).odds == {}


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_plan_equals_one_by_one():
    r = random.Random(2)
    for _ in range(150):
        cap = r.choice([10, 50, 100])
        sizes = [r.randint(1, cap) for _ in range(r.randint(0, 100))]
        bins: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [(room, i) for i, room in enumerate(bins) if room >= s]
            if fits:
                bins[min(fits)[1]] -= s
            else:
                bins.append(cap - s)
        rooms, seen = {}, Counter()
        for s, p, n, first, per in packing.best_fit_plan(Counter(sizes), cap):
            assert p == seen[s]
            seen[s] += n
            for k in range(n):
                rooms[first + k // per] = rooms.get(first + k // per, cap) - s
        assert seen == Counter(sizes) and sorted(rooms.values()) == sorted(bins) and min(rooms.values(), default=0) >= 0


def test_packing_of_rows(spark):
    data = [(i, n) for i, n in enumerate([5, 5, 5, 25, 10, 0, None, 3, 10, 20])]
    got = packing.pack(spark.createDataFrame(data, "doc_id long, n long"), "doc_id", "n", capacity=10).collect()
    held, load = Counter(), Counter()
    for r in got:
        held[r.doc_id] += r.n_tokens
        if r.container is not None:
            load[r.container] += r.n_tokens
    assert {k: v for k, v in held.items()} == {i: n or 0 for i, n in data}
    assert max(load.values()) <= 10 and sorted(load) == list(range(len(load)))
    assert [r.container for r in got if r.doc_id in (5, 6)] == [None, None]
    assert packing.pack(spark.createDataFrame([], "doc_id long, n long"), "doc_id", "n").count() == 0


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_simhash_windows_against_brute_force():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 2**63, 120, dtype=np.uint64)
    got = leaks.simhashes(h, [(48, np.arange(len(h) - 47))])[0]
    for i in (0, 5, 72):
        want = sum(1 << b for b in range(64) if sum(int(x) >> b & 1 for x in h[i : i + 48]) * 2 > 48)
        assert int(got[i]) == want


def test_leaks_planted(spark):
    r = random.Random(9)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9))) for _ in range(4000)]
    say = lambda n: " ".join(r.choices(words, k=n))
    item = say(80)
    w = item.split()
    noisy = w[:]
    noisy[30] = "exchanged"
    docs = [
        (1, say(200) + " " + item.upper().replace(" ", " ​, ") + say(50)),
        (2, " ".join(noisy[:40]) + " " + say(30) + " " + " ".join(noisy[40:])),
        (3, " ".join(w[:20]) + say(300)),
        (4, say(900)),
        (5, None),
        (6, ""),
        (7, item),
        (7, item),
    ]
    items = spark.createDataFrame([("q", item), ("q2", None), ("q3", ""), ("same", item)], "item_id string, text string")
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert Counter((x.doc_id, x.item_id) for x in got.collect()) == Counter({(1, "q"): 1, (2, "q"): 1, (7, "q"): 2, (1, "same"): 1, (2, "same"): 1, (7, "same"): 2})
    assert leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items.limit(0)).count() == 0


# --- 10 --------------------------------------------------------------------------------------------------------------


def test_prose_and_junk():
    good = "However, the volunteers met at the old station in order to talk about the trip, and they left late. It was not easy."
    assert prose.prose_share(good) > 0.95
    assert prose.prose_share("\n".join(good[i : i + 40] for i in range(0, len(good), 40))) > 0.9
    assert prose.prose_share(good + "\n- milk\n- bread") > 0.8
    for junk in ("- milk\n- bread\n- tea\n- salt", "item;n;mean\nlove;3;2.4\nhope;5;1.2", '{"id": 1, "key": "a", "ok": true},\n' * 9, "click here\n" * 20, "aB3" * 60, "<li><a>x</a></li>" * 9, "", "  "):
        assert prose.prose_share(junk) < 0.3, junk


def test_tails_are_exact(spark):
    r = random.Random(6)
    data = [(i, r.choice(["a", "b"]), float(r.randint(0, 5)), float(r.random())) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, language string, s double, t double").withColumn("t", F.round("t", 2))
    got = {(x.language, x.statistic, x.value): (x.at_most, x.at_least) for x in quality.tail_table(df, ("s", "t")).collect()}
    rows = df.collect()
    for (lang, name, value), (lo, hi) in got.items():
        vs = [x[name] for x in rows if x.language == lang]
        assert abs(lo - sum(v <= value for v in vs) / len(vs)) < 1e-12 and abs(hi - sum(v >= value for v in vs) / len(vs)) < 1e-12


def test_statistics_of_nulls_and_scores(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "th"), (3, "a b c", "EN"), (4, "The cat is on the mat and it sleeps there all day.", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.outlier_scores(quality.document_statistics(df)).collect()}
    assert len(got) == 4 and got[1].no_prose_share == 1.0 and got[4].no_prose_share == 0.0
    assert quality.outlier_scores(quality.document_statistics(df.limit(0))).count() == 0
