"""Problem 1: threads of interleaved exchanges, and trees across time buckets, against brute force."""

import math
import random

from heddle.llm import conversations as C

FIELDS = "id long, user_id string, role string, text string, intent string, ts double"


def rows(spark, data):
    return C.threads(C.link_replies(C.messages(spark.createDataFrame(data, FIELDS)))).collect()


def test_interleaved_exchanges_come_apart(spark):
    t = 1.7e9
    data = [
        (1, "U1", "user", "how do I bake sourdough bread at home", None, t),
        (2, "U1", "user", "which train goes to the harbour station", None, t + 20),
        (3, "U1", "bot", "sourdough bread wants a hot oven at home", None, t + 60),
        (4, "U1", "bot", "the train to the harbour station leaves at noon", None, t + 70),
        (5, "U1", "user", "and the train back from the harbour", None, t + 100),
        (6, "U1", "user", "must sourdough bread rest", None, t + 130),
        (7, "U1", "bot", "sourdough bread must rest for a day", None, t + 160),
    ]
    got = {r.id: r.thread for r in rows(spark, data)}
    assert got == {1: 1, 3: 1, 6: 1, 7: 1, 2: 2, 4: 2, 5: 2} or (got[1] == got[3] == got[6] == got[7] and got[2] == got[4] == got[5] and got[1] == 1)


def test_the_choice_of_parents_decides(spark):
    t = 1.7e9
    data = [(k, "U1", "user" if k % 2 else "bot", ["salt", "moon", "wine", "iron"][k % 4], None, t + 500 * k) for k in range(1, 40)]
    got = {r.id: r.thread for r in rows(spark, data)}
    assert len(set(got.values())) > 1  # with the message before as parent it would be one thread


def test_trees_across_buckets_against_brute_force(spark):
    r = random.Random(3)
    ts = sorted(1.7e9 + r.uniform(0, 30 * 3600) for _ in range(900))
    data = [(i, "U1", r.choice(["user", "bot"]), " ".join(r.choices(["red", "fish", "blue", "wine", "moon", "salt"], k=3)), None, t) for i, t in enumerate(ts)]
    at, score = C._parents(ts, list(range(900)), [d[2] for d in data], [d[3] for d in data])
    want = []
    for i in range(900):
        want.append(want[at[i]] if at[i] is not None and score[i] >= C.MIN_SCORE else i)
    assert {x.id: x.thread for x in rows(spark, data)} == dict(enumerate(want))
    assert len({math.floor(t / C.BUCKET) for t in ts}) > 3


def test_usable_conversations_of_a_table(spark, tmp_path):
    t = 1.7e9
    data = [(1, "U1", "user", "hello there", None, t), (2, "U1", "bot", "hi", None, t + 9), (3, "U1", "user", "no answer", None, t + 9000), (4, None, "user", "x", None, t), (5, "U2", "user", None, None, None)]
    spark.createDataFrame(data, FIELDS).write.parquet(f"{tmp_path}/messages.parquet")
    assert [(r.user_id, r.conversation_id, r.thread_id, r.id, r.parent) for r in C.p1_conversations(spark, str(tmp_path)).orderBy("id").collect()] == [("U1", 1, 1, 1, None), ("U1", 1, 1, 2, 1)]
    spark.createDataFrame([], FIELDS).write.parquet(f"{tmp_path}/none/messages.parquet")
    assert C.p1_conversations(spark, f"{tmp_path}/none").count() == 0
