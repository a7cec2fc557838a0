"""Problem 9: leaks with text in between, exchanged words and near misses, against what was planted."""

import random

import pytest

from heddle.llm import leaks

R = random.Random(11)
WORDS = ["".join(R.choices("abcdefghijklmnopqrstuvwxyz", k=R.randint(2, 7))) for _ in range(3000)]


def say(n):
    return R.choices(WORDS, k=n)


ITEMS = [say(R.randint(80, 160)) for _ in range(60)]


def found(make):
    items = leaks.Items([str(i) for i in range(len(ITEMS))], [" ".join(w) for w in ITEMS])
    docs = [leaks.letters(" ".join(say(40) + make(w) + say(40))) for w in ITEMS]
    pairs = items.candidates(docs)
    assert len(pairs) < 5 * len(docs)
    return sum(d == i and items.held(docs[d], i) > leaks.MIN_SHARE for d, i in pairs) / len(docs)


@pytest.mark.parametrize("letters", [600, 1500, 10_000])
def test_text_in_between(letters):
    assert found(lambda w: w[: len(w) // 2] + say(letters // 4) + w[len(w) // 2 :]) >= 0.9


def test_one_word_in_nine_exchanged():
    assert found(lambda w: [("x" * 4 if k % 9 == 4 else x) for k, x in enumerate(w)]) >= 0.9


def test_two_thirds_with_exchanged_words_and_text_in_between():
    def make(w):
        w = [("y" * 5 if k % 12 == 4 else x) for k, x in enumerate(w[: 2 * len(w) // 3])]
        return w[: len(w) // 2] + say(900) + w[len(w) // 2 :]

    assert found(make) >= 0.9


def test_less_than_half_is_no_case():
    assert found(lambda w: w[: int(0.45 * len(w))]) == 0
    assert found(lambda w: w[:15] + say(30) + w[40:55]) == 0
    assert found(lambda w: w[len(w) // 2 :] and say(100)) == 0


def test_order_counts():
    def fifths(w):
        k = len(w) // 5
        return [x for j in (4, 3, 2, 1, 0) for x in w[j * k : (j + 1) * k] + say(20)]

    assert found(fifths) == 0


def test_short_items():
    items = leaks.Items(["run", "word", "none", "sixty"], ["the quick brown fox jumps over it", "Abcdef", "", " ".join(WORDS[:14])])
    docs = [leaks.letters(t) for t in ("so the quick brown fox jumps again", "x abcdef y", "", " ".join(["zz", *WORDS[3:14], "zz"]), "nothing at all")]
    assert [(d, i) for d, i in items.candidates(docs) if items.held(docs[d], i) > 0.5] == [(0, 0), (1, 1), (3, 3)]


def test_a_long_document_in_segments(monkeypatch):
    item = " ".join(say(100))
    doc = leaks.letters(" ".join(say(3000)) + item + " ".join(say(3000)))
    whole = leaks.Items(["a"], [item])
    want = whole.held(doc, 0)
    monkeypatch.setattr(leaks, "SEGMENT", 500)
    cut = leaks.Items(["a"], [item])
    assert cut.candidates([doc, doc[:90]]) == [(0, 0)] and cut.held(doc, 0) == want == 1.0


def test_the_chain_against_brute_force():
    import numpy as np

    def brute(doc, item):
        """Longest common subsequence over letters of common runs."""
        ok = np.zeros((len(doc), len(item)), bool)
        for a in range(len(doc) - leaks.RUN + 1):
            for b in range(len(item) - leaks.RUN + 1):
                if doc[a : a + leaks.RUN] == item[b : b + leaks.RUN]:
                    for k in range(leaks.RUN):
                        ok[a + k, b + k] = True
        best = np.zeros((len(doc) + 1, len(item) + 1), int)
        for a in range(len(doc)):
            for b in range(len(item)):
                best[a + 1, b + 1] = max(best[a, b + 1], best[a + 1, b], best[a, b] + ok[a, b])
        return best[-1, -1]

    r = random.Random(5)
    for _ in range(20):
        item = "".join(r.choices("abcdefghij", k=90))
        parts = [item[a : a + r.randint(12, 40)] for a in (r.randint(0, 70) for _ in range(4))]
        doc = "".join(p + "".join(r.choices("uvwxyz", k=30)) for p in parts)
        starts = [(a, b) for a in range(len(doc) - leaks.RUN + 1) for b in range(len(item) - leaks.RUN + 1) if doc[a : a + leaks.RUN] == item[b : b + leaks.RUN]]
        runs = leaks.passages(np.array(starts, np.int64).reshape(-1, 2), leaks.RUN)
        assert leaks.ordered_letters(runs, len(item)) == brute(doc, item)
