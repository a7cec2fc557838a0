"""Problem 3: whether a line is misread depends on the line and the corpus alone."""

import random

import numpy as np

from heddle.llm import scans


def table(lines):
    keys = [(k, n * times) for text, times in lines for k, n in zip(*scans._keys([text], words=False))]
    total = {}
    for k, n in keys:
        total[k] = total.get(k, 0) + n
    return scans.Counts(np.array(list(total), np.uint64), np.array(list(total.values()), np.int64))


def test_the_usual_count_is_that_of_the_line():
    line, misread = "the careful listeners wrote letters", "the careful listencrs wrote letters"
    rare = "每天写日记能帮助志愿者安心入睡也能让人明白自己" * 4
    counts = table([(line, 400), (misread, 20), (rare, 1)])  # 20 is rare beside 400, not beside 1
    alone = scans.misread_lines([misread], [{}], counts)
    assert alone == {(0, 1): [(18, 19, "e")]}
    crowd = scans.misread_lines([rare, misread, rare, rare], [{}] * 4, counts)
    assert crowd == {(1, 1): alone[0, 1]}


def test_neighbours_change_nothing():
    r = random.Random(5)
    make = lambda: "".join(r.choices("ceoalihnuกถนมบ่้ี ", k=r.randint(1, 30)))
    lines = [make() for _ in range(60)]
    counts = table([(x, r.choice([1, 30, 900])) for x in lines if len(x) >= scans.GRAM])
    for a, b in scans._SINGLE[:40]:
        lines += [x.replace(chr(b), chr(a), 1) for x in lines[:60] if chr(b) in x][:5]
    lines += [x.replace("่", "", 1) for x in lines[:60] if "่" in x]
    alone = {(t, 1): e for t, x in enumerate(lines) for e in scans.misread_lines([x], [{}], counts).values()}
    assert len(alone) > 10
    assert scans.misread_lines(lines, [{}] * len(lines), counts) == alone
    rev = scans.misread_lines(lines[::-1], [{}] * len(lines), counts)
    assert {(len(lines) - 1 - t, i): e for (t, i), e in rev.items()} == alone
