"""Problem 4: cuts keep letters with their marks, and abbreviations end no sentence."""

import unicodedata

from heddle.llm import splitting


def pieces(text, limit=1500, overlap=150):
    return [text[a:b] for a, b in splitting._pieces([text], limit, overlap)[0]]


def test_no_cut_between_a_letter_and_its_marks():
    text = "ที่นี่ไม่มีช่องว่างเลยน้ำใจเพื่อนเก่าเกื้อกูล".replace(" ", "") * 300
    got = pieces(text)
    assert len(got) > 5 and all(len(p) <= 1500 for p in got)
    for p in got[1:]:
        assert unicodedata.category(p[0]) not in ("Mn", "Mc") and p[0] != "ำ"
    for p in got[:-1]:
        assert p[-1] not in "เแโใไ"
    assert got[0] + "".join(p[150:] for p in got[1:]) == text


def test_joined_signs_stay_together():
    family = "\U0001f468\u200d\U0001f469\u200d\U0001f467"
    assert all(not p.startswith("\u200d") and not p.endswith("\u200d") for p in pieces(family * 900))


def test_abbreviations_are_no_sentence_ends():
    text = ("Prof. Vell met Dr. Osk near the old station and they talked about patience for a long time. " * 40).strip()
    for p in pieces(text)[:-1]:
        assert p.rstrip().endswith("time.")


def test_marks_alone_still_give_pieces():
    text = "a" + "\u0e48" * 5000
    got = pieces(text)
    assert all(len(p) <= 1500 for p in got) and got[0] + "".join(p[150:] for p in got[1:]) == text
