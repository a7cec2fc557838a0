"""The language of a text from its scripts and, for Latin script, its most frequent words."""

from __future__ import annotations

import re
from collections import Counter

# fixed values: frequent words of three languages
FREQUENT = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have or had which from they you that's".split(),
    "fr": "le la les de des du et à un une est que qui dans pour pas sur plus par au avec ce il elle nous se sont ont d l".split(),
    "de": "der die das und in zu den ist von mit nicht dem des ein eine auf für im sich es als auch an nach wie bei oder wir".split(),
}
_WORDS = {w: lang for lang, ws in FREQUENT.items() for w in ws if sum(w in o for o in FREQUENT.values()) == 1}
_TOKEN = re.compile(r"[a-zà-ÿœ]+")
_THAI, _KANA, _HAN, _LATIN = (re.compile(p) for p in ("[ก-๛]+", "[ぁ-ヿ]+", "[一-鿿]+", "[A-Za-zÀ-ÿ]+"))


def _amount(run: re.Pattern, text: str) -> int:
    return sum(map(len, run.findall(text)))


def detect(text: str | None, label: str | None = None) -> str | None:
    """th, ja, zh, en, fr or de; where the text does not tell, the label as it is."""
    if not text:
        return label
    plain = text.isascii()
    thai = 0 if plain else _amount(_THAI, text)
    if thai * 2 > len(text):
        return "th"
    kana, han = (0, 0) if plain else (_amount(_KANA, text), _amount(_HAN, text))
    latin = _amount(_LATIN, text)
    most = max(thai, 2 * (kana + han), latin / 2)
    if most == 0:
        return label
    if most == thai:
        return "th"
    if most == 2 * (kana + han):
        return "ja" if kana * 10 > han else "zh"
    votes = Counter(_WORDS[w] for w in _TOKEN.findall(text.lower()) if w in _WORDS).most_common(2)
    if not votes or len(votes) == 2 and votes[0][1] == votes[1][1]:
        return label
    return votes[0][0]
