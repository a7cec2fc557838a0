"""What of a text is running prose, and statistics of its words, lines and signs."""

from __future__ import annotations

import re
from collections import Counter
from functools import cache

import numpy as np

# fixed values: frequent function words, for the share of common words
FUNCTION = {
    "en": "the a an of to in and or but for with from by on at as is are was were be been that which who this these it its his her their they he she we you i not no than then when where while if because so into over after before about only more most some such had has have can could will would".split(),
    "fr": "le la les l de des du d un une et ou mais pour avec par sur dans en à au aux ce cette ces qui que qu il elle ils elles nous vous on je se s ne n pas plus est sont était chez selon avant après car si leur leurs son sa ses ni".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder aber denn für mit von zu zum zur im in am an auf aus bei nach vor über um ist sind war waren nicht als wie dass wenn weil sich er sie es wir ich ihr man nur auch noch so meist".split(),
}
THAI = "ไม่ จะ ให้ ก็ ว่า เพราะ จาก เป็น ได้ ใน แต่ จน มัก ต้อง เมื่อ หาก ทำ ของ และ หรือ โดย ถึง ซึ่ง อย่าง กับ คือ แล้ว ด้วย ยัง มา ไป นี้ เพื่อ ขณะ หลัง ก่อน".split()
CHINESE = "的 了 是 在 不 和 会 能 都 来 去 把 被 更 而 但 就 也 这 那 他 她 我 们 与 因 为 所 以 常 使".split()
JAPANESE = "は が を に で と の も へ から まで より して した する いる ある ない です ます こと".split()
_WORDS = frozenset(w for ws in FUNCTION.values() for w in ws)
_THAI = re.compile("|".join(sorted(THAI, key=len, reverse=True)))
_CHINESE = re.compile("|".join(CHINESE))
_JAPANESE = re.compile("|".join(sorted(JAPANESE, key=len, reverse=True)))
_LATIN = re.compile(r"[a-zß-ÿœ]+")
_TOKEN = re.compile(r"[\x21-\x7e]{24,}")

# Classes of characters, one bit each, for all code points.
LETTER, DIGIT, SPACE, THAI_SIGN, KANA, HAN, LATIN_LETTER = (1 << k for k in range(7))


@cache
def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x30000):
        c = chr(cp)
        out[cp] = LETTER * (c.isalpha() or 0xE31 <= cp <= 0xE4E) | DIGIT * c.isdigit() | SPACE * c.isspace()
    out[0xE01:0xE4F] |= THAI_SIGN
    out[0x3041:0x3100] |= KANA
    out[0x4E00:0xA000] |= HAN
    for lo, hi in ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x100), (0x152, 0x154)):
        out[lo:hi] |= LATIN_LETTER
    return out


class Counts:
    """Counts by class of any stretch of a text, from running sums over the whole of it."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        bits = _classes()[codes]
        self.sums = {}
        for b in (LETTER, DIGIT, SPACE, THAI_SIGN, KANA, HAN, LATIN_LETTER):
            sums = np.zeros(len(bits) + 1, np.int32)
            np.cumsum((bits & b) != 0, out=sums[1:])
            self.sums[b] = sums
        lower = text.lower()
        lower = lower if len(lower) == len(text) else text
        words, common = [], []
        if self.sums[LATIN_LETTER][-1]:
            for m in _LATIN.finditer(lower):
                words.append(m.start())
                if m.group() in _WORDS:
                    common.append(m.start())
        if self.sums[THAI_SIGN][-1]:
            common += [m.start() for m in _THAI.finditer(text)]
        if self.sums[KANA][-1]:
            common += [m.start() for m in _JAPANESE.finditer(text)]
        elif self.sums[HAN][-1]:
            common += [m.start() for m in _CHINESE.finditer(text)]
        self.words = np.array(words, np.int64)
        self.common = np.sort(np.array(common, np.int64))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
        """For stretches [lo, hi): letters, digits, visible, size (letters, East Asian ones twice), common, words."""
        n = {b: s[hi] - s[lo] for b, s in self.sums.items()}
        latin = np.searchsorted(self.words, hi) - np.searchsorted(self.words, lo)
        return {
            "letters": n[LETTER],
            "digits": n[DIGIT],
            "visible": hi - lo - n[SPACE],
            "size": n[LATIN_LETTER] + n[THAI_SIGN] + 2 * (n[KANA] + n[HAN]),
            "common": np.searchsorted(self.common, hi) - np.searchsorted(self.common, lo),
            # words of spaced scripts; the others count pieces of a usual word's length
            "words": latin + (n[THAI_SIGN] + 4) // 5 + (n[KANA] + n[HAN] + 1) // 2,
            "wide": n[THAI_SIGN] + n[KANA] + n[HAN],
            "east": n[KANA] + n[HAN],
        }


_ENDS = re.compile(r"(?:[.!?…。！？]|ค่ะ|ครับ|นะคะ)[\"'”’»」』)）\]]*\s*$")
_INNER = re.compile(r"[.!?,;:…。！？，；：、]+[\"'”’»」』)]*(?=\s|$|[ก-๛぀-鿿])")
MARKER = re.compile(r"^\s*(?:[-–—•*✓✔☐▪·>»+]|\(?\d{1,3}\s*[.):-]|\(?[a-zA-Z][.)])\s+")
# Shapes of lines that no prose has.
TAGS = re.compile(r"</?[a-zA-Z][^<>]*>")
RECORD = re.compile(r'^\s*[\[{(]?\s*[{"\'\[].*["\']?\s*[:=]\s*.*[}\],"\']\s*,?\s*$')
LOG = re.compile(r"^\s*[\[(<]?(?:\d{4}-\d\d-\d\d[T ])?\d{1,2}:\d\d(?::\d\d)?[\])>]?\s+(?:[A-Z]{3,9}\b|\S+[=:]\S)")
CITED = re.compile(r"\(\d{4}[a-z]?\)[.,:]|\b\d+\s?\(\d+\)|\b\d+\s?[–-]\s?\d+\.?\s*$|\bdoi\b|https?://")
FIELDS = re.compile(r"\s*[;|\t]\s*|\s{2,}|\s[·>/]\s")
COMMAS = re.compile(r",(?=\S)")


def line_kind(s: str, n: dict[str, int]) -> str:
    """'' for a stripped line that may be prose, else why it is none; n: its counts."""
    visible = n["visible"]
    if not visible:
        return "blank"
    if "<" in s and len(TAGS.findall(s)) >= 2:
        return "markup"
    if s.count('"') >= 4 and RECORD.match(s):
        return "record"
    if n["digits"]:
        if LOG.match(s):
            return "log"
        if len(CITED.findall(s)) >= 2:
            return "reference"
    if len(s) >= 24:
        longest = max(map(len, _TOKEN.findall(s)), default=0)
        if longest > 0.5 * visible and n["digits"] + sum(map(s.count, "+/=_")) > 0.1 * visible:
            return "code"
    if n["letters"] < 0.6 * visible:
        return "signs"
    fields = [f for f in FIELDS.split(s) if f]
    if len(fields) >= 3 and max(map(len, fields)) <= 45 and len(s) <= 24 * len(fields):
        return "fields"
    if "," in s and n["common"] < 0.12 * max(1, n["words"]):
        fields = [f for f in COMMAS.split(s) if f]
        if len(fields) >= 3 and max(map(len, fields)) <= 40 and not _ENDS.search(s):
            return "fields"
    if s.count("#") >= 2 and len(re.findall(r"#\w", s)) >= 2:
        return "tags"
    return ""


def is_prose(unit: str, n: dict[str, int], ends: bool) -> bool:
    """A unit of text with the words and shape of sentences; ends: it ends like one."""
    words, size = n["words"], n["size"]
    if words < 4 or size < 16:
        return False
    dense = n["common"] / words
    if ends:
        return dense >= 0.08 or words >= 8 and _INNER.search(unit.rstrip("\"'”’»」』) ")[:-2]) is not None
    if n["wide"]:
        return dense >= 0.14 and size >= 34 or dense >= 0.06 and size >= 46
    return dense >= 0.2 and words >= 8


def repeated(pieces: list[str]) -> set[str]:
    """Pieces that come again and again: three times or more, and in that more than a fifth of all."""
    n = Counter(p for p in pieces if p)
    total = sum(n.values())
    return {p for p, k in n.items() if k >= 3 and 5 * k > total}


def _loops(unit: str) -> bool:
    """A phrase said over and over within a unit."""
    words = unit.split()
    if len(words) >= 8 and len(set(words)) <= len(words) // 4:
        return True
    if len(unit) < 60:
        return False
    parts = [unit[i : i + 12] for i in range(0, len(unit) - 11, 5)]
    return len(set(parts)) < 0.3 * len(parts)


class Shape:
    """A text's lines with their counts, computed once for all statistics."""

    def __init__(self, text: str):
        self.lines = [x.strip() for x in text.split("\n")]
        sizes = np.array([len(x) for x in text.split("\n")], np.int64)
        lo = np.cumsum(sizes + 1) - sizes - 1
        counts = Counts(text)
        self.total = {k: int(v[0]) for k, v in counts.of(np.array([0]), np.array([len(text)])).items()}
        columns = {k: v.tolist() for k, v in counts.of(lo, lo + sizes).items()}
        self.counts = [dict(zip(columns, row)) for row in zip(*columns.values())]
        self.ends = [bool(x) and _ENDS.search(x) is not None for x in self.lines]

    def units(self, kept: list[bool]) -> list[list[int]]:
        """Line numbers of stretches that may be prose, lines broken at a margin together."""
        full = sorted((len(x) for x, k in zip(self.lines, kept) if k), reverse=True)
        margin = full[min(len(full) - 1, len(full) // 10)] if full else 0
        units: list[list[int]] = []
        open_ = False
        for i, (x, k) in enumerate(zip(self.lines, kept)):
            if not k:
                open_ = False
                continue
            if open_ and not MARKER.match(x):
                units[-1].append(i)
            else:
                units.append([i])
            open_ = (18 if self.counts[i]["east"] else 30) <= margin <= 130 and len(x) >= 0.7 * margin and not self.ends[i]
        return units

    def prose_share(self) -> float:
        """Share of the visible characters that stand in prose."""
        if not self.total["visible"]:
            return 0.0
        again = repeated(self.lines)
        kept = [bool(x) and x not in again and not line_kind(x, n) for x, n in zip(self.lines, self.counts)]
        good = 0
        for u in self.units(kept):
            n = {k: sum(self.counts[i][k] for i in u) for k in ("words", "size", "common", "wide", "visible")}
            unit = " ".join(self.lines[i] for i in u)
            if is_prose(unit, n, self.ends[u[-1]]) and not _loops(unit):
                good += n["visible"]
        return min(1.0, good / self.total["visible"])


def prose_share(text: str) -> float:
    return Shape(text).prose_share()


STATISTICS = ("mean_word_length", "symbol_ratio", "digit_ratio", "broken_line_share", "uncommon_share", "repeat_share", "short_line_share", "no_prose_share")


def statistics(text: str | None) -> dict[str, float]:
    """All rounded to four places; larger values of STATISTICS speak against prose, but for mean_word_length, where both ends do."""
    shape = Shape(text or "")
    n = shape.total
    lines = [x for x in shape.lines if x]
    bare, words = n["visible"], n["words"]
    few = [w for x in lines for w in x.split()] if len(lines) <= 2 else []
    out = {
        "n_words": float(words),
        "mean_word_length": n["size"] / words if words else 0.0,
        "symbol_ratio": (bare - n["letters"] - n["digits"]) / bare if bare else 1.0,
        "digit_ratio": n["digits"] / bare if bare else 0.0,
        "broken_line_share": 1 - sum(shape.ends) / len(lines) if lines else 1.0,
        "uncommon_share": 1 - n["common"] / words if words else 1.0,
        "repeat_share": max(1 - len(set(lines)) / len(lines) if lines else 0.0, 1 - len(set(few)) / len(few) if len(few) >= 20 else 0.0),
        "short_line_share": sum(len(x) < 30 for x in lines) / len(lines) if lines else 1.0,
        "no_prose_share": 1 - shape.prose_share(),
    }
    return {k: round(min(max(v, 0.0), 1e6), 4) for k, v in out.items()}
