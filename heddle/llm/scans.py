"""Noise in text from scanned pages (problem 3).

Four steps over the chunks:

1. ``edge_lines`` picks lines that may be page furniture: those at page edges
   (ends of the text, next to page numbers) or bound to a page number.
2. ``running_heads`` finds, per source, which of them repeat. Repetition is
   fuzzy: lines are compared by their letters, without marks, with commonly
   confused characters folded into one, and by their beginning, as heads are
   often shortened. Titles of the source count as heads too. Lines that begin
   otherwise, or are longer than a line of print, meet a head on stretches of
   HEAD letters from its middle and end, and must be nearly the whole of it.
3. ``piece_counts`` counts pieces of GRAM letters and words over the whole
   corpus, exactly.
4. ``page_faults`` decides for every line: furniture (number of the chunk's own
   page sequence, running head), cut (a hyphen at the line's end that the corpus
   vocabulary knows joined rather than hyphenated), misread (an edit by a common
   confusion turns pieces the corpus hardly has into pieces it has often).
   ``repair`` applies the same decisions and joins lines to paragraphs.

Scale. Heads are counted by (source, beginning), partially aggregated, and
joined to candidate lines, of which a chunk has a few; hot sources are split
by AQE, as the join's other side is unique. The corpus counts are a table of
distinct pieces, which no task holds as a whole: the chunks are put into lots
of about LOT characters, each lot asks for the distinct pieces of its own text,
then for those of the edits it considers, and gets their counts by an equi-join
with the table. Counts are exact at every size, so results do not depend on
how the chunks are dealt to tasks.

Cases. Null and blank texts have no faults. Null pages: the number's form and
place decide alone. Lines are counted from 1, empty ones too. A heading equal to
the section_title is text. Texts not broken into lines can only be misread.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from heddle.llm.common import clean_key, delivered_once, settle, table

GRAM, LOT = 5, 8_000_000  # letters of a piece; characters of chunks that are decided together
LINE = 100  # characters of a line of print, at most: longer lines are furniture only if they are the title
HEAD, REPEATS = 9, 3  # letters of a head that must agree; chunks of a source in which it must stand
# fixed values: what scanners read for what is printed
CONFUSED = [
    ("ถ", "ก"), ("น", "ม"), ("บ", "น"), ("ต", "ด"), ("ศ", "ค"), ("ำ", "า"), ("ิ", "ี"), ("ี", "ิ"), ("ื", "ึ"), ("ึ", "ื"), ("โ", "ไ"), ("ไ", "โ"), ("ใ", "ไ"), ("พ", "ฟ"), ("ฟ", "พ"), ("ผ", "ฝ"), ("ฝ", "ผ"),
    ("ด", "ค"), ("ค", "ด"), ("ป", "บ"), ("ช", "ซ"), ("ซ", "ช"), ("ฃ", "ข"), ("ฅ", "ค"), ("ฦ", "ภ"), ("ถ", "ภ"), ("ภ", "ถ"), ("ก", "ภ"), ("้", "่"), ("่", "้"), ("เ", "แ"), ("อ", "ฮ"), ("ล", "ส"), ("ส", "ล"), ("ว", "า"), ("า", "ว"), ("ท", "ห"), ("ห", "ท"),
    ("c", "e"), ("e", "c"), ("0", "o"), ("O", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("l", "i"), ("i", "l"), ("I", "l"), ("|", "l"), ("5", "s"), ("5", "S"), ("8", "B"), ("b", "h"), ("h", "b"), ("q", "g"), ("9", "g"), ("6", "b"), ("u", "n"), ("n", "u"), ("t", "f"), ("f", "t"), ("v", "y"), ("y", "v"), ("a", "o"), ("o", "a"), ("e", "é"), ("é", "e"), ("o", "ö"), ("u", "ü"), ("a", "ä"), ("B", "ß"), ("0", "O"), ("1", "I"), ("c", "o"), ("o", "c"),
]
WIDER = [("เเ", "แ"), (" า", "ำ"), ("ํา", "ำ"), ("rn", "m"), ("ri", "n"), ("m", "rn"), ("n", "ri"), ("vv", "w"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("li", "h"), ("h", "li"), ("iii", "m"), ("l<", "k"), ("fi", "h")]
DROPPED = "่้์ัิี็ุูึื๊"
_FOLD = str.maketrans({"ถ": "ก", "ภ": "ก", "น": "ม", "บ": "ม", "ต": "ด", "ค": "ด", "ศ": "ด", "ำ": "า", "แ": "เ", "e": "c", "o": "0", "a": "0", "l": "1", "i": "1", "!": "1", "|": "1", "s": "5", "q": "g", "h": "b", "u": "n", **{c: None for c in DROPPED + "๋ํ"}})
_LETTERS = re.compile(r"[^\w!|]+|_", re.U)
HYPHENS = "-‐¬\xad"
CUT = re.compile(rf"[{HYPHENS}][ \t\xa0]*$")
_THAI = re.compile("[ก-๛]")
_WORD = re.compile(r"[A-Za-zÀ-ÿœŒ0-9!]+(?:[-‐’'][A-Za-zÀ-ÿœŒ0-9!]+)*")
_THAI_DIGITS = str.maketrans("๐๑๒๓๔๕๖๗๘๙", "0123456789")
_MISREAD_DIGITS = str.maketrans("lI|!iOoSsBzZ", "111110055822")
_NUMBER = r"[0-9๐-๙lI|!OoSB]{1,4}|[ivxlcdmIVXLCDM]{1,8}"
PAGE_LINE = re.compile(rf"^\s*(?P<dress>[-–—]\s*|\[\s*|\(\s*|(?:หน[า้]+|p\.|pp\.|page|seite|s\.|第)\s*)?(?P<n>{_NUMBER})(?P<end>\s*[-–—]|\s*\]|\s*\)|\s*\.|\s*页|\s*頁|\s*ページ)?(?:\s*(?:of|de|von|/|จาก)\s*(?P<of>[0-9lIO]+))?\s*$", re.I)
HEAD_LEFT = re.compile(rf"^\s*(?P<n>{_NUMBER})\s*(?P<bar>[|·•]|\s[-–—]|\s{{2,}})\s*(?P<rest>\S.*)$")
HEAD_RIGHT = re.compile(rf"^(?P<rest>.*\S)(?P<bar>\s*\.{{2,}}\s*|\s*…\s*|\s*[|·•]\s*|\s{{2,}}|\s[-–—]\s)(?P<n>{_NUMBER})\s*$")
CHAPTER = re.compile(r"^\s*(?:บ[ทห]ท?\S{0,3}|ch(?:ap(?:ter|itre)?)?\.?|kap(?:itel)?\.?|第)\s*[0-9๐-๙lIivxOo]+\s*(?:章|[.:])?\s*(?P<rest>.*)$", re.I)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def page_number(token: str) -> int | None:
    """Arabic, Thai and Roman numbers, with confused signs."""
    t = token.translate(_THAI_DIGITS)
    if re.fullmatch(r"[ivxlcdm]+", t.lower()) and not re.fullmatch(r"[lI|!]+", t):
        v = [_ROMAN[c] for c in t.lower()]
        return sum(-a if b > a else a for a, b in zip(v, v[1:] + [0]))
    t = t.translate(_MISREAD_DIGITS)
    return int(t) if t.isdigit() else None


def fold(text: str | None) -> str:
    """The letters of a line as they compare: no case, marks, numbers or confused characters."""
    t = (text or "").lower().replace("rn", "m").replace("ri", "n").replace("เเ", "แ")
    return re.sub(r"[0-9๐-๙]", "", _LETTERS.sub("", t)).translate(_FOLD)


def _fits(n: int | None, pages: list[int] | None) -> bool:
    if n is None:
        return False
    return n < 5000 if not pages else min(pages) - 1 <= n <= max(pages) + 1


def _number_line(line: str, pages: list[int] | None, edge: bool) -> bool:
    m = PAGE_LINE.match(line)
    if not m:
        return False
    n = page_number(m["n"])
    dressed = bool(m["dress"] or m["of"] or (m["end"] and m["end"].strip() in "-–—]页頁ページ"))
    if m["of"]:
        return True
    if pages:
        return _fits(n, pages)
    plain = m["n"].isascii() and re.fullmatch(r"[ivxlcdm]+", m["n"]) is None  # body text has no bare Thai or Roman numbers
    return n is not None and n < 2000 and (dressed or edge or bool(m["end"]) or not plain)


def _parts(line: str) -> tuple[str, int | None]:
    """The line without a page number at either end, and that number."""
    for p in (HEAD_LEFT, HEAD_RIGHT):
        m = p.match(line)
        if m and (n := page_number(m["n"])) is not None:
            return m["rest"], n
    return line, None


def _edges(lines: list[str], pages: list[int] | None) -> set[int]:
    """Lines at the ends of the text or next to a page number, blank lines apart."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    at = set(full[:2] + full[-2:])
    for k, i in enumerate(full):
        if _number_line(lines[i], pages, False):
            at.update(full[max(0, k - 1) : k + 2])
    return at


def _pages(x: object) -> list[int] | None:
    return [int(p) for p in x if p is not None] or None if x is not None else None


# --- running heads --------------------------------------------------------------------------------------------------


def _stretches(key: str) -> list[tuple[int, str]]:
    """(which, stretch): HEAD letters from the beginning, the middle and the end."""
    mid = (len(key) - HEAD) // 2
    found = [(0, key[:HEAD])]
    if len(key) >= 2 * HEAD:
        found += [(1, key[mid : mid + HEAD]), (2, key[-HEAD:])]
    return found


def edge_lines(chunks: DataFrame) -> DataFrame:
    """(chunk_id, source_id, line_no, which, head, full): candidates by stretches of their letters; titles have line_no 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cid, src, title, section, pages, text in zip(b.chunk_id, b.source_id, b.title, b.section_title, b.pages, b.text):
                pages = _pages(pages)
                t = fold(title)
                if len(t) >= HEAD:
                    out += [(cid, src, 0, w, h, t) for w, h in _stretches(t)]
                lines = (text or "").split("\n")
                if len(lines) < 3:
                    continue
                own = fold(section)
                edges = _edges(lines, pages)
                for i, x in enumerate(lines):
                    if not x.strip():
                        continue
                    rest, n = _parts(x)
                    k = fold(rest)
                    if len(k) < HEAD or k == own or len(x) > LINE and not (len(t) >= HEAD and _same(k, t)):
                        continue
                    if i not in edges and n is None and not x.isupper() and not CHAPTER.match(x) and not (len(t) >= HEAD and (k[:HEAD] == t[:HEAD] or _same(k, t))):
                        continue
                    out += [(cid, src, i + 1, w, h, k) for w, h in _stretches(k)]
            yield pd.DataFrame(out, columns=["chunk_id", "source_id", "line_no", "which", "head", "full"])

    return chunks.select("chunk_id", "source_id", "title", "section_title", "pages", "text").mapInPandas(run, "chunk_id string, source_id string, line_no int, which int, head string, full string")


def running_heads(candidates: DataFrame) -> DataFrame:
    """(source_id, which, head, key): beginnings that repeat in a source, with their most frequent whole key, and the other stretches of those keys."""
    lines = candidates.filter("which = 0").groupBy("source_id", "head", "full").agg(F.count("*").alias("n"), F.max((F.col("line_no") == 0).cast("int")).alias("title"))
    heads = lines.groupBy("source_id", "head").agg(F.sum("n").alias("n"), F.max("title").alias("title"), F.max_by("full", F.struct("title", "n", F.length("full"))).alias("key"))
    heads = heads.filter((F.col("n") >= REPEATS) | (F.col("title") == 1))
    size = F.length("key")
    more = F.when(size >= 2 * HEAD, F.array(F.struct(F.lit(1).alias("which"), F.substring("key", ((size - HEAD) / 2).cast("int") + 1, F.lit(HEAD)).alias("head")), F.struct(F.lit(2).alias("which"), F.substring("key", size - HEAD + 1, F.lit(HEAD)).alias("head")))).otherwise(F.array().cast("array<struct<which:int,head:string>>"))
    all_ = F.concat(F.array(F.struct(F.lit(0).alias("which"), F.col("head").alias("head"))), more)
    return heads.select("source_id", "key", F.explode(all_).alias("x")).groupBy("source_id", "x.which", "x.head").agg(F.max("key").alias("key"))


# --- corpus counts --------------------------------------------------------------------------------------------------

_BASE = np.uint64(1_000_003)
_POWERS = np.array([pow(1_000_003, GRAM - 1 - k, 1 << 64) for k in range(GRAM)], np.uint64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _sums(codes: np.ndarray) -> np.ndarray:
    """The polynomial of every piece; linear, so that an edit changes it by a difference."""
    n = len(codes) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return sum(codes[k : k + n] * _POWERS[k] for k in range(GRAM))


def _word_key(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)


_SCATTER = np.uint64(0x9E3779B97F4A7C15)


class Counts:
    """Counts by key (of pieces their sums, of words a hash); what is asked for and not there is remembered."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        mixed = keys * _SCATTER
        order = np.argsort(mixed)
        self.keys, self.n = keys[order], n[order].astype(np.int64)
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(mixed[order] >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        self.asked: list[np.ndarray] = []

    def of(self, keys: np.ndarray) -> np.ndarray:
        """By buckets of the scattered keys, which hold one key on average: all keys go through theirs together."""
        flat = keys.ravel()
        bucket = (flat * _SCATTER) >> self.shift
        at, end = self.first[bucket], self.first[bucket + np.uint64(1)]
        out = np.zeros(len(flat), np.int64)
        open_ = np.flatnonzero(at < end)
        missing = [np.flatnonzero(at >= end)]
        while len(open_):
            here = at[open_]
            hit = self.keys[here] == flat[open_]
            out[open_[hit]] = self.n[here[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            more = at[open_] < end[open_]
            missing.append(open_[~more])
            open_ = open_[more]
        missed = np.concatenate(missing)
        if len(missed):
            self.asked.append(np.unique(flat[missed]))
        return out.reshape(keys.shape)

    def word(self, word: str) -> int:
        return int(self.of(np.array([_word_key(word)], np.uint64))[0])


def _whole(codes: np.ndarray) -> np.ndarray:
    """Which pieces lie within one line."""
    breaks = np.cumsum(np.concatenate([[0], codes == 10]))
    return breaks[GRAM:] == breaks[:-GRAM]


def _keys(texts: list[str], words: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the pieces within lines, and of all words, with their counts."""
    codes = _codes("\n".join(texts))
    found = [np.unique(_sums(codes)[_whole(codes)], return_counts=True)] if len(codes) >= GRAM else []
    seen = Counter(w for t in texts for w in _WORD.findall(t.lower())) if words else {}
    if seen:
        found.append((np.array([_word_key(w) for w in seen], np.uint64), np.array(list(seen.values()), np.int64)))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.astype(np.uint64).view(np.int64)


def piece_counts(chunks: DataFrame) -> DataFrame:
    """(key, n) of all pieces of GRAM characters within lines, and of all words, over the whole corpus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, n = _keys(b.text.tolist())
            yield pd.DataFrame({"key": _signed(keys), "n": n.astype(np.int64)})

    texts = chunks.select("text").filter(F.length("text") > 0)
    return texts.mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


# --- misread characters ---------------------------------------------------------------------------------------------

_SINGLE = [(ord(a), ord(b)) for a, b in CONFUSED]
_CONSONANT = np.zeros(0x110000, bool)
_CONSONANT[[c for c in range(0xE01, 0xE3B) if chr(c) not in "ฯะาำ"]] = True


def _better(old: np.ndarray, new: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows are places, columns the pieces around them (there: which exist): whether an edit was needed, and its gain.

    No piece may become rarer, the usual one must become at least nine times as
    frequent, and most of them seven times.
    """
    n = there.sum(axis=1)
    gain = np.where(there, np.log((new + 0.5) / (old + 0.5)), 0.0)
    mean = gain.sum(axis=1) / np.maximum(n, 1)
    often = (there & (new >= 8)).sum(axis=1)
    good = (n >= 2) & ~(there & (new < old)).any(axis=1) & (mean >= 2.2) & ((gain >= 2.0).sum(axis=1) >= np.maximum(2, 0.6 * n)) & (2 * often >= n)
    return good, mean


def misreadings(text: str, counts: Counts) -> list[tuple[int, int, str]]:
    """Edits (start, end, replacement) that common confusions and the corpus suggest; all lines of ``text`` at once.

    What a line gets depends on its own characters alone: breaks around the text
    make its first and last lines like the others.
    """
    if len(text) < GRAM:
        return []
    text = "\n" * GRAM + text + "\n" * GRAM
    codes = _codes(text)
    sums = _sums(codes)
    n = len(sums)
    whole = _whole(codes)
    have = np.zeros(n, np.int64)
    have[whole] = counts.of(sums[whole])
    rare = whole & (have <= np.maximum(3.0, 0.1 * _usual(have, whole, codes)))
    k = np.arange(GRAM)
    # per character: pieces that hold it, and how many of them are rare
    run = np.concatenate([np.zeros(GRAM, np.int64), np.cumsum(rare), np.full(GRAM, rare.sum())])
    held = np.concatenate([np.zeros(GRAM, np.int64), np.cumsum(whole), np.full(GRAM, whole.sum())])
    at_char = np.arange(len(codes))
    n_rare = run[at_char + GRAM] - run[at_char]
    n_held = held[at_char + GRAM] - held[at_char]
    doubtful = (n_rare >= 2) & (n_rare >= 0.6 * n_held)
    places = np.flatnonzero(doubtful)
    best: dict[int, tuple[float, str]] = {}
    if len(places):
        signs = codes[places]
        for a, b in _SINGLE:
            at = places[signs == a]
            if not len(at):
                continue
            start = at[:, None] - k[None, :]
            where = np.clip(start, 0, n - 1)
            there = (start >= 0) & (start < n) & whole[where]
            delta = np.uint64((b - a) & 0xFFFFFFFFFFFFFFFF)
            new = counts.of(sums[where] + delta * _POWERS[k][None, :])
            good, gain = _better(have[where], new, there)
            for i, g in zip(at[good].tolist(), gain[good].tolist()):
                if g > best.get(i, (0.0, ""))[0]:
                    best[i] = (g, chr(b))
    out = [(i, i + 1, made) for i, (_, made) in best.items()]
    taken = set(best)
    # marks that were not read: between a Thai consonant and what follows, where the pieces across are rare
    gaps = np.arange(1, len(codes))
    across = run[gaps + GRAM - 1] - run[gaps]
    n_across = held[gaps + GRAM - 1] - held[gaps]
    gaps = gaps[(across >= 1) & (across >= 0.7 * n_across) & _CONSONANT[codes[:-1].astype(np.int64)]]
    gaps = gaps[(gaps >= GRAM) & (gaps + GRAM <= len(codes))] if len(gaps) else gaps
    if len(gaps):
        start = gaps[:, None] - np.arange(1, GRAM)[None, :]
        there = whole[start]
        old = have[start]
        left = codes[gaps[:, None] + np.arange(-GRAM + 1, 0)[None, :]]
        right = codes[gaps[:, None] + np.arange(0, GRAM - 1)[None, :]]
        for mark in DROPPED:
            around = np.concatenate([left, np.full((len(gaps), 1), ord(mark), np.uint64), right], axis=1)
            pieces = np.stack([counts.of((around[:, j : j + GRAM] * _POWERS[None, :]).sum(axis=1, dtype=np.uint64)) for j in range(1, GRAM)], axis=1)
            # pieces j..j+GRAM of the edited text stand for those that crossed the gap, from the left
            good, gain = _better(old[:, ::-1], pieces, there[:, ::-1])
            for i, g in zip(gaps[good].tolist(), gain[good].tolist()):
                if i - 1 not in taken and i not in taken:
                    out.append((i, i, mark))
                    taken.add(i - 1)
    for seen, made in WIDER:
        at = text.find(seen)
        while at >= 0:
            i, j = at, at + len(seen)
            if doubtful[i:j].any() and not taken & set(range(i, j)) and _attempt(text, i, j, made, counts):
                out.append((i, j, made))
                taken.update(range(i, j))
            at = text.find(seen, at + 1)
    return sorted((i - GRAM, j - GRAM, made) for i, j, made in out)


def _usual(have: np.ndarray, whole: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For every piece the median count of the pieces of its line."""
    line = np.cumsum(codes == 10)[: len(have)]
    at = np.flatnonzero(whole)
    out = np.zeros(len(have))
    if len(at):
        owner = line[at]
        counts = have[at][np.lexsort((have[at], owner))]  # lines stay in order
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        size = np.diff(np.append(first, len(at)))
        out[at] = np.repeat((counts[first + (size - 1) // 2] + counts[first + size // 2].astype(float)) / 2, size)
    return out


def _attempt(text: str, i: int, j: int, made: str, counts: Counts) -> bool:
    """Whether text[i:j] should read ``made``, by the pieces of its line that hold any of it."""
    lo = max(i - GRAM + 1, text.rfind("\n", 0, i) + 1)
    hi = j + GRAM - 1
    stop = text.find("\n", j, hi)
    hi = min(hi if stop < 0 else stop, len(text))
    old, new = (np.sort(counts.of(_sums(_codes(t)))) for t in (text[lo:hi], text[lo:i] + made + text[j:hi]))
    m = min(len(old), len(new))
    return m >= 2 and bool(_better(old[None, :m], new[None, :m], np.ones((1, m), bool))[0][0])


# --- decisions ------------------------------------------------------------------------------------------------------


def is_cut(left: str, right: str, counts: Counts) -> bool:
    """Whether the word at the end of ``left`` (hyphen included) goes on in ``right``."""
    body, nxt = left.rstrip()[:-1], right.lstrip()
    if not body or not nxt or not body[-1].isalpha() and not _THAI.match(body[-1]):
        return False
    if _THAI.match(body[-1]):
        return _THAI.match(nxt[0]) is not None
    if not nxt[0].isalpha():
        return False
    a = re.search(r"[A-Za-zÀ-ÿœŒ0-9!]+(?:[-‐’'][A-Za-zÀ-ÿœŒ0-9!]+)*$", body)
    b = re.match(r"[A-Za-zÀ-ÿœŒ0-9!]+(?:[-‐][A-Za-zÀ-ÿœŒ0-9!]+)*", nxt)
    if not a or not b:
        return True
    x, y = a.group().lower(), b.group().lower()
    joined, apart = counts.word(x + y), counts.word(f"{x}-{y}")
    if joined or apart:
        return joined >= apart
    if left.rstrip()[-1] != "-":
        return True
    # neither known: two words that stand alone elsewhere keep their hyphen
    return not (counts.word(x) >= 5 and counts.word(y) >= 5 and len(x) > 2 and len(y) > 2)


def line_faults(text: str, pages: list[int] | None, heads: dict[int, str], section: str | None, title: str | None, counts: Counts) -> dict[int, set[str]]:
    """Faults by line number from 1; heads: line numbers of running heads with the head's whole key."""
    lines = text.split("\n")
    faults: dict[int, set[str]] = {}
    own = fold(section)
    edges = _edges(lines, pages) if len(lines) >= 3 else set()
    t = fold(title)
    for i, x in enumerate(lines):
        if len(lines) < 3 or not x.strip() or (own and fold(x) == own):
            continue
        rest, n = _parts(x)
        k = fold(rest)
        known = heads.get(i + 1)
        chapter = CHAPTER.match(rest)
        if _number_line(x, pages, i in edges):
            furniture = True
        elif n is not None and _fits(n, pages):
            like_title = bool(t) and len(k) >= 5 and (t.startswith(k) or k.startswith(t))
            furniture = known is not None or chapter is not None or like_title or (len(k) >= 5 and HEAD_RIGHT.match(x) is not None and "..." in x)
        elif chapter is not None and len(x) <= 80:
            furniture = True
        else:
            whole = known if known is not None else t
            furniture = bool(whole) and len(k) >= HEAD and (known is not None or i in edges or k == t) and (k[:HEAD] == whole[:HEAD] and _alike(k, whole) or _same(k, whole))
        if furniture:
            faults.setdefault(i + 1, set()).add("furniture")
    body = [i for i, x in enumerate(lines) if i + 1 not in faults and x.strip()]
    for i, j in zip(body, body[1:]):
        if CUT.search(lines[i]) and is_cut(lines[i], lines[j], counts):
            faults.setdefault(i + 1, set()).add("cut")
    return faults


def misread_lines(texts: list[str], faults: list[dict[int, set[str]]], counts: Counts) -> dict[tuple[int, int], list[tuple[int, int, str]]]:
    """Edits by (text, line number) for all lines that are not furniture; edits count from the line's start."""
    owner, lines = [], []
    for t, (text, found) in enumerate(zip(texts, faults)):
        for i, x in enumerate(text.split("\n"), 1):
            if x.strip() and "furniture" not in found.get(i, ()):
                owner.append((t, i))
                lines.append(x)
    starts = np.cumsum([0] + [len(x) + 1 for x in lines])
    out: dict[tuple[int, int], list[tuple[int, int, str]]] = {}
    edits = misreadings("\n".join(lines), counts)
    at = np.searchsorted(starts, [e[0] for e in edits], side="right") - 1
    for k, (a, b, made) in zip(at.tolist(), edits):
        out.setdefault(owner[k], []).append((a - int(starts[k]), b - int(starts[k]), made))
    return out


def _close(a: str, b: str) -> bool:
    """At least four fifths of the pairs of neighbouring letters agree."""
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
    return len(x & y) >= 0.75 * max(1, min(len(x), len(y)))


def _alike(k: str, whole: str) -> bool:
    """Two keys of about one length that are close."""
    return 0.85 * len(whole) <= len(k) <= 1.15 * len(whole) and _close(k, whole)


def _same(k: str, whole: str) -> bool:
    """Two keys that differ in a letter out of ten at most."""
    return 0.85 * len(whole) <= len(k) <= 1.15 * len(whole) and SequenceMatcher(None, k, whole, False).ratio() >= 0.9


def _known(heads: object, lines: list[str]) -> dict[int, str]:
    """Line number -> head: one that begins like the line of print, else one that it nearly equals."""
    known: dict[int, str] = {}
    for h in sorted(heads, key=lambda h: (h["which"], h["key"])) if heads is not None else ():
        i = h["line_no"]
        if i not in known and (h["which"] == 0 and len(lines[i - 1]) <= LINE or _same(fold(_parts(lines[i - 1])[0]), h["key"])):
            known[i] = h["key"]
    return known


def repair(text: str, faults: dict[int, set[str]], edits: dict[int, list[tuple[int, int, str]]]) -> str:
    """Paragraphs, a line each: furniture dropped, cut words joined, misreadings undone."""
    out: list[str] = []
    fresh = True
    for i, x in enumerate(text.split("\n"), 1):
        kinds = faults.get(i, set())
        if "furniture" in kinds:
            continue
        if not x.strip():
            fresh = True
            continue
        for a, b, made in reversed(edits.get(i, [])):
            x = x[:a] + made + x[b:]
        glue = "cut" in kinds
        x = CUT.sub("", x) if glue else x.rstrip()
        if fresh or not out:
            out.append(x)
        else:
            wide = re.search("[ก-๛぀-鿿]$", out[-1]) and re.match("[ก-๛぀-鿿]", x)
            hyphened = re.search(rf"\w[{HYPHENS}]$", out[-1])  # a hyphen that belongs to the word
            out[-1] += ("" if open_ or wide or hyphened else " ") + x
        open_, fresh = glue, False
    return "\n".join(out)


def scanned_chunks(spark: SparkSession, d: str) -> DataFrame:
    columns = ["source_id", "doc_type", "title", "section_title", "pages", "text"]
    raw = table(spark, d, "book_chunks").select("chunk_id", clean_key("source_id").alias("source_id"), "doc_type", "title", "section_title", "pages", "text")
    return delivered_once(raw, "chunk_id", columns)


def page_faults(chunks: DataFrame, repaired: bool = False) -> DataFrame:
    """(chunk_id, line_no, fault), or (chunk_id, repaired) for chunks with pages or lines."""
    spark = chunks.sparkSession
    chunks = settle(chunks.filter(F.length(F.trim("text")) > 0))
    candidates = settle(edge_lines(chunks))
    heads = running_heads(candidates)
    met = candidates.filter("line_no > 0").join(heads, ["source_id", "which", "head"]).groupBy("chunk_id").agg(F.collect_list(F.struct("line_no", "which", "key")).alias("heads"))
    size = chunks.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    lots = max(2 * spark.sparkContext.defaultParallelism, size // LOT + 1)
    lot = F.pmod(F.xxhash64("chunk_id"), F.lit(lots)).alias("lot")
    rows = settle(chunks.join(met, "chunk_id", "left").select(lot, "chunk_id", "title", "section_title", "pages", "text", "heads"))
    counts = settle(piece_counts(chunks))
    schema = "chunk_id string, repaired string" if repaired else "chunk_id string, line_no int, fault string"

    def own(b: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(_keys(b.text.tolist())[0])
        return pd.DataFrame({"lot": np.full(len(keys), b.lot.iloc[0]), "key": _signed(keys)})

    def edits(b: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        c = Counts(known.key.to_numpy(np.int64).view(np.uint64), known.n.to_numpy(np.int64))
        for lo in range(0, len(b), 200):
            decide(b.iloc[lo : lo + 200], c)
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *c.asked]))
        return pd.DataFrame({"lot": np.full(len(keys), b.lot.iloc[0] if len(b) else 0), "key": _signed(keys)})

    def final(b: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        c = Counts(known.key.to_numpy(np.int64).view(np.uint64), known.n.to_numpy(np.int64))
        out = [r for lo in range(0, len(b), 200) for r in decide(b.iloc[lo : lo + 200], c)]
        return pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    def decide(b: pd.DataFrame, c: Counts) -> list[tuple]:
        faults = []
        for title, section, pages, text, heads_ in zip(b.title, b.section_title, b.pages, b.text, b.heads):
            faults.append(line_faults(text, _pages(pages), _known(heads_, text.split("\n")), section, title, c))
        found = misread_lines(b.text.tolist(), faults, c)
        if repaired:
            return [(cid, repair(text, faults[t], {i: e for (k, i), e in found.items() if k == t})) for t, (cid, text) in enumerate(zip(b.chunk_id, b.text))]
        for t, i in found:
            faults[t].setdefault(i, set()).add("misread")
        return [(cid, i, f) for cid, fs in zip(b.chunk_id, faults) for i, kinds in fs.items() for f in sorted(kinds)]

    keyed = "lot long, key long"
    first = settle(rows.select("lot", "text").groupBy("lot").applyInPandas(own, keyed).join(counts, "key"))
    more = rows.groupBy("lot").cogroup(first.groupBy("lot")).applyInPandas(edits, keyed)
    both = first.unionByName(settle(more.join(counts, "key")))
    return rows.groupBy("lot").cogroup(both.groupBy("lot")).applyInPandas(final, schema)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return page_faults(scanned_chunks(spark, d).filter("doc_type in ('thesis', 'book')"))


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Texts of scanned theses and books as paragraphs, one per line."""
    return page_faults(scanned_chunks(spark, d).filter("doc_type in ('thesis', 'book')"), repaired=True)


QUERIES = {"p3_found": p3_found, "p3_repaired": p3_repaired}
