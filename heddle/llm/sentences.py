"""Sentence boundaries across languages and scripts (problem 6).

A text's possible sentence ends are terminal signs with their closing signs,
line breaks, and, in scripts whose sentences end in white space (Thai), every
white space. Semi-Markov dynamic programming picks the set of whole spans with
the best sum of scores. A span is scored as a whole: its length, how it opens
(first word), how it closes (last words, sign, what follows), every place
inside it where it might have ended but goes on, and whether its quotation
marks balance. What opens, closes and continues Thai sentences is learned from
quotes (``fit_thai``), whose begins and ends are sentence boundaries; the
others follow from their signs.

Scale. Splitting is a map over rows. The Thai model is fitted once on all
distinct quotes: tasks split them and count what stands where, the counts are
added up by a shuffle. The model has numbers for the CELLS most frequent
features (4 x CELLS pieces of either kind), which travel with the tasks.

Cases. Null and blank texts have no sentences. The last sentence always counts.
Positions are code points from the start of the text as stored, with the
sentence's closing signs, without white space after it. Repeated rows give
repeated results; a claim counts once by its id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from heddle.llm.common import delivered_once, even, settle, table
from heddle.operators.ranking import order_statistics

CELLS, ROUNDS, HELD = 60_000, 3, 200_000  # HELD: counts that a task keeps before it hands them on
GRAM, EXPECTED = 6, 14.0  # letters of a piece of a stretch; times it must be expected at a boundary before its absence tells
OPEN, CLOSE = "“„«「『（([‘", "”“»」』）)]’\"'"
# fixed values: abbreviations that a sentence does not end with, and those it may end with
ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof st no nos vol fig eq cf p pp e.g i.e vs ed eds al approx dept gen col sgt rev hon jr sr mt op "
    "hr fr frl nr bd s z.b z d.h d u.a bzw ca usw evtl ggf vgl bzgl inkl exkl st str abb kap "
    "m mm mme mlle mgr env art chap ex p.ex av apr vol "
    "ดร น.ส พ.อ พ.ศ ค.ศ นพ พญ ผศ รศ ศ อ จ ต ถ ก ข ม".split()
)
MAY_END = frozenset("etc p.m a.m p a.m min std h usw co inc ltd".split())
_END = re.compile(r"[.!?…。！？｡]+(?:[”»」』）)\]’\"']|“(?!\w))*")
_WORD_BEFORE = re.compile(r"([\w.]+?)\.*$")
_THAI = re.compile("[ก-๎]")
_SPACE = re.compile(r"\s+")
_VISIBLE = re.compile(r"\S")
_SAID = re.compile("[^" + re.escape(OPEN + "\"'-–—• ¿¡") + "]")  # past what opens a sentence before its first word
_NUMBER = re.compile(r"\d[\d.,:/]*")
_LATIN = re.compile(r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'’-]*")
_EAST = re.compile("[぀-ヿ一-鿿]")
ALWAYS, NEVER = 12.0, -12.0


def _depths(text: str) -> list[int]:
    """Open quotations and brackets before each position; a mark that never closes opens nothing."""
    pairs = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]"}
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        if stack and c == stack[-1][0]:
            spans.append((stack.pop()[1], i))
        elif c in pairs:
            stack.append((pairs[c], i))
        elif c in "”»」』）)]":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == c:
                    spans.append((stack[k][1], i))
                    del stack[k:]
                    break
    change = [0] * (len(text) + 2)
    for a, b in spans:
        change[a + 1] += 1
        change[b + 1] -= 1
    out, n = [], 0
    for i in range(len(text) + 1):
        n += change[i]
        out.append(n)
    return out


def _sign_score(text: str, at: int, end: int, depth: int) -> float:
    """How much the signs text[at:end] close a sentence, by the words around them."""
    sign = text[at:end]
    after = text[end : end + 1]
    seen = _VISIBLE.search(text, end)
    rest = text[seen.start() : seen.start() + 24] if seen else ""
    east = sign[0] in "。！？｡" or (sign[0] == "…" and _EAST.search(text[max(0, at - 2) : at]) is not None)
    if depth > 0:
        return NEVER
    if not rest:
        return ALWAYS
    closes = sign[-1] in CLOSE and sign[-1] not in "…"
    if east:
        if closes and after and not after.isspace():
            return -4.0  # a quotation within a statement that goes on
        return ALWAYS
    if after and not after.isspace() and after not in OPEN:
        return NEVER  # decimals, abbreviations without space, signs in words
    word = _SAID.search(text, seen.start())
    nxt = word.group() if word else ""
    if nxt and nxt.islower():
        return NEVER
    if sign[0] == ".":
        left = _WORD_BEFORE.search(text[max(0, at - 12) : at])
        token = (left.group(1) if left else "").lower().lstrip(".")
        if len(sign) == 1:
            if token in ABBREVIATIONS or (len(token) == 1 and not token.isdigit() and token.isalpha()):
                return NEVER
            if token.isdigit() and len(token) <= 2 and nxt.isupper() and re.match(r"(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jh)", rest):
                return NEVER
            if token in MAY_END or token.endswith((".m", ".b")):
                return 2.0
            if nxt.isdigit() and token in {"no", "nr", "p", "pp", "s", "art", "kap", "ch"}:
                return NEVER
    if closes and sign[0] in "!?" and rest[:1] == ",":
        return NEVER
    if nxt and not nxt.isalnum():
        return -2.0 if nxt in ",;:" else 3.0
    return ALWAYS if nxt.isupper() or nxt.isdigit() or not nxt.isascii() else 6.0


# --- Thai -----------------------------------------------------------------------------------------------------------


def shape(segment: str) -> str:
    """A stretch between white spaces with numbers and Latin words as one sign each."""
    return _LATIN.sub("A", _NUMBER.sub("#", segment))


class ThaiModel:
    """Log odds that a sentence ends in the white space between two stretches."""

    def __init__(self, odds: dict[str, float] | None = None, prior: float = -1.0, mean: float = 4.4, spread: float = 0.6, bars: dict[str, float] | None = None):
        self.odds, self.prior, self.mean, self.spread, self.bars = odds or {}, prior, mean, spread, bars or {}
        self._barred: dict[str, float] = {}

    @staticmethod
    def features(before: str, left: str, right: str, first: bool) -> tuple[str, ...]:
        """Of the gap between two shapes; before: the shape before the left one; first: the left one opens the sentence."""
        f = "1" if first else "0"
        tail = (before[-6:] + " " + left)[-8:]
        return (
            "r5" + right[:5],
            "r12" + right[:12],
            "s3" + tail[-3:],
            "s8" + tail,
            f"l5{f}" + left[:5],
            f"w{f}" + left[-24:] if len(left) <= 24 else f"w{f}+",
            f"p{f}" + left[-4:] + "|" + right[:4],
        )

    def _bar(self, kind: str, pieces: set[str], whole: str) -> float:
        key = kind + whole
        if key not in self._barred:
            if len(self._barred) > 200_000:
                self._barred.clear()
            self._barred[key] = min((self.bars.get(kind + g, 0.0) for g in pieces), default=0.0)
        return self._barred[key]

    def gap(self, before: str, left: str, right: str, first: bool) -> float:
        barred = self._bar("f", _opening_grams(right), right) + self._bar("l", _closing_grams(before, left), before[-6:] + " " + left)
        return self.prior + barred + sum(self.odds.get(f, 0.0) for f in self.features(before, left, right, first))

    def length(self, letters: int) -> float:
        return -0.5 * ((math.log(max(letters, 1)) - self.mean) / self.spread) ** 2


_POLITE = re.compile(r"(?:ครับ|ค่ะ|นะคะ|คะ|หรือไม่[?!]?|[?!]|[^.]\.\.\.?|…)$")


def _opening_grams(right: str) -> set[str]:
    t = "^" + right
    return {t[i : i + GRAM] for i in range(max(1, len(t) - GRAM + 1))}


def _closing_grams(before: str, left: str) -> set[str]:
    t = before[-6:] + " " + left + "$"
    return {t[i : i + GRAM] for i in range(max(1, len(t) - GRAM + 1))}


def _count_pieces(p: list[str], everywhere: Counter, at: Counter) -> None:
    """Pieces of a quote's stretches, by kind (first or last), and of those that do stand first (last)."""
    for k, x in enumerate(p):
        for kind, grams, edge in (("f", _opening_grams(x), k == 0), ("l", _closing_grams(p[k - 1] if k else "", x), k == len(p) - 1)):
            everywhere.update(kind + g for g in grams)
            if edge:
                at.update(kind + g for g in grams)


def _bar_of(n: int, at: int, top: float) -> float:
    """Log of found over expected, where below 0.

    Expected is what a piece would have if its stretches stood first as often
    as those that always do (the upper tenth of the rates).
    """
    expected = top * n
    return max(-8.0, min(0.0, 1.5 * (math.log((at + 1) / (expected + 1)) + 1.2))) if expected >= EXPECTED else 0.0


def _bars(everywhere: Counter, at: Counter) -> dict[str, float]:
    """Pieces of stretches that known first (last) stretches lack."""
    out: dict[str, float] = {}
    for kind in "fl":
        own = {g: n for g, n in everywhere.items() if g[0] == kind}
        rates = sorted(at[g] / n for g, n in own.items() if n >= 30 and at[g] >= 5)
        top = rates[int(0.9 * (len(rates) - 1))] if rates else 1.0
        bars = ((g, _bar_of(n, at[g], top)) for g, n in sorted(own.items(), key=lambda x: (-x[1], x[0]))[: 4 * CELLS])
        out |= {g: v for g, v in bars if v < 0}
    return out


def _stretches(quotes: Iterable[str]) -> list[list[str]]:
    """The shapes of Thai quotes' stretches."""
    parts = [[shape(x) for x in q.split()] for q in quotes if len(_THAI.findall(q)) > 0.4 * len(q)]
    return [p for p in parts if p]


def _first_model(bars: dict[str, float]) -> ThaiModel:
    return ThaiModel(prior=1.0, mean=4.4, spread=0.8, bars=bars)


def _count_split(p: list[str], model: ThaiModel, yes: Counter, no: Counter) -> None:
    """Splits a quote and counts what stands around boundaries and around other gaps; at "z", the spans' letters."""
    cuts = _viterbi(p, model)
    begin = 0
    for k in range(len(p)):
        before = p[k - 1] if k else ""
        if k < len(cuts) and not cuts[k]:
            no.update(ThaiModel.features(before, p[k], p[k + 1], k == begin))
            continue
        if k < len(cuts):
            yes.update(ThaiModel.features(before, p[k], p[k + 1], k == begin))
        else:  # the end of the quote: only what stands before it is known
            yes.update(f for f in ThaiModel.features(before, p[k], "", k == begin) if f[0] in "slw")
        yes[f"z{sum(map(len, p[begin : k + 1]))}"] += 1
        begin = k + 1
    yes.update(("r5" + p[0][:5], "r12" + p[0][:12]))


def _next_model(counts: list[tuple[str, int, int]], n_yes: int, n_no: int, letters: dict[int, int], bars: dict[str, float]) -> ThaiModel:
    """From the most frequent features with their counts, the counts of all gaps, and how many spans have so many letters."""
    n_yes, n_no = max(1, n_yes), max(1, n_no)
    odds = {f: 0.4 * (math.log((a + 0.5) / (n_yes + 1)) - math.log((b + 0.5) / (n_no + 1))) * min(1.0, (a + b) / 5) for f, a, b in counts}
    n = sum(letters.values())
    mean = sum(c * math.log(z) for z, c in sorted(letters.items())) / n
    spread = max(0.25, math.sqrt(sum(c * (math.log(z) - mean) ** 2 for z, c in sorted(letters.items())) / n))
    return ThaiModel(odds, 0.5 + 0.5 * math.log(n_yes / n_no), mean, spread, bars)


def fit_thai(quotes: list[str]) -> ThaiModel:
    """From quotes of whole sentences: their ends are known, the boundaries within are inferred.

    At first a gap is a boundary unless something bars it: a piece of the
    stretch after it that no quote opens with, or of the one before it that none
    closes with. Each round then splits the quotes with the odds so far and
    counts anew what stands around boundaries and around other gaps.
    ``thai_model`` does the same over tasks.
    """
    parts = _stretches(quotes)
    if not parts:
        return ThaiModel()
    everywhere, at = Counter(), Counter()
    for p in parts:
        _count_pieces(p, everywhere, at)
    model = _first_model(_bars(everywhere, at))
    for _ in range(ROUNDS + 1):
        yes, no = Counter(), Counter()
        for p in parts:
            _count_split(p, model, yes, no)
        letters = {int(f[1:]): n for f, n in yes.items() if f[0] == "z"}
        gaps = [sum(n for f, n in c.items() if f.startswith("s3")) for c in (yes, no)]
        most = sorted((f for f in yes.keys() | no.keys() if f[0] != "z"), key=lambda f: (-yes[f] - no[f], f))[:CELLS]
        model = _next_model([(f, yes[f], no[f]) for f in most], *gaps, letters, model.bars)
    return model


def _viterbi(parts: list[str], model: ThaiModel) -> list[bool]:
    """Which gaps of a quote are boundaries."""
    n = len(parts)
    gaps = [(0.0, 0.0)] * n
    for k in range(n - 1):
        fixed = 8.0 if _POLITE.search(parts[k]) else None
        before = parts[k - 1] if k else ""
        gaps[k] = (fixed, fixed) if fixed else (model.gap(before, parts[k], parts[k + 1], False), model.gap(before, parts[k], parts[k + 1], True))
    return _spans([len(p) for p in parts], gaps, [0] * n, model)


def _log1pexp(x: float) -> float:
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


def _spans(sizes: list[int], gaps: list[tuple[float, float]], unbalanced: list[int], model: ThaiModel) -> list[bool]:
    """The dynamic programme: gaps[k] are the log odds of an end after piece k, if pieces precede it in its span and if it opens it."""
    n = len(sizes)
    end = [(-_log1pexp(-a), -_log1pexp(-b)) for a, b in gaps]
    go_on = [(-_log1pexp(a), -_log1pexp(b)) for a, b in gaps]
    best = [0.0] + [-math.inf] * n
    back = [0] * (n + 1)
    for i in range(n):
        inside, size = 0.0, 0
        for j in range(i, n):
            size += sizes[j]
            one = j == i
            s = best[i] + inside + (end[j][one] if j < n - 1 else 0.0) + 0.5 * model.length(size) - 6.0 * (unbalanced[j] != unbalanced[i - 1] if i else unbalanced[j] != 0)
            if s > best[j + 1]:
                best[j + 1], back[j + 1] = s, i
            if j < n - 1:
                inside += go_on[j][one]
                if inside < -60:  # no later end of this span can win: the others only lose less
                    break
    cuts = [False] * max(0, n - 1)
    j = n
    while j > 0:
        j = back[j]
        if j > 0:
            cuts[j - 1] = True
    return cuts


# --- all scripts ----------------------------------------------------------------------------------------------------


def sentence_ends(text: str | None, model: ThaiModel) -> list[int]:
    """End positions of the sentences, each after its last visible character."""
    if not text or not text.strip():
        return []
    depth = _depths(text)
    stop = len(text.rstrip())
    odds: dict[int, tuple[float, float]] = {}
    for m in _END.finditer(text, 0, stop):
        inside = depth[m.start()]
        # closing marks that belong to the quotation leave it
        out = depth[m.end()] if m.end() <= len(text) else 0
        s = _sign_score(text, m.start(), m.end(), min(inside, out))
        if inside > out and s > 0 and m.group()[0] in ".…" and text[m.end() : m.end() + 1] == ",":
            s = NEVER
        if m.end() < stop:
            thai = _THAI.search(text[max(0, m.start() - 3) : m.start()]) is not None
            if thai and m.group()[0] == "." and len(m.group()) == 1:
                continue
            odds[m.end()] = (s, s)
    gaps = [(m.start(), m.end(), "\n" in m.group()) for m in _SPACE.finditer(text, 0, stop) if m.start()]
    pieces = [0] + [e for _, e, _ in gaps] + [stop]
    shapes = [shape(text[a:b].strip()) for a, b in zip(pieces, pieces[1:])]
    begin = 0
    while begin < len(shapes) and not shapes[begin]:
        begin += 1
    for k, (a, b, line) in enumerate(gaps):
        left, right = shapes[k], shapes[k + 1]
        if a in odds or not left or not right:
            continue
        thai = _THAI.search(left) is not None or _THAI.search(right) is not None or (k and left in "A#" and _THAI.search(shapes[k - 1]) is not None)
        if not thai:
            continue
        if depth[a] > 0:
            continue
        if _POLITE.search(left):
            odds[a] = (8.0, 8.0)
        elif line and not _hyphened(text, a):
            odds[a] = (6.0, 6.0)
        else:
            before = shapes[k - 1] if k else ""
            odds[a] = (model.gap(before, left, right, False), model.gap(before, left, right, True))
    ends = sorted(e for e in odds if odds[e][0] > NEVER)
    marks = ends + [stop]
    sizes = [len(text[a:b].strip()) or 1 for a, b in zip([0] + ends, marks)]
    balance = [depth[min(e, len(text))] for e in marks]
    cuts = _spans(sizes, [odds[e] for e in ends] + [(0.0, 0.0)], balance, model if _THAI.search(text) else _FLAT)
    return [e for e, c in zip(ends, cuts) if c] + [stop]


def sign_ends(text: str) -> list[int]:
    """Where terminal signs, with their closing signs, end a sentence: what needs no model."""
    depth = _depths(text)
    out = []
    for m in _END.finditer(text):
        if _THAI.search(text[max(0, m.start() - 3) : m.start()]) and m.group() == ".":
            continue
        if _sign_score(text, m.start(), m.end(), min(depth[m.start()], depth[m.end()])) > 0:
            out.append(m.end())
    return out


def _hyphened(text: str, at: int) -> bool:
    return text[at - 1] in "-‐¬\xad"


class _Flat(ThaiModel):
    def length(self, letters: int) -> float:
        return -0.001 * max(0, letters - 400) / 100


_FLAT = _Flat()


def _counted(quotes: DataFrame, count: Callable[[list[str], Counter, Counter], None]) -> DataFrame:
    """(f, a, b): what ``count`` puts into its two counters, over all quotes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = Counter(), Counter()

        def given() -> pd.DataFrame:
            keys = list(a.keys() | b.keys())
            out = pd.DataFrame({"f": keys, "a": [a[k] for k in keys], "b": [b[k] for k in keys]})
            a.clear()
            b.clear()
            return out.astype({"f": object, "a": "int64", "b": "int64"})

        for batch in batches:
            for p in _stretches(batch["q"]):
                count(p, a, b)
                if len(a) + len(b) > HELD:
                    yield given()
        yield given()

    return settle(quotes.mapInPandas(run, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))


def thai_model(quotes: DataFrame, text: str) -> ThaiModel:
    """``fit_thai`` over all distinct quotes: counts are taken in tasks and added up; the model's own numbers reach the driver."""
    thai = settle(even(quotes.select(F.col(text).alias("q")).filter(F.col("q").rlike("[ก-๎]")).distinct()))
    pieces = _counted(thai, _count_pieces).withColumn("kind", F.substring("f", 1, 1))
    rates = pieces.filter("a >= 30 and b >= 5").select("kind", (F.col("b") / F.col("a")).alias("rate"))
    at = rates.groupBy("kind").agg((F.floor(0.9 * (F.count("*") - 1)) + 1).alias("pos"))
    tops = {r["kind"]: r["rate"] for r in order_statistics(rates, ["kind"], "rate", at).select("kind", F.col("rate")).collect()}
    bars: dict[str, float] = {}
    for kind in "fl":
        top = tops.get(kind, 1.0)
        most = pieces.filter((F.col("kind") == kind) & (top * F.col("a") >= EXPECTED)).orderBy(F.desc("a"), "f").limit(4 * CELLS)
        found = most.filter((F.col("b") + 1) / (top * F.col("a") + 1) < 0.31).collect()  # others have no bar
        bars |= {r["f"]: v for r in found if (v := _bar_of(r["a"], r["b"], top)) < 0}
    model = _first_model(bars)
    for _ in range(ROUNDS + 1):
        counts = _counted(thai, lambda p, a, b, m=model: _count_split(p, m, a, b))
        letters = {int(r["f"][1:]): r["a"] for r in counts.filter("f like 'z%'").collect()}  # a row a length
        if not letters:
            return ThaiModel()
        gaps = counts.filter("f like 's3%'").agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
        most = counts.filter("f not like 'z%'").orderBy(F.desc(F.col("a") + F.col("b")), "f").limit(CELLS).collect()
        model = _next_model([tuple(r) for r in most], *gaps, letters, bars)
    return model


def split_sentences(df: DataFrame, key: str, text: str, model: ThaiModel) -> DataFrame:
    """(key, sentence_no from 1, end_pos, sentence)."""
    schema = f"`{key}` {dict(df.dtypes)[key]}, sentence_no int, end_pos int, sentence string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b["__text"]):
                start = 0
                for n, e in enumerate(sentence_ends(t, model), 1):
                    out.append((k, n, e, t[start:e].strip()))
                    start = e
            yield pd.DataFrame(out, columns=[key, "sentence_no", "end_pos", "sentence"])

    return df.select(key, F.col(text).alias("__text")).filter(F.length(F.trim("__text")) > 0).mapInPandas(run, schema)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    quotes = table(spark, d, "love_claims").groupBy("claim_id").agg(F.max("quote").alias("quote"))
    return split_sentences(quotes, "claim_id", "quote", thai_model(quotes, "quote")).select("claim_id", "end_pos")


def p6_chunk_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of all chunks' texts."""
    model = thai_model(table(spark, d, "love_claims").select("quote"), "quote")
    chunks = delivered_once(table(spark, d, "book_chunks").select("chunk_id", "text"), "chunk_id", ["text"])
    return split_sentences(chunks, "chunk_id", "text", model)


QUERIES = {"p6_found": p6_found, "p6_chunk_sentences": p6_chunk_sentences}
