"""Garbled text from wrong character encoding (problem 5).

A transformation is a pair of codecs (wrong, right): the bytes of a text in
``right`` were read as ``wrong``. Records with characters that no clean text of
the six languages has are suspects. ``learn_transformations`` joins stretches
of suspects with clean near-twins: runs of five words that are equal once all
non-ASCII characters are stripped and that hold TWIN characters at least. The
characters of each pair are aligned, and every transformation that maps the
clean stretch to the suspect's gets a vote. ``garbled_spans`` then marks, in
all suspects, what the learned transformations explain, in order of their
votes. Only where something unusual is left does a catalogue of further codec
pairs follow, for what no twin has taught.

Scale. The suspects are picked by one character class in the scan. Twins meet in
an equi-join on a hash of their stripped words; repeated stretches shrink in a
partial aggregate on either side, so what many records share is one row. The
votes come back as one count per transformation. Marking and restoring are one
map over the suspects.

Cases. Null and empty texts are clean. Characters lost for good (U+FFFD) mark a
record, though only other stretches of it can be restored. Signs such as
(c), +-, 1/2 that stand alone are clean, and so are accented names. Without a
twin nothing is learned and the catalogue alone decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from heddle.llm.common import delivered_once, settle, table

# fixed values: codecs for which text is commonly mistaken, and those it commonly was in
SINGLE = ("cp1252", "latin-1", "cp874", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1254", "koi8-r", "iso8859-15")
DOUBLE = ("gbk", "big5", "cp932", "euc_jp", "cp949")
LEGACY = ("tis-620", "cp874", "gbk", "cp932", "big5", "euc_jp", "cp949")
LETTERS = "àâäçéèêëîïôöùûüœæßÀÂÄÇÉÈÊËÎÏÔÖÙÛÜŒÆ"
SIGNS = "“”„‘’‚…–—•«»°·§€£©®™±½¼¾×²³µ¡¿ ­"
_PLAIN = re.compile(rf"[฀-๛　-ヿ一-鿿＀-￯{LETTERS}{SIGNS}\s\x20-\x7e‹›‐‑−≤≥→←†‡✓★♥]+")


def _byte_chars(codec: str) -> dict[int, str]:
    """Byte -> character; undefined bytes of Windows code pages pass as C1 controls."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


@cache
def _single(codec: str) -> tuple[dict[str, int], re.Pattern]:
    """Character -> byte, and the pattern of runs that are well-formed UTF-8 once turned back into bytes."""
    chars = _byte_chars(codec)

    def span(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(chars[b]) for b in range(lo, hi + 1)) + "]"

    tail = span(0x80, 0xBF)
    pattern = f"(?:{span(0xC2, 0xDF)}{tail}|{span(0xE0, 0xEF)}{tail}{{2}}|{span(0xF0, 0xF4)}{tail}{{3}})+"
    return {c: b for b, c in chars.items()}, re.compile(pattern)


def _back(run: str, codec: str) -> bytes | None:
    table_, _ = _single(codec)
    try:
        return bytes(ord(c) if ord(c) < 128 else table_[c] for c in run)
    except KeyError:
        return None


def _sensible(text: str) -> bool:
    return bool(text) and _PLAIN.fullmatch(text) is not None


def _natural(run: str) -> bool:
    """Whether a run might stand in clean text as it is: Thai, East Asian or accented letters only."""
    return re.fullmatch(rf"[฀-๛]+|[぀-ヿ一-鿿]+|[{LETTERS}]+", run) is not None


_WIDE = re.compile(r"[^\x00-\x7f฀-๛]{3,}")
_HIGH = re.compile(r"[\u0080-ÿ€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ˘˙˚˝˛ˇ∏π∫Ω∞±≤≥∂∑√≈∆◊]{4,}")
_HIGH_CLEAN = re.compile(rf"[{SIGNS}‚„]+|[{LETTERS}’]{{1,4}}")
_FOREIGN = re.compile(r"[Ā-ŒŔ-ſƀ-˅ˈ-˙̀-෿຀-῿]+")
_MIXED = re.compile(r"[A-Za-z](?:[^\x00-\x7f฀-๛　-ヿ一-鿿’‘'‐‑·­¬–—…“”]+)(?=[A-Za-z])|(?<![^\s(«“„])[^\x00-\x7f฀-๛‐-‧　-ヿ一-鿿](?=[a-z]{2})")

Span = tuple[int, int, str, str, str | None]  # start, end, wrong, right, restored
Pairs = tuple[tuple[str, str], ...] | None  # transformations; None: the whole catalogue


def _utf8_spans(text: str, pairs: Pairs = None) -> list[Span]:
    out: list[Span] = []
    for codec in SINGLE if pairs is None else [w for w, r in pairs if r == "utf-8" and w in SINGLE]:
        for m in _single(codec)[1].finditer(text):
            raw = _back(m.group(), codec)
            try:
                made = raw.decode("utf-8") if raw else ""
            except UnicodeDecodeError:
                continue
            again = _restore_once(made) if not _sensible(made) else None
            if again and _sensible(again):
                made = again
            inside = text[m.start() - 1 : m.start()].isascii() and text[m.start() - 1 : m.start()].isalpha()  # Thai letters inside a Latin word
            if codec == "cp874" and "ก" <= text[m.end() : m.end() + 1] <= "๛":  # a Thai word that follows a Latin one without a space
                inside = False
            if not _sensible(made) or (len(made) < 3 and _natural(m.group()) and not inside):
                continue
            if codec == "cp874" and len(made) < 2 and made not in SIGNS and not inside:  # clean Thai may hold one such triple
                continue
            out.append((m.start(), m.end(), codec, "utf-8", made))
    return out


def _restore_once(text: str) -> str | None:
    spans = _best(_utf8_spans(text))
    return _apply(text, spans) if spans else None


def _share(made: str) -> float:
    return sum(_sensible(c) for c in made) / max(1, len(made))


def _wide_spans(text: str, pairs: Pairs = None) -> list[Span]:
    """UTF-8 read as a two-byte East Asian code."""
    out: list[Span] = []
    for m in _WIDE.finditer(text):
        run = m.group()
        for codec in DOUBLE if pairs is None else [w for w, r in pairs if r == "utf-8" and w in DOUBLE]:
            raw = run.encode(codec, "ignore")
            if len(raw) < 1.2 * len(run):
                continue
            made = raw.decode("utf-8", "replace")
            good = made.replace("�", "")
            if len(good) >= 3 and len(good) >= 0.7 * len(made) and re.search("[฀-๛぀-ヿ一-鿿]", good) and _share(good) > 0.9:
                clean = "�" not in made and raw.decode(codec) == run
                out.append((m.start(), m.end(), codec, "utf-8", made if clean else None))
    return out


def _legacy_spans(text: str, pairs: Pairs = None) -> list[Span]:
    """A legacy code of non-Latin script read as a Latin one: long runs of high characters."""
    out: list[Span] = []
    for m in _HIGH.finditer(text):
        run = m.group()
        if _HIGH_CLEAN.fullmatch(run):
            continue
        found: list[Span] = []
        for wrong in ("cp1252", "latin-1", "mac_roman"):
            raw = _back(run, wrong)
            for right in LEGACY if raw else ():
                if pairs is not None and (wrong, right) not in pairs:
                    continue
                try:
                    made = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                if _sensible(made) and re.search("[฀-๛぀-ヿ一-鿿]", made):
                    found.append((m.start(), m.end(), wrong, right, made))
        out += found[:1] or ([(m.start(), m.end(), "?", "?", None)] if pairs is None else [])
    return out


def _foreign_spans(text: str, pairs: Pairs = None) -> list[Span]:
    """Thai in TIS-620 read as UTF-8, with what was not well-formed left out: letters of rare scripts."""
    out: list[Span] = []
    if pairs is not None and ("utf-8", "tis-620") not in pairs:
        return out
    for m in _FOREIGN.finditer(text):
        try:
            made = m.group().encode("utf-8").decode("tis-620")
        except UnicodeError:
            continue
        if re.fullmatch("[ก-๛]{2,}", made):
            out.append((m.start(), m.end(), "utf-8", "tis-620", made))
    return out if sum(e - s for s, e, *_ in out) >= 2 else []


def _letter_spans(text: str, pairs: Pairs = None) -> list[Span]:
    """Accented letters of one single-byte code read as another."""
    found: dict[tuple[str, str], list[Span]] = {}
    odd = [(m.end() - len(run), m.end(), run) for m in _MIXED.finditer(text) for run in [m.group().lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] if run and not re.fullmatch(f"[{LETTERS}]+", run)]
    if not odd:
        return []
    for wrong in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850"):
        for right in ("cp1252", "mac_roman", "cp437", "cp850"):
            if wrong == right or pairs is not None and (wrong, right) not in pairs:
                continue
            for s, e, run in odd:
                raw = _back(run, wrong)
                made = raw.decode(right, "replace") if raw else ""
                if made and re.fullmatch(f"[{LETTERS}’]+", made):
                    found.setdefault((wrong, right), []).append((s, e, wrong, right, made))
    best = max(found.values(), key=len, default=[])
    return best if len(best) >= 2 and len(best) >= 0.6 * len(odd) else []


def _best(spans: list[Span], learned: tuple[tuple[str, str], ...] = ()) -> list[Span]:
    """Of overlapping spans the learned transformation's, else the longest; in order."""
    rank = {t: i for i, t in enumerate(learned)}
    taken: list[Span] = []
    for s in sorted(spans, key=lambda s: (rank.get(s[2:4], len(rank)), -(s[1] - s[0]), s[4] is None)):
        if all(s[1] <= t[0] or s[0] >= t[1] for t in taken):
            taken.append(s)
    return sorted(taken)


def _apply(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s, e, _, _, made in spans:
        out += [text[at:s], text[s:e] if made is None else made]
        at = e
    return "".join(out) + text[at:]


# What no clean text of the six languages has: characters of none of them, and sequences that arise when bytes are read wrongly.
_ODD = (
    rf"[^฀-๛　-ヿ一-鿿＀-￯{LETTERS}{SIGNS}\s\x20-\x7e‹›‐‑−≤≥→←†‡✓★♥]|[\x80-\x9f\ufffd]|[ÂÃ][\xa0-\xbf]|â€|เ[ธน].เ[ธน]|โ€|[A-Za-z][รยล][€…‘’“”•–—\xa0ก-ฟ]"
    r"|‚Ä[^a-z]|[a-zß-ÿ][À-ÞŒ]|[a-z][«»·§€£©®™±½¼¾×²³µ¡¿‚†‡][a-zß-ÿ]|[†‡‚„]{2}|[‡∏]"
)
_SUSPECT = re.compile(_ODD)


def _spans(text: str, pairs: Pairs = None) -> list[Span]:
    """What the transformations explain, in any order, with overlaps."""
    found = _utf8_spans(text, pairs) + _wide_spans(text, pairs) + _legacy_spans(text, pairs) + _foreign_spans(text, pairs)
    return found or _letter_spans(text, pairs)


def garbled_spans(text: str | None, learned: tuple[tuple[str, str], ...] = ()) -> list[Span]:
    """Garbled stretches of a text, in order; empty for clean ones.

    The learned transformations come first; the catalogue is asked where
    something unusual lies outside of what they explain.
    """
    if not text or not _SUSPECT.search(text):
        return []
    spans = _best(_spans(text, learned), learned) if learned else []
    if not spans or _SUSPECT.search(_masked(text, spans)):
        spans = _best(spans + _spans(_masked(text, spans)), learned)
    lost = [(m.start(), m.end(), "?", "?", None) for m in re.finditer("�+", text)]
    return spans + [x for x in lost if all(x[1] <= s[0] or x[0] >= s[1] for s in spans)]


def _masked(text: str, spans: list[Span]) -> str:
    """The text with the spans blank, so that positions stay."""
    for s, e, *_ in spans:
        text = text[:s] + " " * (e - s) + text[e:]
    return text


def restore(text: str, learned: tuple[tuple[str, str], ...] = ()) -> str:
    """The text with every stretch that can be regained, repeated for text garbled twice."""
    return _restored(text, garbled_spans(text, learned), learned)[0]


def _restored(text: str, spans: list[Span], learned: tuple[tuple[str, str], ...]) -> tuple[str, bool]:
    """The restored text, and whether nothing garbled is left; ``spans``: those of the text."""
    for _ in range(3):
        good = [s for s in spans if s[4] is not None]
        if not good:
            break
        text = _apply(text, sorted(good))
        spans = garbled_spans(text, learned)
    return text, not spans


def align(garbled: str, clean: str) -> Counter:
    """Transformations that map stretches of the clean twin to those of the garbled one.

    The ASCII characters of twins agree, so they cut both into as many stretches.
    """
    a, b = (re.findall(r"[^\x00-\x7f]+", t) for t in (garbled, clean))
    votes: Counter = Counter()
    if len(a) != len(b):
        return votes
    for x, y in zip(a, b):
        if x == y or "\ufffd" in x:  # what is lost tells nothing
            continue
        for right in ("utf-8", *LEGACY, "cp1252", "mac_roman", "cp850"):
            try:
                raw = y.encode(right)
            except UnicodeEncodeError:
                continue
            for wrong in (*SINGLE, *DOUBLE, "utf-8"):
                if wrong != right and (_back(x, wrong) == raw if wrong in SINGLE else raw.decode(wrong, "replace") == x):
                    votes[(wrong, right)] += 1
    return votes


WORDS, TWIN = 5, 15  # words of a stretch; ASCII characters that it must hold


def stretches(rows: DataFrame) -> DataFrame:
    """(key, raw, n): runs of WORDS words with characters beyond ASCII, under a hash of what is left without those."""
    words = rows.filter(F.col("text").rlike("[^\\x00-\\x7f]") & F.col("text").rlike("[A-Za-z]{3}")).select(F.split("text", "[ \\t\\r\\n]+").alias("w")).filter(F.size("w") >= WORDS)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (WORDS - 1)), lambda i: F.array_join(F.slice("w", i, WORDS), " "))
    one = words.select(F.explode(runs).alias("raw")).filter(F.col("raw").rlike("[^\\x00-\\x7f]")).withColumn("bare", F.regexp_replace("raw", r"[^\x21-\x7e]+", ""))
    return one.filter(F.length("bare") >= TWIN).groupBy(F.xxhash64("bare").alias("key"), "raw").agg(F.count("*").alias("n"))


def learn_transformations(rows: DataFrame) -> list[tuple[tuple[str, str], int]]:
    """Transformations with the number of stretches that show them, most first; at most one per codec pair. ``rows``: text, odd."""
    bad = stretches(rows.filter("odd")).withColumnRenamed("raw", "bad")
    good = stretches(rows.filter("not odd")).select("key", F.col("raw").alias("good"))
    pairs = bad.join(good, "key").filter("bad <> good").select("bad", "good", "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        votes: Counter = Counter()
        for b in batches:
            for x, y, n in zip(b["bad"], b["good"], b["n"]):
                for t, k in align(x, y).items():
                    votes[t] += k * n
        yield pd.DataFrame([(w, r, n) for (w, r), n in votes.items()], columns=["wrong", "right", "n"])

    counts = pairs.mapInPandas(run, "wrong string, right string, n long").groupBy("wrong", "right").agg(F.sum("n").alias("n"))
    return [((r["wrong"], r["right"]), r["n"]) for r in counts.orderBy(F.desc("n"), "wrong", "right").collect()]


def mark_suspects(df: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, text, odd): odd texts have what clean ones have not."""
    return df.select(key, F.col(text).alias("text")).withColumn("odd", F.coalesce(F.col("text").rlike(_ODD), F.lit(False)))


def restore_garbled(df: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, text, restored, complete, learned) of garbled records.

    complete: nothing garbled is left; learned: the transformations learned from
    twins explain something of it.
    """
    rows = settle(mark_suspects(df, key, text))
    pairs = tuple(t for t, _ in learn_transformations(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["chunk_id"], b["text"]):
                spans = garbled_spans(t, pairs)
                if spans:
                    made, whole = _restored(t, spans, pairs)
                    out.append((k, t, made, whole, any(x[2:4] in pairs for x in spans)))
            yield pd.DataFrame(out, columns=["chunk_id", "text", "restored", "complete", "learned"])

    bad = rows.filter("odd").select(F.col(key).alias("chunk_id"), "text").repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
    return bad.mapInPandas(run, "chunk_id string, text string, restored string, complete boolean, learned boolean").withColumnRenamed("chunk_id", key)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return delivered_once(table(spark, d, "book_chunks").select("chunk_id", "text"), "chunk_id", ["text"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return restore_garbled(_chunks(spark, d)).select("chunk_id")


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return restore_garbled(_chunks(spark, d))


QUERIES = {"p5_found": p5_found, "p5_restored": p5_restored}
