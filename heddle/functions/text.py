"""Scalar text functions as Column expressions; all stay in whole-stage code generation but where a note says so.

Null in, null out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

THAI = r"[฀-๿]"


def fix_sara_am(c: Column) -> Column:
    """A consonant, its tone mark, white space and sara aa are one sara am."""
    return F.regexp_replace(c, r"([ก-ฮ][่-๋]?)[ \t]+า", "$1ำ")


def drop_stray_glyphs(c: Column) -> Column:
    return F.regexp_replace(c, rf"[Î·](?={THAI})", "")


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t ]+", " "))


def clean_lines(c: Column, noise: str) -> Column:
    """Lines trimmed and collapsed, without blank ones and those that a noise pattern matches at their start."""
    lines = F.transform(F.split(c, "\n"), collapse_space)
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(f"^(?:{noise})"))


def join_lines(lines: Column) -> Column:
    """One paragraph of an array of lines: no space between Thai letters, else one. Each line looks at the one before it only."""
    def glued(x: Column, i: Column) -> Column:
        left = F.get(lines, i - 1)
        return F.when(i == 0, x).when(left.rlike(THAI + "$") & x.rlike("^" + THAI), x).otherwise(F.concat(F.lit(" "), x))

    return F.array_join(F.transform(lines, glued), "")


def strip_citations(c: Column) -> Column:
    """Without numbers of one or two digits in round brackets, such as (1) or (2, 3-5); blanks collapse, ends are trimmed."""
    bare = F.regexp_replace(c, r"\(\d{1,2}(?:\s*[,\-–]\s*\d{1,2})*\)", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[ \t\u00a0]+", " "), r"^\s+|\s+$", "")


def redact_contacts(c: Column) -> Column:
    """URLs, e-mail addresses and handles become marks."""
    c = F.regexp_replace(c, r"https?://\S+|www\.\S+", "[url]")
    c = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    return F.regexp_replace(c, r"@[A-Za-z0-9_]{3,}", "[handle]")


def redact(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, made in rules:
        c = F.regexp_replace(c, pattern, made)
    return c


def thai_ratio(c: Column) -> Column:
    """Thai letters of all letters, two places; 0 without letters."""
    letters = F.length(F.regexp_replace(c, r"[^A-Za-zก-ฮ]", ""))
    thai = F.length(F.regexp_replace(c, r"[^ก-ฮ]", ""))
    return F.when(letters > 0, F.round(thai / letters, 2)).otherwise(F.lit(0.0))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""))


def grams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams without white space; empty for shorter texts. The look-ahead finds overlapping ones in one pass."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(c, r"\s+", ""), F.lit("(?s)(?=(" + "." * n + "))"), F.lit(1)))


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's n-grams (arrays) that the text has."""
    return F.size(F.array_intersect(query, text)) / F.greatest(F.lit(1), F.size(query))


def jaccard(a: Column, b: Column) -> Column:
    """0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 1.6).cast("int") + 1


def elide(c: Column, size: int, mark: str = " … ") -> Column:
    """The ends of a text longer than ``size``, its middle replaced by a mark."""
    head = (size - len(mark)) // 2
    tail = size - len(mark) - head
    return F.when(F.length(c) <= size, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(mark), F.substring(c, -tail, tail)))


def citations(c: Column) -> Column:
    """Distinct numbers of bracketed citations in order of appearance."""
    groups = F.regexp_extract_all(c, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*,\s*"), lambda x: x.cast("int")))))


def excerpt(query: Column, text: Column, size: int) -> Column:
    """``size`` characters of the text around its first occurrence of a query word; its beginning without one."""
    words = F.filter(F.split(query, r"\s+"), lambda w: F.length(w) >= 3)
    at = F.array_min(F.filter(F.transform(words, lambda w: F.position(w, text)), lambda i: i > 0))
    return F.substring(text, F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - size // 2), F.lit(size))


def digest(*columns: Column) -> Column:
    """SHA-256 of values joined by a unit separator; null counts as empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def edge_id(source: Column, relation: Column, target: Column, discriminator: Column) -> Column:
    return F.concat(F.lit("edge:"), F.substring(digest(source, relation, target, discriminator), 1, 24))


def quoted(word: str) -> str:
    """A word as a pattern that matches itself, in Java and in RE2."""
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|/-" else c for c in word)


def keyword_pattern(word: str, negation: bool = True, near: Sequence[str] = (), not_after: Sequence[str] = (), not_before: Sequence[str] = ()) -> str:
    """A pattern for one keyword as a whole ASCII word or a stretch of another script.

    ``negation``: not right after a Thai "not" and at most four letters (which
    "no matter" does not count as); ``near``: one of these within 60 characters;
    ``not_after``, ``not_before``: what must not touch it.
    """
    core = rf"\b{quoted(word)}\b" if word.isascii() else quoted(word)
    behind = rf"(?<!{'|'.join(map(quoted, not_after))})" if not_after else ""
    ahead = rf"(?!{'|'.join(map(quoted, not_before))})" if not_before else ""
    no = r"(?<!ไม่(?!ว่า)\S{0,4})" if negation else ""
    one = f"{no}{behind}{core}{ahead}"
    if not near:
        return "(?i)" + one
    words = "|".join(map(quoted, near))
    return rf"(?i)(?:(?<=(?:{words})[\s\S]{{0,60}}){one}|{one}(?=[\s\S]{{0,60}}(?:{words})))"


def keyword_counts(c: Column, keywords: dict[str, Sequence[str]]) -> Column:
    """Map of id to the number of matches of its patterns, ids without one left out: one row in, one row out, no shuffle."""
    entries = [F.struct(F.lit(k).alias("key"), sum(F.regexp_count(c, F.lit(p)) for p in ps).alias("value")) for k, ps in keywords.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"] > 0))


def first_of(c: Column, words: Sequence[str]) -> Column:
    """The first of ``words`` that the text holds, null if none."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(w)), F.lit(w)) for w in words])


def any_of(c: Column, words: Sequence[str]) -> Column:
    return c.rlike("|".join(map(quoted, words)))


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Likeness of two words by their pairs of neighbouring letters, white space and case apart."""
    return jaccard(grams(F.lower(a), 2), grams(F.lower(b), 2))
