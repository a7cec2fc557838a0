"""Sections and chunks of texts: folds over the units of one document, in Arrow batches.

Sizes are counted by ``count``, a function of a text: words between white space
unless a word splitter for scripts without spaces is handed in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

Counter = Callable[[str], int]


def words(text: str) -> int:
    return len(text.split())


def units(paragraphs: Sequence[str], most: int, count: Counter = words) -> Iterator[tuple[str, bool]]:
    """(text, begins a paragraph): whole paragraphs, those above ``most`` by phrases."""
    for p in paragraphs:
        if count(p) <= most:
            yield p, True
        else:
            yield from ((phrase, i == 0) for i, phrase in enumerate(p.split(" ")))


def tail(parts: Sequence[str], least: int, count: Counter = words) -> str:
    """The last phrases that together hold at least ``least`` words."""
    phrases = " ".join(parts).split(" ")
    n, k = 0, len(phrases)
    while k > 0 and n < least:
        k -= 1
        n += count(phrases[k])
    return " ".join(phrases[k:])


def render(parts: Sequence[tuple[str, bool]]) -> str:
    """Paragraphs on lines of their own, phrases after a blank."""
    out: list[str] = []
    for text, begins in parts:
        if out:
            out.append("\n" if begins else " ")
        out.append(text)
    return "".join(out).strip()


def pack_units(paragraphs: Sequence[str], size: int = 300, overlap: float = 0.15, least: int = 60, count: Counter = words) -> list[str]:
    """Chunks of at most ``size`` words, each but the first begun by the tail of the one before; a last one below ``least`` joins it."""
    done: list[list[tuple[str, bool]]] = []
    held: list[tuple[str, bool]] = []
    n = 0
    for unit in units(paragraphs, size, count):
        k = count(unit[0])
        if held and n + k > size:
            done.append(held)
            kept = tail([t for t, _ in held], int(size * overlap), count)
            held, n = ([(kept, False)], count(kept)) if kept else ([], 0)
        held.append(unit)
        n += k
    if held and done and n < least:
        known = set(done[-1])
        done[-1] += [u for u in held if u not in known]
    elif held:
        done.append(held)
    return [render(c) for c in done]


def pack(df: DataFrame, key: str, text: str, size: int = 300, overlap: float = 0.15, least: int = 60, count: Counter = words) -> DataFrame:
    """(key, chunk_no from 0, chunk) of the paragraphs (lines) of each text; null and blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b["__t"]):
                lines = [x.strip() for x in t.split("\n") if x.strip()]
                out += [(k, i, c) for i, c in enumerate(pack_units(lines, size, overlap, least, count))]
            yield pd.DataFrame(out, columns=[key, "chunk_no", "chunk"])

    rows = df.select(key, F.col(text).alias("__t")).filter(F.length(F.trim("__t")) > 0)
    return rows.mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, chunk_no int, chunk string")


def merge_small(df: DataFrame, group: list[str], order: str, chapter: str, title: str, text: str, least: int, count: Counter = words) -> DataFrame:
    """(group, first, n_merged, title, n_words): sections below ``least`` words are carried into the next one of their chapter.

    A source may be large, so only sizes and titles of its sections are ordered
    and folded, in sorted partitions that a fold passes through once; texts stay
    where they are.
    """
    narrow = df.select(*group, order, chapter, title, F.col(text).alias("__t"))

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="__t").assign(__n=[count(t or "") for t in b["__t"]])

    kinds = dict(df.dtypes)
    names = [*group, order, chapter, title]
    rows = narrow.mapInPandas(sized, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", __n long")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: tuple | None = None  # (group values, chapter, first, merged, titles, words)
        for b in batches:
            out = []
            for r in b.itertuples(index=False, name=None):
                g, first, ch, t, n = r[: len(group)], *r[len(group) :]
                ch = None if ch is None or ch != ch else ch
                if carry and (carry[0] != g or carry[1] != ch):
                    out.append(carry)
                    carry = None
                now = (g, ch, carry[2] if carry else first, (carry[3] if carry else 0) + 1, [*(carry[4] if carry else []), *([t] if t else [])], (carry[5] if carry else 0) + n)
                carry = now if now[5] < least else None
                if carry is None:
                    out.append(now)
            yield frame(out)
        yield frame([carry] if carry else [])

    def frame(rows_: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*g, first, merged, " / ".join(titles) or None, n) for g, _, first, merged, titles, n in rows_], columns=[*group, "first", "n_merged", "title", "n_words"])

    ordered = rows.repartition(*group).sortWithinPartitions(*group, order)
    return ordered.mapInPandas(fold, ", ".join(f"`{c}` {kinds[c]}" for c in group) + f", first {kinds[order]}, n_merged long, title string, n_words long")
