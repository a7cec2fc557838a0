"""Splitting oversized items at natural boundaries (problem 4).

A text longer than ``limit`` characters is cut into pieces of at most ``limit``,
neighbours sharing exactly ``overlap`` characters. The boundaries are the
positions after a paragraph, a sentence (as the sentence splitter reads its
signs), a word, and, where nothing else is within reach, any letter with its
marks. Every boundary has one farthest legal successor: the last paragraph end
within reach of the next piece (which starts ``overlap`` before the boundary),
else the last sentence end, word end or letter; of each kind rather one from
which the next piece starts with a whole letter too. All greedy cuts follow from squaring the successor table: after k squarings every
start has marked 2^k cuts, so the cuts of a text with n pieces take log2(n)
whole-array steps instead of a walk. The tables of all texts of an Arrow batch
are one array, so short and long texts share the steps.

No shuffle takes place: a text lives in one row. To keep few huge texts from
sitting in one task, oversized rows are spread by a round-robin repartition.

Cases. Null texts have no pieces; texts within the limit, empty ones too, are
one piece. Pieces cover the text and carry the item's own columns along.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from heddle.llm.common import delivered_once, table
from heddle.llm.sentences import sign_ends

LIMIT, OVERLAP = 1500, 150
# Position after the match is a boundary; classes from the best to the worst.
PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*|\n")
WORD = re.compile(r"\s+|[,;:、，；：]")


@cache
def _bound() -> np.ndarray:
    """For code points: 1 if it belongs to the character before it, 2 if to the one after it."""
    out = np.zeros(0x110000, np.uint8)
    for lo, hi in ((0, 0x20000), (0xE0100, 0xE01F0)):
        out[[c for c in range(lo, hi) if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me")]] = 1
    out[[0x0E33, 0x0EB3]] = 1  # vowels written after their consonant
    out[0x200D] = 3  # joins both
    out[0xD] = 2
    out[0x0E40:0x0E45] = 2  # vowels written before their consonant
    return out


def boundary_classes(text: str) -> np.ndarray:
    """For positions 0..len: 3 after a paragraph, 2 a sentence, 1 a word, 0 a letter, -1 within a letter and its marks."""
    rank = np.zeros(len(text) + 1, np.int8)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) > 1:
        bound = _bound()[codes]
        rank[1:-1][((bound[1:] & 1) | (bound[:-1] & 2)) != 0] = -1
    ends = [e + len(text[e : e + 64]) - len(text[e : e + 64].lstrip()) for e in sign_ends(text)]
    for value, at in ((1, [m.end() for m in WORD.finditer(text)]), (2, ends), (3, [m.end() for m in PARAGRAPH.finditer(text)])):
        rank[at] = np.maximum(rank[at], value)
    return rank


CLASSES = (3, 2, 1, 0)


def _starts_whole(rank: np.ndarray, overlap: int) -> np.ndarray:
    """For every position as a cut: the next piece starts between letters."""
    out = np.ones(len(rank), bool)
    if overlap:
        out[overlap:] = rank[:-overlap] >= 0
    return out


def successors(rank: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """For each position taken as a cut, the farthest legal next cut; the end of the text is its own.

    A piece that begins ``overlap`` before cut b reaches to b - overlap + limit
    and must pass b, or nothing would be gained.
    """
    n = len(rank) - 1
    here = np.arange(n + 1)
    reach = np.minimum(here - overlap + limit, n)
    out = reach.copy()
    settled = reach >= n
    whole = _starts_whole(rank, overlap)
    for value in CLASSES:
        for kind in (whole, ~whole):
            last = np.maximum.accumulate(np.where((rank == value) & kind, here, -1))[reach]
            # a cut must gain at least as much as the next piece repeats, or pieces would hardly advance
            good = ~settled & (last > here + overlap)
            out[good] = last[good]
            settled |= good
    return out


def greedy_cuts(next_cut: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All cuts reached from ``starts``, by squaring the successor table."""
    marked = np.zeros(len(next_cut), bool)
    marked[starts] = True
    jump = next_cut
    while True:
        n = np.count_nonzero(marked)
        marked[jump[np.flatnonzero(marked)]] = True
        squared = jump[jump]
        if np.array_equal(squared, jump) and np.count_nonzero(marked) == n:
            return marked
        jump = squared


def first_cut(rank: np.ndarray, limit: int, overlap: int) -> int:
    """The first piece starts at 0 and repeats nothing."""
    whole = _starts_whole(rank, overlap)[: limit + 1]
    for value in CLASSES:
        for kind in (whole, ~whole):
            at = np.flatnonzero((rank[: limit + 1] == value) & kind)
            if len(at) and at[-1] > overlap:
                return int(at[-1])
    return limit


def _pieces(texts: list[str], limit: int, overlap: int) -> list[list[tuple[int, int]]]:
    long = [i for i, t in enumerate(texts) if len(t) > limit]
    spans: list[list[tuple[int, int]]] = [[(0, len(t))] for t in texts]
    if not long:
        return spans
    tables, starts, offset = [], [], 0
    for i in long:
        rank = boundary_classes(texts[i])
        tables.append(successors(rank, limit, overlap) + offset)
        starts.append(first_cut(rank, limit, overlap) + offset)
        offset += len(rank)
    marked = greedy_cuts(np.concatenate(tables), np.array(starts))
    offset = 0
    for i, t in zip(long, tables):
        cuts = np.flatnonzero(marked[offset : offset + len(t)]).tolist()
        spans[i] = list(zip([0] + [c - overlap for c in cuts[:-1]], cuts))
        offset += len(t)
    return spans


def split_texts(df: DataFrame, key: str, text: str = "text", carry: tuple[str, ...] = (), limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, carried columns, piece_no from 0, n_pieces, start, end, piece)."""
    if not 0 <= overlap < limit / 2:
        raise ValueError("the overlap must be less than half the limit")
    names = [key, *carry]
    schema = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in names) + ", piece_no int, n_pieces int, start int, `end` int, piece string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["__text"].tolist()
            spans = _pieces(texts, limit, overlap)
            rows = [(i, k, len(s), x, y, texts[i][x:y]) for i, s in enumerate(spans) for k, (x, y) in enumerate(s)]
            at = [r[0] for r in rows]
            out = b[names].iloc[at].reset_index(drop=True)
            for j, c in enumerate(("piece_no", "n_pieces", "start", "end", "piece")):
                out[c] = [r[j + 1] for r in rows]
            yield out

    rows = df.select(*names, F.col(text).alias("__text")).filter(F.col("__text").isNotNull())
    short = rows.filter(F.length("__text") <= limit).select(
        *names, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.length("__text").alias("end"), F.col("__text").alias("piece")
    )
    long = rows.filter(F.length("__text") > limit)
    long = long.repartition(df.sparkSession.sparkContext.defaultParallelism * 2)
    return short.unionByName(long.mapInPandas(run, schema))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return delivered_once(table(spark, d, "book_chunks").select("chunk_id", "text", "section_title"), "chunk_id", ["text", "section_title"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that come out as more than one piece."""
    return split_texts(_chunks(spark, d), "chunk_id").filter("n_pieces > 1 and piece_no = 0").select("chunk_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(_chunks(spark, d), "chunk_id", carry=("section_title",))


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}
SQL = {"p4_found": r"select distinct lower(trim(chunk_id, E' \t\n\r')) chunk_id from book_chunks where length(text) > 1500"}
