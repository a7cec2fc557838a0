"""Evaluation texts leaking into training text (problem 9).

Texts are compared by their letters alone (case, digits, white space, invisible
characters and punctuation do not count). The fingerprint of a window is the
64-bit SimHash of its shingles of ``SHINGLE`` letters. Items have windows of
two sizes at every letter: large ones, as long as an item where the counters
reach so far, and small ones that fit between exchanged words. Documents have
the same windows at every ``stride`` letters, so that a stretch of a window and
a stride holds one whole. Fingerprints within RADIUS differ in at most RADIUS
bits, so of RADIUS + 1 blocks at least one agrees: a lookup per block finds all
of them. Windows that follow one another in both texts form stretches; a
document and an item whose stretches reach FLOOR of the item are verified. Runs
of at least RUN equal letters, with exchanged words between two of them, are
passages if they reach PASSAGE letters; what the document's passages hold of
the item, in the item's order, must be more than half of it. How much text
stands between passages does not matter; phrases by themselves do not count.

Scale. The evaluation items are the stated query set; they are taken in blocks
of at most ITEM_BYTES of text, each sent along with the task, and every
document meets each block in one map over the corpus: no shuffle, nothing of
the documents leaves its row. The positions of many documents are fingerprinted
together, and those of one long document in segments of SEGMENT letters: eight
bit counters fit a 64-bit word, and the sums of sliding windows are differences
of one running sum that both sizes share. Only every stride-th window of a
document is looked up; the items, which are few, have all of theirs.

Cases. Null or empty documents and items hold nothing. Items of at most SHORT
letters are verified wherever a document has one of their runs, those below RUN
letters must be held whole. Items of equal text are reported each. A document
that holds several items has a row for each; repeated documents are all
reported.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from heddle.llm.common import table

SHINGLE, RADIUS = 6, 3
SCALES = ((96, 32), (24, 6))  # (shingles of a window, letters from one window of a document to the next)
MIN_SHARE = 0.5
FLOOR = 0.35  # share of an item that stretches of windows must reach before it is verified
RUN, PASSAGE = 12, 40  # letters of a run, and of a passage of runs
EXCHANGED = 16  # letters of an exchanged word, at most
SHORT = 80
SEGMENT = 1_500_000
ITEM_BYTES = 8_000_000
_MARKS = "".join(chr(c) for c in range(0xE31, 0xE4F) if not chr(c).isalnum())
_OTHER = re.compile(rf"[^\w{_MARKS}]+|[\d_]+")

_rng = np.random.default_rng(20240607)
_MIX = _rng.integers(1, 2**63, 2, dtype=np.uint64) | np.uint64(1)
# a byte's bits spread over eight counters of eight bits
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)
_GATHER = np.uint64(0x0102040810204080)


def letters(text: str | None) -> str:
    """Lower-case letters with their marks; nothing else."""
    return _OTHER.sub("", (text or "").lower())


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row and where each begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32).astype(np.uint64), np.cumsum(sizes) - sizes


def shingle_hashes(codes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash for the shingle at every position but the last width - 1."""
    if len(codes) < width:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(codes) - width + 1, np.uint64)
    for k in range(width):
        h = h * _MIX[0] + codes[k : len(codes) - width + 1 + k]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    return h ^ (h >> np.uint64(32))


def simhashes(hashes: np.ndarray, windows: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """For each (size, starts) the 64-bit SimHash of the runs of ``size`` shingles (at most 127) from each start."""
    out = [np.zeros(len(at), np.uint64) for _, at in windows]
    top = np.uint64(0x8080808080808080)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    for byte in range(8):
        np.cumsum(_SPREAD[(hashes >> np.uint64(8 * byte)) & np.uint64(255)], out=sums[1:])
        for prints, (size, at) in zip(out, windows):
            most = np.uint64(sum((127 - size // 2) << (8 * k) for k in range(8)))
            over = ((sums[at + size] - sums[at]) + most) & top  # more than half of the window sets the bit
            prints |= (((over >> np.uint64(7)) * _GATHER) >> np.uint64(56)) << np.uint64(8 * byte)
    return out


class Windows:
    """The windows of one size of all items, with a lookup per block of their fingerprints."""

    def __init__(self, prints: np.ndarray, owner: np.ndarray, place: np.ndarray):
        self.prints, self.owner, self.place = prints, owner, place
        bits = 64 // (RADIUS + 1)
        self.blocks = []
        for k in range(RADIUS + 1):
            mask = np.uint64(((1 << bits) - 1) << (bits * k))
            part = (prints & mask) >> np.uint64(bits * k)
            order = np.argsort(part, kind="stable")
            first = np.searchsorted(part[order], np.arange(1 << bits, dtype=np.uint64)).astype(np.int64)
            self.blocks.append((np.uint64(bits * k), mask, order, first, np.bincount(part.astype(np.int64), minlength=1 << bits)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in ``prints``, window) within RADIUS, each once: from the first block that agrees."""
        lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (shift, mask, order, first, count) in enumerate(self.blocks):
            part = ((prints & mask) >> shift).astype(np.int64)
            times = count[part]
            some = np.flatnonzero(times)
            times = times[some]
            left = np.repeat(some, times)
            right = order[np.repeat(first[part[some]] - np.cumsum(times) + times, times) + np.arange(len(left))]
            apart = prints[left] ^ self.prints[right]
            close = np.flatnonzero(np.bitwise_count(apart) <= RADIUS)
            for _, earlier, *_ in self.blocks[:k]:
                close = close[(apart[close] & earlier) != 0]
            lefts.append(left[close])
            rights.append(right[close])
        return np.concatenate(lefts), np.concatenate(rights)


class Items:
    """A block of items with the lookup tables of their windows and runs."""

    def __init__(self, ids: list[str], texts: list[str]):
        self.ids, self.texts = ids, [letters(t) for t in texts]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.whole = [i for i, n in enumerate(self.sizes) if 0 < n < RUN]  # too short for a run
        self.short = [i for i, n in enumerate(self.sizes) if RUN <= n <= SHORT]
        codes, first = _codes(self.texts)
        hashes = shingle_hashes(codes)
        place = np.arange(len(hashes))
        owner = np.searchsorted(first, place, side="right") - 1
        self.windows = []
        for size, _ in SCALES:
            at = place[(place + size + SHINGLE - 1 <= (first + self.sizes)[owner]) & (self.sizes[owner] > SHORT)]
            self.windows.append(Windows(simhashes(hashes, [(size, at)])[0], owner[at], at - first[owner[at]]))
        runs = [shingle_hashes(codes[a : a + n], RUN) for a, n in zip(first, self.sizes)]
        order = [np.argsort(r, kind="stable") for r in runs]
        self.runs = [(r[o], o) for r, o in zip(runs, order)]
        self.short_runs = np.unique(np.concatenate([np.zeros(0, np.uint64), *[runs[i] for i in self.short]]))

    def candidates(self, docs: list[str]) -> list[tuple[int, int]]:
        """(document, item) whose stretches reach FLOOR of the item, or that share a run with a short item."""
        pairs: set[tuple[int, int]] = {(d, i) for i in self.whole for d, t in enumerate(docs) if t}
        met: list[np.ndarray] = []  # (document and item, letters of stretches)
        reach = max(s for s, _ in SCALES) + SHINGLE - 1
        for part in _segments([len(t) for t in docs], reach):
            codes, first = _codes([docs[d][a:z] for d, a, z in part])
            doc = np.array([d for d, _, _ in part])
            end = np.append(first[1:], len(codes))
            hashes = shingle_hashes(codes)
            place = np.arange(len(hashes))
            owner = np.searchsorted(first, place, side="right") - 1
            starts = []
            for size, stride in SCALES:
                at = np.flatnonzero((place - first[owner]) % stride == 0)
                starts.append((size, at[at + size + SHINGLE - 1 <= end[owner[at]]]))
            for windows, (size, at), prints in zip(self.windows, starts, simhashes(hashes, starts)):
                if len(windows.prints) and len(at):
                    same, inverse = np.unique(prints, return_inverse=True)  # texts repeat phrases
                    left, right = windows.near(same)
                    times = np.bincount(inverse, minlength=len(same))
                    order = np.argsort(inverse, kind="stable")
                    begin = np.cumsum(times) - times
                    n = times[left]
                    rows = order[np.repeat(begin[left] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    met.append(self._stretches(at[rows], doc[owner[at[rows]]], windows, np.repeat(right, n), size + SHINGLE - 1))
            if len(self.short_runs):
                inside = np.flatnonzero(np.isin(shingle_hashes(codes, RUN), self.short_runs))
                at = np.searchsorted(first, inside, side="right") - 1
                pairs.update((d, i) for d in set(doc[at].tolist()) for i in self.short)
        if met:
            rows = np.concatenate(met)
            keys, inverse = np.unique(rows[:, 0], return_inverse=True)
            sums = np.bincount(inverse.ravel(), rows[:, 1])
            d, i = keys // len(self.ids), keys % len(self.ids)
            good = sums >= FLOOR * self.sizes[i]
            pairs.update(zip(d[good].tolist(), i[good].tolist()))
        return sorted(pairs)

    def _stretches(self, at: np.ndarray, doc: np.ndarray, windows: Windows, right: np.ndarray, letters_: int) -> np.ndarray:
        """Rows (document and item, letters): windows that follow one another in both texts, and the first of each stretch."""
        key = doc * len(self.ids) + windows.owner[right]
        order = np.lexsort((at - windows.place[right], at, key))
        key, at, apart = key[order], at[order], (at - windows.place[right])[order]
        gain = np.full(len(key), -1)
        for back in (1, 2, 3):
            near = np.zeros(len(key), bool)
            step = at[back:] - at[:-back]
            near[back:] = (key[back:] == key[:-back]) & (step <= letters_ + EXCHANGED) & (np.abs(apart[back:] - apart[:-back]) <= EXCHANGED)
            gain[back:] = np.where((gain[back:] < 0) & near[back:], step, gain[back:])
        follows = gain >= 0
        begins = np.zeros(len(key), bool)
        begins[:-1] = ~follows[:-1] & follows[1:]
        gain = np.where(follows, gain, np.where(begins | (letters_ > PASSAGE), letters_, 0))
        return np.stack([key, gain], axis=1)

    def held(self, doc: str, item: int, least: float = 0.0) -> float:
        """Share of the item's letters that the document's passages hold in the item's order; 0 where it cannot exceed ``least``."""
        text = self.texts[item]
        if len(text) < RUN:
            return float(text in doc)
        hashes, order = self.runs[item]
        at: list[np.ndarray] = []
        for lo in range(0, max(1, len(doc) - RUN + 1), SEGMENT):
            runs = shingle_hashes(_codes([doc[lo : lo + SEGMENT + RUN - 1]])[0], RUN)
            a = np.searchsorted(hashes, runs, side="left")
            n = np.searchsorted(hashes, runs, side="right") - a
            d = np.repeat(np.arange(len(runs)), n)
            i = order[np.repeat(a - np.cumsum(n) + n, n) + np.arange(len(d))]
            at.append(np.stack([d + lo, i], axis=1))
        kept = passages(np.concatenate(at), min(PASSAGE, max(RUN, len(text) // 2)))
        if kept[:, 2].sum() + EXCHANGED * len(kept) <= least * len(text):
            return 0.0
        return ordered_letters(kept, len(text)) / len(text)


def _segments(sizes: list[int], reach: int) -> Iterator[list[tuple[int, int, int]]]:
    """Stretches (document, begin, end) in lots of about SEGMENT letters; those of one document overlap by a window."""
    lot: list[tuple[int, int, int]] = []
    held = 0
    for d, n in enumerate(sizes):
        for lo in range(0, max(1, n), SEGMENT):
            lot.append((d, lo, min(n, lo + SEGMENT + reach - 1)))
            held += lot[-1][2] - lo
            if held >= SEGMENT:
                yield lot
                lot, held = [], 0
    if lot:
        yield lot


def passages(starts: np.ndarray, least: int) -> np.ndarray:
    """Runs (begin in the document, begin in the item, letters) of passages of at least ``least`` letters.

    ``starts``: rows (place in the document, place in the item) where RUN letters
    agree. Runs with at most an exchanged word between them in both texts are of
    one passage.
    """
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    starts = starts[np.lexsort((starts[:, 0], starts[:, 0] - starts[:, 1]))]
    apart = starts[:, 0] - starts[:, 1]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(starts[:, 0]) != 1) | (np.diff(apart) != 0)]))
    size = np.diff(np.append(first, len(starts))) + RUN - 1
    runs = np.column_stack([starts[first], size])
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    rows = runs.tolist()
    group = list(range(len(rows)))
    total = [n for _, _, n in rows]
    longest = int(runs[:, 2].max())

    def top(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    for k, (d, i, _) in enumerate(rows):
        for j in range(k - 1, -1, -1):
            dj, ij, nj = rows[j]
            if d - dj > longest + EXCHANGED:
                break
            if -RUN <= d - dj - nj <= EXCHANGED and -RUN <= i - ij - nj <= EXCHANGED and i > ij:
                a, b = top(j), top(k)
                if a != b:
                    group[b] = a
                    total[a] += total[b]
    return runs[[total[top(k)] >= least for k in range(len(rows))]]


def ordered_letters(runs: np.ndarray, size: int) -> int:
    """Letters of the item in the longest chain of equal letters of the runs, each later in both texts than the one before.

    A gap of at most EXCHANGED letters in both texts is an exchanged word, which
    counts as held.
    """
    if not len(runs):
        return 0
    n = runs[:, 2]
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    d, i = np.repeat(runs[:, 0], n) + k, np.repeat(runs[:, 1], n) + k
    key = np.unique(d * size + (size - 1 - i))  # by place in the document, places in the item falling: no two of one letter chain
    d, i = (key // size).tolist(), (size - 1 - key % size).tolist()
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(i)
    for n, x in enumerate(i):
        p = bisect_left(tails, x)
        before[n] = last[p - 1] if p else -1
        if p == len(tails):
            tails.append(x)
            last.append(n)
        else:
            tails[p], last[p] = x, n
    held, n = len(tails), last[-1]
    while before[n] >= 0:
        b = before[n]
        if 1 < i[n] - i[b] <= EXCHANGED + 1 and d[n] - d[b] <= EXCHANGED + 1:
            held += i[n] - i[b] - 1
        n = b
    return held


def find_leaks(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """(key, item_id, share) for documents that hold more than ``min_share`` of an item; ``items`` has item_id and text."""
    schema = f"`{key}` {dict(df.dtypes)[key]}, item_id string, share double"
    rows = df.select(key, F.col(text).alias("__text")).filter(F.length("__text") > 0)
    parts = []
    for block in _blocks(items):

        def run(batches: Iterator[pd.DataFrame], block: Items = block) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield _search(b, block, key, min_share)

        parts.append(rows.mapInPandas(run, schema))
    if not parts:
        return df.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def _blocks(items: DataFrame) -> Iterator[Items]:
    ids, texts, held = [], [], 0
    for r in items.select("item_id", "text").filter("text is not null and item_id is not null").distinct().orderBy("item_id").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        held += len(r["text"]) * 3
        if held > ITEM_BYTES:
            yield Items(ids, texts)
            ids, texts, held = [], [], 0
    if ids:
        yield Items(ids, texts)


def _search(b: pd.DataFrame, items: Items, key: str, min_share: float) -> pd.DataFrame:
    docs = [letters(t) for t in b["__text"]]
    keys = b[key].tolist()
    out = []
    for d, i in items.candidates(docs):
        share = items.held(docs[d], i, min_share)
        if share > min_share:
            out.append((keys[d], items.ids[i], share))
    return pd.DataFrame(out, columns=[key, "item_id", "share"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents").select("doc_id", "text"), _items(spark, d)).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Per item: how many documents hold it, and how much of it at most."""
    leaks = find_leaks(table(spark, d, "documents").select("doc_id", "text"), _items(spark, d))
    return leaks.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.round(F.max("share"), 4).alias("most"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    questions = table(spark, d, "rag_questions").select(F.col("qid").alias("item_id"), F.col("gold_answer").alias("text"))
    return questions.unionByName(table(spark, d, "unmatch_heldout").select(F.col("id").alias("item_id"), F.col("input_text").alias("text")))


QUERIES = {"p9_found": p9_found, "p9_leaks": p9_leaks}
