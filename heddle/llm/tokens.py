"""Counting tokens: existing tokenizers, and a unigram vocabulary by double-array trie and count-only Viterbi.

Tokenizer files stay where they are; their folder is a parameter (environment
variable HEDDLE_TOKENIZERS, else /opt/tokenizers). Their bytes travel to the
executors with the task, a fixed size however large the data.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence

import numpy as np

FOLDER = os.environ.get("HEDDLE_TOKENIZERS", "/opt/tokenizers")
PIECES = "piece_bpe_32k.model"


def model_bytes(name: str = PIECES, folder: str = FOLDER) -> bytes:
    with open(f"{folder}/{name}", "rb") as f:
        return f.read()


_loaded: dict[int, object] = {}


def piece_counter(model: bytes) -> Callable[[Sequence[str]], list[int]]:
    """Exact token counts under a SentencePiece model, without special tokens."""
    key = hash(model)
    if key not in _loaded:
        import sentencepiece

        _loaded[key] = sentencepiece.SentencePieceProcessor(model_proto=model)
    sp = _loaded[key]

    def count(texts: Sequence[str]) -> list[int]:
        return [len(x) for x in sp.encode(list(texts), num_threads=1)] if len(texts) else []

    return count


def unigram_vocabulary(model: bytes) -> tuple[list[str], list[float]]:
    """Ordinary pieces of a SentencePiece model with their stored scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids]


class DoubleArray:
    """A trie over bytes: the child of state s by byte b is base[s] + b where check there names s."""

    def __init__(self, words: Sequence[bytes]):
        tree: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for k, w in enumerate(words):
            s = 0
            for b in w:
                if b not in tree[s]:
                    tree[s][b] = len(tree)
                    tree.append({})
                    ends.append(-1)
                s = tree[s][b]
            ends[s] = k
        size = 4 * len(tree) + 4096  # room enough: part of it stays free, plus a byte's range at the end
        base, check, word = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0] = True
        place, first, hint, order = {0: 0}, 256, {}, [0]
        for node in order:  # breadth first, each node at the first place where all its children fit
            kids = sorted(tree[node])
            if not kids:
                continue
            while used[first]:
                first += 1
            lo = max(first, kids[0] + 1)
            if len(kids) == 1:  # most nodes: any free place will do
                while used[lo]:
                    lo += 1
                at = lo - kids[0]
            else:
                lo = max(lo, hint.get(len(kids), 0))
                while True:
                    free = np.flatnonzero(~used[lo : lo + 2048]) + lo
                    fits = np.ones(len(free), bool)
                    for k in kids[1:]:
                        fits &= ~used[free + (k - kids[0])]
                    if fits.any():
                        break
                    lo += 2048
                at = int(free[np.argmax(fits)]) - kids[0]
                hint[len(kids)] = at + kids[0]  # before it nodes of as many children found no room
            s = place[node]
            base[s] = at
            for k in kids:
                t = at + k
                used[t], check[t], word[t] = True, s, ends[tree[node][k]]
                place[tree[node][k]] = t
                order.append(tree[node][k])
        self.base, self.check, self.word = np.concatenate([base, np.zeros(256, np.int32)]), np.concatenate([check, np.full(256, -1, np.int32)]), np.concatenate([word, np.full(256, -1, np.int32)])

    def matches(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words that begin at ``starts`` and end by ``stops``: (start, end, word)."""
        state, at = np.zeros(len(starts), np.int32), starts.copy()
        begin, out = starts, []
        while len(begin):
            live = at < stops
            begin, at, stops, state = begin[live], at[live], stops[live], state[live]
            nxt = self.base[state] + data[at]
            live = self.check[nxt] == state
            begin, at, stops, state = begin[live], at[live] + 1, stops[live], nxt[live]
            w = self.word[state]
            hit = w >= 0
            if hit.any():
                out.append((begin[hit], at[hit], w[hit]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))


SEGMENT = re.compile("▁*[^▁]+|▁+")
SCALE = 1000
LONG = 32_000  # bytes of a segment up to which score and count share one number


class UnigramCounter:
    """Best-path lengths under a unigram vocabulary with byte fallback; ties take the path of fewer tokens."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float]):
        self.trie = DoubleArray([p.encode() for p in pieces])
        finite = [s for s in scores if s > -1e8]
        least = min(finite, default=0.0)
        self.score = np.round(np.maximum(scores, least - 5.0) * SCALE).astype(np.int64)
        self.unknown = int(round((least - 10.0) * SCALE))

    def segments(self, segments: Sequence[str]) -> np.ndarray:
        """Token counts of segments; all of a call advance together, byte by byte.

        Up to LONG bytes a path's key is score * 65536 - count; beyond, where
        that would overflow, score and count are two numbers.
        """
        raw = [s.encode("utf-8", "surrogatepass") for s in segments]
        size = np.array([len(r) for r in raw], np.int64)
        counts = np.zeros(len(raw), np.int64)
        if not size.sum():
            return counts
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
        # one slot more than bytes per segment: position k holds the best way to the first k bytes
        first = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(raw)), size)
        head = (data & 0xC0) != 0x80
        starts = np.flatnonzero(head)
        stop = (first + size)[owner]
        begin, end, word = self.trie.matches(data, starts, stop[starts])
        # fallback: a character as its bytes
        after = np.append(starts[1:], len(data))
        width = after - starts
        begin = np.concatenate([begin, starts])
        end = np.concatenate([end, after])
        score = np.concatenate([self.score[word], self.unknown * width])
        tokens = np.concatenate([np.ones(len(word), np.int64), width])
        seg = owner[begin]
        slot0 = first + np.arange(len(raw))
        source, target = begin + seg, end + seg
        rel = end - first[seg]
        order = np.lexsort((target, rel))
        source, target, score, tokens, rel = source[order], target[order], score[order], tokens[order], rel[order]
        best = np.full(len(data) + len(raw), np.iinfo(np.int64).min // 2, np.int64)
        best[slot0] = 0
        edges = np.flatnonzero(np.diff(rel, prepend=-1))
        if size.max() <= LONG:
            gain = score * 65536 - tokens
            for lo, hi in zip(edges, np.append(edges[1:], len(rel))):
                t = target[lo:hi]
                cut = np.flatnonzero(np.diff(t, prepend=-1))
                best[t[cut]] = np.maximum.reduceat(best[source[lo:hi]] + gain[lo:hi], cut)
            counts = (-best[slot0 + size]) % 65536
        else:
            fewest = np.zeros(len(best), np.int64)
            for lo, hi in zip(edges, np.append(edges[1:], len(rel))):
                t = target[lo:hi]
                cut = np.flatnonzero(np.diff(t, prepend=-1))
                paths, held = best[source[lo:hi]] + score[lo:hi], fewest[source[lo:hi]] + tokens[lo:hi]
                top = np.maximum.reduceat(paths, cut)
                ties = paths == np.repeat(top, np.diff(np.append(cut, hi - lo)))
                best[t[cut]] = top
                fewest[t[cut]] = np.minimum.reduceat(np.where(ties, held, np.iinfo(np.int64).max), cut)
            counts = fewest[slot0 + size]
        counts[size == 0] = 0
        return counts

    def __call__(self, texts: Sequence[str], budget: int = 4_000_000) -> np.ndarray:
        """Token counts of texts: each is normalised (spaces become the piece mark, one leads), cut and its segments summed."""
        total = np.zeros(len(texts), np.int64)
        index: dict[str, int] = {}
        pairs: list[tuple[int, int]] = []

        def flush() -> None:
            words = list(index)
            order = sorted(range(len(words)), key=lambda i: len(words[i]))
            got = np.zeros(len(words), np.int64)
            lo = 0
            while lo < len(order):  # blocks of similar length bound the memory
                hi, held = lo, 0
                while hi < len(order) and (held < 200_000 or hi == lo):
                    held += len(words[order[hi]])
                    hi += 1
                got[order[lo:hi]] = self.segments([words[i] for i in order[lo:hi]])
                lo = hi
            for t, i in pairs:
                total[t] += got[i]
            index.clear()
            pairs.clear()

        held = 0
        for t, text in enumerate(texts):
            if not text:
                continue
            for s in SEGMENT.findall("▁" + text.replace(" ", "▁")):
                if s not in index:
                    index[s] = len(index)
                    held += len(s)
                pairs.append((t, index[s]))
            if held > budget:
                flush()
                held = 0
        flush()
        return total
