"""Token counts of a byte-fallback BPE vocabulary by rank-synchronous array merging.

Pre-tokens of a batch are one ragged numpy array of symbols. Long ones (of more than LONG characters)
are cut wherever two characters meet that stand side by side in no piece, as no merge can join them:
unbroken strings fall into short sequences. In each round every sequence finds its pair of lowest rank, and all these
pairs are merged at once; the symbols that survive are the tokens.

Merging every occurrence of the same pair in one round is the sequential result unless a
merge could open a pair of lower rank than its own. Such pieces are listed when the table is
built; of these only the leftmost occurrence is merged in a round. What is still long after ROUNDS
rounds (as one word repeated without spaces for pages) is finished pair by pair from a heap.

Defined cases: a null or empty text has 0 tokens and 0 bytes; repeated rows are counted each;
characters outside the vocabulary count as their UTF-8 bytes; control strings inside a text
are ordinary text; nothing is truncated; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from lodestone.llm.common import documents, map_arrow
from lodestone.llm.pieces import Vocabulary

#: Distinct words a worker remembers; beyond that it forgets all and starts again.
REMEMBERED = 400_000
FREE = np.iinfo(np.int64).max
#: After so many rounds, sequences of more than LONG symbols are finished from a heap.
ROUNDS, LONG = 64, 256


class MergeTable:
    """Ranks of symbol pairs: a pair's rank is the place of its merged piece by score."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        self.merge: dict[int, tuple[int, int]] = {}
        order = sorted(v.normal.values(), key=lambda i: (-v.scores[i], i))
        rank = {i: r for r, i in enumerate(order)}
        self.single = {p: i for p, i in v.normal.items() if len(p) == 1}
        keys, merged = [], []
        unsafe = set()
        for p, i in v.normal.items():
            for cut in range(1, len(p)):
                a, b = v.normal.get(p[:cut]), v.normal.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(i)
                    unsafe |= {x for x in (a, b) if len(v.pieces[x]) > 1 and rank[x] > rank[i]}
        beside = {self.single[p[k]] << 32 | self.single[p[k + 1]] for p in v.normal for k in range(len(p) - 1) if p[k] in self.single and p[k + 1] in self.single}
        self.beside = np.array(sorted(beside), np.int64)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        self.rank = np.full(len(v.pieces) + 1, FREE >> 32, np.int64)
        for i, r in rank.items():
            self.rank[i] = r
        self.unsafe = np.zeros(len(v.pieces), bool)
        self.unsafe[list(unsafe)] = True

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 32 | merged id of each pair, FREE where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(found, self.rank[self.merged[at]] << 32 | self.merged[at], FREE)

    def finish(self, symbols: list[int]) -> int:
        """Surviving symbols of one sequence: always the pair of lowest rank, of equal ones the leftmost, is merged."""
        if not self.merge:
            self.merge.update(zip(self.keys.tolist(), zip(self.rank[self.merged].tolist(), self.merged.tolist(), strict=True), strict=True))
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (m := self.merge.get(a << 32 | b))]
        heapq.heapify(heap)
        left = n
        while heap:
            _, merged, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = merged, -2
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merge.get(merged << 32 | symbols[k]):
                    heapq.heappush(heap, (*m, i, merged, symbols[k]))
            h = before[i]
            if h >= 0 and (m := self.merge.get(symbols[h] << 32 | merged)):
                heapq.heappush(heap, (*m, h, symbols[h], merged))
        return left

    def counts(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each word; a symbol outside the vocabulary counts as its bytes."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        known, back = np.unique(chars, return_inverse=True)
        ids = np.array([self.single.get(chr(c), -1) for c in known], np.int64)
        width = np.array([len(chr(c).encode("utf-8", "surrogatepass")) for c in known], np.int64)
        sym, extra = ids[back], np.where(ids < 0, width - 1, 0)[back]
        length = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), length)
        total = np.bincount(word, weights=extra, minlength=len(words)).astype(np.int64)
        if not len(sym):
            return total
        apart = word[1:] != word[:-1]
        inside = np.flatnonzero(np.repeat(length > LONG, length)[:-1] & ~apart)
        if len(inside):
            a, b = sym[inside], sym[inside + 1]
            key = a << 32 | b
            at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
            apart[inside] = (self.beside[at] != key) | (a < 0) | (b < 0)
        heads = np.flatnonzero(np.concatenate(([True], apart)))
        owner = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(sym))))
        out = np.zeros(len(heads), np.int64)

        def paired(s, o):
            p = np.full(len(s), FREE)
            if len(s) > 1:
                p[:-1] = np.where(o[:-1] == o[1:], self.pair(s[:-1], s[1:]), FREE)
            return p

        rank = paired(sym, owner)
        rounds = 0
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            least = np.minimum.reduceat(rank, starts)
            live = least < FREE
            sizes = np.diff(np.append(starts, len(sym)))
            rounds += 1
            if rounds > ROUNDS:
                for k in np.flatnonzero(live & (sizes > LONG)).tolist():
                    out[owner[starts[k]]] += self.finish(sym[starts[k] : starts[k] + sizes[k]].tolist()) - sizes[k]
                    live[k] = False
            if not live.all():  # finished sequences leave
                out[owner[starts[~live]]] += sizes[~live]
                keep = np.repeat(live, sizes)
                sym, owner, rank = sym[keep], owner[keep], rank[keep]
                least, sizes = least[live], sizes[live]
                if not len(sym):
                    break
            best = np.repeat(least, sizes)
            hit = rank == best
            at = np.flatnonzero(hit)
            # of a run of overlapping occurrences (as in "aaaa") every second one, from the left
            run = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])))
            first = at[np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))]
            at = at[(at - first) % 2 == 0]
            alone = self.unsafe[best[at] & 0xFFFFFFFF]
            if alone.any():
                leftmost = np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))
                at = at[~alone | leftmost]
            sym[at] = best[at] & 0xFFFFFFFF
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            new = place[at]
            touched = np.unique(np.concatenate((new, new[new > 0] - 1)))
            inner = touched[touched + 1 < len(sym)]
            rank[touched] = FREE
            same = inner[owner[inner] == owner[inner + 1]]
            rank[same] = self.pair(sym[same], sym[same + 1])
        return total + np.bincount(word[heads], weights=out, minlength=len(words)).astype(np.int64)


@lru_cache(maxsize=2)
def _table(path: str) -> tuple[MergeTable, dict[str, int]]:
    return MergeTable(Vocabulary(path)), {}


def count_texts(texts: list[str], path: str, remembered: int = REMEMBERED) -> np.ndarray:
    """Tokens of each text; words are counted once and remembered in the process."""
    table, seen = _table(path)
    split = [table.vocabulary.words(t) for t in texts]
    new = set().union(*split) - seen.keys() if split else set()
    if len(seen) + len(new) > remembered:
        seen.clear()
        new = set().union(*split)
    if new:
        # words of like length share a round, and a batch of arrays stays small
        ordered = sorted(new, key=len)
        size, batch = 0, []
        for w in ordered:
            batch.append(w)
            size += len(w)
            if size > 1_000_000:
                seen.update(zip(batch, table.counts(batch).tolist(), strict=True))
                size, batch = 0, []
        if batch:
            seen.update(zip(batch, table.counts(batch).tolist(), strict=True))
    return np.fromiter((sum(map(seen.__getitem__, w)) for w in split), np.int64, len(split))


def token_counts(df: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                n = count_texts(texts, path)
                yield {"doc_id": part.column(0), "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n, "over_limit": n > limit}

    return map_arrow(documents(df, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
