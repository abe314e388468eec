"""Packing of tokenised documents into windows by the sum-of-squares rule.

A document is cut into full windows; what is left over is placed online. An array counts the
open windows at each fill level, and a piece goes to the level (or a new window) after which
the sum of the squared counts is least; ties go to the fullest window. A window that is full
leaves the array.

Each task packs the rows it reads, so nothing is shuffled and no task waits for another. When
a task has read its last row, its open windows are closed: the emptiest ones are cut up to fill
the fullest, and the one window that stays open is cut into runs whose lengths are powers of
two, which need no padding.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each; a
document of any length is packed whole; an empty table gives no pieces; extra columns are
ignored. Sequence ids hold the task's number in their upper bits and are unique.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestone.llm.common import documents, map_arrow

#: Distinct words a worker remembers; beyond that it forgets all and starts again.
REMEMBERED = 1_200_000
_MARKS = string.punctuation
#: White space for str.split, but not for the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")


#: Words encoded as one text.
TOGETHER = 2000
# How a tokenizer must cut texts for its ids to be those of the words one by one.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds:
    """Token ids of texts. Where the tokenizer never joins characters across white space, nor letters
    with the marks behind them, and has no capitals, each chunk between white space is cut into a
    word and its marks, which are encoded once by the library and remembered. Whether it does is
    read from its file; texts of any other tokenizer are encoded whole.

    Words of letters are encoded many at a time, as one text: each ends with a token that ends a
    word, and where their number is not that of the words these are encoded one by one."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.batch = getattr(self.lib, "encode_batch_fast", self.lib.encode_batch)
        self.seen: dict[str, bytes] = {}
        self.remembered = remembered
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model, suffix = rules["model"], rules["model"].get("end_of_word_suffix")
        cuts = [p.get("pattern", {}).get("Regex") for p in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_words = bool(suffix) and (rules.get("normalizer") or {}).get("normalizers") == _NORMAL and cuts[:1] == [_CUT] and not rules.get("post_processor")
        self.by_words &= not any(t["normalized"] or t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in rules.get("added_tokens", []))
        if self.by_words:
            self.ends = np.zeros(self.lib.get_vocab_size(), bool)
            self.ends[[i for w, i in model["vocab"].items() if w.endswith(suffix)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters."""
        out = []
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            ids = np.array(self.batch([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) == len(some):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
            else:
                out += self._encode(some)
        return out

    def _learn(self, chunks: set[str]) -> None:
        seen, parts, letters, other = self.seen, [], set(), set()
        for chunk in chunks:
            word = chunk.rstrip(_MARKS)
            if word.isalpha():
                marks = chunk[len(word) :]
                word = word.lower() if word.isascii() else word
                letters.add(word)
                if marks or word != chunk:
                    parts.append((chunk, word, marks))
                    if marks:
                        other.add(marks)
            else:
                other.add(chunk)
        letters.difference_update(seen)
        letters = list(letters)
        seen.update(zip(letters, self._words(letters), strict=True))
        other = [w for w in other if w not in seen]
        for at in range(0, len(other), 10_000):
            seen.update(zip(other[at : at + 10_000], self._encode(other[at : at + 10_000]), strict=True))
        for chunk, word, marks in parts:
            seen[chunk] = seen[word] + seen[marks] if marks else seen[word]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return self._encode(texts)
        whole = [i for i, t in enumerate(texts) if _ODD.search(t)]
        split = [t.split() for t in texts]
        for i in whole:
            split[i] = []
        new = set().union(*split) - self.seen.keys() if split else set()
        if len(self.seen) + len(new) > self.remembered:
            self.seen.clear()
            new = set().union(*split)
        self._learn(new)
        out = [b"".join(map(self.seen.__getitem__, w)) for w in split]
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


class SumOfSquares:
    """Online packer. place() and close() return finished pieces: (sequence, offset, piece)."""

    def __init__(self, size: int):
        self.size, self.count = size, np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}  # fill level: windows, each a list of pieces
        self.sequences = 0

    def level(self, length: int) -> int:
        """The fill level that a piece of this length (under size) goes to; 0: a new window."""
        n, size = self.count, self.size
        top = size - length  # levels up to this one have room
        cost = 2 * n[length : size + 1] - 2 * n[: top + 1] + 2
        cost[top] = 1 - 2 * n[top]  # a full window is counted no more
        cost[0] = 2 * n[length] + 1
        cost[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))

    def _emit(self, window: list) -> list:
        out, at = [], 0
        for piece in window:
            out.append((self.sequences, at, piece))
            at += piece[2]
        self.sequences += 1
        return out

    def place(self, piece: tuple) -> list:
        """piece: (document, start, length, ...)."""
        length = piece[2]
        if length == self.size:
            return self._emit([piece])
        at = self.level(length)
        window = []
        if at:
            window = self.open[at].pop()
            self.count[at] -= 1
        window.append(piece)
        if at + length == self.size:
            return self._emit(window)
        self.open.setdefault(at + length, []).append(window)
        self.count[at + length] += 1
        return []

    def close(self) -> list:
        """Cuts the emptiest open windows to fill the fullest; cuts the last one at powers of two."""
        windows = [[level, w] for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open.clear()
        self.count[:] = 0
        out, first, last = [], 0, len(windows) - 1
        while first < last:
            (level, window), donor = windows[first], windows[last]
            while level < self.size and donor[1]:
                taken, rest = _cut(donor[1].pop(), self.size - level)
                window.append(taken)
                level += taken[2]
                donor[0] -= taken[2]
                if rest:
                    donor[1].append(rest)
            if not donor[1]:
                last -= 1
            windows[first][0] = level
            if level == self.size:
                out += self._emit(window)
                first += 1
        for level, window in windows[first : last + 1]:
            while level:
                room = 1 << (level.bit_length() - 1)
                level -= room
                part = []
                while room:
                    taken, rest = _cut(window.pop(0), room)
                    part.append(taken)
                    room -= taken[2]
                    if rest:
                        window.insert(0, rest)
                out += self._emit(part)
        return out


def _cut(piece: tuple, room: int) -> tuple:
    doc, start, length, ids, total = piece
    if length <= room:
        return piece, None
    return (doc, start, room, ids[: 4 * room], total), (doc, start + room, length - room, ids[4 * room :], total)


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def pack(df: DataFrame, path: str, size: int = 4096, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id and offset."""
    if size < 1:
        raise ValueError("size must be positive")
    stop = np.array([end], "<u4").tobytes()

    def run(batches):
        encode, packer = _word_ids(path), SumOfSquares(size)
        base = TaskContext.get().partitionId() << 32

        def rows(found):
            at = lambda i: [p[i] for _, _, p in found]
            return {"doc_id": at(0), "start": at(1), "length": at(2), "ids": at(3), "doc_tokens": at(4), "sequence_id": [base + s for s, _, _ in found], "offset": [o for _, o, _ in found]}

        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                found = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids += stop
                    total = len(ids) // 4
                    for start in range(0, total, size):
                        found += packer.place((doc, start, min(size, total - start), ids[4 * start : 4 * (start + size)], total))
                if found:
                    yield rows(found)
        if found := packer.close():
            yield rows(found)

    return map_arrow(documents(df, id_col, text_col), run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
