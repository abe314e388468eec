"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

The distinct marked words of a batch are sorted; walking them in that order visits their trie
depth first. The forward scores of a common prefix are kept on a stack and reused, so each
trie node is scored once. No piece spans two marked words, so the best path of a text is the
concatenation of its words' best paths.

The search maximises the sum of piece scores, which is the segmentation of a unigram model.
A BPE model file stores merge ranks, not log probabilities: their sum would prefer two common
fragments to the whole word. For such a file the score of a piece is minus the logarithm of
its rank (Zipf's law), a fixed rule without training. The ids are those that the library gives
for the same pieces and scores in a unigram model file; they differ from the ids of the
library's merge procedure for the BPE file, which no additive score can express.

Defined cases: a null or empty text has no ids and decodes to an empty text; characters outside
the vocabulary become byte pieces; a mark character inside a text decodes to a space; control
strings are ordinary text; repeated rows are encoded each; nothing is truncated; extra columns
are ignored. Decoding skips control ids and replaces bytes that are not UTF-8.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import documents, map_arrow
from lodestone.llm.pieces import MARK, Vocabulary

#: Distinct words a worker remembers; beyond that it forgets all and starts again.
REMEMBERED = 400_000
#: Below the worst piece by so much: the score of a character outside the vocabulary.
UNKNOWN_PENALTY = 10.0
#: Scores are multiples of this, so that single and double precision sum alike.
STEP = 1 / 1024


def unigram_scores(vocabulary: Vocabulary) -> dict[str, float]:
    """Stored scores of a unigram model; minus the logarithm of the rank where ranks are stored."""
    stored = {p: vocabulary.scores[i] for p, i in vocabulary.normal.items()}
    ranks = all(s == round(s) for s in stored.values()) and min(stored.values()) < -1000
    return {p: -round(math.log(2 - s) / STEP) * STEP for p, s in stored.items()} if ranks else stored


class PrefixViterbi:
    def __init__(self, vocabulary: Vocabulary, scores: dict[str, float] | None = None):
        self.vocabulary = vocabulary
        self.scores = scores or unigram_scores(vocabulary)
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        # every ending of a piece: the score of the piece that it is, or minus infinity
        self.tails = dict.fromkeys((p[k:] for p in self.scores for k in range(len(p))), -math.inf) | self.scores
        self.text_of = [b""] * len(vocabulary.pieces)
        for p, i in vocabulary.normal.items():
            self.text_of[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(vocabulary.byte_ids):
            self.text_of[i] = bytes([b])

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Each word's ids as little-endian 32-bit integers; words may come in any order."""
        scores, tails, unknown, nothing = self.scores, self.tails, self.unknown, -math.inf
        normal, byte_ids = self.vocabulary.normal, self.vocabulary.byte_ids
        best, back, last, out = [0.0], [0], "", {}
        for word in sorted(words):
            n = min(len(word), len(last))
            shared = 0
            while shared < n and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, at, start = -math.inf, end - 1, end - 1
                # to the left as long as a piece ends so; of equal paths the one with the longest last piece
                while start >= 0 and (s := tails.get(word[start:end])) is not None:
                    if (s := best[start] + s) >= top and s > nothing:
                        top, at = s, start
                    start -= 1
                if word[end - 1 : end] not in scores and best[end - 1] + unknown > top:
                    top, at = best[end - 1] + unknown, end - 1
                best.append(top)
                back.append(at)
            ids, end = [], len(word)
            while end:
                start = back[end]
                piece = word[start:end]
                if piece in scores:
                    ids.append(normal[piece])
                else:
                    ids.extend(byte_ids[b] for b in reversed(piece.encode("utf-8", "surrogatepass")))
                end = start
            out[word] = np.array(ids[::-1], "<i4").tobytes()
            last = word
        return out

    def encode(self, texts: list[str], seen: dict[str, bytes] | None = None, remembered: int = REMEMBERED) -> list[bytes]:
        seen = {} if seen is None else seen
        split = [self.vocabulary.words(t) for t in texts]
        new = set().union(*split) - seen.keys() if split else set()
        if len(seen) + len(new) > remembered:
            seen.clear()
            new = set().union(*split)
        seen.update(self.encode_words(list(new)))
        return [b"".join(map(seen.__getitem__, w)) for w in split]

    def decode(self, ids) -> str:
        text = b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def _search(path: str) -> tuple[PrefixViterbi, dict[str, bytes]]:
    return PrefixViterbi(Vocabulary(path)), {}


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row."""

    def run(batches):
        search, seen = _search(path)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                found = search.encode(part.column(1).to_pylist(), seen)
                ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield {"doc_id": part.column(0), "ids": ids}

    return map_arrow(documents(df, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and the decoded text of every row; null ids decode to an empty text."""

    def run(batches):
        search, _ = _search(path)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                lists = part.column(1)
                ids, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                text = [search.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield {"doc_id": part.column(0), "ids": lists, "text": text}

    source = df.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"coalesce(cast(`{ids_col}` as array<int>), cast(array() as array<int>)) AS ids")
    return map_arrow(source, run, "doc_id long, ids array<int>, text string")
