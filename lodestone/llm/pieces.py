"""A SentencePiece vocabulary as plain tables, and the split of a text into marked words."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MARK = "▁"


@dataclass
class Vocabulary:
    """Pieces, scores and special ids of a SentencePiece model file.

    A word boundary is exact wherever no piece spans it: pieces hold the mark only in front
    (or are marks alone), so a text may be cut before each run of marks. Line ends and tabs
    that no piece holds are cut off too.
    """

    path: str
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    byte_ids: list[int] = field(default_factory=list)
    normal: dict[str, int] = field(default_factory=dict)
    kind: str = "bpe"

    def __post_init__(self):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=self.path)
        n = lib.vocab_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.scores = [lib.get_score(i) for i in range(n)]
        self.byte_ids = [-1] * 256
        for i, p in enumerate(self.pieces):
            if lib.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.normal[p] = i
        if -1 in self.byte_ids:
            raise ValueError("the model has no byte fallback")
        if lib.encode("a  b") == lib.encode("a b") or lib.encode("a") != lib.encode_as_ids("a"):
            raise ValueError("the model must keep white space")
        self.longest = max(map(len, self.normal))
        if any(MARK in p.lstrip(MARK) for p in self.normal):
            raise ValueError("a piece spans words")
        apart = "".join(c for c in "\n\t\r" if not any(c in p for p in self.normal))
        cut = f"|[{apart}]" if apart else ""
        self._words = re.compile(f"{MARK}*[^{MARK}{apart}]+|{MARK}+{cut}")

    def words(self, text: str) -> list[str]:
        """The marked words; their concatenation is the normalised text. Empty for an empty text."""
        return self._words.findall(MARK + text.replace(" ", MARK)) if text else []
