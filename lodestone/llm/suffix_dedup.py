"""Exact removal of repeated passages with enhanced suffix arrays.

A byte is removed if a string of `length` bytes that covers it also starts earlier: in a document
of smaller id, or before in the same document. Strings are judged on the input.

Suffixes of a corpus do not fit one array, so they are dealt out such that equal strings meet:

1. Documents are packed into units (a few MB, compressed, written once).
2. Every string of `length` bytes is owned by its anchor, the 32-byte word of least hash inside it
   (a minimizer). Neighbouring strings mostly share an anchor, so a unit has one row for each run
   of them: a segment. Anchors are dealt by their hash; an anchor that no other segment has is
   done. Equal segments are merged into the earliest, the others are covered whole.
3. Anchors with several different segments are left: the edges of repeats. Their bytes are fetched
   and meet in one task, which sorts their suffixes, takes the longest common prefixes of
   neighbours and scans the array with a stack: each interval of the common-prefix tree whose
   occurrences differ in the byte before (or have none) is a maximal repeat. All its occurrences
   but the earliest are covered.
4. An anchor with very many segments (a passage that a third of all documents hold) is split:
   its segments are cut into single strings, dealt by their own hash and merged within a unit
   first, so that no task gets more than one of each unit. It is split if one unit holds more than
   `split_from` different ones, or all units together more than `split_total`.

Tasks are as many as the session's shuffle partitions, or more: one for PART_BYTES of text.
Removals of a unit are joined back to it. Nothing is sampled, capped or collected to the driver.

Defined cases: a null or empty text, and any of fewer than `length` bytes, stays whole; texts of any
length are units of their own and scanned in pieces; matches never cross documents; rows with the
same id are separate documents, in the order of their position; those without an id come after all
others; self-overlapping repeats count; an empty table gives an empty table; extra columns are
ignored unless they are named in `carry`.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow, pack_arrays, stage, unpack_arrays

#: Length of the strings, of the anchor word inside, and bytes of a unit.
LENGTH, WORD, UNIT_BYTES = 100, 32, 4 << 20
#: Bytes whose suffixes are sorted at once; a task sorts its anchors in so many parts.
SORTED_BYTES = 1 << 20
#: Different segments of an anchor in one unit, and in all units, above which it is split into strings.
SPLIT_FROM, SPLIT_TOTAL = 16, 4096
#: Text bytes of a task.
PART_BYTES = 64 << 20
_CHUNK = 1 << 20
_POSITION = np.uint64((1 << 24) - 1)
COVER, FETCH, ANCHORS, BYTES = 0, 1, 2, 3
#: Where documents without an id stand.
NO_ID = (1 << 63) - 1


def _u(x: int) -> np.uint64:
    return np.uint64(x & (1 << 64) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _u(32))) * _u(0x9E3779B97F4A7C15)
    return x ^ (x >> _u(29))


class Unit:
    """Some documents, ordered by id, as one buffer; the last `none` of them have no id and count as NO_ID."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: bytes, none: int = 0, carried: list[bytes] | None = None):
        self.ids, self.sizes, self.data, self.none, self.carried = ids, sizes, data, none, carried or []
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    @staticmethod
    def of(docs: list[tuple[int | None, bytes, bytes]]) -> Unit:
        docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
        ids = np.array([NO_ID if d[0] is None else d[0] for d in docs], np.int64)
        return Unit(ids, np.array([len(d[1]) for d in docs], np.int64), b"".join(d[1] for d in docs), sum(d[0] is None for d in docs), [d[2] for d in docs])

    def packed(self) -> bytes:
        import zstandard

        beside = np.array([len(c) for c in self.carried], np.int64).tobytes()
        body = b"".join([self.ids.tobytes(), self.sizes.tobytes(), beside, *self.carried, self.data])
        return struct.pack("<II", len(self.ids), self.none) + zstandard.ZstdCompressor(level=3).compress(body)

    @staticmethod
    def unpacked(blob: bytes) -> Unit:
        import zstandard

        n, none = struct.unpack("<II", blob[:8])
        raw = zstandard.ZstdDecompressor().decompress(blob[8:])
        ends = 24 * n + np.cumsum(np.frombuffer(raw, np.int64, n, 16 * n))
        carried = [raw[a:b] for a, b in zip([24 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return Unit(np.frombuffer(raw, np.int64, n), np.frombuffer(raw, np.int64, n, 8 * n), raw[int(ends[-1]) :], none, carried)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.ends, at, side="right")]


def word_hash(data: np.ndarray, word: int = WORD) -> np.ndarray:
    """A 64-bit hash of the `word` bytes (a multiple of 8) from each position."""
    if len(data) < word:
        return np.zeros(0, np.uint64)
    x = data.astype(np.uint64)
    x = x[:-1] | x[1:] << _u(8)
    x = x[:-2] | x[2:] << _u(16)
    x = x[:-4] | x[4:] << _u(32)
    n = len(data) - word + 1
    h = _mix(x[:n])
    for k in range(8, word, 8):
        h = _mix(h * _u(0xBF58476D1CE4E5B9) + x[k : k + n])
    return h


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    m, w = v, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    rest = width - w
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def string_hash(h: np.ndarray, at: np.ndarray, length: int, word: int = WORD) -> np.ndarray:
    """A hash of the `length` bytes from each position in `at`; h: word_hash of the buffer."""
    out = np.zeros(len(at), np.uint64)
    for k in [*range(0, length - word, word), length - word]:
        out = _mix(out * _u(0x94D049BB133111EB) + h[at + k])
    return out


def segments(unit: Unit, length: int, word: int = WORD):
    """Runs of strings with one anchor: its 40-bit hash, a hash of the segment, first string, and number of strings less one."""
    data = np.frombuffer(unit.data, np.uint8)
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    whole = np.zeros(n + length, np.int8)  # strings that lie inside one document
    big = unit.sizes >= length
    np.add.at(whole, unit.starts[big], 1)
    np.add.at(whole, unit.ends[big] - length + 1, -1)
    whole = np.cumsum(whole, dtype=np.int8)[:n] > 0
    out = []
    for at in range(0, n, _CHUNK):
        end = min(n, at + _CHUNK)
        h = word_hash(data[at : end + length - 1], word)
        v = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        m = sliding_min(v, length - word + 1)
        inside = whole[at:end]
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (inside[1:] != inside[:-1])
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(m)) - 1
        keep = inside[lo]
        lo, hi = lo[keep], hi[keep]
        seg = _mix(string_hash(h, lo, length, word) * _u(3) + _mix(string_hash(h, hi, length, word) + (hi - lo).astype(np.uint64)))
        out.append((m[lo] >> _u(24), seg, lo + at, hi - lo))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys (the last counts most), and which rows of it begin a new group of all keys."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] &= s[1:] == s[:-1]
    new[1:] = ~new[1:]
    return order, new


def groups(sorted_key: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_key), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    return np.flatnonzero(new)


def cover(at: np.ndarray, length: np.ndarray) -> bytes:
    return pack_arrays(at.astype(np.uint32), length.astype(np.uint32))


# the suffix array of a task's segments


def dense_rank(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    key = a if b is None else a.astype(np.uint64) << _u(32) | b
    return np.unique(key, return_inverse=True)[1].astype(np.uint32)


class SuffixArray:
    """Suffixes of items (byte strings in one buffer) that start at given positions.

    suffixes: positions in lexicographic order of those that share `least` bytes with another;
    common: bytes shared with the one before, never beyond either's item.
    """

    def __init__(self, data: bytes, start: np.ndarray, size: np.ndarray, starts: np.ndarray, item: np.ndarray, least: int):
        raw = np.frombuffer(data + bytes(512), np.uint8)
        self.raw = raw
        x = raw.astype(np.uint64)
        x = x[:-1] << _u(8) | x[1:]
        x = x[:-2] << _u(16) | x[2:]
        x = x[:-4] << _u(32) | x[4:]
        ranks = {8: dense_rank(x)}
        del x
        for w in (8, 16, 32):
            r = ranks[w]
            ranks[2 * w] = dense_rank(r[:-w], r[w:])
        r = ranks[64]
        if not 8 <= least <= 128:
            raise ValueError("strings of 8 to 128 bytes")
        top = max(w for w in ranks if w <= least)
        key = dense_rank(ranks[top][starts], ranks[top][starts + least - top])
        often = np.bincount(key.astype(np.int64))[key.astype(np.int64)] > 1 if len(key) else np.zeros(0, bool)
        pos, item = starts[often], item[often]
        order = np.lexsort((r[pos + 128], r[pos + 64], r[pos]))
        self.suffixes, self.items = pos[order], item[order]
        left = (start + size)[self.items] - self.suffixes
        a, b = self.suffixes[:-1].copy(), self.suffixes[1:].copy()
        n = np.zeros(len(a), np.int64)
        for w in (64, 64, 32, 16, 8):
            n[ranks[w][a + n] == ranks[w][b + n]] += w
        for _ in range(7):
            n += raw[a + n] == raw[b + n]
        self.common = np.concatenate(([0], np.minimum(n, np.minimum(left[:-1], left[1:]))))[: len(pos)]
        at_start = self.suffixes == start[self.items]
        self.before = np.where(at_start, -1, raw[np.maximum(self.suffixes - 1, 0)].astype(np.int64))

    def repeats(self, least: int):
        """Maximal repeats: (bytes, first, last) places in the array of all occurrences.

        Intervals of the common-prefix tree are left-maximal if the bytes before their occurrences
        differ; the start of an item differs from every byte."""
        common, before = self.common.tolist(), self.before.tolist()
        n = len(common)
        i = 0
        while i < n:
            stack: list[list] = []  # bytes, first place, byte before (-1: several)
            j = i + 1
            while j < n and common[j] >= least:
                first, byte = j - 1, before[j - 1]
                while stack and stack[-1][0] > common[j]:
                    size, lo, b = stack.pop()
                    byte = byte if byte == b else -1
                    if byte == -1:
                        yield size, lo, j - 1
                    first = lo
                    if stack and stack[-1][0] >= common[j]:
                        stack[-1][2] = byte if byte == stack[-1][2] else -1
                        byte = stack[-1][2]
                if stack and stack[-1][0] == common[j]:
                    stack[-1][2] = byte if byte == stack[-1][2] else -1
                else:
                    stack.append([common[j], first, byte])
                j += 1
            byte = before[j - 1]
            while stack:
                size, lo, b = stack.pop()
                byte = byte if byte == b else -1
                if byte == -1:
                    yield size, lo, j - 1
            i = j


def covered_by_earlier(data: bytes, size: np.ndarray, runs: np.ndarray, order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, offset and bytes of the occurrences of maximal repeats that are not the earliest.

    Item k has size[k] bytes; its strings start at offsets 0 to runs[k]; order ranks items by
    where they stand, and within an item by offset."""
    start = np.cumsum(size) - size
    item = np.repeat(np.arange(len(size)), runs + 1)
    offset = np.arange(len(item)) - np.repeat(np.cumsum(runs + 1) - (runs + 1), runs + 1)
    array = SuffixArray(data, start, size, start[item] + offset, item, length)
    when = order[array.items] + (array.suffixes - start[array.items])
    best = np.zeros(len(array.suffixes), np.int64)
    for n, lo, hi in array.repeats(length):
        first = lo + int(np.argmin(when[lo : hi + 1]))
        kept = best[first]
        np.maximum(best[lo : hi + 1], n, out=best[lo : hi + 1])
        best[first] = kept
    at = np.flatnonzero(best)
    return array.items[at], (array.suffixes - start[array.items])[at], best[at]


# the stages


def _deal(df: DataFrame, parts: int) -> DataFrame:
    return df.repartitionById(parts, "dest")


def _unit_rows(docs: DataFrame, unit_bytes: int) -> DataFrame:
    def run(batches):
        base, count, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                for doc, text, beside in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    held.append((doc, raw, beside or b""))
                    size += len(raw)
                    if size >= unit_bytes:
                        yield {"unit": [base + count], "blob": [Unit.of(held).packed()]}
                        count, held, size = count + 1, [], 0
        if held:
            yield {"unit": [base + count], "blob": [Unit.of(held).packed()]}

    return map_arrow(docs, run, "unit long, blob binary")


_MOVED = "dest int, unit long, kind int, blob binary"


def _rows(rows: list[tuple]) -> dict:
    return dict(zip(("dest", "unit", "kind", "blob"), map(list, zip(*rows, strict=True)), strict=True))


def _anchors(units: DataFrame, parts: int, length: int, split_from: int) -> DataFrame:
    """Dealt by anchor: the unit's different segments. Dealt by unit: what it covers and fetches itself."""

    def run(batches):
        for batch in batches:
            for unit_id, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                unit = Unit.unpacked(blob)
                anchor, seg, lo, run_ = segments(unit, length)
                order, new = firsts(seg, anchor)
                own = hash(unit_id) % parts
                again = order[~new]
                out = [(own, unit_id, COVER, cover(lo[again], run_[again] + length))] if len(again) else []
                at = order[new]  # different segments, by anchor
                g = groups(anchor[at])
                many = np.diff(np.append(g, len(at)))
                split = np.repeat(many > split_from, many)
                if split.any():
                    s = at[split]
                    out.append((own, unit_id, FETCH, pack_arrays(lo[s].astype(np.uint32), run_[s].astype(np.uint8), np.ones(len(s), np.uint8), anchor[s])))
                told = at[g[many > split_from]]  # one row says that the anchor is split
                at = np.concatenate([at[~split], told])
                flag = np.concatenate([np.zeros(len(at) - len(told), np.uint8), np.ones(len(told), np.uint8)])
                dest = (anchor[at] % np.uint64(parts)).astype(np.int64)
                by = np.argsort(dest, kind="stable")
                at, flag, dest = at[by], flag[by], dest[by]
                cuts = np.searchsorted(dest, np.arange(parts + 1))
                doc = unit.doc_of(lo[at]) if len(at) else np.zeros(0, np.int64)
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    s = slice(cuts[p], cuts[p + 1])
                    out.append((p, unit_id, ANCHORS, pack_arrays(anchor[at[s]], seg[at[s]] >> _u(16), doc[s], lo[at[s]].astype(np.uint32), run_[at[s]].astype(np.uint8), flag[s])))
                for k in range(0, len(out), 256):
                    yield _rows(out[k : k + 256])

    return map_arrow(units, run, _MOVED)


def _by_unit(unit: np.ndarray, kind: int, fn) -> list[tuple]:
    """A row for each unit with what fn gives for the places of its rows."""
    if not len(unit):
        return []
    order = np.argsort(unit, kind="stable")
    g = groups(unit[order])
    ends = np.append(g[1:], len(order)).astype(np.int64)
    return [(0, int(unit[order[a]]), kind, fn(order[a:b])) for a, b in zip(g.tolist(), ends.tolist(), strict=True)]


def _merge(moved: DataFrame, length: int, split_total: int) -> DataFrame:
    """Per anchor: covers all but the earliest of equal segments; asks for the bytes of different ones."""

    def run(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            through = []
            for dest, unit, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == ANCHORS:
                    a = unpack_arrays(blob, "u8", "u8", "i8", "u4", "u1", "u1")
                    held.append([*a, np.full(len(a[0]), unit)])
                else:
                    through.append((dest, unit, kind, blob))
            for k in range(0, len(through), 256):
                yield _rows(through[k : k + 256])
        if not held:
            return
        anchor, seg, doc, lo, run_, flag, unit = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        _, back, count = np.unique(anchor, return_inverse=True, return_counts=True)
        some = (count[back] > 1) & (flag == 0)
        split = np.zeros(len(count), bool)
        split[back[flag == 1]] = True
        at = np.flatnonzero(some)
        order = at[np.lexsort((lo[at], unit[at], doc[at], seg[at], back[at]))]
        new = np.ones(len(order), bool)
        new[1:] = (back[order[1:]] != back[order[:-1]]) | (seg[order[1:]] != seg[order[:-1]])
        first, later = order[new], order[~new]
        different = np.bincount(back[first], minlength=len(count))
        split |= different > split_total
        ask = first[(different[back[first]] > 1) | split[back[first]]]
        out = _by_unit(unit[later], COVER, lambda k: cover(lo[later[k]], run_[later[k]].astype(np.int64) + length))
        out += _by_unit(unit[ask], FETCH, lambda k: pack_arrays(lo[ask[k]], run_[ask[k]], split[back[ask[k]]].astype(np.uint8), anchor[ask[k]]))
        for k in range(0, len(out), 256):
            yield _rows(out[k : k + 256])

    return map_arrow(moved, run, _MOVED)


def _fetch(asked: DataFrame, parts: int, length: int) -> DataFrame:
    """The bytes of the segments that are asked for, dealt by anchor; of split ones, their strings, dealt by hash."""

    def run(batches):
        for batch in batches:
            for unit_id, blob, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                unit = Unit.unpacked(blob)
                lo, run_, split, anchor = (np.concatenate(x) for x in zip(*(unpack_arrays(a, "u4", "u1", "u1", "u8") for a in asks), strict=True))
                lo, run_ = lo.astype(np.int64), run_.astype(np.int64)
                data = np.frombuffer(unit.data, np.uint8)
                out = []
                s = split == 1
                if s.any():
                    at = np.unique(np.repeat(lo[s] - (np.cumsum(run_[s] + 1) - (run_[s] + 1)), run_[s] + 1) + np.arange((run_[s] + 1).sum()))
                    h = _string_hashes(data, at, length)
                    order, new = firsts(h)
                    again = order[~new]
                    if len(again):
                        out.append((hash(unit_id) % parts, unit_id, COVER, cover(at[again], np.full(len(again), length))))
                    at = at[order[new]]
                    lo = np.concatenate([lo[~s], at])
                    run_ = np.concatenate([run_[~s], np.zeros(len(at), np.int64)])
                    key = np.concatenate([anchor[~s], h[order[new]]])
                else:
                    key = anchor
                dest = (key % np.uint64(parts)).astype(np.int64)
                by = np.argsort(dest, kind="stable")
                lo, run_, dest = lo[by], run_[by], dest[by]
                part_of = (key[by] // np.uint64(parts)).astype(np.uint16)
                doc = unit.doc_of(lo)
                cuts = np.searchsorted(dest, np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    k = slice(cuts[p], cuts[p + 1])
                    raw = b"".join(unit.data[a : a + r + length] for a, r in zip(lo[k].tolist(), run_[k].tolist(), strict=True))
                    head = pack_arrays(doc[k], lo[k].astype(np.uint32), run_[k].astype(np.uint8), part_of[k])
                    out.append((p, unit_id, BYTES, struct.pack("<I", len(head)) + head + _squeeze(raw)))
                for k in range(0, len(out), 128):
                    yield _rows(out[k : k + 128])

    return map_arrow(asked, run, _MOVED)


def _squeeze(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def _string_hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    out = []
    for k in range(0, len(at), 100_000):
        rows = np.lib.stride_tricks.sliding_window_view(data, length)[at[k : k + 100_000]]
        pad = np.zeros((len(rows), -length % 8), np.uint8)
        words = np.ascontiguousarray(np.hstack([rows, pad])).view(np.uint64)
        h = np.zeros(len(rows), np.uint64)
        for w in range(words.shape[1]):
            h = _mix(h * _u(0x94D049BB133111EB) + words[:, w])
        out.append(h)
    return np.concatenate(out)


def _suffix_stage(moved: DataFrame, length: int) -> DataFrame:
    """Covers the occurrences of maximal repeats that are not the earliest."""

    def run(batches):
        import zstandard

        held, texts = [], []
        for batch in batches:
            through = []
            for dest, unit, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == BYTES:
                    n = struct.unpack("<I", blob[:4])[0]
                    a = unpack_arrays(blob[4 : 4 + n], "i8", "u4", "u1", "u2")
                    held.append([*a, np.full(len(a[0]), unit)])
                    texts.append(zstandard.ZstdDecompressor().decompress(blob[4 + n :]))
                else:
                    through.append((dest, unit, kind, blob))
            for k in range(0, len(through), 256):
                yield _rows(through[k : k + 256])
        if not held:
            return
        doc, lo, run_, part, unit = (np.concatenate(x) for x in zip(*held, strict=True))
        lo, run_ = lo.astype(np.int64), run_.astype(np.int64)
        data = b"".join(texts)
        held.clear()
        texts.clear()
        ends = np.cumsum(run_ + length)
        part = part.astype(np.int64) % (len(data) // SORTED_BYTES + 1)
        for chosen in np.split(order := np.argsort(part, kind="stable"), np.flatnonzero(np.diff(part[order])) + 1):
            some = b"".join(data[a:b] for a, b in zip((ends - run_ - length)[chosen].tolist(), ends[chosen].tolist(), strict=True))
            place = np.empty(len(chosen), np.int64)
            place[np.lexsort((lo[chosen], unit[chosen], doc[chosen]))] = np.arange(len(chosen)) * 1024  # room for an item's offsets
            item, offset, size = covered_by_earlier(some, run_[chosen] + length, run_[chosen], place, length)
            item = chosen[item]
            at = lo[item] + offset
            out = _by_unit(unit[item], COVER, lambda k, at=at, size=size: cover(at[k], size[k]))
            for k in range(0, len(out), 256):
                yield _rows(out[k : k + 256])

    return map_arrow(moved, run, _MOVED)


def whole_characters(data: np.ndarray, start: int, end: int) -> tuple[int, int]:
    """The largest part of data[start:end] that cuts no UTF-8 character."""
    while start < end and data[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def _cut(joined: DataFrame, as_text: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for blob, covers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                unit = Unit.unpacked(blob)
                gone = np.zeros(len(unit.data) + 1, np.int32)
                for c in covers or ():
                    at, size = unpack_arrays(c, "u4", "u4")
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + size, -1)
                gone = np.cumsum(gone)[:-1] > 0
                data = np.frombuffer(unit.data, np.uint8)
                rows = {"doc_id": [], "n_bytes": [], "starts": [], "ends": [], "kept": [], "carried": unit.carried}
                ids = unit.ids.tolist()[: len(unit.ids) - unit.none] + [None] * unit.none
                for doc, lo, hi in zip(ids, unit.starts.tolist(), unit.ends.tolist(), strict=True):
                    mask = gone[lo:hi]
                    edge = np.flatnonzero(np.diff(mask, prepend=False, append=False)) if mask.any() else np.zeros(0, np.int64)
                    if as_text and len(edge):
                        inner = [whole_characters(data[lo:hi], a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                        edge = np.array([x for r in inner if r[0] < r[1] for x in r], np.int64)
                        mask = np.zeros(hi - lo, bool)
                        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                            mask[a:b] = True
                    rows["doc_id"].append(doc)
                    rows["n_bytes"].append(hi - lo)
                    rows["starts"].append(edge[::2])
                    rows["ends"].append(edge[1::2])
                    rows["kept"].append(data[lo:hi][~mask].tobytes() if len(edge) else unit.data[lo:hi])
                for k in range(0, len(rows["doc_id"]), 256):
                    part = {n: v[k : k + 256] for n, v in rows.items()}
                    if as_text:
                        part["kept"] = [x.decode("utf-8", "replace") for x in part["kept"]]
                    part |= {n: pa.array(part[n], pa.list_(pa.int64())) for n in ("starts", "ends")}
                    yield part

    return map_arrow(joined, run, f"doc_id long, n_bytes long, starts array<long>, ends array<long>, kept {'string' if as_text else 'binary'}, carried binary")


def remove_repeats(
    df: DataFrame,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit_bytes: int = UNIT_BYTES,
    split_from: int = SPLIT_FROM,
    split_total: int = SPLIT_TOTAL,
    as_text: bool = False,
    carry: F.Column | None = None,
) -> DataFrame:
    """doc_id, n_bytes, the removed byte runs (starts, ends) and what is kept of every row.

    kept holds bytes, or with as_text a string; then characters that a run cuts are kept whole.
    carried holds the row's value of the binary column carry (empty without it)."""
    if not 64 <= length <= 128:
        raise ValueError("length must be 64 to 128 bytes")
    spark = df.sparkSession
    source = df if carry is None else df.withColumn("__carry", carry)
    rows = source.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), (F.lit(None).cast("binary") if carry is None else F.col("__carry")).alias("carry"))
    units = stage(_unit_rows(rows, unit_bytes), "units")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), units.count() * unit_bytes // PART_BYTES)
    merged = stage(_merge(_deal(_anchors(units, parts, length, split_from), parts), length, split_total), "segments")
    asked = merged.where(F.col("kind") == FETCH).groupBy("unit").agg(F.collect_list("blob").alias("asks"))
    moved = _fetch(units.join(asked, "unit").select("unit", "blob", "asks"), parts, length)
    covers = merged.where(F.col("kind") == COVER).unionByName(_suffix_stage(_deal(moved, parts), length))
    covers = covers.groupBy("unit").agg(F.collect_list("blob").alias("covers"))
    return _cut(units.join(covers, "unit", "left").select("blob", "covers"), as_text)
