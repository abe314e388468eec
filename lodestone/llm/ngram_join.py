"""Jaccard self-join of documents on word n-grams by MinHash banding.

A document is the set of its runs of five words (64-bit hashes); a shorter one is the single run
of all its words. Words are runs of letters and digits (every character beyond ASCII counts as
one of them), in lower case. Documents with the same set are merged into one representative.

`bands` x `rows` MinHash values: sets that agree in all rows of a band share a bucket. Each bucket is
a star around its least member (no pairs are listed), and the connected components of the stars
hold all candidate pairs. The full sets of candidates are made again from their texts, of which a
bit map of fixed size leaves out the rest before anything is shuffled, and components are compared
in blocked cells (cells.py), bounded by rows and by bytes, where the sizes of all intersections are
counted.

Rows are as many, and bands so many, that a pair of the threshold's similarity is missed with
probability `miss` at most and all bands take at most HASHES values: for 0.8 and 7e-4 they are 40
bands of 8 rows; a pair of 0.85 is then missed with 4e-6. A threshold that this cannot reach is an
error.

Defined cases: a null or empty text, or one without words, links with nothing; rows with the same
id are separate documents with one id, of a group of them exactly one row is kept; ties go to the
smaller id, and a null id comes after all others; an empty table gives an empty table; extra
columns are ignored; texts of any length are used whole, and a cell holds two blocks of at most
GRAMS runs, or two texts that are longer.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import cells
from lodestone.llm.common import bit_map, connected_components, documents, map_arrow, marked, stage

WORDS = 5
SIMILAR = 0.8
#: Chance to miss a pair of the threshold's similarity, and MinHash values of a text.
MISS, HASHES = 7e-4, 320
#: Runs of a block of texts.
GRAMS = 1 << 20
_RNG = np.random.default_rng(11)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = [np.uint64(int(x) | 1) for x in _RNG.integers(1, 1 << 63, 64, dtype=np.uint64)]
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def banding(threshold: float, miss: float = MISS, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows: as many rows as the hashes allow, so that few unlike texts meet."""
    for rows in range(16, 0, -1):
        together = threshold**rows
        bands = 1 if together >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-together)))
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError(f"{hashes} MinHash values cannot find pairs of similarity {threshold} but for {miss}")


BANDS, ROWS = banding(SIMILAR)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, made as long as the longest batch so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int):
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(_BACK, size)
        return cls.up, cls.down


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, in order."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    up, down = _Powers.get(len(data))
    inside = _IN_WORD[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    h = _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    cuts = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw])[:-1])
    return np.split(h, cuts)


def shingle_sets(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of n words."""
    out = []
    for h in word_hashes(texts):
        if not len(h):
            out.append(h)
            continue
        k = min(n, len(h))
        runs = len(h) - k + 1
        s = np.full(runs, np.uint64(k))
        for i in range(k):
            s += h[i : i + runs] * _STEP[i]
            s = (s << np.uint64(7)) | (s >> np.uint64(57))
        out.append(np.unique(_mix(s)))
    return out


class BandHasher:
    def __init__(self, bands: int, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, bands) bucket numbers; all sets hold something."""
        least = np.empty((len(sets), self.bands * self.rows), np.uint32)
        size = np.array([len(s) for s in sets])
        at = 0
        while at < len(sets):  # pieces that stay in the processor's cache
            end = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), 24_000)) + at)
            x = np.concatenate(sets[at:end])
            # folds 64 bits to 32 before each multiplication by an odd number
            low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
            starts = np.concatenate(([0], np.cumsum(size[at:end])[:-1]))
            work = np.empty_like(low)
            for k in range(self.bands * self.rows):
                np.multiply(low, self.a[k], out=work)
                work += self.b[k]
                work ^= work >> np.uint32(15)
                work += high
                work *= np.uint32(0x85EBCA6B)
                least[at:end, k] = np.minimum.reduceat(work, starts)
            at = end
        h = np.zeros((len(sets), self.bands), np.uint64)
        grid = least.reshape(len(sets), self.bands, self.rows).astype(np.uint64)
        for r in range(self.rows):
            h = _mix(h + grid[:, :, r] * _STEP[r] + np.arange(self.bands, dtype=np.uint64))
        return h.view(np.int64)


def similar_pairs(sets: list[np.ndarray], threshold: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of sets with a Jaccard similarity of at least threshold; with side, only across sides.

    Rare members list their pairs; frequent ones are columns of a matrix that is multiplied."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        hit = both >= threshold * (size.sum() - both) - 1e-9 and (side is None or side[0] != side[1])
        return (np.array([0]), np.array([1])) if hit else (np.zeros(0, int), np.zeros(0, int))
    owner = np.repeat(np.arange(n), size)
    _, member, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((owner, member))
    owner, member = owner[order], member[order]
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    both = np.zeros(n * n, np.int64)
    rare = 12
    for c in range(2, rare + 1):
        at = first[count == c]
        if len(at):
            rows = owner[at[:, None] + np.arange(c)]
            i, j = np.triu_indices(c, 1)
            both += np.bincount((rows[:, i] * n + rows[:, j]).ravel(), minlength=n * n)
    both = both.reshape(n, n)
    often = np.flatnonzero(count > rare)
    for lo in range(0, len(often), 2048):
        part = often[lo : lo + 2048]
        column = np.repeat(np.arange(len(part)), count[part])
        within = np.arange(len(column)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
        grid = np.zeros((n, len(part)), np.float32)
        grid[owner[np.repeat(first[part], count[part]) + within], column] = 1
        both += np.triu(grid @ grid.T, 1).astype(np.int64)
    i, j = np.nonzero(both)
    shared = both[i, j]
    hit = shared >= threshold * (size[i] + size[j] - shared) - 1e-9
    if side is not None:
        hit &= side[i] != side[j]
    return i[hit], j[hit]


def ngram_join(
    df: DataFrame,
    threshold: float = SIMILAR,
    n: int = WORDS,
    miss: float = MISS,
    hashes: int = HASHES,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = cells.BLOCK,
    grams: int = GRAMS,
    hashed: bool = False,
) -> DataFrame:
    """doc_id, n_links (documents of at least the threshold), component_id (the least id reachable by
    links) and kept (its own id is that one, and of several such rows it is the first) of every row;
    with hashed also text_hash, the xxhash64 of the text."""
    bands, rows = banding(threshold, miss, hashes)
    docs = documents(df, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))

    def digest(s: np.ndarray) -> bytes:
        return hashlib.blake2b(s.tobytes(), digest_size=16).digest()

    def signed(batches):
        hasher = BandHasher(bands, rows)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column(1).to_pylist(), n)
                some = [k for k, s in enumerate(sets) if len(s)]
                found: list = [None] * len(sets)
                for k, b in zip(some, hasher([sets[k] for k in some]) if some else (), strict=True):
                    found[k] = b
                keys = [digest(s) if len(s) else None for s in sets]
                node = [None if k is None else int.from_bytes(k[:8], "little", signed=True) for k in keys]
                yield {"doc_id": part.column(0), "text_hash": part.column(2), "key": keys, "node": node, "grams": [len(s) for s in sets], "bands": pa.array(found, pa.list_(pa.int64()))}

    signed_docs = map_arrow(docs, signed, "doc_id long, text_hash long, key binary, node long, grams long, bands array<long>")
    signed_docs = stage(signed_docs.withColumn("row", F.monotonically_increasing_id()), "signatures")
    some = signed_docs.where("key IS NOT NULL")
    # a set goes by the row of its least id, as a repeated id may carry several sets
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "text_hash")).alias("first")
    reps = some.groupBy("key", "node", "grams").agg(first, F.count("*").alias("copies"))
    reps = stage(reps.select("key", "node", "grams", F.col("first.row").alias("rep"), "first", "copies"), "sets")

    def enter(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        node, at = np.unique(batch.column(0).to_numpy(), return_index=True)
        bucket = batch.column(1).flatten().to_numpy().reshape(-1, bands)[at]
        return np.repeat(node, bands), bucket.ravel()

    found = cells.stars(some.select("node", "bands"), enter, reps.count() * bands)
    # a component goes by 64 bits of its sets' digests; equal ones of two sets would only join two components
    parts = stage(connected_components(found, "candidates", forest=True), "candidate-parts")
    wanted = parts.join(reps.select("node", "key", "rep", "copies", "grams", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash")), "node")
    wanted = stage(wanted, "candidate-sets")
    split = F.greatest(cells.blocks("size", block), F.ceil(F.col("runs") / F.lit(grams))).alias("blocks")
    sizes = wanted.groupBy("component").agg(F.count("*").alias("size"), F.sum("grams").alias("runs")).select("component", split)
    wanted = wanted.join(sizes, "component").select("component", "blocks", "rep", "copies", "key", F.xxhash64("id", "hash").alias("mark"))
    held = bit_map(wanted, "mark")

    def sets_of(batches):
        for batch in batches:
            part = batch.filter(pa.array(marked(held, batch.column(1).to_numpy())))
            for at in range(0, len(part), 256):
                sets = shingle_sets(part.slice(at, 256).column(0).to_pylist(), n)
                yield {"key": [digest(s) for s in sets], "members": [s.tobytes() for s in sets]}

    full = map_arrow(docs.select("text", F.xxhash64("doc_id", "text_hash").alias("mark")), sets_of, "key binary, members binary")
    # repeated rows of one id and text bring one set; partitions by key serve the join and the grouping
    full = full.join(wanted, "key").groupBy("key").agg(*(F.first(c).alias(c) for c in ("rep", "component", "blocks", "copies", "members")))
    placed = cells.with_cells(full, "rep", "blocks")

    def verify(cell: pa.Table):
        ids = cell.column("rep").to_numpy()
        sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in cell.column("members")]
        across = cell.column(1)[0].as_py() != cell.column(2)[0].as_py()
        i, j = similar_pairs(sets, threshold, cell.column("__mine").to_numpy() if across else None)
        return cells.linked_rows(ids, cell.column("copies").to_numpy(), i, j)

    linked = cells.compare(placed, ["component", "__i", "__j"], ["__mine", "rep", "copies", "members"], verify, "ngram-links")
    # classes by the sets' rows: of each set its links and the row that its component goes by
    found = cells.classes(reps.select(F.col("rep").alias("set"), "key"), reps.select("key", "rep", "copies"), linked, "set")
    found = stage(found.select(F.col("set").alias("rep"), "n_links", F.col("component_id").alias("part")).join(reps.select("rep", "key", "first"), "rep"), "ngram-classes")
    least = found.groupBy("part").agg(F.min("first").alias("least"))
    known = found.join(least, "part").select("key", "n_links", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("kept_row"))
    more = ["text_hash"] if hashed else []
    out = some.join(known, "key").select("doc_id", "n_links", "component_id", (F.col("row") == F.col("kept_row")).alias("kept"), *more)
    alone = signed_docs.where("key IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), *more)
    return out.union(alone)
