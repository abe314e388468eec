"""Candidate groups and their blocked comparison: what the pair operators share.

Rows that share a bucket are tied to the bucket's least row (a star, no pairs are listed); the
components of all stars are the candidate groups. A group of n rows is split into blocks by a hash
of the row's id; each pair of blocks is a cell. Cells are spread over all tasks, so that no task
ever holds a large group. A cell gives one row for each of its linked rows: how many rows it links
to, and one row of its linked set.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import connected_components, local_roots, map_arrow, pack_arrays, stage, unpack_arrays

#: Rows of a block; a cell holds two blocks at most.
BLOCK = 1024
#: Groups of more rows than SMALL are split into up to SPREAD blocks, so that several tasks share them.
SMALL, SPREAD = 256, 4
#: Entries of a task that ties buckets.
ENTRIES = 4_000_000
#: Entries that a task ties at once before they are shuffled.
TIED = 500_000
_ENTRIES, _EDGES = 0, 1


def tie(node: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each bucket's least node stands, in the order of buckets, and (node, least node) of the others, each pair once."""
    order = np.lexsort((node, bucket))
    new = np.ones(len(order), bool)
    new[1:] = bucket[order[1:]] != bucket[order[:-1]]
    first = order[new]
    u, v = node[order], np.repeat(node[first], np.diff(np.append(np.flatnonzero(new), len(order))))
    u, v = u[u != v], v[u != v]
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    once = np.ones(len(u), bool)
    once[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return first, u[once], v[once]


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that the links (u, v) tie to a smaller one, ascending, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = local_roots(len(nodes), at[: len(u)], at[len(u) :])
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def _pack_entries(bucket: np.ndarray, node: np.ndarray) -> bytes:
    """Entries in the order of buckets; 40 bits of a bucket tell it from the others of its task."""
    table, place = np.unique(node, return_inverse=True)
    head = pack_arrays(table)
    return struct.pack("<I", len(head)) + head + pack_arrays(np.diff(bucket.view(np.uint64) >> np.uint64(24), prepend=np.uint64(0)), place.astype(np.uint32))


def _unpack_entries(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and buckets."""
    n = struct.unpack("<I", blob[:4])[0]
    step, place = unpack_arrays(blob[4 + n :], "u8", "u4")
    return unpack_arrays(blob[4 : 4 + n], "i8")[0][place], np.cumsum(step, dtype=np.uint64).view(np.int64)


def stars(df: DataFrame, enter: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], entries: int) -> DataFrame:
    """(u, v): links whose components are the groups of nodes that buckets bring together.

    enter gives the nodes and buckets (64-bit integers) of a batch; entries: about how many there
    are. What a task has read is tied before the shuffle: a bucket of any size brings one entry each
    time, and the nodes that it ties go by their least one. Entries travel packed, some 6 bytes each,
    to tasks of about ENTRIES."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), entries // ENTRIES + 1)

    def tied(nodes: list[np.ndarray], buckets: list[np.ndarray]):
        node, bucket = np.concatenate(nodes), np.concatenate(buckets)
        nodes.clear(), buckets.clear()
        first, u, v = tie(node, bucket)
        u, v = _forest(u, v)
        node, bucket = node[first], bucket[first].view(np.uint64)
        if len(u):
            at = np.minimum(np.searchsorted(u, node), len(u) - 1)
            node = np.where(u[at] == node, v[at], node)
        dest = (bucket % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((bucket, dest))
        node, bucket = node[order], bucket[order]
        cuts = np.cumsum(np.bincount(dest, minlength=parts))
        out = [(p, _ENTRIES, _pack_entries(bucket[a:z], node[a:z])) for p, (a, z) in enumerate(zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)) if a < z]
        if len(u):
            out.append((int(u[0]) % parts, _EDGES, pack_arrays(u, v)))
        for k in range(0, len(out), 256):
            yield dict(zip(("dest", "kind", "blob"), map(list, zip(*out[k : k + 256], strict=True)), strict=True))

    def pack(batches):
        nodes, buckets, size = [], [], 0
        for batch in batches:
            for at in range(0, len(batch), 2048):
                node, bucket = enter(batch.slice(at, 2048))
                nodes.append(node), buckets.append(bucket)
                size += len(node)
                if size > TIED:
                    yield from tied(nodes, buckets)
                    size = 0
        if size:
            yield from tied(nodes, buckets)

    def meet(batches):
        nodes, buckets = [], []
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == _EDGES:
                    u, v = unpack_arrays(blob, "i8", "i8")
                    yield {"u": u, "v": v}
                else:
                    node, bucket = _unpack_entries(blob)
                    nodes.append(node), buckets.append(bucket)
        if nodes:
            _, u, v = tie(np.concatenate(nodes), np.concatenate(buckets))
            u, v = _forest(u, v)
            for k in range(0, len(u), 100_000):
                yield {"u": u[k : k + 100_000], "v": v[k : k + 100_000]}

    return map_arrow(map_arrow(df, pack, "dest int, kind int, blob binary").repartitionById(parts, "dest"), meet, "u long, v long")


def blocks(rows: str, block: int = BLOCK) -> F.Column:
    """Into how many blocks a group of so many rows is split."""
    n = F.col(rows)
    return F.greatest(F.ceil(n / F.lit(block)), F.least(F.lit(SPREAD), F.ceil(n / F.lit(SMALL)))).cast("long")


def with_cells(df: DataFrame, id_col: str, blocks_col: str) -> DataFrame:
    """One row for each cell of a row: adds __mine (its block), __i and __j (the cell, i <= j)."""
    return (
        df.withColumn("__mine", F.pmod(F.xxhash64(id_col), F.col(blocks_col)))
        .withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks_col) - 1)))
        .withColumn("__i", F.least("__mine", "__other"))
        .withColumn("__j", F.greatest("__mine", "__other"))
        .drop("__other")
    )


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in the first `keys` columns (integers) of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:keys]], 1)
        cuts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(batch)]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            now = tuple(key[lo].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def linked_rows(ids: np.ndarray, weight: np.ndarray, i: np.ndarray, j: np.ndarray) -> dict:
    """Rows (rep, links, root) of the linked ones of ids; links are weighted with the other's copies."""
    n = len(ids)
    links = np.bincount(i, weights=weight[j], minlength=n) + np.bincount(j, weights=weight[i], minlength=n)
    at = np.flatnonzero(links)
    root = local_roots(n, i, j)
    return {"rep": ids[at], "links": links[at].astype(np.int64), "root": ids[root[at]]}


LINKED = "rep long, links long, root long"


def compare(cells: DataFrame, keys: list[str], columns: list[str], fn: Callable[[pa.Table], dict | None], name: str) -> DataFrame:
    """Deals the cells out by their keys and applies fn to each; fn gives linked_rows or None."""
    dealt = cells.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        held: list[dict] = []
        size = 0
        for group in grouped(batches, len(keys)):
            if group.num_rows > 1 and (rows := fn(group)) is not None and len(rows["rep"]):
                held.append(rows)
                size += len(rows["rep"])
            if size > 5000:
                yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}
                held, size = [], 0
        if held:
            yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}

    return stage(map_arrow(dealt, run, LINKED), name)


def classes(members: DataFrame, reps: DataFrame, linked: DataFrame, id_name: str) -> DataFrame:
    """id_name, n_links, component_id and kept of all members.

    members: (id_name, key); reps: (key, rep, copies), rep the least id of the key's rows."""
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(linked.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    known = reps.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select(
        "key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").cast("long").alias("component_id")
    )
    return members.join(known, "key").select(id_name, "n_links", "component_id", (F.col(id_name) == F.col("component_id")).alias("kept"))
