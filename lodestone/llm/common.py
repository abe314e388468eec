"""What the corpus operators share: Arrow maps and plain documents, beside staged tables and components."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.components import connected_components, local_roots  # noqa: F401
from lodestone.sources.staging import shared_dir, stage  # noqa: F401


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow for functions that yield dicts of columns in the order of schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind if isinstance(kind, StructType) else StructType())

    def run(batches):
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays(
                [columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, kind)


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that count, as (doc_id, text); a null text is empty."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


# arrays travel as byte planes, which compress


def pack_arrays(*arrays: np.ndarray) -> bytes:
    import zstandard

    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"" for a in arrays)
    return struct.pack("<I", len(arrays[0])) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_arrays(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    n = struct.unpack("<I", blob[:4])[0]
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob[4:]), [], 0
    for kind in map(np.dtype, kinds):
        size = kind.itemsize * n
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


#: Bits of a map (8 MB), and of the parts in which it is made.
MAP_BITS, PART_BITS = 26, 20


def bit_map(df: DataFrame, column: str) -> bytes:
    """Bits of the values (64-bit hashes) of a column, compressed; its size does not grow with the rows.

    Parts of the map are made and united by tasks."""
    size = 1 << (PART_BITS - 3)

    def mark(batches):
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            bit = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS)
            for part in np.unique(bit >> np.uint64(PART_BITS)).tolist():
                at = (bit[bit >> np.uint64(PART_BITS) == part] & np.uint64((1 << PART_BITS) - 1)).astype(np.int64)
                np.bitwise_or.at(parts.setdefault(part, np.zeros(size, np.uint8)), at >> 3, (1 << (at & 7)).astype(np.uint8))
        for part, bits in parts.items():
            yield {"part": [part], "bits": [zlib.compress(bits.tobytes(), 1)]}

    def unite(batches):
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            for part, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts.setdefault(part, np.zeros(size, np.uint8))[:] |= np.frombuffer(zlib.decompress(bits), np.uint8)
        for part, bits in parts.items():
            yield {"part": [part], "bits": [zlib.compress(bits.tobytes(), 1)]}

    schema = "part int, bits binary"
    whole = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in map_arrow(map_arrow(df.select(column), mark, schema).repartition("part"), unite, schema).collect():  # at most 64 rows
        whole[r.part * size : (r.part + 1) * size] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return zlib.compress(whole.tobytes(), 1)


@lru_cache(maxsize=1)
def _bits(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def marked(packed: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the map."""
    bit = (hashes.view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return (_bits(packed)[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
