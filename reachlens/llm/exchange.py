"""Blocks of documents and buckets of keys, and the packed messages that go between them.

Statistics over all documents are too many rows to shuffle one by one. So documents are dealt into blocks of bounded
size by a hash of their id and text; a block sends each bucket (a range of 64-bit hashes) one packed message with its own distinct
keys, the bucket merges the messages of all blocks, and answers each block about the keys it asked for. A frequent key
comes once from each block, so no bucket grows with its frequency, and messages are numpy arrays all the way.
"""

from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: UTF-8 bytes of text in a block, about.
BLOCK_BYTES = 8 << 20


def count_blocks(docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("n")).first()["n"] or 0
    return max(1, math.ceil(total / block_bytes))


def in_blocks(docs: DataFrame, blocks: int, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """_block, _id, _text of all documents, and the columns to ``carry`` as _carry0 and so on; nothing else of ``docs`` is read.

    Ids are hashed with their texts, so that many rows with one id, or none, don't make one large block, and with the number of
    the input partition, so that of rows equal in both a block gets those of a partition at most. That number doesn't depend on
    the order of rows, so a partition that is read again is dealt alike.
    """
    return docs.select(*(F.col(c).alias(f"_carry{k}") for k, c in enumerate(carry)), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.spark_partition_id()), F.lit(blocks)).cast("int").alias("_block"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values stirred (the finalizer of SplitMix64: fixed values), so that ranges of them are even buckets."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the keys (sorted) of each bucket begin, and the end: bucket b holds the b-th of ``buckets`` even ranges."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def parts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[slice]]:
    """The buckets that hold some of the keys (sorted), and the keys of each. Empty buckets get no message, so there are never
    more messages than keys, however many blocks and buckets."""
    at = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    edges = [*first.tolist(), len(keys)]
    return at[first], [slice(a, b) for a, b in zip(edges, edges[1:])]


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def expand(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys: their gaps, byte plane by byte plane, since the high bytes of gaps are mostly zero."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return squeeze(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_keys(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Non-negative integers, in the narrowest type that holds them, byte plane by byte plane."""
    top = int(numbers.max()) if len(numbers) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return bytes([width]) + squeeze(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def unpack_numbers(packed: bytes) -> np.ndarray:
    width = packed[0]
    planes = np.frombuffer(expand(packed[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype(np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of each key among them, and their numbers."""
    order = np.argsort(keys)
    run = keys[order]
    new = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return run[new], place, np.diff(np.append(starts, len(run)))
