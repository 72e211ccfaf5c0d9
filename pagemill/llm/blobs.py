"""Numeric columns packed into binary values, so that a shuffle moves few rows and few bytes."""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text: str | None) -> list[bytes]:
    """A-Z lowered words of a text; ``bytes`` methods know exactly the contract's white space and letters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_words(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pack(*columns: np.ndarray, rising: tuple[int, ...] = ()) -> bytes:
    """Columns (any integer or float types) as one compressed value.

    Those in ``rising`` are sorted integers and stored as differences; all are
    stored byte plane by byte plane, where high bytes compress to nothing.
    """
    parts = []
    for i, c in enumerate(columns):
        c = np.ascontiguousarray(c)
        kind = c.dtype.str
        if i in rising:
            c = np.diff(c, prepend=c.dtype.type(0))
        parts.append(f"{kind} {len(c)} {int(i in rising)};".encode())
        parts.append(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() if len(c) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(value: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(value)
    out, at = [], 0
    while at < len(data):
        end = data.index(b";", at)
        kind, n, rising = data[at:end].decode().split()
        dtype, n = np.dtype(kind), int(n)
        size = n * dtype.itemsize
        c = np.frombuffer(data, np.uint8, size, end + 1).reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n) if n else np.empty(0, dtype)
        out.append(np.cumsum(c, dtype=dtype) if rising == "1" else c)
        at = end + 1 + size
    return out


def bucket_count(docs: DataFrame, target_bytes: int, least: int = 32) -> int:
    """A power of two of buckets with about ``target_bytes`` of text each, from a scan of text lengths."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, 1 << math.ceil(math.log2(max(1, total / target_bytes))))
