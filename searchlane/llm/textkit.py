"""Word splitting and vectorised hashing used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: bytes of text that one numpy pass holds (a longer text is a pass of its own)
CHUNK_BYTES = 4 << 20

#: whitespace of the contract's words ``[^\x20\x09-\x0D]+``; bytes.split() splits at the same six bytes
SPACES = "\\x20\\x09-\\x0D"

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that low and high bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(w: np.ndarray, m: int) -> np.ndarray:
    """Hash of every run of ``m`` consecutive word hashes."""
    n = len(w) - m + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = w[:n].copy()
    for j in range(1, m):
        h = h * _BASE + w[j:n + j]
    return mix(h)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
