"""Words, shingles and SimHash fingerprints of whole texts, in bounded memory.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, A-Z lower-cased;
both are what bytes.split() and bytes.lower() do, so UTF-8 needs no decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of text whose words are held at once.
PIECE = 1 << 20
SPACE = b" \t\n\x0b\x0c\r"


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task, and so would what it once held."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def encoded(text) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if isinstance(text, str) else b""


def pieces(b: bytes, overlap: int, limit: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """(index of its first word, words) of a text; each piece repeats the last `overlap` words before it."""
    if len(b) <= limit:
        yield 0, b.split()
        return
    kept: list[bytes] = []
    at, first = 0, 0
    while at < len(b):
        end = min(len(b), at + limit)
        while end < len(b) and b[end] not in SPACE:
            end += 1
        words = kept + b[at:end].split()
        yield first, words
        kept = words[-overlap:] if overlap else []
        first += len(words) - len(kept)
        at = end


def hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles of `size` words, repeats included; fewer words: of them all."""
    h = xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([h(joined, 42)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return np.array([h(joined[a:e], 42) for a, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], dtype=np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, lowest bit first."""
    out = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 15):
        out += np.unpackbits(np.ascontiguousarray(h[i : i + (1 << 15)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return out


def majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits((counts * 2 > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def simhash(text, size: int) -> int:
    """Unsigned 64-bit SimHash over word shingles; 0 for a text without words."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    last = -1
    for first, words in pieces(encoded(text), size - 1):
        if first and len(words) < size:  # nothing new but the repeated words
            continue
        h = hashes(words, size)
        counts += bit_counts(h)
        n += len(h)
        last = first
    return majority(counts, n) if last >= 0 and n else 0
