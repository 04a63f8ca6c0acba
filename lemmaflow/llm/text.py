"""Words and stable hashes, for tasks that run Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Words are runs of anything but ASCII white space, as bytes.split() cuts them.
MAX_CACHED = 300_000


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; keeps at most MAX_CACHED words, further ones are hashed each time."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MAX_CACHED:
            self[word] = h
        return h


_cache = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_cache.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct signed hashes of the word k-grams; of the whole sequence if there are fewer words; none without words."""
    if not words:
        return np.empty(0, np.int64)
    h = word_hashes(words)
    n = max(1, len(words) - k + 1)
    with np.errstate(over="ignore"):
        x = np.full(n, min(k, len(words)), np.uint64)
        for i in range(min(k, len(words))):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(x.view(np.int64))


def ascii_words(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z only (bytes.lower leaves all else alone)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=schema.field(n).type) for n, x in columns.items()], schema=schema)
