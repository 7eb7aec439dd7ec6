"""Words of raw UTF-8 text as dense numbers, shared by the operators that work on word windows.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Texts are
processed in slices of bounded bytes, so that memory does not follow the input.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
U64 = np.uint64


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each with about ``most`` bytes of text; a longer text has a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(sizes), 0
    while at < len(batch):
        n = max(1, int(np.searchsorted(total, total[at] - sizes[at] + most, side="right")) - at)
        yield batch.slice(at, n)
        at += n
    release()


def release() -> None:
    """Give freed memory back to the system: the Python workers share an executor's bound with its JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Words:
    """The words of a column of texts in a row: ``ids`` number equal words alike, ``ends`` says where each text begins and ends."""

    def __init__(self, texts: pa.Array):
        found = pc.ascii_split_whitespace(texts.fill_null(""))
        flat, ends = found.flatten(), found.offsets.to_numpy() - found.offsets[0].as_py()
        full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # space at the edges of a text leaves empty words
        if not full.all():
            ends, flat = np.concatenate([[0], np.cumsum(full)])[ends], flat.filter(pa.array(full))
        coded = flat.dictionary_encode()
        self.flat, self.ends = flat, ends.astype(np.int64)
        self.ids, self.unique = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word in a row."""
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.unique.cast(pa.binary() if self.unique.type == pa.string() else pa.large_binary()).to_pylist()), dtype=U64, count=len(self.unique))[self.ids]

    def joined(self, keep: np.ndarray) -> pa.Array:
        """Each text's kept words, joined by one space."""
        ends = np.concatenate([[0], np.cumsum(keep)])[self.ends].astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), self.flat.filter(pa.array(keep))), " ")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def window_hashes(hashes: np.ndarray, width: int, factor: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive entries."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= U64(factor)
        out += hashes[k : k + n]
    return mixed(out)


def window_starts(ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a run of ``width`` words of one text begins, and the text of each."""
    per = np.maximum(np.diff(ends) - width + 1, 0)
    doc = np.repeat(np.arange(len(per)), per)
    first = np.repeat(ends[:-1] - np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    return np.arange(len(doc)) + first, doc


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a run of ``width`` that begins at one of ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0
