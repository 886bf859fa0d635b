"""What the operators of this subpackage share: NumPy kernels over whole batches of text, and memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from waymill.scratch import materialise, scratch_path

__all__ = ["U64", "WORD", "Words", "hash_share", "materialise", "mix", "pack", "release", "remainder", "scratch_path", "slices", "span_hashes", "squeeze", "tidied", "unpack", "unsqueeze", "windows"]

U64 = np.uint64
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one kernel call handles at most, unless one text is longer.
SLICE_CHARS = 500_000


def remainder(column: str, n: int):
    """crc32 of the value as text, modulo n (null for null)."""
    return F.crc32(F.col(column).cast("string")) % n


def release() -> None:
    """Give freed memory back to the system: a worker outlives its task, and the next stage has others beside it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidied(run):
    """A function over batches that releases its memory when it is through."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each hold about ``limit`` bytes or are one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip(np.r_[0, edges], np.r_[edges, n], strict=True):
            yield batch.slice(int(a), int(b - a))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (wraps)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^0 ... r^(n-1) and their inverses modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.r_[U64(1), np.full(size - 1, U64(r), dtype=U64)], dtype=U64) for r in (_R, _R_INV)]
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for each pair of bounds, in O(len(data)).

    For short spans of values that are hashes themselves: over raw bytes of long spans
    powers modulo 2^64 have known collisions (Thue-Morse words).
    """
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(0x51ED27)) * up[:-1], dtype=U64, out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


class Words:
    """Words of a list of texts, by the pattern WORD: owners, bounds, and which are equal.

    doc: index of the text by word; start, end: byte bounds in ``data``, the UTF-8 of all
    texts; first: for each text the index of its first word. Made when asked for:
    distinct, the different words (each with one space after it), by their bytes; index:
    which of these each word is; hashes: XXH3 of 64 bits by word.
    """

    def __init__(self, texts: list[str | bytes | None]):
        raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.joined = b" ".join(raw) + b" "
        data = self.data = np.frombuffer(self.joined, dtype=np.uint8)
        inside = np.empty(len(data) + 1, dtype=np.int8)
        inside[0] = 0
        inside[1:] = ((data != 32) & ((data < 9) | (data > 13))).view(np.int8)
        step = np.diff(inside)
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        offsets = np.cumsum(lengths + 1) - lengths - 1
        self.first = np.searchsorted(self.start, np.r_[offsets, len(data)])
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    @cached_property
    def plain(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with one space after each, and where each begins (and the last ends)."""
        keep = (self.data != 32) & ((self.data < 9) | (self.data > 13))
        keep[self.end] = True
        bounds = np.r_[0, np.cumsum(self.end - self.start + 1)]
        out = self.data[keep]
        out[bounds[1:] - 1] = 32
        return out, bounds

    @cached_property
    def _coded(self) -> tuple[list[bytes], np.ndarray]:
        out, bounds = self.plain
        column = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])
        coded = column.dictionary_encode()
        bounds, whole = np.frombuffer(coded.dictionary.buffers()[1], np.int64, len(coded.dictionary) + 1).tolist(), coded.dictionary.buffers()[2].to_pybytes()
        return [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.asarray(coded.indices)

    @property
    def distinct(self) -> list[bytes]:
        return self._coded[0]

    @property
    def index(self) -> np.ndarray:
        return self._coded[1]

    @cached_property
    def hashes(self) -> np.ndarray:
        found = np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct), dtype=U64, count=len(self.distinct))
        return found[self.index] if len(self) else np.zeros(0, dtype=U64)

    def digests(self) -> list[bytes]:
        """BLAKE2b of 128 bits of each text's words: equal for texts of the same words, and no others that anyone knows."""
        out, bounds = self.plain
        whole, ends = memoryview(out), bounds[self.first].tolist()
        return [hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive entries; len(hashes) - n + 1 of them."""
    if len(hashes) < n:
        return np.zeros(0, dtype=U64)
    at = np.arange(len(hashes) - n + 1)
    return span_hashes(hashes, at, at + n)


def pack(values: np.ndarray) -> bytes:
    """A numeric array, bytes transposed and compressed."""
    import zstandard

    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    """The array that pack() took."""
    import zstandard

    dtype = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def squeeze(text: str | None) -> bytes | None:
    """A text, compressed for a shuffle; null stays null."""
    import zstandard

    return None if text is None else zstandard.ZstdCompressor(level=1).compress(text.encode("utf-8", "surrogatepass"))


def unsqueeze(blob: bytes | None) -> str | None:
    import zstandard

    return None if blob is None else zstandard.ZstdDecompressor().decompress(blob).decode("utf-8", "surrogatepass")


def hash_share(key: Column | str, share: float) -> Column:
    """Whether a row is in the sample of this share by the whole 64-bit hash of the key; however small, a share is not cut to 0."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(key) < F.lit(int(share * 2.0**64) - (1 << 63))
