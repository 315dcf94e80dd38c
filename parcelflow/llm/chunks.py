"""Arrow helpers shared by the text operators: bounded slices of a batch and its distinct chunks.

Most text is made of words that come again and again.  A slice is split at single spaces by Arrow's
kernels and dictionary-encoded, so Python code sees each distinct chunk once per slice and the rest is
array arithmetic on the codes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once by a Python worker; one longer document is a slice of its own.
SLICE_BYTES = 3 << 20


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that column ``text`` of each piece holds about ``limit`` bytes at most; nulls become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text)
        if col.null_count:
            batch = batch.set_column(text, batch.schema.field(text).with_nullable(False), pc.fill_null(col, b"" if pa.types.is_binary(col.type) else ""))
        ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def text_flags(batches: Iterator[pa.Array], test: Callable[[pa.Array], np.ndarray], limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Of each array of texts, what ``test`` says of its bounded slices; nulls are tested as empty texts."""
    for texts in batches:
        flags = [test(part.column(0)) for part in slices(iter([pa.record_batch([texts], names=["text"])]), 0, limit)]
        yield pa.array(np.concatenate(flags) if flags else np.zeros(0, bool))


def release() -> None:
    """Hand freed memory back to the system: Spark keeps Python workers for later stages, which run beside idle ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def split_distinct(texts: pa.Array, sep: str = " ") -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first chunk of each text and the end, code of each chunk, distinct chunks) of texts split at ``sep``."""
    lists = pc.split_pattern(texts, sep)
    codes = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], codes.indices.to_numpy(zero_copy_only=False), codes.dictionary


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i]`` of all i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring offsets; an empty stretch gives 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets from 0) of a string or binary array without nulls, without copying."""
    if texts.type in (pa.large_string(), pa.large_binary()):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
