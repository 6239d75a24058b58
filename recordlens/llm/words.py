"""Words of many texts at once, as bytes in one array."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Lower-cases A-Z only.
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: Text handled at a time, so that memory stays in proportion to it (or to one longer text).
BLOCK_BYTES = 4 << 20


def byte_set(members: bytes | bytearray | list[int]) -> np.ndarray:
    """A mask over all byte values."""
    mask = np.zeros(256, bool)
    mask[list(members)] = True
    return mask


def blocks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``BLOCK_BYTES`` of text in column ``text``, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes behind each other, A-Z lower-cased, and where each text begins and the
    last ends. A null text is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset:column.offset + len(column) + 1]
    if not len(column) or bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = memoryview(column.buffers()[2])[bounds[0]:bounds[-1]]
    return np.frombuffer(bytes(data).translate(LOWER), np.uint8), bounds - bounds[0]


def words(data: np.ndarray, bounds: np.ndarray,
          inside: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Maximal runs of bytes that ``inside`` allows, within a text, and where each begins."""
    allowed = inside[data]
    begins = allowed.copy()
    begins[1:] &= ~allowed[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    begins[edges] = allowed[edges]
    at = np.flatnonzero(begins)
    before = np.cumsum(allowed, dtype=np.int64)[at] - 1 if len(at) else at
    kept = np.ascontiguousarray(data[allowed])
    offsets = np.append(before, len(kept)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]), at


def owner(bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each position lies in."""
    return np.searchsorted(bounds, at, "right") - 1


#: Texts of these characters alone have one normal form, and a lower case that keeps it.
PLAIN = re.compile("[\x00-\u012f\u0131-\u0148\u014a-\u017f\u2010-\u2027\u2030-\u203a\u20ac]*")
#: A letter or digit of those that tokenizers of words always part from punctuation behind it.
_BEHIND = re.compile("(?<=[0-9a-z\u00df-\u00f6\u00f8-\u00ff])([!-/:-@\\[-^`{-~]+)(?=[ \n])")


def pieces(text: str, plain: bool = True) -> list[str]:
    """A text cut at spaces and line breaks, for tokenizers that normalise to composed lower
    case, drop white space and never join across it. Where it can't change their result, the
    text is lower-cased and punctuation behind a word is a piece too, so that pieces recur."""
    if plain and (text.isascii() or PLAIN.fullmatch(text)):
        text = _BEHIND.sub(r" \1", text.lower())
    return text.replace("\n", " ").split(" ")
