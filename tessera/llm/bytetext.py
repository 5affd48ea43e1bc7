"""Vectorised scanning of UTF-8 text columns: words, their hashes and their documents.

Everything here works on one flat byte buffer with document offsets, so the cost is a few numpy
passes a byte and memory is a small multiple of the batch that the caller cut with ``chunks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIX = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags, true outside the given inclusive byte ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Words are maximal runs of bytes outside white space.
NON_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words are maximal runs of digits, lower-case letters and bytes of non-ASCII characters.
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def chunks(column: pa.Array | pa.ChunkedArray, most: int = 6 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``most`` bytes; nulls are empty.

    A single longer text makes a run of its own: texts are never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        end = min(end, len(column))
        yield row, end, buf[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes that table marks; runs end with their document."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = table[buf]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    at = off[:-1][off[:-1] < len(buf)]
    begin[at] = word[at]
    close = word.copy()
    close[:-1] &= ~word[1:]
    at = off[1:][off[1:] > 0] - 1
    close[at] = word[at]
    return np.flatnonzero(begin), np.flatnonzero(close) + 1


def docs_of(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Words of each document: offsets into starts."""
    return np.searchsorted(starts, off)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step."""
    size = ends - starts
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray(shape=(len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    active, step = None, 0
    while True:
        at = starts if active is None else starts[active] + step
        left = size if active is None else size[active] - step
        mixed = (out if active is None else out[active]) ^ (words[at] & _MASK[np.minimum(left, 8)])
        mixed *= MIX
        mixed ^= mixed >> np.uint64(29)
        if active is None:
            out = mixed
            active = np.flatnonzero(size > 8)
        else:
            out[active] = mixed
            active = active[left > 8]
        step += 8
        if not len(active):
            break
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive combination of two hash arrays."""
    out = (a * np.uint64(0xFF51AFD7ED558CCD)) ^ (b + MIX)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    out ^= out >> np.uint64(30)
    return out


def hash_word(word: str) -> int:
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(hash_spans(raw, np.array([0]), np.array([len(raw)]))[0])
