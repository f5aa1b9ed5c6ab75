"""Byte-level numpy kernels over Arrow text columns, shared by the operators of this subpackage.

A column of texts is handled as one flat ``uint8`` array with row offsets, in blocks of about
``BLOCK`` bytes, so that the memory of a task doesn't depend on the size of an Arrow batch.
A single text longer than a block makes a block of its own: texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

#: ASCII space and \t \n \v \f \r: what separates words in every contract of this subpackage.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least (kept per process)."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << (n - 1).bit_length()
        up, down = np.full(size, base, np.uint64), np.full(size, _inverse(int(base)), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(up), np.cumprod(down)
        if size <= 4 * BLOCK:  # a giant text's table isn't kept
            _powers[int(base)] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


def text_blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows of about ``limit`` bytes; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, flat[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that don't cross a row boundary."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = member.copy()
    first[1:] &= ~member[:-1] | edge[1:n]
    last = member.copy()
    last[:-1] &= ~member[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of white-space separated words, and the offsets of each row's words."""
    starts, ends = runs(~IS_SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by prefix sums of a polynomial modulo 2**64."""
    up, down = powers(_BASE, len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n consecutive items from each position of ``first``."""
    up, down = powers(_GRAM, len(hashes) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=total[1:])
        return mix((total[first + n] - total[first]) * down[first])


def gram_starts(word_offsets: np.ndarray, n: int) -> np.ndarray:
    """Positions at which n words of one row begin."""
    total = int(word_offsets[-1])
    if total < n:
        return np.zeros(0, np.int64)
    room = np.repeat(word_offsets[1:], np.diff(word_offsets))
    at = np.arange(total)
    return at[at + n <= room]
