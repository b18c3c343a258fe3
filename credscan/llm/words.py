"""Words of Arrow text columns as 64-bit hashes, computed with numpy over whole batches.

A word is a maximal run of bytes outside space, tab, newline, vertical tab, form feed and
carriage return, with A-Z lowered; bytes above 0x7F belong to words. Null texts count as empty.
Long batches are hashed in blocks that end at a separator, so memory follows the block.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value per byte, and the powers of the base and of its inverse."""
    with np.errstate(over="ignore"):
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        powers = np.cumprod(np.full(BLOCK + 1, _BASE, np.uint64)) * np.uint64(pow(_BASE, -1, 1 << 64))
        inverse = np.cumprod(np.full(BLOCK + 1, pow(_BASE, -1, 1 << 64), np.uint64)) * np.uint64(_BASE)
    return values, powers, inverse


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offset of each row (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~outside[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def word_spans(column: pa.Array, alphanumeric: bool = False):
    """Bytes with A-Z lowered, start and end of each word, and the first word of each row.

    ``alphanumeric`` makes every ASCII byte that is neither letter nor digit a separator.
    """
    data, offsets = text_bytes(column)
    starts, ends = _spans(data, offsets, ~_ALNUM if alphanumeric else _SPACE)
    return _LOWER[data], starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; spans are ascending and disjoint."""
    values, powers, inverse = _tables()
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            upto = int(np.searchsorted(ends, low + BLOCK, side="right"))
            if upto == at:  # one span longer than a block: its blocks are chained
                chained = np.uint64(0)
                for k in range(low, ends[at], BLOCK):
                    part = data[k : min(k + BLOCK, ends[at])]
                    chained = mix(np.atleast_1d(chained + (values[part] * powers[: len(part)]).sum(dtype=np.uint64)))[0]
                out[at] = chained
                at += 1
                continue
            block = data[low : ends[upto - 1]]
            sums = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(values[block] * powers[: len(block)], out=sums[1:])
            s, e = starts[at:upto] - low, ends[at:upto] - low
            out[at:upto] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            at = upto
    return out


def word_hashes(column: pa.Array, alphanumeric: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the first word of each row (one more than rows)."""
    data, starts, ends, bounds = word_spans(column, alphanumeric)
    return hash_spans(data, starts, ends), bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all runs of ``width`` words of each row, in order, and their bounds.

    A row with fewer words gives one shingle of all its words, a row without words none.
    """
    counts = np.diff(bounds)
    with np.errstate(over="ignore"):
        run = hashes.copy()
        short = np.where((counts > 0) & (counts < width))[0]
        whole = []
        for row in short:
            value = np.uint64(counts[row])
            for h in hashes[bounds[row] : bounds[row + 1]]:
                value = mix(np.atleast_1d(value * np.uint64(_BASE) + h))[0]
            whole.append(value)
        for step in range(1, width):
            run = mix(run[:-1] * np.uint64(_BASE) + hashes[step:]) if len(run) else run
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    row_of = np.repeat(np.arange(len(counts)), sizes)
    at = bounds[:-1][row_of] + np.arange(len(row_of)) - out_bounds[:-1][row_of]
    out = np.zeros(len(at), np.uint64)
    full = counts[row_of] >= width
    out[full] = run[at[full]]
    out[out_bounds[:-1][short]] = np.array(whole, np.uint64)
    return (out >> np.uint64(1)).astype(np.int64), out_bounds
