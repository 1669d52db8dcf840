"""NumPy helpers on the buffers of Arrow string columns: words, hashes, ragged gathers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time.
CHUNK = 1 << 20

ODD, UNODD = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base & (2**64 - 1)
    return np.multiply.accumulate(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices, from prefix sums of a polynomial over the bytes.

    For feature buckets only: slices that collide can be constructed.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    low, high = int(starts[0]), int(ends.max())
    n = high - low
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * powers(ODD, n), out=sums[1:])
    back = powers(UNODD, n)
    h = (sums[ends - low] - sums[starts - low]) * back[np.minimum(starts - low, n - 1)]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: Bytes up to which slices are hashed side by side; longer ones one by one.
SIDE_BY_SIDE = 64
TAILS = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)


def seeded_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: list[int]) -> np.ndarray:
    """64-bit hashes of slices, one row for each seed: blocks of 8 bytes, each mixed into all before it.

    With seeds that are drawn for a run, nobody can choose slices that collide.
    """
    out = np.empty((len(seeds), len(starts)), np.uint64)
    if not len(starts):
        return out
    sizes = ends - starts
    for lane, seed in zip(out, seeds):
        lane[:] = mix(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**64))
    low, high = int(starts.min()), int(ends.max())
    padded = np.zeros(high - low + 8, np.uint8)
    padded[: high - low] = data[low:high]
    blocks = np.ndarray(high - low + 1, "<u8", padded, strides=(1,))  # the 8 bytes from every byte on
    at = 0
    live = np.flatnonzero((sizes > 0) & (sizes <= SIDE_BY_SIDE))
    while len(live):
        block = blocks[starts[live] - low + at] & TAILS[np.minimum(sizes[live] - at, 8)]
        for lane in out:
            lane[live] = mix(lane[live] ^ block)
        at += 8
        live = live[sizes[live] > at]
    for i in np.flatnonzero(sizes > SIDE_BY_SIDE).tolist():
        piece = data[starts[i]:ends[i]].tobytes()
        for lane, seed in zip(out, seeds):
            lane[i] = int.from_bytes(hashlib.blake2b(piece, digest_size=8, key=(seed % 2**64).to_bytes(8, "little")).digest(), "little")
    return out


def ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices first[i], first[i] + 1, ... (counts[i] of them) for every i."""
    total = int(counts.sum())
    shift = first - np.append(0, np.cumsum(counts)[:-1]) if len(counts) else first
    return np.repeat(shift, counts) + np.arange(total)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK):
    """Slices of a batch whose texts hold about ``limit`` bytes (one text at least)."""
    _, offsets = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def binaries(values: np.ndarray, before: np.ndarray, width: int = 4) -> pa.Array:
    """Binary values out of a flat array cut at ``before``."""
    return pa.Array.from_buffers(pa.large_binary(), len(before) - 1, [
        None, pa.py_buffer((before * width).astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


UPPER_TO_LOWER = np.arange(256, dtype=np.uint8)
UPPER_TO_LOWER[65:91] += 32
IS_WHITE = np.zeros(256, bool)
IS_WHITE[[32, *range(9, 14)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the runs without space and U+0009-U+000D, and the number of words before every text."""
    low, high = int(offsets[0]), int(offsets[-1])
    if low == high:
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    solid = ~IS_WHITE[data[low:high]]
    edge = np.zeros(high - low + 1, bool)
    edge[offsets - low] = True
    before = np.append(True, ~solid[:-1]) | edge[:-1]
    after = np.append(~solid[1:], True) | edge[1:]
    starts, ends = np.flatnonzero(solid & before) + low, np.flatnonzero(solid & after) + low + 1
    return starts, ends, np.searchsorted(starts, offsets)


def combined(hashes: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """One hash of several, in their order."""
    total = np.full(len(hashes[0]), salt * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for k, h in enumerate(hashes):
        total = total + h * np.uint64(pow(0xBF58476D1CE4E5B9, k + 1, 2**64))
    return mix(total)
