"""Array kernels over whole Arrow text columns: words, window hashes and per-document reductions.

A block is the UTF-8 bytes of several texts end to end with their offsets; no step runs a Python
loop over words (but for those of more than LONG bytes). Null texts count as empty ones.

Hashes are 64 bits, made by steps that each end in mix(): they are not linear in the bytes or words, so
that texts cannot be told apart worse than by chance because of how they are built. Where chance is not
good enough, callers take two seeds or compare the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
LONG = 64  # bytes: longer words are hashed one by one
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def blocks(column, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about limit bytes; a longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], (offsets[at : to + 1] - offsets[at]).astype(np.int64)
        at = to


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of true bytes, cut at text borders, and each text's first run."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    off = ~mask
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = off[:-1], off[1:]
    start = np.flatnonzero(mask & (before | edge[:n]))
    end = np.flatnonzero(mask & (after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than 0x20 and 0x09 to 0x0D."""
    return runs(~SPACE[data], offsets)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, *seeds: int):
    """A 64-bit hash of each span; with several seeds a list, one array for each. Spans of up to eight bytes that are equally long never meet."""
    size = end - start
    at8 = eights(data)
    out = [mix(size.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(seed)) for seed in seeds or (0,)]
    live = np.flatnonzero(size <= LONG)
    for step in range(0, LONG, 8):
        live = live[size[live] > step]
        if not len(live):
            break
        x = at8[start[live] + step] & _MASK[np.minimum(size[live] - step, 8)]
        for h in out:
            h[live] = mix(h[live] ^ x * U64(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(size > LONG):
        raw = data[start[i] : end[i]].tobytes()
        for h, seed in zip(out, seeds or (0,), strict=True):
            h[i] = xxhash.xxh3_64_intdigest(raw, seed)
    return out if len(seeds) > 1 else out[0]


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring pieces from theirs."""
    return mix(a * U64(0xC2B2AE3D27D4EB4F) + (b ^ (b >> U64(29))))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i:i+k] for each i, from pieces of 1, 2, 4 .. words; borders are the caller's to keep."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    piece, out, done, size = h, None, 0, 1
    while done < k:
        if k & size:
            part = piece[done : done + n]
            out = part if out is None else join(out, part)
            done += size
        if done < k:
            piece, size = join(piece[:-size], piece[size:]), 2 * size
    return out


def inside(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions i whose window of k words stays in its text, and each text's first such position. first: words before each text."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    base = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(base[-1], dtype=np.int64) + np.repeat(first[:-1] - base[:-1], count)
    return at, base


def per_text(op: np.ufunc, values: np.ndarray, base: np.ndarray, empty) -> np.ndarray:
    """op reduced over values[base[i]:base[i+1]], empty where there are none."""
    out = np.full(len(base) - 1, empty, values.dtype)
    full = np.flatnonzero(base[1:] > base[:-1])
    if len(full):
        out[full] = op.reduceat(values, base[full])
    return out


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))
