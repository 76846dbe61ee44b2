"""Words of many texts at once: NumPy over the UTF-8 bytes of an Arrow column, so no Python code runs per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GROUP_BYTES = 1 << 20
PIECE_BYTES = 1 << 18
#: Bytes of a task's batches beyond which its worker gives memory back.
TIDY_BYTES = 1 << 20


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker; functions sent by value lose their modules' globals between tasks."""
    import sys

    return sys.__dict__.setdefault("_annalist_worker_cache", {})


def tidy() -> None:
    """Give back to the system what a task's batches have left; idle workers keep the rest of their memory."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def tidied(run):
    """A function of batches that tidies up when it ends, if it has seen more than TIDY_BYTES."""

    def each(batches):
        seen = 0

        def counted():
            nonlocal seen
            for batch in batches:
                seen += batch.nbytes
                yield batch

        yield from run(counted())
        if seen > TIDY_BYTES:
            tidy()

    return each


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_tables(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, folded byte) for `space`: words [^\\x20\\x09-\\x0D]+; `alnum`: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of text lower-cased in A-Z.

    Both classes treat every byte of a character beyond ASCII alike, so bytes decide as code points would.
    """
    b = np.arange(256)
    fold = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    if kind == "space":
        word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    else:
        word = ((fold >= 48) & (fold <= 57)) | ((fold >= 97) & (fold <= 122)) | (b >= 128)
    return word, fold


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1) of an Arrow string column; a null is an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a random value per byte, powers of an odd base, powers of its inverse) modulo 2**64."""
    cache = worker_cache()
    if "powers" not in cache:
        base = 0x9E3779B97F4A7C15
        n = PIECE_BYTES + 1
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        cache["powers"] = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)), np.cumprod(up), np.cumprod(down)
    return cache["powers"]


def piece_words(data: np.ndarray, cuts: np.ndarray, is_word: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of at most PIECE_BYTES bytes; no word crosses one of the sorted cuts."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    value, up, down = powers()
    w = is_word[data]
    before = np.empty(len(w), bool)
    before[0], before[1:] = False, w[:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    edge = before.copy()
    edge[cuts] = False
    starts = np.flatnonzero(w & ~edge)
    closing = before & ~w
    closing[cuts] |= before[cuts]
    ends = np.flatnonzero(closing)
    if w[-1]:
        ends = np.append(ends, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[fold[data]] * up[: len(data)], out=total[1:])
    return starts, ends, (total[ends] - total[starts]) * down[starts]


def long_word_hash(data: np.ndarray, fold: np.ndarray) -> np.uint64:
    """The same hash for one word longer than PIECE_BYTES."""
    value, up, _ = powers()
    out, scale = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for i in range(0, len(data), PIECE_BYTES):
        part = data[i : i + PIECE_BYTES]
        out = out + scale * np.sum(value[fold[part]] * up[: len(part)], dtype=np.uint64)
        scale = scale * up[PIECE_BYTES]
    return out[0]


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, first): byte places and hashes of all words, and the index of each document's first word (n + 1)."""
    out, at, stop = [], int(offsets[0]), int(offsets[-1])
    while at < stop:
        end = min(stop, at + PIECE_BYTES)
        long = False
        if end < stop and end not in offsets[np.searchsorted(offsets, end) : np.searchsorted(offsets, end) + 1]:
            gaps = np.flatnonzero(~is_word[data[at:end]])
            last = offsets[np.searchsorted(offsets, end) - 1]
            if len(gaps) or last > at:
                end = max(int(last), at + int(gaps[-1]) + 1 if len(gaps) else 0)
            else:
                long = True
        if long:
            limit = int(offsets[np.searchsorted(offsets, at, "right")])
            gap = np.flatnonzero(~is_word[data[at:limit]])
            end = at + int(gap[0]) if len(gap) else limit
            out.append((np.array([at]), np.array([end]), np.array([long_word_hash(data[at:end], fold)], np.uint64)))
        else:
            a, b = np.searchsorted(offsets, (at, end))
            s, e, h = piece_words(data[at:end], offsets[a : b + 1] - at, is_word, fold)
            out.append((s + at, e + at, h))
        at = end
    if out:
        s, e, h = (np.concatenate(x) for x in zip(*out, strict=True))
    else:
        s = e = np.zeros(0, np.int64)
        h = np.zeros(0, np.uint64)
    return s, e, mix64(h + (e - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), np.searchsorted(s, offsets)


def groups(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about GROUP_BYTES each; a longer document is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP_BYTES, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive words; windows that cross documents are for the caller to leave out."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix64(out)


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
