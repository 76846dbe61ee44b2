"""Benchmark decontamination: a broadcast table of normalised test windows, scanned against the windows of every document.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text lower-cased in A-Z. A benchmark item gives every window of
`window` consecutive words; a shorter item is one window, an item without words none. A document word inside any occurrence
of a window is hit. Hash hits are verified word by word before they count.

The table holds arrays: sorted hashes, and for each the place of its words in the items' text. A benchmark of up to BLOCK_BYTES of
text is broadcast as one table. A larger one is cut into blocks, whose tables executors write to the shared folder; a worker
holds CHUNK_BYTES of documents and one block's table at a time, whatever the benchmark's size.

Defined results: a null or empty text has no words and is clean; repeated rows are judged alike; an empty table gives an
empty result; an empty benchmark hits nothing; a null item_id is never listed, though its windows hit; further columns,
whatever their names, stay with `clean()` and are ignored by `scan()`.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch, file_system
from ._text import byte_tables, groups, text_buffer, tidied, windows, words

WINDOW = 13
#: Bytes of benchmark text whose windows make one table: all of a broadcast, or a block. A text longer than that is a block of its own.
BLOCK_BYTES = 8 << 20
#: Bytes of documents that a worker scans with one block after another.
CHUNK_BYTES = 16 << 20
SCAN = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def benchmark_windows(rows: list[tuple], window: int) -> dict:
    """{"text": all items' normalised words, a space after each; "items": their ids; "windows": {window length: (a bit for each 20-bit prefix in use, sorted hashes, begins and ends in the text, places in items)}}"""
    import pyarrow as pa

    is_word, fold = byte_tables("alnum")
    data, offsets = text_buffer(pa.array([r[1] for r in rows], pa.large_string()))
    s, e, h, first = words(data, offsets, is_word, fold)
    text = b"".join(fold[data[x:y]].tobytes() + b" " for x, y in zip(s.tolist(), e.tolist(), strict=True))
    ends = np.cumsum(e - s + 1) - 1  # of each word in that text
    begins = ends - (e - s)
    each: dict[int, list[np.ndarray]] = {}
    for i in range(len(rows)):
        a, b = int(first[i]), int(first[i + 1])
        if k := min(window, b - a):
            each.setdefault(k, []).append(np.stack([np.arange(a, b - k + 1), np.full(b - a - k + 1, i)]))
    out = {}
    for k, parts in each.items():
        at, item = np.concatenate(parts, axis=1)
        hashes = windows(h, k)[at]
        order = np.argsort(hashes, kind="stable")
        bits = np.zeros(1 << 20, bool)
        bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
        out[k] = bits, hashes[order], begins[at][order], ends[at + k - 1][order], item[order].astype(np.int32)
    return {"text": text, "items": [None if r[0] is None else str(r[0]) for r in rows], "windows": out}


def scan_texts(column, table: dict) -> Iterator[tuple[int, list[tuple[int, int]], set[str], np.ndarray, np.ndarray]]:
    """For each text of an Arrow column: words, hit ranges of words, items, and the byte places of its words."""
    is_word, fold = byte_tables("alnum")
    data, offsets = text_buffer(column)
    known_text, items = table["text"], table["items"]
    for a, b in groups(data, offsets):
        s, e, h, first = words(data, offsets[a : b + 1], is_word, fold)
        found: dict[int, list[tuple[int, int, str | None]]] = {}
        for k, (bits, hashes, begins, ends, item) in table["windows"].items():
            w = windows(h, k)
            if not len(w):
                continue
            near = np.flatnonzero(bits[(w >> np.uint64(44)).astype(np.int64)])
            low, high = np.searchsorted(hashes, w[near]), np.searchsorted(hashes, w[near], "right")
            doc = np.searchsorted(first, near, "right") - 1
            good = (low < high) & (near + k <= first[doc + 1])
            for i, d, x, y in zip(near[good].tolist(), doc[good].tolist(), low[good].tolist(), high[good].tolist(), strict=True):
                text = b" ".join(fold[data[p:q]].tobytes() for p, q in zip(s[i : i + k].tolist(), e[i : i + k].tolist(), strict=True))
                for j in range(x, y):
                    if known_text[begins[j] : ends[j]] == text:
                        found.setdefault(d, []).append((i - int(first[d]), i - int(first[d]) + k, items[item[j]]))
        for d in range(b - a):
            x, y = int(first[d]), int(first[d + 1])
            hits = sorted({(i, j) for i, j, _ in found.get(d, ())})
            yield y - x, hits, {t for _, _, t in found.get(d, ()) if t is not None}, s[x:y] - offsets[a + d], e[x:y] - offsets[a + d]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def verdict(n_words: int, n_hit: int, items) -> tuple[int, int, int, str, bool]:
    items = sorted(items)
    return n_words, n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words


class Tables:
    """The window tables of a benchmark, for workers: one that is broadcast, or blocks in the shared folder that are read one at a time."""

    def __init__(self, shared=None, path: str = "", names: tuple[str, ...] = ()):
        self.shared, self.path, self.names = shared, path, names

    def each(self) -> Iterator[dict]:
        if self.shared is not None:
            yield self.shared.value
            return
        files, folder = file_system(self.path)
        for name in self.names:
            with files.open_input_file(f"{folder}/{name}") as block:
                yield pickle.loads(block.read())

    def chunks(self, batches) -> Iterator[list]:
        """Batches that are scanned together."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if self.shared is not None or size > CHUNK_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held


def tables_of(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int) -> Tables:
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item).alias("item_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    if size <= block_bytes:
        return Tables(spark.sparkContext.broadcast(benchmark_windows([(r[0], r[1]) for r in rows.collect()], window)))
    path = Scratch(spark).path()
    files, folder = file_system(path)
    files.create_dir(folder)

    def run(batches):
        import uuid

        import pyarrow as pa

        files, folder = file_system(path)
        held, size = [], 0

        def close():
            name = f"{uuid.uuid4().hex}.windows"
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write(pickle.dumps(benchmark_windows(held, window), protocol=5))
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = len((row[1] or "").encode())
                if held and size + more > block_bytes:
                    yield close()
                    held, size = [], 0
                held.append(row)
                size += more
        if held:
            yield close()

    dealt = rows.repartition(max(1, int(size // block_bytes)), F.xxhash64("item_id", "text"))
    # only the blocks that committed tasks name count
    names = Scratch(spark).write(dealt.mapInArrow(tidied(run), "name string"))
    return Tables(path=path, names=tuple(r["name"] for r in names.orderBy("name").collect()))


def scanned(batches: list, place: int, tables: Tables, places: bool) -> list[list]:
    """For each batch and row: [words, merged hit ranges, items, byte places of the words, if asked for and hit]."""
    out = [[[0, [], set(), None] for _ in range(batch.num_rows)] for batch in batches]
    for table in tables.each():
        for rows, batch in zip(out, batches, strict=True):
            for row, (n, ranges, items, s, e) in zip(rows, scan_texts(batch.column(place), table), strict=True):
                row[0] = n
                if ranges:
                    row[1] = merged([*row[1], *ranges])
                    row[2] |= items
                    row[3] = (s, e) if places else None
    return out


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans (merged hit ranges of words), items."""
    tables = tables_of(benchmark, "item_id", "text", window, block_bytes)

    def run(batches):
        import pyarrow as pa

        for chunk in tables.chunks(batches):
            for batch, rows in zip(chunk, scanned(chunk, 1, tables, False), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([[{"a": a, "b": b} for a, b in r[1]] for r in rows], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                        pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string())),
                    ],
                    ["doc_id", "n_words", "spans", "items"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(run), f"doc_id {kind}, n_words long, spans array<struct<a: long, b: long>>, items array<string>")


def scan(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and 20 * n_hit >= n_words) per document."""
    found = hits(docs, benchmark, doc_id, text, window, block_bytes)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [verdict(n, sum(y - x for x, y in merged([(s["a"], s["b"]) for s in spans])), items) for n, spans, items in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.mapInArrow(tidied(run), f"doc_id {found.schema['doc_id'].dataType.simpleString()}, {SCAN}")


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with all their columns: without the contaminated ones (`documents`), or without the hit words (`spans`).

    No join and no shuffle: one pass over the rows, which drops or cuts as it goes by the hits of the whole benchmark.
    """
    names = docs.columns
    place = names.index(text)
    tables = tables_of(benchmark, "item_id", "text", window, block_bytes)

    def run(batches):
        import pyarrow as pa

        for chunk in tables.chunks(batches):
            for batch, rows in zip(chunk, scanned(chunk, place, tables, remove == "spans"), strict=True):
                if remove == "documents":
                    bad = np.array([bool(x) and 20 * sum(b - a for a, b in x) >= n for n, x, _, _ in rows], bool)
                    yield batch.filter(pa.array(~bad))
                    continue
                texts = batch.column(place).to_pylist()
                for i, (_, x, _, at_words) in enumerate(rows):
                    if x:
                        raw, (s, e), at, kept = texts[i].encode(), at_words, 0, []
                        for a, b in x:
                            kept.append(raw[at : s[a]])
                            at = e[b - 1]
                        texts[i] = b"".join([*kept, raw[at:]]).decode()
                yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(place).type) if c == place else batch.column(c) for c in range(len(names))], schema=batch.schema)

    return docs.mapInArrow(tidied(run), docs.schema)
