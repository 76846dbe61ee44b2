"""Token-ID store: raw id files, each with a minimal perfect hash index over its document keys.

File format: a folder of pairs of files and a Parquet dataset `manifest` with one row per pair. In the order of (shard, part)
the files hold the documents in ascending doc_id order.
  <name>.bin   the ids of all documents, little-endian, `width` bytes each (2 where every id of the vocabulary fits, else 4),
               one document after another, each closed by the end id; nothing else
  <name>.idx   int64 x n_buckets   seeds: displacement of each bucket of the hash; -1 - slot places a lone key directly
               uint64 x n_docs     ends: where each document ends, in ids from the file's start
               int64 x n_docs      keys: the documents' keys (0 for a null doc_id, which come first and have none)
               uint32 x n_keys     slots: the first document of the key in each slot
               uint16 x n_keys     prints: the fingerprint of the key in each slot
  manifest     shard, part int; name; low, high long: least and greatest key; n_docs, n_null, n_keys, n_buckets, n_ids long; width int
A lookup hashes the key to a bucket, reads one seed, one fingerprint, one slot, the key and two ends, and then the document's
range of ids: a fixed number of bytes beside the ids, whatever the size of file and store. A file ends at FILE_DOCS documents or
FILE_IDS ids, whatever the ids of its documents; a key whose documents run on into the next file is in the index of both.

Each attempt of a task writes files of its own names; only those that the manifest lists, which Spark commits, count, so a lost
executor leaves no half file behind that anything reads. The files are written and read with pyarrow's file systems.

Defined results: a null or empty text has only the end id; a null doc_id is stored first and has no key; repeated doc_ids are
stored one after another under one key; ids that are no whole numbers stand in their order under the xxhash64 of their text,
which `digest` and `lookup` return; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import Scratch, file_system
from ._text import long_word_hash, mix64, PIECE_BYTES, powers, text_buffer, tidied, worker_cache

END_ID = 2
FILE_DOCS, FILE_IDS = 1 << 18, 1 << 27
#: Ids read at once.
READ_IDS = 1 << 21
#: Distinct pre-tokens whose ids a worker keeps before it starts its table anew; not a cap on results.
KEPT = 1_000_000
#: Texts with other characters than these, with a special token's opener or with a contraction are encoded whole by the library; the others split by the classes below.
OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
CONTRACTION = re.compile(r"(?:(?<![^\w\s])(?<! )|^)'(?:[stmd]|re|ve|ll)")
LETTER, DIGIT, SPACE, SIGN = 0, 1, 2, 3
MANIFEST = "shard int, part int, name string, low long, high long, n_docs long, n_null long, n_keys long, n_buckets long, n_ids long, width int"


def is_plain(text: str) -> bool:
    return "<|" not in text and not OTHER.search(text) and not ("'" in text and CONTRACTION.search(text))


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte of plain UTF-8 text; both bytes of a character have its class."""
    cache = worker_cache()
    if "classes" not in cache:
        table = np.full(256, SIGN, np.uint8)
        table[[9, 10, 13, 32]] = SPACE
        table[48:58] = DIGIT
        table[65:91] = table[97:123] = table[0xC3:0xCA] = LETTER
        cache["classes"] = table
    out = cache["classes"][data]
    two = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
    lead, after = data[two], data[two + 1]
    signs = (lead == 0xC3) & ((after == 0x97) | (after == 0xB7))  # the multiplication and division signs
    letters = (lead == 0xC2) & ((after == 0xAA) | (after == 0xB5) | (after == 0xBA))
    out[two] = np.where(letters, LETTER, np.where(signs, SIGN, out[two]))
    out[two + 1] = out[two]
    return out


def pre_token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in plain texts that stand one after another: runs of one class, each with a space before it, if any; of the other white space, what stands before the last of a run, and that last."""
    kinds = byte_classes(data)
    start = np.empty(len(data), bool)
    start[0], start[1:] = True, kinds[1:] != kinds[:-1]
    edges = offsets[offsets < len(data)]
    start[edges] = True
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], len(data))
    white = kinds[runs] == SPACE
    # a run of white space that something follows within the text gives up its last character
    last = ends[white] - 1
    closing = np.zeros(len(data) + 1, bool)
    closing[edges] = closing[len(data)] = True
    followed = ~closing[ends[white]]
    start[last[followed]] = True
    spaces = followed & (data[last] == 32)
    start[ends[white][spaces]] = False  # a space goes with what follows
    return np.flatnonzero(start)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    value, up, down = powers()
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE_BYTES, "right")))
        low, high = int(starts[a]), int(ends[b - 1])
        if high - low > PIECE_BYTES:
            out[a] = long_word_hash(data[low:high], np.arange(256, dtype=np.uint8))
            a = b
            continue
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(value[data[low:high]] * up[: high - low], out=total[1:])
        out[a:b] = (total[ends[a:b] - low] - total[starts[a:b] - low]) * down[starts[a:b] - low]
        a = b
    return mix64(out + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


class Known:
    """Ids of pre-tokens by the hash of their bytes: open addressing in arrays, so that many are looked up at once."""

    def __init__(self, code: str):
        self.code = code
        self.clear()

    def clear(self) -> None:
        self.bits = 22
        self.keys, self.place = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.n, self.ids, self.used = 0, np.zeros(1 << 20, self.code), 0
        self.first, self.size = np.zeros(KEPT + (1 << 20), np.int32), np.zeros(KEPT + (1 << 20), np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        left, mask = np.arange(len(keys)), np.uint64((1 << self.bits) - 1)
        at = (keys & mask).astype(np.int64)
        while len(left):
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.place[at[hit]]
            on = ~hit & (held != 0)
            left, at = left[on], (at[on] + 1) & int(mask)
        return out

    def add(self, keys: np.ndarray, encoded: list) -> None:
        """New, distinct keys and their ids."""
        sizes = np.fromiter(map(len, encoded), np.int32, len(encoded))
        flat = np.fromiter((i for e in encoded for i in e), self.code, int(sizes.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        where = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.first[where], self.size[where] = self.used + np.cumsum(sizes) - sizes, sizes
        self.n, self.used = self.n + len(keys), self.used + len(flat)
        left, mask = np.arange(len(keys)), (1 << self.bits) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]  # of several that want a place the last written has it
            self.place[at[free]] = where[left[free]]
            lost = self.keys[at] != keys[left]
            left, at = left[lost], (at[lost] + 1) & mask


def encoder(path: str):
    """(bytes per id, a function from an Arrow column of texts to each one's ids as bytes).

    Each distinct pre-token is encoded once by the library and then found by the hash of its bytes.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    cache = worker_cache()
    if ("ids", path) not in cache:
        tokenizer = Tokenizer.from_file(path)
        cache["ids", path] = tokenizer, Known("uint16" if tokenizer.get_vocab_size() <= 1 << 16 else "uint32")
    tokenizer, known = cache["ids", path]
    width = known.ids.itemsize

    def raw(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(column) -> list[bytes]:
        import pyarrow as pa

        texts = [t or "" for t in column.to_pylist()]
        odd = [i for i, t in enumerate(texts) if not is_plain(t)]
        out = [b""] * len(texts)
        for i, ids in zip(odd, raw([texts[i] for i in odd]), strict=True):
            out[i] = np.array(ids, known.ids.dtype).tobytes()
        strange = set(odd)
        plain = [i for i, t in enumerate(texts) if t and i not in strange]
        if not plain:
            return out
        data, offsets = text_buffer(pa.array([texts[i] for i in plain], pa.large_string()))
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        starts = pre_token_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys = span_hashes(data, starts, ends) | np.uint64(1 << 63)  # never 0, which marks a free place
        entry = known.find(keys)
        if (entry < 0).any():
            new, first = np.unique(keys[entry < 0], return_index=True)
            at = np.flatnonzero(entry < 0)[first]
            if known.n + len(new) > KEPT:
                known.clear()
                new, at = np.unique(keys, return_index=True)
            for i in range(0, len(new), 20_000):
                pieces = [data[a:b].tobytes().decode() for a, b in zip(starts[at[i : i + 20_000]].tolist(), ends[at[i : i + 20_000]].tolist(), strict=True)]
                known.add(new[i : i + 20_000], raw(pieces))
            entry = known.find(keys)
        sizes = known.size[entry]
        upto = np.cumsum(sizes)
        ids = known.ids[np.repeat(known.first[entry] - (upto - sizes), sizes) + np.arange(int(upto[-1]))].tobytes()
        bounds = np.append(0, upto)[np.searchsorted(starts, offsets)] * width
        for k, i in enumerate(plain):
            out[i] = ids[bounds[k] : bounds[k + 1]]
        return out

    return width, encode


def slot_of(keys: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return (mix64(keys + (seed.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)).astype(np.uint16)


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(keys) % np.uint64(buckets)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed of each bucket, slot of each key) of a minimal perfect hash over distinct 64-bit keys: hash and displace."""
    n = len(keys)
    keys = keys.astype(np.int64).view(np.uint64)
    buckets = max(1, -(-n // 4))
    at = buckets_of(keys, buckets) if n else np.zeros(0, np.int64)
    order = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[order], np.arange(buckets + 1))
    free, seeds, slots = np.ones(n, bool), np.zeros(buckets, np.int64), np.zeros(n, np.int64)
    sizes = np.diff(bounds)
    for b in np.argsort(-sizes, kind="stable"):
        size = int(sizes[b])
        if size < 2:
            break
        own, seed = order[bounds[b] : bounds[b + 1]], 0
        while True:
            trial = slot_of(keys[own][None, :], np.arange(seed, seed + 16)[:, None], n)
            ordered = np.sort(trial, axis=1)
            good = np.flatnonzero(free[trial].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
            if len(good):
                seeds[b], slots[own] = seed + good[0], trial[good[0]]
                free[slots[own]] = False
                break
            seed += 16
    left = np.flatnonzero(free)
    for slot, b in zip(left.tolist(), np.flatnonzero(sizes == 1).tolist(), strict=True):
        seeds[b], slots[order[bounds[b]]] = -1 - slot, slot
    return seeds, slots


def find_all(keys: np.ndarray, seeds: np.ndarray, prints: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The first document of each key in its file, or -1 if its fingerprint is not the stored one."""
    if not len(keys) or not len(slots):
        return np.full(len(keys), -1, np.int64)
    own = keys.astype(np.int64).view(np.uint64)
    seed = seeds[buckets_of(own, len(seeds))]
    slot = np.where(seed < 0, -1 - seed, slot_of(own, np.maximum(seed, 0), len(slots)))
    return np.where(prints[slot] == fingerprints(own), slots[slot].astype(np.int64), -1)


def layout(row: dict) -> dict[str, tuple[int, str, int]]:
    """{array: (byte at which it begins in the index file, type, length)}"""
    out, at = {}, 0
    for name, kind, n in (("seeds", "<i8", row["n_buckets"]), ("ends", "<u8", row["n_docs"]), ("keys", "<i8", row["n_docs"]), ("slots", "<u4", row["n_keys"]), ("prints", "<u2", row["n_keys"])):
        out[name] = at, kind, n
        at += n * np.dtype(kind).itemsize
    return out


def index_arrays(keys: np.ndarray, n_null: int) -> dict[str, np.ndarray]:
    """The index of a file whose documents have these keys, the first n_null none."""
    own, first = np.unique(keys[n_null:], return_index=True)
    seeds, place = build_index(own)
    prints, slots = np.zeros(len(own), "<u2"), np.zeros(len(own), "<u4")
    prints[place], slots[place] = fingerprints(own.view(np.uint64)), first + n_null
    return {"seeds": seeds.astype("<i8"), "keys": keys.astype("<i8"), "slots": slots, "prints": prints}


def write_store(docs: DataFrame, path: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, file_docs: int = FILE_DOCS, file_ids: int = FILE_IDS) -> None:
    """Encode every text and write the store to `path`, documents ascending over shards (ranges of doc_id) and their files."""

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        width, encode = encoder(tokenizer_path)
        end = int(end_id).to_bytes(width, "little")
        files, folder = file_system(path)
        shard, part, out, held = TaskContext.get().partitionId(), 0, None, 0
        keys: list[int | None] = []
        sizes: list[int] = []

        def close():
            nonlocal out, part, held, keys, sizes
            out.close()
            n_null = sum(k is None for k in keys)
            arrays = index_arrays(np.array([0 if k is None else k for k in keys], np.int64), n_null) | {"ends": np.cumsum(sizes, dtype="<u8")}
            known = arrays["keys"][n_null:]
            row = {"shard": shard, "part": part, "name": name, "low": int(known.min()) if len(known) else None, "high": int(known.max()) if len(known) else None, "n_docs": len(keys), "n_null": n_null, "n_keys": len(arrays["slots"]), "n_buckets": len(arrays["seeds"]), "n_ids": held, "width": width}
            with files.open_output_stream(f"{folder}/{name}.idx") as index:
                for array in layout(row):
                    index.write(arrays[array].tobytes())
            out, part, held, keys, sizes = None, part + 1, 0, [], []
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in MANIFEST.split(", ")]))

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                for key, ids in zip(rows.column(0).to_pylist(), encode(rows.column(1)), strict=True):
                    if out is None:
                        name = f"{shard:06d}-{part:06d}-{uuid.uuid4().hex}"
                        out = files.open_output_stream(f"{folder}/{name}.bin", buffer_size=1 << 20)
                    out.write(ids)
                    out.write(end)
                    keys.append(key)
                    sizes.append(len(ids) // width + 1)
                    held += sizes[-1]
                    if len(keys) >= file_docs or held >= file_ids:
                        yield close()
        if out is not None:
            yield close()

    key = F.col(doc_id).cast("long") if docs.schema[doc_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else F.when(F.col(doc_id).isNotNull(), F.xxhash64(F.col(doc_id).cast("string")))
    # a hash and a number of the row split even a range of one doc_id
    rows = docs.select(F.col(doc_id).alias("id"), key.alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("th"), F.monotonically_increasing_id().alias("row"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), "th", "row"]
    files, folder = file_system(path)
    files.create_dir(folder)
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "text").mapInArrow(tidied(run), MANIFEST).write.parquet(f"{path}/manifest")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, which names the files."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def find(index, row: dict, key: int) -> int:
    """The first document of the key in a file, or -1; `index` is the open index file, of which single entries are read."""
    at = layout(row)

    def entry(array: str, i: int) -> int:
        begin, kind, _ = at[array]
        size = np.dtype(kind).itemsize
        index.seek(begin + i * size)
        return int(np.frombuffer(index.read(size), kind)[0])

    if not row["n_keys"]:
        return -1
    own = np.array([key], np.int64).view(np.uint64)
    seed = entry("seeds", int(buckets_of(own, row["n_buckets"])[0]))
    slot = -1 - seed if seed < 0 else int(slot_of(own, np.array([seed]), row["n_keys"])[0])
    if entry("prints", slot) != int(fingerprints(own)[0]):
        return -1
    d = entry("slots", slot)
    return d if entry("keys", d) == key else -1


def documents(files, folder: str, row: dict, key: int):
    """The ids of each document of the key in a file, one after another."""
    (ends, _, _), (keys, _, _) = (layout(row)[c] for c in ("ends", "keys"))
    with files.open_input_file(f"{folder}/{row['name']}.idx") as index, files.open_input_file(f"{folder}/{row['name']}.bin") as payload:
        d = find(index, row, key)
        while 0 <= d < row["n_docs"]:
            index.seek(keys + 8 * d)
            if int(np.frombuffer(index.read(8), "<i8")[0]) != key:
                break
            index.seek(ends + 8 * max(0, d - 1))
            bounds = np.frombuffer(index.read(16 if d else 8), "<u8").astype(np.int64)
            begin, end = (int(bounds[0]), int(bounds[1])) if d else (0, int(bounds[0]))
            payload.seek(begin * row["width"])
            yield np.frombuffer(payload.read((end - begin) * row["width"]), f"<u{row['width']}")
            d += 1


def lookup(store: DataFrame, path: str, keys: list[int]) -> DataFrame:
    """doc_id and its ids (array) for each stored document of the given keys; files are pruned by their key range, and of a file only the entries and ranges of its keys are read."""
    wanted = sorted(set(keys))

    def run(batches):
        import pyarrow as pa

        files, folder = file_system(path)
        for batch in batches:
            for row in batch.to_pylist():
                for key in wanted:
                    if row["low"] <= key <= row["high"]:
                        for ids in documents(files, folder, row, key):
                            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], ["doc_id", "ids"])

    if not wanted:
        return store.sparkSession.createDataFrame([], "doc_id long, ids array<long>")
    return store.where((F.col("high") >= wanted[0]) & (F.col("low") <= wanted[-1])).mapInArrow(run, "doc_id long, ids array<long>")


def digest(store: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back through the index of its file."""
    from pyspark.sql import Window

    # as many rows as files
    starts = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = store.withColumn("at", F.coalesce(F.sum("n_ids").over(starts), F.lit(0)))

    def crcs(payload, width: int, ends: np.ndarray):
        """The crc32 of each document's ids in four bytes each, read READ_IDS at a time."""
        out, begin = [], 0
        while begin < len(ends):
            first = int(ends[begin - 1]) if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, first + READ_IDS, "right")))
            payload.seek(first * width)
            if stop == begin + 1:
                crc = 0
                for at in range(first, int(ends[begin]), READ_IDS):
                    crc = zlib.crc32(np.frombuffer(payload.read((min(int(ends[begin]), at + READ_IDS) - at) * width), f"<u{width}").astype("<u4"), crc)
                out.append(crc)
            else:
                wide = memoryview(np.frombuffer(payload.read((int(ends[stop - 1]) - first) * width), f"<u{width}").astype("<u4").tobytes())
                edges = [0, *(4 * (ends[begin:stop] - first)).tolist()]
                out += [zlib.crc32(wide[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)]
            begin = stop
        return np.array(out, np.int64)

    def run(batches):
        import pyarrow as pa

        files, folder = file_system(path)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(f"{folder}/{row['name']}.idx") as index:
                    raw = index.read()
                part = {c: np.frombuffer(raw, kind, n, at) for c, (at, kind, n) in layout(row).items()}
                n, own, ends = row["n_null"], part["keys"], part["ends"].astype(np.int64)
                each = np.arange(len(own))
                # the documents of a key follow its first
                begins = np.append(True, own[1:] != own[:-1]) | (each <= n)
                first = np.maximum.accumulate(np.where(begins, each, 0))
                if (find_all(own[n:], part["seeds"], part["prints"], part["slots"]) != first[n:]).any():
                    raise ValueError("the index leads a key to another document")
                with files.open_input_file(f"{folder}/{row['name']}.bin") as payload:
                    crc = crcs(payload, row["width"], ends)
                sizes = np.diff(ends, prepend=0)
                columns = [pa.array(own, pa.int64(), mask=each < n), pa.array(row["at"] + ends - sizes), pa.array(sizes), pa.array(crc)]
                for i in range(0, len(own), 10_000):
                    yield pa.RecordBatch.from_arrays([c.slice(i, 10_000) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a file to a task
    tasks = max(1, store.count())
    return placed.repartitionByRange(tasks, "shard", "part").mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the store to the shared folder and digest what its files hold."""
    path = Scratch(docs.sparkSession).path()
    write_store(docs, path, tokenizer_path)
    return digest(read_store(docs.sparkSession, path), path)
