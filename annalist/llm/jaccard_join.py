"""Exact n-gram Jaccard join by vertical partitioning, up to the components of its links.

A document's set holds its distinct `k`-word shingles. All shingles stand in one global order: first by a class of how
often their hash bucket occurs in the whole corpus, then by hash. The order is cut into contiguous fragments of equal mass;
a pair's overlap is counted within each fragment by itself, and the partial counts are summed per pair. So no task ever
needs a whole set, however long the document.

Which pairs are counted:
1. Documents with equal sets form a class; only classes are joined.
2. Stars: classes that agree in half of their min-hashes with one of a few hubs of those buckets. The links found give
   provisional components, so a large group of near copies costs a few pairs a member and not all pairs.
3. Completion, which makes the result exact: two sets that reach the threshold share a shingle within their prefixes (the
   rarest n - ceil(t n) + 1 shingles), and such a pair of *different* provisional components that passes the length, the
   position and the sketch filters is a candidate. In the first rounds a class offers only its nearest candidate, and what is
   linked merges, at least by a step; a class without a candidate then takes no further part. When a round links nothing, or
   after NEAREST_ROUNDS, every candidate that is left is counted. Pairs within a component can't change the components and are
   left out. So candidates that are not links remain only between components that are truly apart.

Defined results: a null or empty text, or one without words, has no shingles and is its own component; fewer than `k` words
make one shingle; a class or component of null ids only has a null id; repeated rows get equal rows; an empty table gives an
empty result; other columns are ignored. Shingles are 64-bit hashes and classes are 64-bit hashes of sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import BROADCAST_IDS, Scratch
from ._tables import summed_slices
from ._text import as_signed, byte_tables, groups, mix64, text_buffer, tidied, windows, words

K, NUM, DEN = 5, 80, 100
#: Buckets of the frequency table, the bits of a shingle's id that hold its hash, fragments, min-hashes, how many must agree, and hubs of a bucket.
BUCKET_BITS, HASH_BITS, FRAGMENTS, MINHASHES, AGREE, HUBS = 19, 58, 8, 8, 4, 4
SLICES = 512
SKETCH_BITS = 512
#: Pairs whose sketches are compared at once.
BLOCK = 1 << 16
#: Prefix shingles that a task of the completion takes, about.
PART_IDS = 400_000
#: Rounds in which a class offers its nearest candidate only.
NEAREST_ROUNDS = 2
#: Documents of one shingle up to which all pairs of them are walked at once; in a longer run those outside its largest component are.
LONG_RUN = 64
#: Tasks that share the rows of a min-hash bucket.
SALTS = 8
#: Rows that a task of the completion deals at once.
DEAL_ROWS = 2000


def shingle_sets(column, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    is_word, fold = byte_tables("space")
    data, offsets = text_buffer(column)
    for a, b in groups(data, offsets):
        _, _, h, first = words(data, offsets[a : b + 1], is_word, fold)
        all_windows = windows(h, k)
        for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(all_windows[x : y - k + 1]) if y - x >= k else windows(h[x:y], y - x)[: y > x]


def frequencies(texts: DataFrame, k: int) -> np.ndarray:
    """How many (document, shingle) rows fall into each of 2**BUCKET_BITS hash buckets: one fixed-size table for any corpus."""

    def count(batches):
        import pyarrow as pa

        total, held, size = np.zeros(1 << BUCKET_BITS, np.int64), [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                held.append((s >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
                size += len(s)
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=1 << BUCKET_BITS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << BUCKET_BITS)
        if total.any():
            narrow = np.uint32 if total.max() < 1 << 32 else np.int64
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.astype(narrow).tobytes() for x in np.split(total, SLICES)], pa.binary())], ["slice", "counts"])

    return summed_slices(texts.mapInArrow(tidied(count), "slice int, counts binary"), SLICES, (1 << BUCKET_BITS) // SLICES)


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """0 for buckets that are as full as chance explains, then rising with the excess, 63 at most."""
    mean = counts.mean()
    excess = np.maximum(0, counts - mean) / (4 * np.sqrt(mean + 1))
    return np.minimum(63, np.where(excess < 1, 0, 1 + np.floor(4 * np.log2(1 + excess)))).astype(np.uint8)


def pivots(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The ids at which the global order is cut into FRAGMENTS parts of equal mass."""
    mass = np.cumsum(np.bincount(classes, counts, minlength=64))
    out = []
    for j in range(1, FRAGMENTS):
        want = mass[-1] * j / FRAGMENTS
        c = min(63, int(np.searchsorted(mass, want, "right")))
        before = mass[c - 1] if c else 0
        share = min(1.0, (want - before) / max(mass[c] - before, 1))
        out.append((c << HASH_BITS) + min((1 << HASH_BITS) - 1, int(share * (1 << HASH_BITS))))
    return np.array(out, np.uint64)


def ordered(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The set's ids in the global order."""
    return np.sort((classes[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(HASH_BITS)) | (s >> np.uint64(64 - HASH_BITS)))


def at_least(n, num: int, den: int):
    """ceil(n * num / den)"""
    return (n * num + den - 1) // den


def set_key(s: np.ndarray) -> int:
    """A hash of the whole set, without regard to order."""
    return int(as_signed(mix64(np.array([np.sum(mix64(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) + np.uint64(len(s))], np.uint64)))[0])


def sketch(s: np.ndarray) -> np.ndarray:
    """For each of four or more hash buckets a shingle (a power of two, SKETCH_BITS at least), whether it holds an odd number of the set: where two sketches differ, so do the sets, at least once a bit."""
    bits = max(SKETCH_BITS, 1 << (4 * len(s) - 1).bit_length()) if len(s) else SKETCH_BITS
    return (np.bincount((s >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1).astype(np.uint8)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The sketch with fewer buckets."""
    return np.bitwise_xor.reduce(bits.reshape(size, -1), axis=1)


def sketches_apart(x: bytes, y: bytes) -> int:
    """A lower bound of the size of the sets' symmetric difference."""
    a, b = np.unpackbits(np.frombuffer(x, np.uint8)), np.unpackbits(np.frombuffer(y, np.uint8))
    size = min(len(a), len(b))
    return int(np.count_nonzero(folded(a, size) != folded(b, size)))


def profiles(docs: DataFrame, classes, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n, cls, min-hashes m0..., the sketch, folded and whole, and the prefix (ids, 8 bytes each) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        seeds = mix64(np.arange(1, MINHASHES + 1, dtype=np.uint64))
        for batch in batches:
            sizes, keys, mins, narrow, wide, prefixes = [], [], [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n = len(s)
                sizes.append(n)
                keys.append(set_key(s))
                mins.append([((s ^ seed) * np.uint64(0x9FB21C651E98DF25)).min() if n else 0 for seed in seeds])
                bits = sketch(s)
                narrow.append(np.packbits(folded(bits, SKETCH_BITS)).tobytes())
                wide.append(np.packbits(bits).tobytes())
                prefixes.append(ordered(s, classes.value)[: n - at_least(n, num, den) + 1].tobytes() if n else b"")
            table = np.array(mins, np.uint64).reshape(-1, MINHASHES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), *(pa.array(as_signed(np.ascontiguousarray(table[:, j]))) for j in range(MINHASHES)), pa.array(narrow, pa.binary()), pa.array(wide, pa.binary()), pa.array(prefixes, pa.binary())],
                ["doc_id", "n", "cls", *(f"m{j}" for j in range(MINHASHES)), "sketch", "wide", "prefix"],
            )

    return docs.mapInArrow(tidied(run), f"doc_id {kind}, n long, cls long, {', '.join(f'm{j} long' for j in range(MINHASHES))}, sketch binary, wide binary, prefix binary")


def stars(kinds: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of a class and the hubs of its min-hash buckets, if they meet in AGREE buckets.

    A bucket's hubs are, for each of HUBS residues, the class that shares its min-hashes with the most others: in a group of
    near copies those nearest to what was copied, to which a copy is linked if it is linked to any.
    """
    salt = F.pmod("cls", F.lit(SALTS)).alias("s")
    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("s")
    rows = kinds.select("cls", salt, F.posexplode(F.array(*(f"m{j}" for j in range(MINHASHES)))).alias("j", "m"))
    full = rows.groupBy("j", "m").agg(F.count("*").alias("c")).where("c > 1").select("j", "m", "c", salts)
    shared = scratch.write(rows.join(full, ["j", "m", "s"]))
    score = shared.groupBy("cls").agg(F.sum("c").alias("score"))
    best = shared.join(score, "cls").groupBy("j", "m", F.pmod("cls", F.lit(HUBS)).alias("r")).agg(F.max(F.struct("score", "cls")).alias("best"))
    hubs = best.groupBy("j", "m").agg(F.collect_list("best.cls").alias("hubs")).select("j", "m", "hubs", salts)
    met = shared.join(hubs, ["j", "m", "s"]).select("j", "cls", F.explode("hubs").alias("hub")).where("hub <> cls")
    met = met.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b"), "j")
    return met.groupBy("a", "b").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("j"))).alias("met")).where(F.bit_count("met") >= AGREE).select("a", "b")


def across(ids: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: np.ndarray, comp: np.ndarray, sketches: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(d, e, differing sketch bits) of documents of different components that share an id and pass the filters.

    ids, doc, pos: each prefix shingle, the document it is of and its place there; n, comp, sketches: of each document.
    """
    order = np.lexsort((n[doc], ids))
    ids, doc, pos = ids[order], doc[order], pos[order]
    heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    tails = np.append(heads[1:], len(ids))
    own = comp[doc]
    mixed = np.maximum.reduceat(own, heads) != np.minimum.reduceat(own, heads)

    def passing(x, y):
        d, e = doc[x], doc[y]
        both, needed = np.minimum(n[d] - pos[x], n[e] - pos[y]), at_least(n[d] + n[e], num, num + den)
        good = (comp[d] != comp[e]) & (both >= needed)
        d, e, apart = d[good], e[good], (n[d] + n[e] - 2 * needed)[good]
        for i in range(0, len(d), BLOCK):
            bits = np.bitwise_count(sketches[d[i : i + BLOCK]] ^ sketches[e[i : i + BLOCK]]).sum(axis=1)
            near = bits <= apart[i : i + BLOCK]
            if near.any():
                yield d[i : i + BLOCK][near], e[i : i + BLOCK][near], bits[near].astype(np.int64)

    short = mixed & (tails - heads <= LONG_RUN)
    left = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in zip(heads[short].tolist(), tails[short].tolist(), strict=True))])
    stop, step = np.repeat(tails[short], (tails - heads)[short]), 1
    while len(left):
        # the run is sorted by size: once one is too long for this one, so are all after it
        fits = left + step < stop
        left, stop = left[fits], stop[fits]
        fits = n[doc[left]] * den >= n[doc[left + step]] * num
        left, stop = left[fits], stop[fits]
        yield from passing(left, left + step)
        step += 1

    long = mixed & ~short
    for a, b in zip(heads[long].tolist(), tails[long].tolist(), strict=True):
        size, (kinds, kind, counts) = n[doc[a:b]], np.unique(own[a:b], return_inverse=True, return_counts=True)
        outside = kind != counts.argmax()
        low, high = np.searchsorted(size, at_least(size, num, den)), np.searchsorted(size, size * den // num, "right")
        for i in np.flatnonzero(outside).tolist():
            other = np.arange(low[i], high[i])
            # of two outsiders the first meets the second
            other = other[~outside[other] | (other > i)]
            yield from passing(np.full(len(other), a + i), a + other)


def completion(prefixes: DataFrame, parts: int, num: int, den: int, nearest: bool) -> DataFrame:
    """Pairs (a, b; ca, cb) of classes of different provisional components, and these, that share a prefix shingle and pass the filters.

    prefixes: cls, comp, n, sketch, prefix. The shingles are dealt by ranges of their hash; each task pairs those of its range. A
    pair is tested wherever it shares a shingle, and a pair that reaches the threshold passes at its first common shingle.
    `nearest`: for every class a that has candidates only the one whose sketch differs least, for the sets' sizes.
    """

    def deal(batches):
        import pyarrow as pa

        width = np.uint64(HASH_BITS - 32)
        for batch in (b.slice(i, DEAL_ROWS) for b in batches for i in range(0, b.num_rows, DEAL_ROWS)):
            blobs = batch.column(4).to_pylist()
            ids = np.frombuffer(b"".join(blobs), np.uint64)
            lengths = np.array([len(x) // 8 for x in blobs], np.int64)
            if not len(ids):
                continue
            row = np.repeat(np.arange(len(lengths)), lengths)
            pos = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            place = (((ids >> width) & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            cls, comp, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            sketches = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            there, begins = np.unique(place[order], return_index=True)
            out = []
            for p, take in zip(there.tolist(), np.split(order, begins[1:]), strict=True):
                used, local = np.unique(row[take], return_inverse=True)
                apart = np.flatnonzero(cls[used] != comp[used])
                local = local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
                out.append((p, ids[take].tobytes(), local.tobytes(), np.minimum(pos[take], 65535).astype(np.uint16).tobytes(), cls[used].tobytes(), n[used].tobytes() if n[used].max() >= 1 << 32 else n[used].astype(np.uint32).tobytes(), apart.astype(np.uint32).tobytes(), comp[used][apart].tobytes(), sketches[used].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*out, strict=True))], ["p", "ids", "local", "pos", "cls", "n", "apart", "comp", "sketch"])

    def gathered(batches):
        ids, doc, pos, cls, n, comp, sketches, seen = [], [], [], [], [], [], [], 0
        for batch in batches:
            for _, i, lo, po, c, size, apart, other, bits in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                t, k = np.frombuffer(i, np.uint64), np.frombuffer(c, np.int64)
                ids.append(t)
                doc.append(np.frombuffer(lo, np.uint16 if len(lo) == 2 * len(t) else np.uint32).astype(np.int32) + np.int32(seen))
                pos.append(np.frombuffer(po, np.uint16))
                cls.append(k)
                n.append(np.frombuffer(size, np.uint32 if len(size) == 4 * len(k) else np.int64).astype(np.int64))
                own = k.copy()
                own[np.frombuffer(apart, np.uint32)] = np.frombuffer(other, np.int64)
                comp.append(own)
                sketches.append(np.frombuffer(bits, np.uint64).reshape(len(k), -1))
                seen += len(k)
        return [np.concatenate(x) for x in (ids, doc, pos, cls, n, comp, sketches)] if ids else None

    def every(batches):
        import pyarrow as pa

        def flush():
            pairs = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in range(4)], ["a", "b", "ca", "cb"])

        if (all_of := gathered(batches)) is None:
            return
        ids, doc, pos, cls, n, comp, sketches = all_of
        found, held = [], 0
        for d, e, _ in across(ids, doc, pos, n, comp, sketches, num, den):
            swap = cls[d] > cls[e]
            d, e = np.where(swap, e, d), np.where(swap, d, e)
            found.append(np.stack([cls[d], cls[e], comp[d], comp[e]], axis=1))
            held += len(d)
            if held > 1 << 20:
                yield flush()
                found, held = [], 0
        if found:
            yield flush()

    def best(batches):
        import pyarrow as pa

        if (all_of := gathered(batches)) is None:
            return
        ids, doc, pos, cls, n, comp, sketches = all_of
        least, with_, at_comp = np.full(len(cls), np.inf), np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
        for d, e, bits in across(ids, doc, pos, n, comp, sketches, num, den):
            share = bits / (n[d] + n[e])
            for x, y in ((d, e), (e, d)):
                order = np.lexsort((cls[y], share, x))
                order = order[np.append(True, x[order][1:] != x[order][:-1])]
                at, score, other, home = x[order], share[order], cls[y[order]], comp[y[order]]
                better = (score < least[at]) | ((score == least[at]) & (other < with_[at]))
                least[at[better]], with_[at[better]], at_comp[at[better]] = score[better], other[better], home[better]
        has = np.isfinite(least)
        yield pa.RecordBatch.from_arrays([pa.array(x[has]) for x in (cls, with_, comp, at_comp, least)], ["a", "b", "ca", "cb", "score"])

    blobs = prefixes.select("cls", "comp", "n", "sketch", "prefix").mapInArrow(tidied(deal), "p int, ids binary, local binary, pos binary, cls binary, n binary, apart binary, comp binary, sketch binary")
    dealt = blobs.repartitionById(parts, F.col("p"))
    if nearest:
        rows = dealt.mapInArrow(tidied(best), "a long, b long, ca long, cb long, score double")
        return rows.groupBy("a").agg(F.min(F.struct("score", "b", "ca", "cb")).alias("x")).select("a", "x.b", "x.ca", "x.cb")
    return dealt.mapInArrow(tidied(every), "a long, b long, ca long, cb long").distinct()


def promising(pairs: DataFrame, leads: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, and further columns) whose sizes and whole sketches let them reach the threshold; leads: cls, n, wide of their classes."""
    more = [c for c in pairs.columns if c not in ("a", "b")]

    def test(batches):
        import pyarrow as pa

        for batch in batches:
            m, n, x, y = (batch.column(i).to_pylist() for i in range(4))
            good = [den * min(m[i], n[i]) >= num * max(m[i], n[i]) and sketches_apart(x[i], y[i]) <= m[i] + n[i] - 2 * at_least(m[i] + n[i], num, num + den) for i in range(batch.num_rows)]
            yield batch.select(list(range(4, batch.num_columns))).filter(pa.array(good, pa.bool_()))

    wide = leads.select("cls", "n", "wide")
    both = pairs.join(wide.toDF("a", "m", "x").hint("merge"), "a").join(wide.toDF("b", "n", "y").hint("merge"), "b")
    return both.select("m", "n", "x", "y", "a", "b", *more).mapInArrow(tidied(test), ", ".join(f"{c} long" for c in ("a", "b", *more))).distinct()


def leads_of(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """cls, n, sketch, wide, prefix and lo of the classes in heads (cls, lo), each from the document of least id."""
    heads = heads.select(F.col("cls").alias("c"), "lo")
    return rows.join(heads, (F.col("cls") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("lo"))).select("cls", "n", "sketch", "wide", "prefix", "lo")


def fragments(docs: DataFrame, leads: DataFrame, classes, cuts: np.ndarray, k: int) -> DataFrame:
    """cls, f and the ids of each fragment of the classes' sets, made again from the texts of the documents named by `lo`."""
    heads = leads.select(F.col("lo").alias("lo_id")).distinct()
    if heads.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        heads = F.broadcast(heads)
    texts = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("lo_id")), "left_semi")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for s in shingle_sets(batch.column(0), k):
                key, ids = set_key(s), ordered(s, classes.value)
                rows += [(key, f, part.tobytes()) for f, part in enumerate(np.split(ids, np.searchsorted(ids, cuts))) if len(part)]
            keys, places, parts = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(parts, pa.binary())], ["cls", "f", "ids"])

    return texts.select("text").mapInArrow(tidied(cut), "cls long, f int, ids binary")


def links(pairs: DataFrame, cut: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, and further columns) that reach the threshold: partial overlaps by fragment, summed per pair."""
    more = [c for c in pairs.columns if c not in ("a", "b")]

    def overlap(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (0, 1))
            both = [len(np.intersect1d(np.frombuffer(p or b"", np.uint64), np.frombuffer(q or b"", np.uint64), assume_unique=True)) for p, q in zip(x, y, strict=True)]
            counts = [pa.array([len(z or b"") // 8 for z in c], pa.int64()) for c in (x, y)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2, batch.num_columns)), pa.array(both, pa.int64()), *counts], [*batch.schema.names[2:], "both", "na", "nb"])

    left = cut.select(F.col("cls").alias("a"), "f", F.col("ids").alias("x"))
    right = cut.select(F.col("cls").alias("b"), "f", F.col("ids").alias("y"))
    # every fragment of either side: the sizes are summed as well
    sides = pairs.select("a", "b", *more, F.explode(F.array(*map(F.lit, range(FRAGMENTS)))).alias("f"))
    met = sides.join(left.hint("merge"), ["a", "f"], "left").join(right.hint("merge"), ["b", "f"], "left").select("x", "y", "a", "b", "f", *more)
    counted = met.mapInArrow(tidied(overlap), "a long, b long, f int, " + "".join(f"{c} long, " for c in more) + "both long, na long, nb long")
    # repeated rows of a doc_id give a fragment more than once
    each = counted.groupBy("a", "b", *more, "f").agg(*(F.max(c).alias(c) for c in ("both", "na", "nb")))
    sums = each.groupBy("a", "b", *more).agg(*(F.sum(c).alias(c) for c in ("both", "na", "nb")))
    return sums.where(den * F.col("both") >= num * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b", *more)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node with an edge, root the least node reachable: alternating large and small stars."""
    state, before = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), None
    while True:
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = wide.groupBy("u").agg(F.min("v").alias("m"))
        near = wide.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        near = near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        state = scratch.write(near.union(root.select("u", F.col("m").alias("v"))).distinct())
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """roots (cls, comp) after the links found between components (ca, cb): each goes to the least that it is linked to, and on to where that one goes. A step towards the components of the links; what it leaves apart later rounds see."""
    ends = found.select(F.col("ca").alias("u"), F.col("cb").alias("v")).union(found.select("cb", "ca"))
    least = ends.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("v"))
    ahead = least.select(F.col("u").alias("v"), F.col("v").alias("w"))
    to = least.join(ahead, "v", "left").select(F.col("u").alias("comp"), F.least(F.col("v"), F.coalesce("w", "v")).alias("to"))
    return roots.join(to, "comp", "left").select("cls", F.coalesce("to", "comp").alias("comp"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable over pairs with den * overlap >= num * union)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = frequencies(docs.select("text"), k)
    if not counts.any():  # no document has a shingle
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    by_bucket = frequency_classes(counts)
    classes, cuts = spark.sparkContext.broadcast(by_bucket), pivots(counts, by_bucket)

    rows = scratch.write(profiles(docs, classes, k, num, den))
    kinds = scratch.write(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("lo"), F.min("n").alias("n"), *(F.min(f"m{j}").alias(f"m{j}") for j in range(MINHASHES))))

    met = scratch.write(stars(kinds, scratch))
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    near = scratch.write(promising(met, leads_of(kinds.join(ends(met), "cls", "left_semi"), rows), num, den))
    # the fragments of every class that was ever compared
    cut = scratch.write(fragments(docs, kinds.join(ends(near), "cls", "left_semi"), classes, cuts, k))
    first = components(scratch.write(links(near, cut, num, den)), scratch)

    roots = kinds.select("cls").join(first.toDF("cls", "root"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("comp"))
    leads, active, nearest, all_links = leads_of(kinds, rows), False, True, [first.toDF("a", "b")]
    parts = max(8, -(-int(counts.sum()) * (den - num) // den // PART_IDS))
    for turn in range(NEAREST_ROUNDS + 1):
        nearest = nearest and turn < NEAREST_ROUNDS
        offered = scratch.write(completion(leads.join(roots, "cls"), parts, num, den, nearest))
        if not active:
            # a class without a candidate now has none after components have merged
            active, leads = True, scratch.write(leads_of(kinds.join(offered.select(F.col("a").alias("cls")), "cls", "left_semi"), rows))
            roots = roots.join(leads.select("cls"), "cls", "left_semi")
            parts = max(8, -(-int(leads.agg(F.coalesce(F.sum(F.length("prefix")), F.lit(0))).first()[0]) // 8 // PART_IDS))
        swap = F.col("a") > F.col("b")
        pairs = offered.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("cb")).otherwise(F.col("ca")).alias("ca"), F.when(swap, F.col("ca")).otherwise(F.col("cb")).alias("cb")).distinct()
        near = scratch.write(promising(pairs, leads, num, den))
        new = scratch.write(leads.select("cls", "lo").join(ends(near), "cls", "left_semi").join(cut.select("cls").distinct(), "cls", "left_anti"))
        if not new.isEmpty():
            cut = cut.union(scratch.write(fragments(docs, new, classes, cuts, k)))
        found = scratch.write(links(near, cut, num, den))
        all_links.append(found.select("a", "b"))
        if not nearest:
            break
        nearest = not found.isEmpty()
        roots = scratch.write(merged(roots, found)) if nearest else roots

    edges = functools.reduce(DataFrame.union, all_links)
    last = components(edges, scratch)
    lows = kinds.select(F.col("cls").alias("node"), "lo").join(last, "node", "left").select("node", "lo", F.coalesce("root", "node").alias("root"))
    least = lows.groupBy("root").agg(F.min("lo").alias("component_id"))
    named = scratch.write(lows.join(least, "root").select(F.col("node").alias("cls"), "component_id"))
    return rows.select("doc_id", "n", "cls").join(named, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
