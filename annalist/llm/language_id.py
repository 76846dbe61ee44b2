"""Language ID by multilingual mixture inference.

Each language has a table of byte-trigram probabilities, learned from labelled documents. A word's likelihood in a language
is that of its trigrams, the spaces around it included. A document's words are a mixture of languages;
expectation-maximisation finds the proportions, over all languages and then over the best one, two, ... languages, and the
set with the best penalised likelihood is chosen: half of PENALTY * ln(words) for each further language. Every estimate runs
until no proportion of the document changes by CLOSE any more.

Training uses text and label of at most about SAMPLE labelled documents a language, chosen by a hash of their id, and
whole texts of those. Predictions depend on the text alone.

Defined results: a null text, or one without a letter, is `und` with score 0, as is every text if nothing could be learned;
labels that are null, and texts that are, teach nothing; more than MOST_LABELS distinct labels are an error; repeated rows are judged alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import summed_slices
from ._text import groups, mix64, text_buffer, tidied

#: Labelled documents a language that are learned from, about; a documented bound of the model, not of what is judged.
SAMPLE = 4000
FEATURE_BITS, SLICES = 15, 32
SMOOTHING, PENALTY = 0.5, 4.0
#: The change of a proportion below which an estimate has settled, and rounds after which it is taken as it is.
CLOSE, ROUNDS = 1e-4, 200
#: Distinct labels that a model may have: each takes a table of 2**FEATURE_BITS counts.
MOST_LABELS = 1000
CHUNK = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes lower-cased, one space for all but letters and bytes beyond ASCII, one space before and after each text; offsets of the texts in them)."""
    b = np.arange(256)
    table = np.where((b >= 65) & (b <= 90), b + 32, np.where(((b >= 97) & (b <= 122)) | (b >= 128), b, 32)).astype(np.uint8)
    own = offsets - offsets[0]
    return np.append(np.insert(table[data[offsets[0] : offsets[-1]]], own, 32), np.uint8(32)), own + np.arange(len(own))


def features(s: np.ndarray) -> np.ndarray:
    """The feature of each trigram."""
    t = s[:-2].astype(np.uint64) | (s[1:-1].astype(np.uint64) << np.uint64(8)) | (s[2:].astype(np.uint64) << np.uint64(16))
    return (mix64(t + np.uint64(1)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages by code point, log-probabilities: features x languages) from rows (doc_id, text, lang)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LABELS + 1).collect()}
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} distinct labels; a model holds a table for each")
    if not sizes:
        return [], np.zeros((1 << FEATURE_BITS, 0), np.float32)
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, sample / n) * 1_000_000)).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1_000_000)) < share)

    def count(batches):
        import pyarrow as pa

        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            data, offsets = text_buffer(batch.column(0))
            for a, b in groups(data, offsets):
                s, at = letters(data, offsets[a : b + 1])
                f, own = features(s), s[1:-1] != 32
                for i in range(b - a):
                    part = slice(int(at[i]), int(at[i + 1]))
                    counts = np.bincount(f[part][own[part]], minlength=1 << FEATURE_BITS)
                    totals[langs[a + i]] = totals.get(langs[a + i], 0) + counts
        out = [(names.index(lang) * SLICES + i, x.tobytes()) for lang, c in totals.items() for i, x in enumerate(np.split(c.astype(np.int64), SLICES))]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int32(), pa.binary()))], ["slice", "counts"])

    names = sorted(sizes)
    table = summed_slices(picked.select("text", "lang").mapInArrow(tidied(count), "slice int, counts binary"), len(names) * SLICES, (1 << FEATURE_BITS) // SLICES)
    counts = table.reshape(len(names), -1)
    seen = counts.sum(axis=1) > 0
    counts, names = counts[seen], [n for n, s in zip(names, seen, strict=True) if s]
    return names, np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * counts.shape[1])).T.astype(np.float32)


def word_likelihoods(s: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: np.ndarray) -> np.ndarray:
    """words x languages: the log-likelihood of each word."""
    out = np.zeros((len(starts), model.shape[1]))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK)))
        low, high = int(starts[a]) - 1, int(ends[b - 1]) - 1
        f = features(s[low : high + 2])
        for j in range(model.shape[1]):
            total = np.zeros(len(f) + 1)
            np.cumsum(model[:, j][f], out=total[1:])
            out[a:b, j] = total[ends[a:b] - 1 - low] - total[starts[a:b] - 1 - low]
        a = b
    return out


def expectation(like: np.ndarray, share: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Settled proportions, for all documents at once: like words x languages, share documents x languages; every document has words."""
    out, left, open_ = share.copy(), np.arange(len(sizes)), np.ones(len(sizes), bool)
    for _ in range(ROUNDS):
        r = like * np.repeat(share, sizes, axis=0)
        r /= r.sum(axis=1, keepdims=True)
        new = np.add.reduceat(r, first, axis=0) / sizes[:, None]
        # what has settled stays as it is, so that a document's neighbours don't change its result
        out[left[open_]] = new[open_]
        open_ = open_ & (np.abs(new - share).max(axis=1) >= CLOSE)
        share = new
        if not open_.any():
            break
        if open_.sum() < 0.7 * len(open_):
            like = like[np.repeat(open_, sizes)]
            share, sizes, left, open_ = share[open_], sizes[open_], left[open_], open_[open_]
            first = np.cumsum(sizes) - sizes
    return out


def infer(logs: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents x languages: proportions within the chosen set; languages in it)."""
    langs = logs.shape[1]
    top = logs.max(axis=1, keepdims=True)
    like = np.maximum(np.exp(logs - top), 1e-30)
    share = expectation(like, np.full((len(sizes), langs), 1 / langs), first, sizes)
    rank = np.argsort(-share, axis=1, kind="stable")
    totals = np.add.reduceat(logs - top, first, axis=0)
    best = totals.argmax(axis=1)
    found, count = np.zeros_like(share), np.ones(len(sizes), np.int64)
    found[np.arange(len(sizes)), best] = 1
    score = totals.max(axis=1)
    for k in range(2, langs + 1):
        allowed = np.zeros_like(share)
        np.put_along_axis(allowed, rank[:, :k], 1, axis=1)
        # where the k-th language holds next to nothing, the larger set can't win
        open_ = np.flatnonzero(np.take_along_axis(share, rank[:, k - 1 : k], axis=1)[:, 0] * sizes > 0.5)
        if not len(open_):
            break
        take = np.repeat(np.isin(np.arange(len(sizes)), open_), sizes)
        own, part = sizes[open_], like[take]
        begin = np.cumsum(own) - own
        start = (share[open_] + 1e-9) * allowed[open_]
        mixed = expectation(part, start / start.sum(axis=1, keepdims=True), begin, own)
        fit = np.add.reduceat(np.log((part * np.repeat(mixed, own, axis=0)).sum(axis=1)), begin) - 0.5 * PENALTY * (k - 1) * np.log(np.maximum(own, 2))
        better = fit > score[open_]
        score[open_[better]], found[open_[better]], count[open_[better]] = fit[better], mixed[better], k
    return found, count


def proportions(docs: DataFrame, names: list[str], model: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (its proportion), shares (all proportions, by `names`) and n_langs of every document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        table = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            known = np.asarray(batch.column(2).to_pylist(), bool)
            pred, score, n_langs = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            shares = np.zeros((batch.num_rows, len(names)))
            for a, b in groups(data, offsets) if names else ():
                s, at = letters(data, offsets[a : b + 1])
                w = s != 32
                edge = np.flatnonzero(w[1:] != w[:-1]) + 1  # a space comes first and last
                starts, ends = edge[::2], edge[1::2]
                bounds = np.searchsorted(starts, at)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                if not len(full):
                    continue
                share, count = infer(word_likelihoods(s, starts, ends, table), bounds[full], sizes[full])
                shares[a + full], n_langs[a + full] = share, count
            lead = shares.argmax(axis=1) if names else np.zeros(batch.num_rows, np.int64)
            for i in np.flatnonzero(known & (n_langs > 0)):
                pred[i], score[i] = names[lead[i]], min(1.0, max(0.0, float(shares[i, lead[i]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred), pa.array(score), pa.array(shares.tolist(), pa.list_(pa.float64())), pa.array(n_langs)], ["doc_id", "lang_pred", "score", "shares", "n_langs"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("known"))
    return rows.mapInArrow(tidied(run), f"doc_id {kind}, lang_pred string, score double, shares array<double>, n_langs int")


def predict(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those that aren't held out."""
    names, model = learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), sample)
    out = proportions(docs, names, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_langs")
