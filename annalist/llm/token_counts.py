"""Token counts with a whole-token shortcut.

Offline, `whole_tokens` proves which vocabulary strings the library encodes, alone, as one token; pre-tokens found in that
table count one without any merging. Only the other pre-tokens are merged, by the library, each distinct one once per
worker (a bounded table). Texts in which a pre-token can't be told from outside the library - special tokens' openers,
or characters for which normalisation and this module's classes are not proved alike - go to the library whole.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import tidied, worker_cache

LIMIT = 2048
#: Distinct merged pre-tokens a worker keeps before it starts its table anew; not a cap on results.
KEPT = 1_000_000
#: Characters for which lower-casing, composition and the word classes below are the library's: ASCII but controls, and letters and signs up to U+024F without U+0130 and the superscript digits and fractions, which are numbers but not digits.
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]|<\|")
#: The pre-tokeniser's pattern, for those characters; words, which no contraction can begin like, come first.
PRE = re.compile(r"[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d|\d|(?:[^\s\w]|_)+")


def load(path: str):
    """The library's tokenizer, once per worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    cache = worker_cache()
    if ("tokenizer", path) not in cache:
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        cache["tokenizer", path] = t
    return cache["tokenizer", path]


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a plain text, lower-cased as the library does."""
    return PRE.findall(text.lower())


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for. Printable bytes stand for themselves, the others follow from code point 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def whole_tokens(tokenizer, word_end: str = "</w>") -> set[str]:
    """The plain strings that end a word in the vocabulary and that the library, given the string alone, encodes as one token."""
    alphabet, candidates = byte_alphabet(), set()
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        own = piece.removesuffix(word_end)
        if own != piece and all(c in alphabet for c in own):
            try:
                word = bytes(alphabet[c] for c in own).decode()
            except UnicodeDecodeError:
                continue
            if not PLAIN.search(word) and PRE.fullmatch(word) and word == word.lower():
                candidates.add(word)
    tried = sorted(candidates)
    return {w for w, e in zip(tried, tokenizer.encode_batch(tried, add_special_tokens=False), strict=True) if len(e.ids) == 1}


def counter(path: str):
    """A function from a list of texts to their token counts."""
    tokenizer, cache = load(path), worker_cache()
    if ("whole", path) not in cache:
        cache["whole", path] = whole_tokens(tokenizer)
    whole, merged = cache["whole", path], cache.setdefault(("merged", path), {})

    def count(texts: list[str]) -> list[int]:
        out, odd = [0] * len(texts), [i for i, t in enumerate(texts) if PLAIN.search(t)]
        rest: dict[int, list[str]] = {}
        strange = set(odd)
        for i, t in enumerate(texts):
            if t and i not in strange:
                found = pre_tokens(t)
                others = [p for p in found if p not in whole]
                out[i] = len(found) - len(others)
                if others:
                    rest[i] = others
        new = {p for others in rest.values() for p in others if p not in merged}
        if len(merged) + len(new) > KEPT:
            merged.clear()
            new = {p for others in rest.values() for p in others}
        new = list(new)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            merged.update((p, len(e.ids)) for p, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True))
        for i, others in rest.items():
            out[i] += sum(map(merged.__getitem__, others))
        for i, e in zip(odd, tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = len(e.ids)
        return out

    return count


def token_counts(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) per document."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        count = counter(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counts = count([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(tidied(run), f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
