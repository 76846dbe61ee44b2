"""The pipeline against a plain version, stage by stage, over all documents of the smallest tables."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from annalist.llm import mixing, quality_rules, sharding
from pyspark.sql import functions as F

from .test_operators import WORD, alnum, em, measures, shingles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def votes(t):
    words, chars, symbols, dup, repeat = measures(t)
    found = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, letters = len(lines), sum(c.isalpha() for c in t)
    lettered, distinct = sum(any(c.isalpha() for c in w) for w in found), len(set(found))
    closed = sum(bool(re.search(r"[.!?:;…»”\"')\]]\s*$", x)) for x in lines)
    defects = [words < 50, 10 * symbols > words, 100 * lettered < 80 * words, 100 * letters < 75 * chars, n > 1 and 100 * dup > 30 * n, 100 * repeat > 30 * words, 10 * distinct < words, chars < 3 * words or chars > 12 * words, 100 * closed < 10 * n]
    signs = [n > 0 and 100 * closed >= 80 * n, words > 0 and 100 * letters >= 90 * chars, words >= 100 and 5 * distinct >= words]
    return tuple([-1 if d else 0 for d in defects] + [1 if s else 0 for s in signs]), words < 50 or 100 * repeat > 50 * words


def plain_quality(rows):
    voted = [votes(r["text"] or "") for r in rows]
    good = em(Counter(v for v, _ in voted), quality_rules.ROUNDS)
    return [r for r, (v, bad) in zip(rows, voted, strict=True) if not bad and good[v] >= quality_rules.KEEP_AT]


def plain_near_duplicates(rows):
    sets, kept, group = [shingles(r["text"]) for r in rows], [], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    for g in set(group):
        kept.append(min((r for r, x in zip(rows, group, strict=True) if x == g), key=lambda r: r["doc_id"]))
    return kept


def plain_decontamination(rows, items):
    windows = defaultdict(set)
    for t in items:
        w = alnum(t)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[k].add(tuple(w[i : i + k]))
    out = []
    for r in rows:
        w = alnum(r["text"])
        hit = {i + j for k, known in windows.items() for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in known for j in range(k)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(r)
    return out


def plain_mixture(rows, keys):
    sizes, size = Counter(), {r["doc_id"]: len(WORD.findall(r["text"])) for r in rows}
    for r in rows:
        sizes[r["source"]] += size[r["doc_id"]]
    weight, total, capped = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}, sum(sizes.values()), set()
    while True:
        left, rest = total - sum(3 * sizes[s] for s in capped), sum(w for s, w in weight.items() if s not in capped)
        over = {s for s in sizes if s not in capped and left * weight[s] >= 3 * sizes[s] * rest}
        if not over:
            break
        capped |= over
    target = {s: float(3 * sizes[s]) if s in capped else left * weight[s] / rest for s in sizes}
    copies, used, at = [], 0, Counter()
    shuffled = sorted(rows, key=lambda r: hashlib.md5(str(keys[r["doc_id"]]).encode()).hexdigest())
    for copy in range(mixing.MAX_COPIES):
        for r in shuffled:
            at[r["source"]] += size[r["doc_id"]]
            copies.append((at[r["source"]] / target[r["source"]], hashlib.md5(str(keys[r["doc_id"]]).encode()).hexdigest(), copy, r))
    out = []
    for _, _, _, r in sorted(copies, key=lambda x: x[:3]):
        used += size[r["doc_id"]]
        if used > total:
            break
        out.append(r)
    return out


def test_pipeline(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    items = pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist()
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows, key = corpus_pipeline.keyed(df, "doc_id", "text", "source")
    keys = {r["doc_id"]: r[key] for r in rows.select("doc_id", key).collect()}
    steps = [plain_quality, plain_near_duplicates, lambda rows: plain_decontamination(rows, items), lambda rows: plain_mixture(rows, keys)]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, steps, strict=False):
        got = stage(spark, df, SF)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        want = plain(docs)
        assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in want), name
        df, docs = spark.createDataFrame(got.collect(), got.schema), want
    placed = corpus_pipeline.STAGES[-1][1](spark, df, SF).collect()
    count, whole = Counter(r["doc_id"] for r in docs), len(docs)
    assert Counter(r["doc_id"] for r in placed) == count
    prefs = {r["cell"]: r["prefs"] for r in sharding.preferences(spark, 24, 64).collect()}
    order = spark.createDataFrame([(i,) for i in count], "doc_id long").select("doc_id", sharding.cell_of(F.col("doc_id")).alias("cell"), F.xxhash64("doc_id", F.lit(0x0DD5)).alias("h")).orderBy("cell", "h").collect()
    room, want = [whole // 24 + (i < whole % 24) for i in range(24)], Counter()
    for r in order:
        for _ in range(count[r["doc_id"]]):
            shard = next(s for s in prefs[r["cell"]] if room[s])
            room[shard] -= 1
            want[r["doc_id"], shard] += 1
    assert Counter((r["doc_id"], r["shard"]) for r in placed) == want
    by_id = {r["doc_id"]: r["text"] for r in docs}
    assert all(r["text_crc32"] == zlib.crc32(by_id[r["doc_id"]].encode()) and r["size"] == len(by_id[r["doc_id"]].encode()) + 8 for r in placed)


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and {"doc_id", "shard", "slot"} <= set(rows.columns)


def edge_rows():
    text = " ".join(f"word{i} stands." for i in range(120))
    other = " ".join(f"thing{i} moves here." for i in range(80))
    return [
        (1, text, "en", "a", 5), (1, text, "en", "a", 5), (1, other, "en", "b", 5), (None, text, "en", "a", 1), (None, text, None, None, None), (None, None, None, "a", 1), (2, None, "en", None, 1), (3, "", "en", "a", 0), (4, other + " end.", "en", "b", 2),
        (5, "one two", "en", "a", 7),
    ]


def test_stages_on_edge_rows(spark):
    """Null texts and ids, repeated rows, columns of any name, and no rows at all."""
    df = spark.createDataFrame(edge_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("key", "copies", "rows", "copy", "part", "at", "__key", "id", "component_id", "kept", "cell", "size"):
        df = df.withColumn(name, F.lit(name))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, df, SF).collect()
        assert stage(spark, df.limit(0), SF).count() == 0
        if name == "sharding":
            assert len(rows) == len(edge_rows())
            continue
        assert set(rows[0].asDict()) == set(df.columns) and {r["key"] for r in rows} == {"key"}
        kept[name] = Counter((r["doc_id"], r["text"]) for r in rows)
    text, other = edge_rows()[0][1], edge_rows()[2][1]
    assert kept["quality rules"] == Counter({(1, text): 2, (1, other): 1, (None, text): 2, (4, other + " end."): 1})
    assert kept["n-gram Jaccard join"] == Counter({(None, text): 1, (1, other): 1, (None, None): 1, (2, None): 1, (3, ""): 1, (5, "one two"): 1})
    assert kept["benchmark decontamination"] == Counter((r[0], r[1]) for r in edge_rows())


def test_mixture_shares_copies_among_equal_rows(spark):
    rows = [(7, "some words of a text", "en", "a", 1)] * 5 + [(i, f"row {i} has its words", "en", "b", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    keyed, key = corpus_pipeline.keyed(df, "doc_id", "text", "source")
    taken = mixing.mix(keyed, key).where("size > 0").groupBy("doc_id").agg(F.sum("taken").alias("n")).join(keyed.select(F.col(key).alias("doc_id"), "text").distinct(), "doc_id")
    want = {r["text"]: r["n"] // 5 for r in taken.collect()}
    got = Counter(r["text"] for r in dict(corpus_pipeline.STAGES)["mixing sources to target weights"](spark, df, SF).collect())
    assert got == Counter({t: n for t, n in want.items() if n}) and len(set(want.values())) > 1


def test_a_stage_leaves_other_tables(spark):
    from annalist.llm import line_dedup

    df = spark.createDataFrame(edge_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    other = line_dedup.digest(df)
    for name, stage in corpus_pipeline.STAGES:
        if name != "n-gram Jaccard join":
            stage(spark, df, SF)
    assert other.count() == len(edge_rows())
