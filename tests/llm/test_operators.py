"""Operators against plain versions on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing, quality_rules, sharding, token_counts, token_store, url_filter

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, size string, cls string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    vowels = ["ba", "lo", "ti", "re", "un", "ka", "sol", "men"]
    return " ".join("".join(rng.choice(vowels, rng.integers(1, 4))) for _ in range(n)) + "."


def texts():
    base = prose(1, 120)
    words = base.split()
    near = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in (3, 50, 100)]
    return [
        base, *near, base, None, "", " \n\t ", "one two", "one two", "One  TWO", "l'été <|endoftext|> ²½ ∑ 你好", prose(2, 300) + "\n" + prose(3, 60), prose(2, 300) + "\n" + prose(4, 60),
        "spam eggs ham " * 80, prose(5, 4000), "x" * 5000, "line of six words right here\n" * 4 + "line of six words left here\nshort\nshort", "line of six words right over here\nother", prose(6, 12) + " " + base,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "c"][i % 4 if i % 5 else 0], 1, "w", "s", "c", "k") for i, t in enumerate(texts())]
    rows += [rows[1], rows[5], rows[12]]  # repeated rows
    rows.append((None, base_of(rows), None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def base_of(rows):
    return rows[0][1] + " tail"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def measures(t):
    t = t or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs):
    got = rows_of(quality_rules.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for r in docs.collect():
        m = measures(r["text"])
        want.append((r["doc_id"], *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert got == sorted(want, key=str)


def test_quality_many_repeats(spark):
    text = " ".join(f"w{i}" for i in list(range(200)) * 2)  # more repeated windows than are looked up one by one
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality_rules.judge(df).first()["n_repeat_words"] == measures(text)[4]


def em(patterns, rounds):
    """The posterior of each vote pattern, in plain Python."""
    good, bad, share, worth = quality_rules.prior(False), quality_rules.prior(True), quality_rules.SHARE, quality_rules.PRIOR_DOCS

    def post(v):
        odds = np.log(share / (1 - share)) + sum(np.log(g / b) if x else np.log((1 - g) / (1 - b)) for x, g, b in zip(v, good, bad, strict=True))
        return 1 / (1 + np.exp(-odds))

    for _ in range(rounds):
        ps = {v: post(v) for v in patterns}
        n_good, n_bad = sum(n * ps[v] for v, n in patterns.items()), sum(n * (1 - ps[v]) for v, n in patterns.items())
        good = [(sum(n * ps[v] for v, n in patterns.items() if v[j]) + worth * p) / (n_good + worth) for j, p in enumerate(quality_rules.prior(False))]
        bad = [(sum(n * (1 - ps[v]) for v, n in patterns.items() if v[j]) + worth * p) / (n_bad + worth) for j, p in enumerate(quality_rules.prior(True))]
        share = (n_good + worth * quality_rules.SHARE) / (n_good + n_bad + worth)
    return {v: post(v) for v in patterns}


def test_quality_recovers_planted_rates(spark):
    rng = np.random.default_rng(11)
    good_rates = np.array([0.03, 0.01, 0.05, 0.02, 0.1, 0.01, 0.02, 0.04, 0.03, 0.95, 0.9, 0.8])
    bad_rates = np.array([0.3, 0.5, 0.2, 0.6, 0.4, 0.25, 0.15, 0.35, 0.45, 0.5, 0.3, 0.6])
    is_good = rng.random(40_000) < 0.7
    fired = rng.random((40_000, 12)) < np.where(is_good[:, None], good_rates, bad_rates)
    patterns = Counter(tuple((-1 if j < 9 else 1) * int(x) for j, x in enumerate(row)) for row in fired.tolist())
    model = quality_rules.estimate(spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "votes array<int>, n long")).first()["model"]
    assert abs(model["share"] - 0.7) < 0.02
    assert np.abs(np.array(model["good"]) - good_rates).max() < 0.02 and np.abs(np.array(model["bad"]) - bad_rates).max() < 0.03
    votes_right = np.array([(is_good[fired[:, j]] == (j >= 9)).mean() for j in range(12)])
    assert np.abs(np.array(model["accuracy"]) - votes_right).max() < 0.04
    for x in (*model["good"], *model["bad"], *model["accuracy"], model["share"]):
        assert 0.0005 < x < 0.9995  # no estimate sits on a bound


def test_quality_estimate(docs):
    measured = quality_rules.measure(docs).withColumn("votes", F.array(*quality_rules.votes()))
    voted = {r["doc_id"]: tuple(r["votes"]) for r in measured.collect()}
    patterns = Counter(tuple(r["votes"]) for r in measured.collect())
    want = em(patterns, quality_rules.ROUNDS)
    for r in quality_rules.judge(docs).collect():
        assert r["probability"] == pytest.approx(want[voted[r["doc_id"]]], abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and r["probability"] >= quality_rules.KEEP_AT)


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    rows = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in docs.collect()]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:  # share, hold at the cap, share the excess again
        left = total - sum(3 * sizes[s] for s in capped)
        rest = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and left * weight[s] / rest >= 3 * sizes[s]} if rest else set()
        if not over:
            break
        capped |= over
    target = {s: 3 * sizes[s] if s in capped else left * weight[s] / rest for s in names}
    source = {(i, n): s for i, s, n in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(rows) and sum(taken.values()) <= total
    biggest = max(n for _, _, n in rows)
    assert all(abs(taken[s] - target[s]) <= biggest for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_token_store(docs, spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for name, limits in (("one", {}), ("many", {"file_docs": 2, "file_ids": 500})):
        folder = f"{tmp_path}/{name}"
        token_store.write_store(docs, folder, path, **limits)
        store = token_store.read_store(spark, folder)
        assert rows_of(token_store.digest(store, folder), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)
        found = token_store.lookup(store, folder, [0, 12, 999]).collect()
        assert sorted(r["doc_id"] for r in found) == [0, 12, 12]
        assert next(r["ids"] for r in found if r["doc_id"] == 0) == [*t.encode(texts()[0], add_special_tokens=False).ids, 2]
    assert store.count() > 8 and store.agg(F.max("n_docs")).first()[0] == 2


def test_token_store_ids(spark, tmp_path):
    """Null ids, one repeated id and ids that are strings: files end all the same."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    for name, kind, ids in (("null", "long", [None] * 50), ("same", "long", [7] * 50), ("text", "string", [f"doc-{i % 40}" for i in range(50)])):
        docs = spark.createDataFrame([(i, f"text number {k}") for k, i in enumerate(ids)], f"doc_id {kind}, text string")
        folder = f"{tmp_path}/{name}"
        token_store.write_store(docs, folder, path, file_docs=6)
        store = token_store.read_store(spark, folder)
        got = token_store.digest(store, folder).collect()
        assert len(got) == 50 and store.agg(F.max("n_docs")).first()[0] == 6
        assert len({r["doc_id"] for r in got}) == (40 if name == "text" else 1)
        if name == "same":
            assert token_store.lookup(store, folder, [7]).count() == 50
        if name == "text":
            hashed = spark.range(1).select(F.xxhash64(F.lit("doc-3"))).first()[0]
            assert token_store.lookup(store, folder, [hashed]).count() == 2


def test_token_store_reads_little(spark, tmp_path):
    """A lookup reads the same few bytes of an index, however many documents there are."""
    rng = np.random.default_rng(5)

    class Counted:
        def __init__(self, raw):
            self.raw, self.at, self.n = raw, 0, 0

        def seek(self, at):
            self.at = at

        def read(self, size):
            self.n += size
            return self.raw[self.at : self.at + size]

    for n in (10, 1000, 30_000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        arrays = token_store.index_arrays(keys, 0) | {"ends": np.arange(1, len(keys) + 1, dtype="<u8")}
        row = {"n_docs": len(keys), "n_keys": len(keys), "n_buckets": len(arrays["seeds"])}
        raw = b"".join(arrays[c].tobytes() for c in token_store.layout(row))
        for i in (0, len(keys) // 2, len(keys) - 1):
            index = Counted(raw)
            assert token_store.find(index, row, int(keys[i])) == i and index.n == 8 + 2 + 4 + 8
        assert all(token_store.find(Counted(raw), row, int(k)) == -1 for k in rng.integers(-(1 << 62), 1 << 62, 300))


def test_minimal_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 500, 4096):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        seeds, slots = token_store.build_index(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))
        index = token_store.index_arrays(keys, 0)
        assert token_store.find_all(keys, index["seeds"], index["prints"], index["slots"]).tolist() == list(range(len(keys)))
        strangers = token_store.find_all(rng.integers(-(1 << 62), 1 << 62, 300), index["seeds"], index["prints"], index["slots"])
        assert (strangers >= 0).sum() <= 3  # fingerprints of 16 bits


def test_sharding(docs, spark):
    many = spark.range(1000).select((F.col("id") % 900).alias("doc_id"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    for df in (docs, many, many.where("doc_id < 5")):
        got = sharding.assign(df).collect()
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        counts = defaultdict(list)
        for r in got:
            counts[r["shard"]].append(r["slot"])
        sizes = [len(counts[s]) for s in range(24)]
        assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(24))
        assert all(sorted(v) == list(range(len(v))) for v in counts.values())


def test_sharding_walk(spark):
    """The fold against a row-by-row walk along the ring."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    prefs = {r["cell"]: r["prefs"] for r in sharding.preferences(spark, 24, 64).collect()}
    keyed = df.select("doc_id", sharding.cell_of(F.col("doc_id")).alias("cell"), F.xxhash64("doc_id", F.lit(0x0DD5)).alias("h")).orderBy("cell", "h", "doc_id").collect()
    room, want = [125] * 24, {}
    for r in keyed:
        shard = next(s for s in prefs[r["cell"]] if room[s])
        room[shard] -= 1
        want[r["doc_id"]] = shard
    got = {r["doc_id"]: r["shard"] for r in sharding.assign(df).collect()}
    assert got == want
    more = {r["doc_id"]: r["shard"] for r in sharding.assign(df, shards=25).collect()}
    moved = sum(got[k] != more[k] for k in got)
    assert moved < len(got) / 4  # most rows stay though all capacities shrink


def test_sharding_repeats(spark):
    rows = [(1, "a")] * 500 + [(None, None)] * 300 + [(i, "b") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole, parts = (sharding.assign(df, repeats=n) for n in (100_000, 7))
    names = ("doc_id", "size", "text_crc32", "law", "shard", "slot")
    assert rows_of(whole, *names) == rows_of(parts, *names)
    slots = defaultdict(list)
    for r in parts.collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and {len(x) for x in slots.values()} <= {37, 38}


def url_plain(url, allow, block):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = []
    for rule in [*allow, *block]:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), len(h), rule))
    rule = max(fits)[2] if fits else None
    return host, path, rule, "block" if rule in block else "allow"


def test_url_filter(spark):
    allow, block = ["com/", "www.example.com/en/"], ["example.com/en/", "net/es/", "net/fr/"]
    urls = [
        "https://WWW.Example.com/en/1?x=/fr/", "http://m.example.com/en/", "http://example.com/EN/", "https://a.b.net/es/x", "net/es/", None, "", "http://net/fr/", "http://xnet/fr/", "http://a.net/fr", "ftp://x.com?q", "ftp://x.com/#f",
        "a://b://c.com/", "http://com/", "http://.com/x", "http://example.org/en/", "http://www.example.com/en/", "http://a.www.example.com/en/\nb", "http:///en/", "http://example.com:80/en/",
    ]
    pages = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, rule string, host string")
    want = [(i, *url_plain(u, allow, block)) for i, u in enumerate([*urls, urls[0]])]
    assert rows_of(url_filter.judge(pages, allow, block), "page_id", "host", "path", "rule", "verdict") == sorted(want, key=str)
    hosts = [f"h{i}.example.com/" for i in range(300)]
    many = spark.createDataFrame([(i, f"http://h{i}.example.com/x") for i in range(0, 1200)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(many, [], hosts).collect()}
    assert got == {i: "block" if i < 300 else "allow" for i in range(1200)}
    # several parts of a list, lists that are tables, and paths of many lengths
    table = spark.createDataFrame([(h,) for h in [*hosts, None]], "rule string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(many, spark.createDataFrame([], "rule string"), table, most_bits=700).collect()}
    assert got == {i: "block" if i < 300 else "allow" for i in range(1200)}
    deep = [f"a.net/{'x' * n}" for n in range(0, 240, 2)]
    long = [f"http://{h}/{'x' * n}{'y' * 20_000}" for n in (0, 1, 7, 239, 240) for h in ("a.net", "b.a.net", "c.net", "q" * 30_000 + ".net")]
    pages2 = spark.createDataFrame(list(enumerate(long)), "page_id long, url string")
    want = [(i, *url_plain(u, deep[::2], deep[1::2])) for i, u in enumerate(long)]
    for bits in (1 << 25, 200):
        assert rows_of(url_filter.judge(pages2, deep[::2], deep[1::2], most_bits=bits), "page_id", "host", "path", "rule", "verdict") == sorted(want, key=str)
    assert url_filter.judge(pages.limit(0), allow, block).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, [], []).collect()} == {"allow"}


def near_lines(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def tie(t):
    """The rank of a text among those of one doc_id."""
    import xxhash

    h = 42 if t is None else xxhash.xxh64(t.encode(), seed=42).intdigest()
    return (h - (1 << 64) if h >= 1 << 63 else h) % line_dedup.TIES


def doomed_lines(rows):
    """{(doc_id, text, line number)} of lines that go, without scripts that have no spaces."""
    lines, at, gone = [], {}, set()
    for d, t in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, tie(x[1]))):
        for pos, line in enumerate((t or "").split("\n")):
            if w := WORD.findall(line):
                lines.append((d, t, pos, w))
                at.setdefault(tuple(w), len(lines) - 1)
    for i, (d, t, pos, w) in enumerate(lines):
        long = len(w) >= line_dedup.MIN_WORDS
        if at[tuple(w)] != i or long and any(j < i and len(x) >= line_dedup.MIN_WORDS and near_lines(list(x), w) for x, j in at.items()):
            gone.add((d, t, pos))
    return gone


def test_line_dedup(docs, empty):
    gone = doomed_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = line_dedup.dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    want = []
    for r in docs.collect():
        x = (r["text"] or "").split("\n")
        kept = [y for p, y in enumerate(x) if (r["doc_id"], r["text"], p) not in gone]
        want.append((r["doc_id"], None if r["text"] is None else "\n".join(kept), len(x), len(x) - len(kept)))
    assert rows_of(got, "doc_id", "text", "n_lines", "n_dropped") == sorted(want, key=str)
    assert line_dedup.digest(empty).count() == 0
    # earlier columns of the same names are replaced
    assert line_dedup.dedup(got).columns == got.columns


def test_line_dedup_of_shared_ids(spark):
    rows = [
        (1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta\nkeep me as the first of its kind"), (2, "wholly other unique line of words\nsecond line of that same document\nkeep me as the first of its kind"),
        (None, "one line of a document without id\nshort"), (None, "another line with words of its own\nshort"), (None, "another line with words of its own\nshort"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = doomed_lines(rows)
    want = sorted("\n".join(y for p, y in enumerate(t.split("\n")) if (d, t, p) not in gone) for d, t in rows)
    assert sorted(r["text"] for r in line_dedup.dedup(df).collect()) == want
    assert sum("wholly other unique line" in t for t in want) == 1
    named = df.withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    got = line_dedup.dedup(named).collect()
    assert len(got) == 6 and sorted(r["text"] for r in got if r["doc_id"]) == sorted("\n".join(y for p, y in enumerate(t.split("\n")) if (d, t, p) not in gone) for d, t in rows if d)


def test_line_dedup_short_and_unspaced(spark):
    rows = [
        (1, "Les.\nhttps://a.example\n三个人今天去公园\none two three four"), (2, "Les.\n三个人明天去公园\none two three four"), (3, "Les\n你好\nOne two three four"), (4, "三 个人今天去公园\n  \n\n  Les.\n你好\nx 你好\none two three"),
        (5, "สวัสดีครับ"), (6, "สวัสดีครับ\nสวัสดีคร้บ\nย"),
    ]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # 明 for 今 is one edit of the eight characters; 你好, of two, goes only as a copy; case and a missing full stop make another short line
    assert got == {1: rows[0][1], 2: "", 3: rows[2][1], 4: "  \n\nx 你好\none two three", 5: rows[4][1], 6: "ย"}


def test_token_counts(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    want = []
    for r in docs.collect():
        n = len(t.encode(r["text"] or "", add_special_tokens=False).ids)
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 2048))
    assert rows_of(token_counts.token_counts(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)


def test_whole_tokens_are_proved():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = token_counts.whole_tokens(t)
    assert len(whole) > 10_000 and "the" in whole
    assert all(len(t.encode(w, add_special_tokens=False).ids) == 1 for w in list(whole)[:500])


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def test_decontamination(docs, spark, empty):
    words = texts()[0].split()
    items = [(1, " ".join(words[20:40])), (2, "one two"), (10, " ".join(words[30:45]).upper()), (3, None), (4, "..."), (5, prose(9, 30)), (6, "menlo"), (None, " ".join(words[60:80]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = []
    for i, t in items:
        w = alnum(t)
        k = min(13, len(w))
        windows += [(i, w[j : j + k]) for j in range(len(w) - k + 1) if k]
    want = []
    import hashlib

    for r in docs.collect():
        w, hit, found = alnum(r["text"]), set(), set()
        for i, x in windows:
            for j in range(len(w) - len(x) + 1):
                if w[j : j + len(x)] == x:
                    hit |= set(range(j, j + len(x)))
                    found |= {str(i)} - {"None"}
        want.append((r["doc_id"], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontaminate.scan(docs, bench), *names) == sorted(want, key=str)
    assert rows_of(decontaminate.scan(docs, bench, block_bytes=100), *names) == sorted(want, key=str)
    clean = {w[0] for w in want if not w[5]}
    for size in (32 << 20, 100):
        kept = decontaminate.clean(docs, bench, block_bytes=size)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == clean
    cut = decontaminate.scan(decontaminate.clean(docs, bench, remove="spans"), bench).collect()
    assert sum(r["n_hit"] for r in cut) < sum(w[2] for w in want) / 4
    assert decontaminate.scan(empty, bench).count() == 0 and decontaminate.scan(docs, bench.limit(0)).where("contaminated").count() == 0


def shingles(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_join(docs, empty):
    rows = docs.collect()
    sets = [shingles(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j]["doc_id"] for j in range(len(rows)) if group[j] == group[i] and rows[j]["doc_id"] is not None]
        want.append((r["doc_id"], len(sets[i]), min(ids) if sets[i] and ids else r["doc_id"]))
    assert rows_of(jaccard_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == sorted(want, key=str)
    assert jaccard_join.near_duplicates(empty).count() == 0


def near_copies(n, seed):
    """Near copies of one text at many distances, among them some that no other reaches."""
    rng = np.random.default_rng(seed)
    base = prose(seed, 150).split()
    out = []
    for i in range(n):
        words = list(base)
        for j in rng.choice(len(words), rng.integers(0, 9), replace=False):
            words[j] = f"w{i}x{j}"
        out.append(" ".join(words))
    return out


def test_jaccard_candidates_grow_with_the_group(spark, monkeypatch):
    """The components are those of all links, and the pairs that are counted grow as a group does, not as its pairs."""
    counted, promising = [], jaccard_join.promising

    def noted(pairs, *rest):
        counted.append(pairs.count())
        return promising(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "promising", noted)
    per_copy = []
    for n in (150, 600):
        counted.clear()
        rows = near_copies(n, 7)
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
        sets, group = [shingles(t) for t in rows], list(range(n))
        for i in range(n):
            for j in range(i):
                if group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    a, b = max(group[i], group[j]), min(group[i], group[j])
                    group = [b if g == a else g for g in group]
        assert got == dict(enumerate(group))
        assert len(set(group)) > 1
        per_copy.append(sum(counted) / n)
    assert per_copy[1] < 1.5 * per_copy[0]


def test_jaccard_across():
    """Long runs of a shingle give the same pairs as a plain loop."""
    rng = np.random.default_rng(2)
    docs = 300
    ids = np.concatenate([np.full(docs, 5, np.uint64), rng.integers(0, 40, 900).astype(np.uint64) + np.uint64(10)])
    doc = np.concatenate([np.arange(docs), rng.integers(0, docs, 900)]).astype(np.int32)
    n, comp = rng.integers(50, 90, docs), np.where(rng.random(docs) < 0.7, 1, rng.integers(2, 9, docs))
    sketches = np.zeros((docs, 8), np.uint64)
    pos = rng.integers(0, 5, len(ids)).astype(np.uint16)
    got = {(min(x, y), max(x, y)) for d, e, _ in jaccard_join.across(ids, doc, pos, n, comp, sketches, 80, 100) for x, y in zip(d.tolist(), e.tolist(), strict=True)}
    want = set()
    for i in range(len(ids)):
        for j in range(i):
            a, b = int(doc[i]), int(doc[j])
            if ids[i] == ids[j] and comp[a] != comp[b] and 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b]) and min(n[a] - pos[i], n[b] - pos[j]) >= -(-80 * (n[a] + n[b]) // 180):
                want.add((min(a, b), max(a, b)))
    assert got == want and len(want) > 1000


def test_summed_slices(spark):
    import pyarrow as pa

    from annalist.llm._tables import summed_slices

    def table(batches):
        for batch in batches:
            total = np.bincount(np.array(batch.column(0).to_pylist()) % 32, minlength=32)
            yield pa.RecordBatch.from_arrays([pa.array(range(4), pa.int32()), pa.array([x.astype(np.int64).tobytes() for x in np.split(total, 4)], pa.binary())], ["slice", "counts"])

    got = summed_slices(spark.range(0, 10_000, 1, 150).mapInArrow(table, "slice int, counts binary"), 4, 8)
    assert got.tolist() == np.bincount(np.arange(10_000) % 32).tolist()


def long_texts():
    """Texts over a megabyte, and a word longer than a piece of text that is hashed at once."""
    body = prose(21, 200_000)
    return [body, body.replace("ba", "be", 1), "y" * 700_000 + " and some more words after it", None, "", "y" * 700_000 + " and some more words after it"]


def test_long_texts(spark):
    rows = list(enumerate(long_texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in jaccard_join.near_duplicates(docs).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 2}
    assert [got[i]["n_shingles"] for i in range(6)] == [len(shingles(t)) for _, t in rows]
    words = alnum(rows[0][1])
    bench = spark.createDataFrame([(1, " ".join(words[150_000:150_020])), (2, "y" * 700_000 + " and some more words after it")], "item_id long, text string")
    for size in (32 << 20, 100):
        found = {r["doc_id"]: r for r in decontaminate.scan(docs, bench, block_bytes=size).collect()}
        assert [found[i]["n_hit"] for i in range(6)] == [20, 20, 7, 0, 0, 7] and [found[i]["n_words"] for i in (0, 2)] == [len(words), 7]
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for _, x in rows]
    digest = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_store.encode_and_read_back(docs, path).collect()}
    assert digest == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)}


def mixture_plain(logs, subsets):
    """The set of languages with the best penalised likelihood, and its proportions, by plain EM over every set."""
    n, best = len(logs), None
    top = logs.max(axis=1, keepdims=True)
    like = np.exp(logs - top)
    for langs in subsets:
        share = np.full(len(langs), 1 / len(langs))
        for _ in range(2000):
            r = like[:, langs] * share
            new = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
            done = np.abs(new - share).max() < 1e-9
            share = new
            if done:
                break
        fit = np.log((like[:, langs] * share).sum(axis=1)).sum() - 0.5 * language_id.PENALTY * (len(langs) - 1) * np.log(max(n, 2))
        if best is None or fit > best[0]:
            best = fit, langs, share
    return best


def test_language_id_against_plain_em():
    from itertools import combinations

    rng = np.random.default_rng(9)
    langs, docs = 5, []
    subsets = [list(c) for k in range(1, langs + 1) for c in combinations(range(langs), k)]
    for mix in ([1], [0.5, 0.5], [0.7, 0.3], [0.2] * 5, [0.4, 0.3, 0.2, 0.1], [0.9, 0.1], [1, 0], [0.34, 0.33, 0.33]):
        n = int(rng.integers(60, 200))
        of = rng.choice(len(mix), n, p=np.array(mix) / sum(mix))
        logs = rng.normal(-12, 1.5, (n, langs))
        logs[np.arange(n), of] += rng.normal(7, 2, n)
        docs.append(logs)
    sizes = np.array([len(x) for x in docs])
    first = np.cumsum(sizes) - sizes
    share, count = language_id.infer(np.concatenate(docs), first, sizes)
    for i, logs in enumerate(docs):
        _, chosen, wanted = mixture_plain(logs, subsets)
        assert count[i] == len(chosen) and set(np.flatnonzero(share[i]).tolist()) == set(chosen)
        assert np.abs(share[i][chosen] - wanted).max() < 0.01
        alone, alone_count = language_id.infer(logs, np.array([0]), sizes[i : i + 1])
        assert np.array_equal(alone[0], share[i]) and alone_count[0] == count[i]  # the neighbours don't matter


def test_language_id_edges(spark):
    """A very long text, ties, clashing names and too many labels."""
    rows = [(i, "the thing with the king " * 10 if i % 2 else "que l'eau moi quoi " * 10, "en" if i % 2 else "fr") for i in range(40)]
    rows += [(100, "the thing with the king " * 60_000, None), (101, "que l'eau moi quoi " * 3 + "z" * 400_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "known": F.lit(1), "n_langs": F.lit(2)})
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df).collect()}
    assert got[100] == "en" and got[101] in ("en", "fr") and got[1] == "en" and got[2] == "fr"
    same = df.withColumn("text", F.lit("abc def"))
    assert len({(r["lang_pred"], r["score"]) for r in language_id.predict(same).collect()}) == 1
    with pytest.raises(ValueError, match="labels"):
        language_id.learn(spark.range(1100).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.col("id").cast("string").alias("lang")))


def test_language_id(spark, empty):
    rng = np.random.default_rng(0)
    stems = {"en": ["the", "ing", "wh", "sh", "tion"], "fr": ["eau", "oi", "que", "ment", "é"]}
    rows = []
    for i in range(400):
        lang = ["en", "fr"][i % 2]
        rows.append((i, " ".join("".join(rng.choice(stems[lang], 3)) for _ in range(40)), lang))
    rows += [(1000, None, "en"), (1001, "123 ...", "fr"), (1002, "", None), (1003, rows[0][1] + " " + rows[1][1], None), (0, rows[0][1], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict(df).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == lang for i, _, lang in rows[:400])
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert by_id[1003]["n_langs"] == 2 and 0.4 < by_id[1003]["score"] < 0.6
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    relabelled = df.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "fr").otherwise(F.col("lang")))
    assert sorted(map(str, language_id.predict(relabelled).collect())) == sorted(map(str, got))
    assert language_id.predict(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_empty_tables(empty):
    for f in (quality_rules.judge, mixing.mix, sharding.assign):
        assert f(empty).count() == 0
    assert token_counts.token_counts(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert token_store.encode_and_read_back(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_language_id_many_languages(spark):
    rng = np.random.default_rng(3)
    stems = {f"l{i}": [f"{a}{b}" for b in "aeiou"] for i, a in enumerate(("kr", "bl", "zw", "mn", "tch", "spr"))}
    text = lambda lang, n: " ".join("".join(rng.choice(stems[lang], 3)) for _ in range(n))
    rows = [(i, text(f"l{i % 6}", 40), f"l{i % 6}") for i in range(300)]
    for k in (4, 5, 6):
        rows.append((1000 + k, " ".join(text(f"l{i}", 60 + (i == 0) * 20) for i in range(k)), None))
    got = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id > 1000").collect()}
    for k in (4, 5, 6):
        assert got[1000 + k]["n_langs"] == k and got[1000 + k]["lang_pred"] == "l0" and abs(got[1000 + k]["score"] - 80 / (60 * k + 20)) < 0.03


def test_decontamination_blocks_keep_rows(spark):
    words = prose(1, 60).split()
    bench = spark.createDataFrame([(1, " ".join(words[:20])), (2, " ".join(words[20:40])), (3, " ".join(words[40:]))], "item_id long, text string")
    rows = [(None, " ".join(words[:20])), (None, prose(8, 20)), (7, " ".join(words[20:60])), (7, " ".join(words[20:60])), (7, prose(9, 40)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    whole, parts = (rows_of(decontaminate.scan(docs, bench, block_bytes=size), *names) for size in (32 << 20, 100))
    assert parts == whole and len(parts) == 6 and sum(r[5] for r in parts) == 3
