"""Ranked retrieval for many queries at once: BM25 in two definitions, vectors, rank fusion, floors, MMR (TXT-1, 2; VEC-2, 4; JOIN-11; WIN-1, 2, 14 to 16; TOP-1 to 13; AGG-46)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import rrf


def top_k(rows: DataFrame, key: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k of each key, with their rank from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= k)


#: Queries that are scored at once, documents of a task that are, and cells of their table of term counts.
QUERY_BLOCK, DOC_BLOCK, CELLS = 256, 1024, 1 << 22


class Best:
    """The k best of each query seen so far, ties by the least id; of a task, however many batches it has."""

    def __init__(self, queries: int, k: int):
        import numpy as np

        self.k, self.score, self.id = k, np.full((0, queries), -np.inf), np.zeros((0, queries), np.int64)

    def add(self, score, ids) -> None:
        """score: rows x queries, -inf where there is none; ids: one a row."""
        import numpy as np

        order = np.argsort(ids, kind="stable")
        score, ids = np.concatenate([self.score, score[order]]), np.concatenate([self.id, np.repeat(ids[order][:, None], score.shape[1], axis=1)])
        by_id = np.argsort(ids, axis=0, kind="stable")
        score, ids = np.take_along_axis(score, by_id, 0), np.take_along_axis(ids, by_id, 0)
        first = np.argsort(-score, axis=0, kind="stable")[: self.k]
        self.score, self.id = np.take_along_axis(score, first, 0), np.take_along_axis(ids, first, 0)

    def rows(self):
        """(query, id, score) of what is held."""
        import numpy as np

        at, query = np.nonzero(self.score > -np.inf)
        return query, self.id[at, query], self.score[at, query]


def term_statistics(docs: DataFrame, tokens) -> DataFrame:
    """term, df of every term, and under the null term n and the number of tokens in all: one pass, counted before it is shuffled, written once."""
    from ..sources.readers import scratch_path

    t = tokens(F.col("text"))
    marks = F.concat(F.transform(F.array_distinct(t), lambda x: F.struct(x.alias("term"), F.lit(1).cast("long").alias("tokens"))), F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size(t).cast("long").alias("tokens"))))
    path = scratch_path(docs.sparkSession)
    docs.select(F.inline(marks)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tokens").alias("tokens")).write.parquet(path)
    return docs.sparkSession.read.schema("term string, df long, tokens long").parquet(path)


def bm25_top(docs: DataFrame, queries: DataFrame, tokens, k: int, okapi: bool = False, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, places: int = 6, statistics: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, rank of the k best documents of each query, ties by doc_id; scores to `places`.

    docs: doc_id, text; queries: query_id, text, a stated set; tokens: a function of a text column. The first definition has idf ln(1 + (N - df + 0.5) / (df + 0.5)) and every
    distinct query term once; with `okapi` idf is ln((N - df + 0.5) / (df + 0.5)), negative ones replaced by epsilon times the mean of all terms, and a repeated query term counts again.

    Queries go in blocks whose terms are broadcast. A task scores its documents against a block by a matrix product and keeps k a query, so that what is shuffled is k rows a query and task.
    """
    spark = docs.sparkSession
    statistics = term_statistics(docs, tokens) if statistics is None else statistics
    whole = statistics.where("term is null").first()
    n, total = (whole["df"], whole["tokens"]) if whole else (0, 0)
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    floor = epsilon * (statistics.where("term is not null").agg(F.avg(raw)).first()[0] or 0.0) if okapi else 0.0
    idf = F.when(raw < 0, floor).otherwise(raw) if okapi else F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    # the terms of the queries, each with its weight in one
    weights = wanted.join(statistics.where("term is not null").select("term", idf.alias("idf")), "term").select("query_id", "term", (F.col("idf") * (F.col("times") if okapi else F.lit(1))).alias("w"))
    numbered = queries.select("query_id").distinct()
    parts = max(1, -(-numbered.count() // QUERY_BLOCK))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    rows, out = docs.select("doc_id", tokens(F.col("text")).alias("t")), None
    for i in range(parts):
        block = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).collect()
        shared = spark.sparkContext.broadcast([tuple(r) for r in block])

        def run(batches, shared=shared):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            ids = sorted({q for q, _, _ in shared.value})
            terms = sorted({t for _, t, _ in shared.value})
            if not ids:
                return
            at, of = {q: j for j, q in enumerate(ids)}, {t: j for j, t in enumerate(terms)}
            table, has = np.zeros((len(terms), len(ids))), np.zeros((len(terms), len(ids)), np.float32)
            for q, t, w in shared.value:
                table[of[t], at[q]], has[of[t], at[q]] = w, 1
            known, best, step = pa.array(terms, pa.string()), Best(len(ids), k), max(1, min(DOC_BLOCK, CELLS // len(terms)))
            for batch in (x.slice(j, step) for x in batches for j in range(0, x.num_rows, step)):
                lists = batch.column(1)
                sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
                term = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)
                counts = np.bincount((row * len(terms) + term)[term >= 0], minlength=len(sizes) * len(terms)).reshape(len(sizes), len(terms)).astype(np.float64)
                part = counts * (k1 + 1) / (counts + k1 * (1 - b + b * sizes[:, None] / (total / n)))
                score = np.round(part @ table, places)
                score[(counts > 0).astype(np.float32) @ has == 0] = -np.inf
                best.add(score, batch.column(0).to_numpy(zero_copy_only=False))
            query, doc, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in query.tolist()]), pa.array(doc), pa.array(score)], ["query_id", "doc_id", "score"])

        near = rows.mapInArrow(run, kinds)
        out = near if out is None else out.union(near)
    return top_k(out, "query_id", [F.desc("score"), F.asc("doc_id")], k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, places: int = 12) -> DataFrame:
    """query_id, doc_id, similarity, rank of the k nearest unit vectors of each query, ties by doc_id; similarities to `places`. vectors: doc_id, v; queries: query_id, v, a stated set.

    Arrow batches against a block of queries by matrix product; each task keeps k a query over all its batches. Queries are broadcast in blocks of 16 * QUERY_BLOCK.
    """
    spark = vectors.sparkSession
    parts = max(1, -(-queries.count() // (16 * QUERY_BLOCK)))
    out = None
    for i in range(parts):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).select("query_id", "v").collect()
        shared = spark.sparkContext.broadcast([(r["query_id"], r["v"]) for r in block])

        def run(batches, shared=shared):
            import numpy as np
            import pyarrow as pa

            ids = [q for q, _ in shared.value]
            if not ids:
                return
            table, best = np.array([v for _, v in shared.value], np.float64), Best(len(ids), k)
            for batch in (x.slice(j, DOC_BLOCK) for x in batches for j in range(0, x.num_rows, DOC_BLOCK)):
                m = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                best.add(np.round(m @ table.T, places), batch.column(0).to_numpy(zero_copy_only=False))
            query, doc, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in query.tolist()]), pa.array(doc), pa.array(score)], ["query_id", "doc_id", "similarity"])

        near = vectors.select("doc_id", "v").mapInArrow(run, "query_id long, doc_id long, similarity double")
        out = near if out is None else out.union(near)
    return top_k(out, "query_id", [F.desc("similarity"), F.asc("doc_id")], k)


def fuse(sparse: DataFrame, dense: DataFrame, k: int, c: int = 60) -> DataFrame:
    """query_id, doc_id, score, rank: reciprocal-rank fusion of two ranked lists by a full outer join (JOIN-11, TOP-5)."""
    s = sparse.select("query_id", "doc_id", F.col("rank").alias("sparse_rank"))
    d = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"))
    both = s.join(d, ["query_id", "doc_id"], "full_outer").withColumn("score", F.round(rrf([F.col("sparse_rank"), F.col("dense_rank")], c), 10))
    return top_k(both, "query_id", [F.desc("score"), F.asc("doc_id")], k)


def floored(rows: DataFrame, floor: float, least: int, k: int) -> DataFrame:
    """Of each query those scoring at least floor times its best; filled up to `least` in rank order; then k (TOP-8)."""
    w = Window.partitionBy("query_id")
    marked = rows.withColumn("good", F.col("score") >= floor * F.max("score").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), F.asc("doc_id"))))
    return marked.where((F.col("good") | (F.col("rank") <= least)) & (F.col("rank") <= k)).select("query_id", "doc_id", "score", "rank")


def mmr(rows: DataFrame, weight: float, k: int) -> DataFrame:
    """query_id, doc_id, place: greedy re-ranking by weight * relevance - (1 - weight) * likeness to what is chosen (TOP-9). rows: query_id, doc_id, score, v; a bounded candidate list a query."""

    def choose(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["score", "doc_id"], ascending=[False, True])
        s, v = pdf["score"].to_numpy(float), np.array(pdf["v"].tolist(), float)
        s = (s - s.min()) / (s.max() - s.min()) if s.max() > s.min() else np.ones(len(s))
        left, chosen, like = list(range(len(s))), [], np.zeros(len(s))
        while left and len(chosen) < k:
            best = max(left, key=lambda i: (round(weight * s[i] - (1 - weight) * (like[i] if chosen else 0.0), 12), -i))
            left.remove(best)
            like = np.maximum(like, v @ v[best]) if chosen else v @ v[best]
            chosen.append(best)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "doc_id": pdf["doc_id"].to_numpy()[chosen], "place": range(1, len(chosen) + 1)})

    return rows.groupBy("query_id").applyInPandas(choose, "query_id long, doc_id long, place int")


def token_windows(docs: DataFrame, tokens: Column, width: int, overlap: int) -> DataFrame:
    """doc_id, window, tokens: overlapping windows of a fixed number of tokens (WIN-14)."""
    rows = docs.select("doc_id", tokens.alias("t")).where(F.size("t") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("t") - 1 - overlap).cast("int"), F.lit(width - overlap))
    return rows.select("doc_id", "t", F.posexplode(starts).alias("window", "at")).select("doc_id", "window", F.slice("t", F.col("at") + 1, F.lit(width)).alias("tokens"))


def best_window(scored: DataFrame) -> DataFrame:
    """doc_id, window, score: the best-scoring window, the first of equals (WIN-15, 16)."""
    return scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("window")).alias("w"))).alias("b")).select("doc_id", (-F.col("b.w")).alias("window"), F.col("b.score").alias("score"))
