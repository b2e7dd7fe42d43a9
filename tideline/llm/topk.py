"""Exact top-k by inner product: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Vectors of a part, queries of a block, and the longest vectors that fit the rotation and the first bounds.
PART, QUERIES, HEAD = 4096, 2048, 2048
#: Rotated coordinates summed before the first bound, and vectors judged at once.
LEAD, STEP = 16, 512
#: Bands of length.
BANDS = 64


def quantized(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as a double array; null for null vectors and those with a null or non-finite component."""
    ok = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")))


def _stack(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each q, larger scores and then smaller ids first."""
    order = np.lexsort((ids, -score, q))
    g = q[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    return order[np.arange(len(g)) - begin < k]


def scan(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, rotate: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vector place, score) of every pair that can be among a query's k best in x.

    floor: a score that k vectors elsewhere reach, by query, or -inf. x is taken by
    descending length. Where even |q||x| stays below the floor, all later vectors do. The
    first LEAD rotated coordinates plus the product of the remaining lengths bound a pair;
    pairs that stay above are scored exactly on the integers.
    """
    order = np.argsort(-np.einsum("ij,ij->i", x, x), kind="stable")
    lead = min(LEAD, x.shape[1])
    qr, qn = q @ rotate, np.sqrt(np.einsum("ij,ij->i", q, q))
    q_rest = np.sqrt(np.maximum(np.einsum("ij,ij->i", qr[:, lead:], qr[:, lead:]), 0))
    floor = floor.copy()
    top = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    live = np.arange(len(q))
    for at in range(0, len(order), STEP):
        some = order[at : at + STEP]
        part = x[some]
        xn = np.sqrt(np.einsum("ij,ij->i", part, part))
        live = live[qn[live] * xn[0] * (1 + 1e-9) + 1e-6 >= floor[live]]
        if not len(live):
            break
        rotated = part @ rotate
        x_rest = np.sqrt(np.maximum(np.einsum("ij,ij->i", rotated[:, lead:], rotated[:, lead:]), 0))
        bound = qr[live, :lead] @ rotated[:, :lead].T + q_rest[live][:, None] * x_rest[None, :]
        slack = 1e-9 * qn[live][:, None] * xn[None, :] + 1e-6
        may = (bound + slack >= floor[live][:, None]) & (qid[live][:, None] != ids[some][None, :])
        r, c = np.nonzero(may)
        if not len(r):
            continue
        if len(r) * 4 > may.size:
            score = (q[live] @ part.T)[r, c]  # integers below 2 ** 53: exact in any order
        else:
            score = np.concatenate([np.einsum("ij,ij->i", q[live[r[i : i + 65536]]], part[c[i : i + 65536]]) for i in range(0, len(r), 65536)])
        keep = score >= floor[live[r]]
        qs, xs, s = np.concatenate([top[0], live[r[keep]]]), np.concatenate([top[1], some[c[keep]]]), np.concatenate([top[2], score[keep]])
        best = _best(qs, s, ids[xs], k)
        top = qs[best], xs[best], s[best]
        # The floor rises where k vectors are known.
        count = np.bincount(top[0], minlength=len(q))
        least = np.full(len(q), np.inf)
        np.minimum.at(least, top[0], top[2])
        floor = np.where(count >= k, np.maximum(floor, least), floor)
    return top


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products over all rows but its own.

    Queries are the rows where is_query, a condition over the id under the name `id`, holds. Ties go to the smaller id.
    Rows with a null id, a null vector, or a null or non-finite component take no part. A
    shorter vector counts as filled with zeros. "Its own" are all rows of the query's id;
    rows that repeat a candidate count as often as they occur; repeated queries answer
    once. Fewer than k candidates: all of them. An empty table gives no rows, and other
    columns are ignored. Scores are exact while they stay below 2 ** 53.

    Candidates lie in bands of falling length. A query knows from the HEAD longest vectors a score that its k best
    reach, and so, by Cauchy-Schwarz, up to which band it has to look; only there do the two meet, queries in blocks
    and candidates in parts, QUERIES + PART vectors a task. A meeting
    returns k rows a query at most. Only HEAD vectors, and numbers by band, go to the driver and back.
    """
    spark, wanted = vectors.sparkSession, F.coalesce(is_query, F.lit(False))
    v = vectors.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col), scale).alias("v")).where("id is not null and v is not null")
    v = v.groupBy("id", "v").agg(F.count("*").alias("copies")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    head = v.orderBy(F.desc("norm"), "id").select("id", "v").limit(HEAD).collect()
    stats = v.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.percentile_approx("norm", [i / BANDS for i in range(1, BANDS)], 10 * BANDS).alias("cuts")).first()
    schema = "query_id long, vec_id long, score long, copies long"
    dims = max(stats["d"] or 1, 1)
    first = _stack([r["v"] for r in head], dims)
    _, _, right = np.linalg.svd(first, full_matrices=True) if len(first) else (None, None, np.eye(dims))
    known = spark.sparkContext.broadcast((np.array([r["id"] for r in head], np.int64), first, np.ascontiguousarray(right.T)))

    @F.pandas_udf("double")
    def floor(ids: pd.Series, vs: pd.Series) -> pd.Series:
        """The k-th best score among the longest vectors: what the k best overall reach at least."""
        hid, h, _ = known.value
        out = np.full(len(ids), -np.inf)
        for at in range(0, len(ids) if len(hid) else 0, STEP):
            i = ids.to_numpy()[at : at + STEP]
            s = np.where(hid[None, :] == i[:, None], -np.inf, _stack(vs.iloc[at : at + STEP], dims) @ h.T)
            if len(hid) >= k:
                out[at : at + STEP] = np.partition(s, len(hid) - k, axis=1)[:, len(hid) - k]
        return pd.Series(out)

    # Band 0 holds the longest vectors; equal lengths share a band, which is dealt into parts by hash.
    cuts = sorted(set(stats["cuts"] or []), reverse=True)
    band = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("norm"))) if cuts else F.lit(0)
    banded = v.withColumn("band", band)
    sizes = {r["band"]: r for r in banded.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}  # at most BANDS rows
    bands = max(sizes, default=-1) + 1
    counts = [-(-sizes[b]["n"] // PART) if b in sizes else 0 for b in range(bands)]
    ends, tops = np.cumsum([0, *counts]).tolist(), [sizes[b]["top"] if b in sizes else 0.0 for b in range(bands)]
    numbers = lambda values, kind: F.array(*map(F.lit, values)).cast(f"array<{kind}>")
    reach = F.size(F.filter(numbers(tops, "double"), lambda t: t * F.col("norm") * (1 + 1e-9) + 1e-6 >= F.col("floor")))
    queries = saved(v.where(wanted).select("id", "v", "norm", floor("id", "v").alias("floor")).withColumn("reach", reach).drop("norm"), "topk-queries")
    # Queries of like reach share blocks, the furthest first, so a band meets the first so many blocks.
    level = F.floor(F.log2(F.lit(max(bands, 1)) / F.greatest("reach", F.lit(1)))).cast("int")
    need = sorted((-r["far"], r["level"], r["n"]) for r in queries.groupBy(level.alias("level")).agg(F.max("reach").alias("far"), F.count("*").alias("n")).collect())
    blocks, begin = {lv: -(-n // QUERIES) for _, lv, n in need}, {}
    for _, lv, _ in need:
        begin[lv] = sum(blocks[x] for x in begin)
    upto = [sum(blocks[lv] for far, lv, _ in need if -far > b) for b in range(bands)]
    pick = lambda table: F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])[level] if table else F.lit(0)
    block = pick(begin) + F.pmod(F.xxhash64(F.lit(6), "id", "v"), pick(blocks).cast("long")).cast("int")
    to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    asked = queries.withColumn("b", block).withColumn("p", F.explode(to(F.get(numbers(ends, "int"), F.col("reach"))))).drop("reach")
    part = F.get(numbers(ends, "int"), F.col("band")) + F.pmod(F.xxhash64("id", "v"), F.get(numbers(counts, "long"), F.col("band"))).cast("int")
    sides = banded.select("id", "v", "copies", part.alias("p"), F.explode(to(F.get(numbers(upto, "int"), F.col("band")))).alias("b"))
    queries = asked

    def meet(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score", "copies")})
        qid, ids, copies = q["id"].to_numpy(), x["id"].to_numpy(), x["copies"].to_numpy()
        a, b, s = scan(qid, _stack(q["v"].tolist(), dims), q["floor"].to_numpy(), ids, _stack(x["v"].tolist(), dims), known.value[2], k)
        return pd.DataFrame({"query_id": qid[a], "vec_id": ids[b], "score": s.astype(np.int64), "copies": copies[b]})

    found = sides.groupBy("p", "b").cogroup(queries.groupBy("p", "b")).applyInPandas(meet, schema)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k)
    each = best.withColumn("_c", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    again = Window.partitionBy("query_id").orderBy("r", "_c")
    return each.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

