"""Nearest neighbours by an inverted multi-index.

Each vector is split into two halves, and each half is quantised with its own codebook; a pair of codewords is a cell. For a
query, cells are visited in order of the summed squared distances of the two halves to their codewords: a heap holds the frontier
of the pairs of two sorted lists. The traversal stops when the cells hold enough entries, whose distances are then
computed on the original vectors.

Equal vectors are one entry, which keeps the smallest ids only, as many as a result can need. A cell is dealt to chunks of a
bounded size. Codebooks and the number of entries per cell have at most MAX_CODEWORDS rows and MAX_CODEWORDS^2 numbers, and
only they reach the driver and all executors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut_lineage

NEIGHBOURS = 10
QUERY_STEP = 100
#: Vectors that the codebooks are fitted on: the first by a hash of their components.
SAMPLE = 20_000
#: Codewords of each half, if there are as many entries as cells.
MAX_CODEWORDS = 32
#: Share of all entries, and number of entries, that the visited cells hold at least; measured recall is in the README.
SHARE = 0.5
LEAST = 500
#: Entries of a cell that stay together, and about as many as one task compares with its queries.
CHUNK = 4096
ROUNDS = 12


def codewords(entries: int) -> int:
    return max(1, min(MAX_CODEWORDS, round(math.sqrt(entries))))


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's algorithm from k-means++ seeds; a codeword that loses all its vectors moves to the worst served one."""
    rng = np.random.default_rng(7)
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(1)
    for _ in range(1, k):
        centres.append(x[rng.choice(len(x), p=near / near.sum())] if near.sum() > 0 else x[rng.integers(len(x))])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    centres = np.array(centres)
    for _ in range(ROUNDS):
        owner, cost = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        size = np.bincount(owner, minlength=k)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        for empty in np.flatnonzero(size == 0):
            worst = int(cost.argmax())
            centres[empty], cost[worst] = x[worst], 0
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distance = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
    owner = distance.argmin(1)
    return owner, distance[np.arange(len(x)), owner]


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Numbers of the cells in order of summed distance until they hold `wanted` entries; cells without entries are passed over."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    u, v = first[a].tolist(), second[b].tolist()
    rows = counts[a][:, b]
    out, found, k = [], 0, len(v)
    heap = [(u[0] + v[0], 0, 0)]
    while heap and found < wanted:
        _, i, j = heapq.heappop(heap)
        if rows[i, j]:
            out.append(int(a[i]) * k + int(b[j]))
            found += int(rows[i, j])
        # (i, j + 1) follows (i, j); (i + 1, 0) follows (i, 0): every pair enters the heap once, after a nearer one.
        if j + 1 < k:
            heapq.heappush(heap, (u[i] + v[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(u):
            heapq.heappush(heap, (u[i + 1] + v[0], i + 1, 0))
    return out


def _assign(books: tuple[np.ndarray, np.ndarray]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["vector"].to_numpy()).astype(float)
                half = books[0].shape[1]
                yield batch.assign(cell=nearest(x[:, :half], books[0])[0] * len(books[1]) + nearest(x[:, half:], books[1])[0])

    return run


def shard_of(cell, part, shards: int):
    """Where a part of a cell lies; the same formula on numbers and on columns."""
    return (cell * 7919 + part * 104_729) % shards


def _route(books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, wanted: int, shards: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each query to the shards that hold the parts of its cells, with the cells to look at there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = books[0].shape[1]
        flat = counts.ravel()
        for batch in batches:
            for query, vector in zip(batch["query_id"], batch["vector"], strict=True):
                x = np.asarray(vector, dtype=float)
                looks: dict[int, list[int]] = {}
                for c in traverse(((books[0] - x[:half]) ** 2).sum(1), ((books[1] - x[half:]) ** 2).sum(1), counts, wanted):
                    for p in range(-(-int(flat[c]) // CHUNK)):
                        looks.setdefault(shard_of(c, p, shards), []).append(c)
                yield pd.DataFrame({"query_id": query, "shard": list(looks), "cells": list(looks.values()), "query": [vector] * len(looks)})

    return run


def _rerank(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(entries) and len(queries):
            x = np.stack(entries["vector"].to_numpy()).astype(float)
            size = np.array([len(i) for i in entries["ids"]])
            all_ids = np.concatenate(entries["ids"].to_numpy())
            all_cells, owner = entries["cell"].to_numpy(), np.repeat(np.arange(len(size)), size)
            for query, cells, vector in zip(queries["query_id"], queries["cells"], queries["query"], strict=True):
                seen = np.isin(all_cells, cells)
                score = np.full(len(x), np.inf)
                score[seen] = np.sqrt(((x[seen] - np.asarray(vector, dtype=float)) ** 2).sum(1))
                fits = seen[owner] & (all_ids != query)
                i, s = all_ids[fits], score[owner[fits]]
                if len(i) > k:  # all that tie with the k-th stay until the ids decide
                    near = s <= np.partition(s, k - 1)[k - 1]
                    i, s = i[near], s[near]
                best = np.lexsort((i, s))[:k]
                out.append((np.full(len(best), query), i[best], s[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """`vec_id` and `vector` of the rows that take part: finite components, not all zero, of the most frequent dimension."""
    wide = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    fine = wide.where(
        F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("vector", lambda c: c != 0)
    )
    sizes = fine.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return fine.where(F.size("vector") == (sizes["d"] if sizes else 0))


def neighbours(vectors: DataFrame, step: int = QUERY_STEP, k: int = NEIGHBOURS, share: float = SHARE) -> DataFrame:
    """The `k` nearest rows found for every row whose vec_id is divisible by `step`: `query_id`, `rank`, `vec_id`, `score`.

    Candidates are all rows but those with the query's own id; the score is the Euclidean distance in double precision, ties go to the
    smaller id, and a query with fewer candidates gets them all. Rows with a null id, and vectors that are null, zero, of
    another dimension, or hold a null or non-finite component take no part. A repeated vec_id with another vector is a candidate
    with each; as a query, it is one query with the smallest of its vectors. Other columns are ignored; an empty table gives no rows.
    """
    rows = cut_lineage(usable(vectors))
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    first = Window.partitionBy("vector").orderBy("vec_id")
    kept = rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    entries = cut_lineage(kept.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    total = entries.count()
    if not total:
        return spark.createDataFrame([], schema)
    sample = np.array([r.vector for r in entries.orderBy(F.xxhash64("vector")).limit(SAMPLE).select("vector").collect()], dtype=float)
    half, size = sample.shape[1] // 2, codewords(total)
    books = codebook(sample[:, :half], size), codebook(sample[:, half:], size)
    kind = rows.schema["vector"].dataType.simpleString()
    indexed = cut_lineage(entries.mapInPandas(_assign(books), f"vector {kind}, ids array<long>, cell long"))
    counts = np.zeros(size * size, dtype=np.int64)
    for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    parts = F.ceil(F.get(F.lit(counts.tolist()), F.col("cell").cast("int")) / CHUNK)
    shards = max(8, total // CHUNK)
    dealt = indexed.withColumn("part", F.pmod(F.xxhash64("vector"), parts)).withColumn("shard", shard_of(F.col("cell"), F.col("part"), shards).cast("int"))
    wanted = max(k + 1, LEAST, math.ceil(share * total))
    asked = rows.where(F.col("vec_id") % step == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    routed = asked.mapInPandas(
        _route(books, counts.reshape(size, size), wanted, shards), f"query_id long, shard int, cells array<long>, query {kind}"
    )
    found = routed.groupBy("shard").cogroup(dealt.select("shard", "cell", "vector", "ids").groupBy("shard")).applyInPandas(
        _rerank(k), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
