"""Join of near-equal texts: word n-gram Jaccard similarity by MinHash banding, verified on the whole n-gram sets.

1. Each text becomes its set of word n-grams (64 bit hashes), a MinHash signature and one hash per band. Texts with equal
   sets form one class at once, so copies are never paired.
2. Band hashes are shuffled and those of one class only are dropped. A bucket of many classes is dealt to pairs of blocks of bounded size,
   so no task sees a whole bucket, and a pair is looked at only in the first band in which it collides.
3. Pairs are verified where the n-gram sets of both sides meet: a task holds a bounded number of sets. It returns the
   number of links of each class and one edge per class to the smallest class it is connected with there, never pairs.
4. Links are summed, and connected components of the edges give the group of near-equal texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tables import components, small
from lectern.session import cut_lineage

WORDS = 5
SIMILARITY = 0.8
#: Share of pairs at the threshold itself that at least one band has to bring together.
RECALL = 0.9999
MAX_HASHES = 128
SEED = 9
#: Classes in a block of a large bucket, and sets that a verifying task holds at least before it is closed.
BLOCK = 256
CHUNK_BYTES = 500_000

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1


def bands_and_rows(similarity: float, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """The most selective banding, within `most` hash functions, that finds a pair of this similarity with this probability."""
    for rows in range(most, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-min(similarity, 1 - 1e-12) ** rows))
        if bands * rows <= most:
            return bands, rows
    return most, 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Spans:
    """Hashes of spans of a byte string from one prefix sum of byte * BASE^position, modulo 2^64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n + 1:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                powers = np.full(n + 1, base & MASK, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data))
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


SPANS = Spans()


def _ngram_chunk(split: list[list[str]], n: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(w) for w in split], dtype=np.int64)
    data = np.frombuffer(" ".join([" ".join(w) for w in split if w]).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    stops = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.append(0, stops[:-1] + 1)
    grams = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    first = np.cumsum(counts) - counts
    inner = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
    begin = np.repeat(first, grams) + inner
    end = begin + np.repeat(np.minimum(counts, n), grams) - 1
    if not len(begin):
        return np.zeros(0, dtype=np.uint64), grams
    return SPANS.of(SPANS.prefix(data), starts[begin], stops[end]), grams


def ngrams(texts: list[str], n: int = WORDS) -> Iterator[np.ndarray]:
    """The n-gram hashes of each text in order, repeated ones included; a text of fewer words has one gram of all its words."""
    i = 0
    while i < len(texts):
        split, size = [], 0
        while i < len(texts) and (not split or size + len(texts[i]) <= CHUNK_BYTES):
            split.append(texts[i].lower().split())
            size += len(texts[i])
            i += 1
        hashes, grams = _ngram_chunk(split, n)
        yield from np.split(hashes, np.cumsum(grams)[:-1])


def minhash(hashes: list[np.ndarray], number: int) -> np.ndarray:
    """Signatures (one row per non-empty array) under `number` multiplicative hash functions."""
    flat = np.concatenate(hashes)
    at = np.cumsum([0, *[len(h) for h in hashes[:-1]]])
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, number, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(hashes), number), dtype=np.uint64)
    work = np.empty_like(flat)
    for j, a in enumerate(factors):
        np.multiply(flat, a, out=work)
        np.bitwise_xor(work, work >> np.uint64(29), out=work)
        np.multiply(work, a, out=work)
        out[:, j] = np.minimum.reduceat(work, at)
    return out


def set_id(grams: np.ndarray) -> int:
    """One number for a sorted set of n-grams; equal for equal sets."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sign(n: int, bands: int, rows: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def part(ids: list, sets: list[np.ndarray]) -> pd.DataFrame:
        hashes = np.zeros((len(sets), bands), dtype=np.uint64)
        full = [i for i, u in enumerate(sets) if len(u)]
        if full:
            signature = minhash([sets[i] for i in full], bands * rows).reshape(len(full), bands, rows)
            for r in range(rows):
                hashes[full] = mixed(hashes[full] * np.uint64(31) + signature[:, :, r])
        return pd.DataFrame({"doc_id": ids, "rep": [set_id(u) for u in sets], "n": [len(u) for u in sets], "bands": list(hashes.view(np.int64))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, sets, size = [], [], 0
            for doc, h in zip(batch["doc_id"], ngrams(batch["text"].tolist(), n), strict=True):
                ids.append(doc)
                sets.append(np.unique(h))
                size += len(h)
                if size > 500_000:
                    yield part(ids, sets)
                    ids, sets, size = [], [], 0
            if ids:
                yield part(ids, sets)

    return run


def _sets(n: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(h) for h in ngrams(batch["text"].tolist(), n)]
            yield pd.DataFrame({"rep": [set_id(u) for u in sets], "grams": [u.tobytes() for u in sets]})

    return run


def _new_pairs(band: int, side: np.ndarray, n: np.ndarray, bands: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of a bucket's block pair that did not collide in an earlier band and whose sizes allow the similarity."""
    if side[0] == side[-1]:
        i, j = np.triu_indices(len(n), 1)
    else:
        i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(side == side[0]), np.flatnonzero(side != side[0]), indexing="ij"))
    fits = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
    i, j = i[fits], j[fits]
    for b in range(band):
        new = bands[i, b] != bands[j, b]
        i, j = i[new], j[new]
    return i, j


GROUP = ["band", "key", "lo", "hi"]


def _tasks(similarity: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sorted bucket rows to verifying tasks: rows (task, class, its partners in the task)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_task: dict[int, set[int]] = {}
        number, worker, kept = 0, 0, None

        def close() -> pd.DataFrame:
            rows = [(worker << 32 | number, rep, list(partners)) for rep, partners in open_task.items()]
            return pd.DataFrame(rows, columns=["task", "rep", "partners"])

        for batch in batches:
            worker = int(batch["worker"].iloc[0]) if len(batch) else worker
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            ids = rows[GROUP].to_numpy()
            cuts = np.append(0, np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1)
            kept = rows.iloc[cuts[-1] :]
            for part in _groups(rows, cuts, similarity, open_task):
                if part:
                    yield close()
                    open_task, number = {}, number + 1
                    part.append(open_task)
        if kept is not None and len(kept):
            for part in _groups(kept.reset_index(drop=True), np.array([0, len(kept)]), similarity, open_task):
                if part:
                    yield close()
                    open_task, number = {}, number + 1
                    part.append(open_task)
        if open_task:
            yield close()

    return run


def _groups(rows: pd.DataFrame, cuts: np.ndarray, similarity: float, task: dict[int, set[int]]) -> Iterator[list]:
    """Add the new pairs of each group to `task`; a full one is handed over and the caller appends the next."""
    reps, n, side, band = (rows[c].to_numpy() for c in ("rep", "n", "side", "band"))
    bands = np.stack(rows["bands"].to_numpy()) if len(rows) else np.zeros((0, 0))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a < 2:
            continue
        i, j = _new_pairs(int(band[a]), side[a:b], n[a:b], bands[a:b], similarity)
        for x, y in zip(reps[a + i].tolist(), reps[a + j].tolist(), strict=True):
            task.setdefault(x, set()).add(y)
            task.setdefault(y, set())
        if len(task) >= BLOCK:
            full = [True]
            yield full
            task = full[-1]


def _verify(similarity: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(task: pd.DataFrame) -> pd.DataFrame:
        reps = task["rep"].to_numpy()
        place = {r: i for i, r in enumerate(reps.tolist())}
        sets = [np.frombuffer(g, dtype=np.uint64) for g in task["grams"]]
        weight = task["n_docs"].to_numpy()
        links, root = np.zeros(len(reps), dtype=np.int64), list(range(len(reps)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, partners in enumerate(task["partners"]):
            if not len(partners):
                continue
            js = [place[p] for p in partners]
            other = np.concatenate([sets[j] for j in js])
            at = np.cumsum([0, *[len(sets[j]) for j in js]])
            hit = sets[i][np.minimum(np.searchsorted(sets[i], other), len(sets[i]) - 1)] == other
            shared = np.add.reduceat(hit.astype(np.int64), at[:-1])
            for j, s in zip(js, shared.tolist(), strict=True):
                if s >= similarity * (len(sets[i]) + len(sets[j]) - s) - 1e-9:
                    links[i] += weight[j]
                    links[j] += weight[i]
                    root[find(i)] = find(j)
        least: dict[int, int] = {}
        for i, r in enumerate(reps.tolist()):
            least[find(i)] = min(r, least.get(find(i), r))
        return pd.DataFrame({"rep": reps, "n_links": links, "leader": [least[find(i)] for i in range(len(reps))]})

    return run


def ngram_join(docs: DataFrame, similarity: float = SIMILARITY, n: int = WORDS, recall: float = RECALL) -> DataFrame:
    """`doc_id`, `class_id` and `n_links` of every document.

    Two texts are linked if the Jaccard similarity of their sets of word n-grams (lower case, split at white space) is at least
    `similarity`; `n_links` counts the other documents a document is linked with, copies included; `class_id` is the
    smallest doc_id of the connected component. Null texts and texts without words have no links and are classes
    of their own; a text of fewer than n words has one gram. Rows with a null doc_id are left out; of rows with the same doc_id
    each counts as a document of that id. Other columns are ignored; an empty table gives no rows.
    """
    bands, rows = bands_and_rows(similarity, recall)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = cut_lineage(texts.mapInPandas(_sign(n, bands, rows), "doc_id long, rep long, n int, bands array<long>"))
    classes = cut_lineage(
        signed.where("n > 0").groupBy("rep").agg(
            F.min("doc_id").alias("smallest"), F.count("*").alias("n_docs"), F.first("n").alias("n"), F.first("bands").alias("bands")
        )
    )
    entry = classes.select("rep", F.posexplode("bands").alias("band", "hash"))
    buckets = entry.groupBy("band", "hash").agg(F.count("*").alias("m")).where("m > 1")
    members = entry.join(buckets, ["band", "hash"]).join(classes.select("rep", "n", "bands"), "rep")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = (
        members.withColumn("side", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "band", F.col("hash").alias("key"), F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"),
            "side", "rep", "n", "bands",
        )
        .repartition(*GROUP).sortWithinPartitions(*GROUP, "side", "rep").withColumn("worker", F.spark_partition_id())
    )
    tasks = cut_lineage(dealt.mapInPandas(_tasks(similarity), "task long, rep long, partners array<long>"))
    needed = classes.join(tasks.select("rep").distinct(), "rep").select(F.col("smallest").alias("doc_id"))
    grams = texts.join(small(needed), "doc_id", "left_semi").mapInPandas(_sets(n), "rep long, grams binary").dropDuplicates(["rep"])
    grams = grams.join(classes.select("rep", "n_docs"), "rep")
    verified = cut_lineage(
        tasks.join(grams, "rep").groupBy("task").applyInPandas(_verify(similarity), "rep long, n_links long, leader long")
    )
    links = verified.groupBy("rep").agg(F.sum("n_links").alias("links"))
    groups = components(verified.select(F.col("rep").alias("a"), F.col("leader").alias("b")))
    groups = classes.select("rep", "smallest", "n_docs").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    groups = cut_lineage(groups.withColumn("component", F.coalesce("component", "rep")))
    named = groups.groupBy("component").agg(F.min("smallest").alias("class_id"))
    found = groups.join(named, "component").join(links, "rep", "left")
    return signed.select("doc_id", "rep", "n").join(found, "rep", "left").select(
        "doc_id",
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("n") > 0, F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).otherwise(F.lit(0)).alias("n_links"),
    )


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of `docs` for each group of near-equal texts: of those with its smallest doc_id, the first as the table was read.

    Rows count by themselves, also those that repeat a doc_id. Rows with a null doc_id stay, and rows without words are groups of their own.
    """
    numbered = cut_lineage(docs.withColumn("__row", F.monotonically_increasing_id()))
    rows = numbered.where("doc_id is not null")
    classes = ngram_join(rows.select(F.col("__row").alias("doc_id"), "text"), similarity)
    named = classes.select(F.col("doc_id").alias("__of"), "class_id").join(rows.select("__row", F.col("doc_id").cast("long").alias("__id")), F.col("__of") == F.col("__row"))
    keep = named.groupBy("class_id").agg(F.min(F.struct("__id", "__row")).alias("first")).select(F.col("first.__row").alias("__kept"))
    kept = numbered.join(keep, F.col("__row") == F.col("__kept"), "left_semi")
    return kept.unionByName(numbered.where("doc_id is null")).drop("__row")
