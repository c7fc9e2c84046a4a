"""Ranked lexical search by scanning the documents with an Aho-Corasick automaton of all item terms.

The items are the small side: their terms, each between two guards, go into one automaton that every task builds for
itself. A document's bytes are lowered and every delimiter becomes the guard, so an automaton hit is a whole term and
nothing but a term; overlapping guards are found like any overlapping pattern. No index of the documents is made:
one scan counts documents, terms and document frequencies, a second one scores each document against the items its hits
map to and keeps the best rows of its task, and only those are shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 10
#: Bytes of item text whose automaton one scan carries; more items are dealt into groups with a scan each.
GROUP_BYTES = 4_000_000
#: Cells (documents x items) that are scored together, and characters of text.
CELLS, CHARS = 200_000, 2_000_000
#: Pieces in which the best rows of many tasks are ranked before the last ranking of an item.
MERGERS = 64

# ASCII letters and digits and every other non-ASCII character make a term; only A to Z are lowered.
GUARD = b" "
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def guarded(text: str) -> bytes:
    """Lowered UTF-8 bytes with every delimiter as a guard, and a guard at both ends."""
    return GUARD + text.encode("utf-8", "surrogatepass").translate(LOWERED) + GUARD


def terms(text: str) -> list[bytes]:
    return guarded(text).split()


@dataclass
class Items:
    """Items of one group: their ids, the sorted terms, and for each term the items that hold it and how often."""

    ids: list[int | None]
    words: list[bytes]
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int | None, str]]) -> Items:
        bags = [Counter(terms(text)) for _, text in rows]
        words = sorted(set().union(*bags))
        at = {w: i for i, w in enumerate(words)}
        links = sorted((at[w], i, n) for i, bag in enumerate(bags) for w, n in bag.items())
        term, item, times = (np.array(x, dtype=np.int64) for x in (zip(*links) if links else ((), (), ())))
        return Items([i for i, _ in rows], words, np.searchsorted(term, np.arange(len(words) + 1)), item, times)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(self.words):
            found.add_word((GUARD + w + GUARD).decode("latin-1"), i)
        found.make_automaton()
        return found


def _scan(items: Items, batches: Iterator[pd.DataFrame], documents: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of documents with their term numbers n, and one (document, term, tf) per distinct hit."""
    automaton = items.automaton()
    width = max(1, len(items.words))
    for batch in batches:
        i = 0
        while i < len(batch):
            j, size, n, hits = i, 0, [], []
            while j < len(batch) and j - i < documents and (j == i or size < CHARS):
                low = guarded(batch["text"].iat[j] or "")
                size += len(low)
                n.append(len(low.split()))
                if items.words:
                    found = np.fromiter((v for _, v in automaton.iter(low.decode("latin-1"))), np.int64)
                    hits.append(found + (j - i) * width)
                j += 1
            key, tf = np.unique(np.concatenate(hits) if hits else np.zeros(0, np.int64), return_counts=True)
            yield batch.iloc[i:j], np.array(n, dtype=np.int64), key // width, key % width, tf
            i = j


#: Rows of the counting scan that are not terms.
DOCUMENTS, TERMS = -1, -2


def _counts(items: Items) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, documents, total = np.zeros(len(items.words), dtype=np.int64), 0, 0
        for _, n, _, term, _ in _scan(items, batches, CELLS):
            df += np.bincount(term, minlength=len(df))
            documents, total = documents + int((n > 0).sum()), total + int(n.sum())
        seen = np.flatnonzero(df)
        yield pd.DataFrame({"term": [DOCUMENTS, TERMS, *seen.tolist()], "n": [documents, total, *df[seen].tolist()]})

    return run


def _best(items: Items, weight: np.ndarray, documents: int, total: int, top: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(items.ids)
        floor = np.ones(size, dtype=np.int64)  # the score a row needs to be among the best so far
        # item, score, no id, id of the best rows so far
        kept = np.zeros((4, 0), dtype=np.int64)
        for block, n, doc, term, tf in _scan(items, batches, max(1, CELLS // max(1, size))):
            m = np.array([25 + 75 * x * documents // max(1, total) for x in n.tolist()], dtype=np.int64)
            value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            fan = items.first[term + 1] - items.first[term]
            link = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan - items.first[term], fan)
            scores = np.zeros((len(block), size), dtype=np.int64)
            np.add.at(scores, (np.repeat(doc, fan), items.item[link]), np.repeat(value, fan) * items.times[link])
            row, item = np.nonzero(scores >= floor)
            if not len(row):
                continue
            missing = block["doc_id"].isna().to_numpy()
            ids = block["doc_id"].fillna(0).astype("int64").to_numpy()
            kept = np.concatenate([kept, np.stack([item, scores[row, item], missing[row], ids[row]])], axis=1)
            kept = kept[:, np.lexsort((kept[3], kept[2], -kept[1], kept[0]))]
            start = np.searchsorted(kept[0], np.arange(size))
            place = np.arange(kept.shape[1]) - start[kept[0]]
            kept, place = kept[:, place < top], place[place < top]
            full = place == top - 1
            floor[kept[0, full]] = np.maximum(1, kept[1, full])
        out = pd.DataFrame({"item": kept[0], "score": kept[1], "doc_id": pd.array(kept[3], dtype="Int64")})
        out.loc[kept[2] == 1, "doc_id"] = pd.NA
        out["item_id"] = pd.array([items.ids[i] for i in kept[0]], dtype="Int64")
        yield out

    return run


def _groups(benchmark: DataFrame) -> Iterator[Items]:
    """Distinct items in groups of about GROUP_BYTES, one on the driver at a time."""
    distinct = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = distinct.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    groups = max(1, math.ceil(size / GROUP_BYTES))
    for g in range(groups):
        part = distinct.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        rows = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            yield Items.of(rows)


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """The `top` best documents of every item: `item_id`, `rank`, `doc_id`, `score`; equal scores by ascending doc_id.

    Only `doc_id` and `text` of `docs`, `item_id` and `text` of `benchmark` are read, so other columns may have any name.
    A null or empty text has no terms: such a document counts nowhere and such an item returns no rows. Repeated documents are
    ranked each, a null doc_id after others of equal score; equal items are one item, and different texts under one item_id get
    a list each. An empty table of either kind gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for items in _groups(benchmark):
        counts = texts.select("text").mapInPandas(_counts(items), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        found = {r.term: r.n for r in counts.collect()}  # one row per item term at most
        documents, total = found.pop(DOCUMENTS, 0), found.pop(TERMS, 0)
        weight = np.array(
            [math.floor(1000 * math.log((2 * documents + 2) / (2 * found.get(i, 0) + 1))) for i in range(len(items.words))], dtype=np.int64
        )
        best = texts.mapInPandas(_best(items, weight, documents, total, top), "item int, score long, doc_id long, item_id long")
        # A task gives `top` rows per item, so an item with many tasks is ranked in pieces first.
        piece = F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGERS))
        first = best.withColumn("_place", F.row_number().over(Window.partitionBy("item", piece).orderBy(*order))).where(F.col("_place") <= top)
        last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        out = out.unionByName(last.select("item_id", "rank", "doc_id", "score"))
    return out


_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
corpus AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM docs),
wanted AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM docs)
       WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY term),
scored AS (
    SELECT item_id, r, doc_id,
           sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM tf JOIN weight USING (term) JOIN wanted USING (term), corpus GROUP BY item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
