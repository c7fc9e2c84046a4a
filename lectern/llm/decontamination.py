"""Benchmark items inside documents, by size-partitioned MinHash sketches and exact shingle containment.

A short item inside a long document has a tiny Jaccard similarity, so a fixed MinHash sketch of the document would
miss it. Items are therefore partitioned by their number of shingles (powers of two), and each class has its own
sketch length: the k smallest shingles under a seeded hash, where k is one more than the number of shingles that
an item of the class may lack. A document that contains the wanted share of an item has at least one of these k, so
no item is missed. A document's own MinHash sketch for the same recall would be longer than the document, so that side keeps
its whole shingle set.
Candidates are verified on the whole shingle sets. All steps are DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.tables import small
from lectern.session import cut_lineage

WORDS = 5
CONTAINMENT = 0.8
SEED = 20_257
BLANKS = " \t\n\r\f\v"


def words(text: Column) -> Column:
    return F.split(F.btrim(F.lower(text), F.lit(BLANKS)), r"[ \t\n\r\f\x0b]+")


def _runs(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(n)]))


def shingles(df: DataFrame, key: str, n: int = WORDS, short: Sequence[int] = ()) -> DataFrame:
    """`key` and `h`, one row per run of `n` words of `text`, with repetition, and per run of each length in `short`; none for null and for shorter texts.

    Words become a column of their own first: inside the lambda they would be split again for every run. The outer
    explode keeps the optimizer from computing the hashes once more for a filter on their number.
    """
    split = df.where(F.col(key).isNotNull()).select(key, words(F.col("text")).alias("w"))
    runs = [F.when(F.size("w") >= m, _runs(m)) for m in (n, *short)]
    if short:
        runs = [F.concat(*[F.coalesce(r, F.array().cast("array<bigint>")) for r in runs])]
    hashed = split.select(key, runs[0].alias("hs"))
    return hashed.select(key, F.explode_outer("hs").alias("h")).where("h is not null")


def short_items(items: DataFrame, n: int) -> DataFrame:
    """`item_id`, `m` and `h` of items of m words, fewer than `n`: the whole item is its one shingle."""
    split = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where((F.size("w") < n) & (F.get("w", F.lit(0)) != ""))
    whole = F.coalesce(*[F.when(F.size("w") == m, F.xxhash64(*[F.get("w", F.lit(k)) for k in range(m)])) for m in range(1, n)], F.lit(None).cast("bigint"))
    return split.select("item_id", F.size("w").alias("m"), whole.alias("h"))


def size_class(n: Column) -> Column:
    """The largest power of two that is not above the size."""
    return F.pow(F.lit(2), F.floor(F.log2(n))).cast("long")


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, n: int = WORDS) -> DataFrame:
    """Pairs of a document and an item of which it holds the share `containment` or more.

    Input: `doc_id`, `text` and `item_id`, `text`; other columns are ignored. Result: `doc_id`, `item_id`, `n_shared`, `n_item` and
    `containment`. Shingles are sets over whole texts in lower case, so order and repetition of passages play no part; rows
    with the same id count as one text. An item of m < `n` words has one shingle of m words and is looked for among the documents' runs
    of m words. Rows with a null id, null texts and texts without words take no part; empty tables give no rows.
    """
    whole = short_items(items, n)
    short = sorted(r.m for r in whole.select("m").distinct().collect())  # lengths below n
    item_rows = shingles(items, "item_id", n).union(whole.select("item_id", "h")).distinct()
    sized = item_rows.withColumns({
        "n_item": F.count("*").over(Window.partitionBy("item_id")),
        "rank": F.row_number().over(Window.partitionBy("item_id").orderBy(F.xxhash64("h", F.lit(SEED)), "h")),
    })
    class_top = 2 * size_class(F.col("n_item")) - 1
    sketch_length = F.floor((1 - containment) * class_top + 1e-9) + 1
    item_table = cut_lineage(sized.select("item_id", "h", "n_item", (F.col("rank") <= sketch_length).alias("in_sketch")))

    sketches = small(item_table.where("in_sketch").select("item_id", "h"))
    candidates = cut_lineage(shingles(docs, "doc_id", n, short).join(sketches, "h").select("doc_id", "item_id").distinct())

    ids = small(candidates.select("doc_id").distinct())
    rows = shingles(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), "doc_id", n, short)
    shared = (
        rows.join(small(item_table.select("item_id", "h", "n_item")), "h").distinct()
        .groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.max("n_item").alias("n_item"))
    )
    return (
        shared.join(candidates, ["doc_id", "item_id"], "left_semi").where(F.col("n_shared") >= containment * F.col("n_item") - 1e-9)
        .select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )


def clean(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """`docs` without the documents that hold an item; rows with a null doc_id stay."""
    found = contaminated(docs, items, containment).select("doc_id").distinct()
    return docs.join(small(cut_lineage(found)), "doc_id", "left_anti").select(*[docs[c] for c in docs.columns])


ORACLE = f"""
WITH doc AS (
  SELECT doc_id AS id, string_split_regex(trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)), '[ \\t\\n\\r\\f\\v]+') AS w
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), item AS (
  SELECT item_id AS id, string_split_regex(trim(lower(text), ' ' || chr(9) || chr(10) || chr(13)), '[ \\t\\n\\r\\f\\v]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), doc_shingle AS (
  SELECT DISTINCT id, array_to_string(w[i : i + {WORDS - 1}], ' ') AS s
  FROM (SELECT id, w, unnest(generate_series(1, len(w) - {WORDS - 1})) AS i FROM doc)
), item_shingle AS (
  SELECT DISTINCT id, array_to_string(w[i : i + {WORDS - 1}], ' ') AS s
  FROM (SELECT id, w, unnest(generate_series(1, len(w) - {WORDS - 1})) AS i FROM item)
), size AS (SELECT id, count(*) AS n_item FROM item_shingle GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM doc_shingle d JOIN item_shingle i USING (s) JOIN size z ON z.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= {CONTAINMENT} * any_value(n_item) - 1e-9
"""
