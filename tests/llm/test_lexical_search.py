"""Ranked search against a plain computation of the same scores."""

import math
import re
from collections import Counter

from lectern.llm import lexical_search
from lectern.llm.lexical_search import search

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = [
    (1, "The cat sat. the CAT, cats the-cat"), (2, "cat"), (3, "dog dog dog"), (4, ""), (5, None), (6, "Übung übung ÜBUNG cat_dog"),
    (7, "a b a b"), (8, "cat"), (8, "cat"), (None, "cat"), (9, "... --- \n"), (10, "日本語 cat " * 20_000), (11, "the of the of dog"),
]
ITEMS = [(1, "the cat"), (2, "dog dog dog cat"), (3, "übung a"), (4, None), (5, "nothing here"), (6, "..."), (7, "日本語"), (1, "the cat"), (8, "the of " * 3000)]


def words(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in PATTERN.findall(text or "")]


def plain(docs, items, top=10):
    bags = [(i, words(t)) for i, t in docs]
    bags = [(i, w, Counter(w)) for i, w in bags if w]
    n_docs, n_terms = len(bags), sum(len(w) for _, w, _ in bags)
    df = Counter(t for _, _, c in bags for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, w, c in bags:
            m = 25 + 75 * len(w) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def frames(spark, docs=DOCS, items=ITEMS):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score int, item string").repartition(3)
    return d, spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")


def test_equals_plain_scores(spark):
    assert found(search(*frames(spark))) == plain(DOCS, ITEMS)
    assert found(search(*frames(spark), top=2)) == plain(DOCS, ITEMS, 2)


def test_small_blocks_and_groups_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "GROUP_BYTES", 60)
    docs, items = frames(spark)
    assert found(search(docs, items)) == plain(DOCS, ITEMS)
    kept = {}
    for cells, chars in ((3, 10), (10**6, 10**7)):
        monkeypatch.setattr(lexical_search, "CELLS", cells)
        monkeypatch.setattr(lexical_search, "CHARS", chars)
        group = lexical_search.Items.of([(1, "the cat"), (2, "dog dog")])
        run = lexical_search._best(group, lexical_search.np.array([5, 7, 9]), 8, 40, 2)
        kept[cells] = [f.values.tolist() for f in run(iter([docs.toPandas()]))]
    assert kept[3] == kept[10**6]


def test_real_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(search(docs, items)) == want and len(want) > 100


def test_empty(spark):
    docs, items = frames(spark)
    assert search(docs.limit(0), items).count() == 0 and search(docs, items.limit(0)).count() == 0
    assert search(docs, items.where("item_id in (4, 5, 6)")).count() == 0
