"""Containment search against sets of word runs."""

import random

from lectern.llm.decontamination import clean, contaminated


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def data():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(5, 60))) for i in range(30)] + [(90, None), (91, "too short"), (None, text(20)), (92, "a b c d e " * 9)]
    docs = []
    for i in range(60):
        item = (rng.choice(items[:30])[1]).split()
        cut = item[: max(5, int(len(item) * rng.choice([0.5, 0.8, 0.9, 1.0])))]
        docs.append((i, text(rng.randrange(400)) + "\n " + " ".join(cut).upper() + "\t" + text(rng.randrange(400))))
    return docs + [(70, None), (71, ""), (72, "a b c d e a b c d e"), (72, "a b c d e a b c d e"), (None, items[0][1]), (73, text(20000) + " " + items[3][1])], items


def test_equals_sets(spark):
    docs, items = data()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_item int").repartition(4)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, h int")
    want = set()
    for i, t in docs:
        for j, u in items:
            both, size = len(grams(t) & grams(u)), len(grams(u))
            if i is not None and j is not None and size and both >= 0.8 * size - 1e-9:
                want.add((i, j, both, size))
    assert {tuple(r)[:4] for r in contaminated(d, b).collect()} == want and want
    bad = {i for i, *_ in want}
    assert sorted(str(r.doc_id) for r in clean(d, b).collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_native_and_empty(spark):
    docs, items = data()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = contaminated(d, b)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert contaminated(d.limit(0), b).count() == 0 and contaminated(d, b.limit(0)).count() == 0


def test_items_of_few_words(spark):
    items = [(1, "Forty two"), (2, "answer"), (3, "to be or not"), (4, " "), (5, None), (6, "one two three four five"), (None, "answer")]
    docs = [(1, "the ANSWER is forty\ttwo"), (2, "forty and two"), (3, "answer"), (4, ""), (5, None), (6, "or not to be"), (7, "so to be or not"), (8, "one two three four five"), (8, "forty two forty two"), (None, "answer")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = contaminated(d, b)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 1, 1, 1.0), (1, 2, 1, 1, 1.0), (3, 2, 1, 1, 1.0), (7, 3, 1, 1, 1.0), (8, 1, 1, 1, 1.0), (8, 6, 1, 1, 1.0)]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
