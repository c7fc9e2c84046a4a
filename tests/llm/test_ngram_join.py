"""The n-gram join against all pairs."""

import random

from lectern.llm import ngram_join as J
from lectern.llm.ngram_join import bands_and_rows, ngram_join, representatives


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, similarity=0.8):
    sets = [(i, grams(t)) for i, t in rows if i is not None]
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and both >= similarity * len(sets[a][1] | sets[b][1]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, least[find(k)], links[k]) for k, (i, _) in enumerate(sets))


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(60):  # one group of near copies, larger than a block below
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append(" ".join(w))
    rows += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 200))) for _ in range(40)]
    rows += [rows[0]] * 30 + ["", None, "  ", "one two", "One  TWO", "x " * 3000]
    return [(7 * i, t) for i, t in enumerate(rows)] + [(None, rows[0])]


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_links int").repartition(5)
    assert sorted(tuple(r) for r in ngram_join(df).collect()) == brute(rows)


def test_representatives(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([i for i, c, _ in brute(rows) if i == c])
    kept = [r.doc_id for r in representatives(df).collect()]
    assert sorted(i for i in kept if i is not None) == want and kept.count(None) == 1


def test_empty(spark):
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_banding():
    bands, rows = bands_and_rows(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


def test_one_row_of_a_group_is_kept(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, a), (5, b), (3, b + " more"), (3, c), (7, a + " more"), (8, c), (8, c), (9, ""), (None, a), (None, a)]
    got = representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(5, a), (3, b + " more"), (3, c), (9, ""), (None, a), (None, a)]))
