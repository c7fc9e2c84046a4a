"""Token counts against a segmentation of every word by itself."""

import math

from lectern.llm.token_counts import MARK, Unigram, token_counts

WORDS = ["the", "then", "thenceforth", "ab", "abc", "abcabc", "Straße", "日本", "😀x", "x" * 300, "then"]


def alone(model, word):
    path = MARK + word
    best = [(0.0, 0)]
    for d in range(1, len(path) + 1):
        options = [(best[i][0] + model.score[path[i:d]], -(-best[i][1] - 1)) for i in range(d) if path[i:d] in model.score]
        options = options or [(best[d - 1][0] + model.byte * len(path[d - 1].encode()), best[d - 1][1] + len(path[d - 1].encode()))]
        best.append(min(options, key=lambda x: (-x[0], x[1])))
    return best[-1][1]


def test_shared_equals_alone():
    model = Unigram("piece_bpe_32k.model")
    assert model.counts(WORDS) == {w: alone(model, w) for w in WORDS}
    assert all(math.isfinite(s) for s in model.score.values())


def test_token_counts(spark):
    model = Unigram("piece_bpe_32k.model")
    texts = ["the then  thenceforth", "", None, " \n", "abc " * 5000, "abc", "abc"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "ab", 1)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts(df).collect()}
    assert got == {i: (len((t or "").split()), sum(alone(model, w) for w in (t or "").split())) for i, t in enumerate(texts)} | {None: (1, alone(model, "ab"))}
    assert token_counts(df.limit(0)).count() == 0
