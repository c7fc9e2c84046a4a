"""Toxic spans from a linear-chain conditional random field over tokens.

Every token has a state, clean or toxic. Its evidence are its word, prefixes and shape and the shapes of its two neighbours;
transition weights tie adjacent states, and a chain starts clean. Documents carry labels, tokens do not: all tokens of a clean
document are labelled clean, and a toxic document says that at least one of its tokens is toxic, which ones is hidden. The
likelihood of such a document is 1 - P(all clean), so training needs only the forward-backward marginals and P(all clean).
A document's score comes from its marginals by a logistic curve; tokens with a marginal of half or more are the spans.

With the potential of the clean state set to 1, both messages of a chain are one ratio per token and their updates are
fractional linear maps. Chains are cut into pieces, the maps of a piece are multiplied for all pieces at once, and a short
pass over pieces carries the ratios along, so that a text of millions of tokens takes no loop over its tokens.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.line_crf import held_out

#: Labelled documents of either label that the tagger is fitted on: the first by a hash of their id.
TRAIN_DOCUMENTS = 1500
#: A longer labelled text takes no part in fitting (it is scored whole), so that the driver's share is bounded.
TRAIN_CHARS = 20_000
THRESHOLD = 0.5
STEPS, RATE, PENALTY = 60, 0.15, 2e-6
#: Share of toxic labels that no token explains; training documents in which a feature must occur to count.
UNEXPLAINED, SUPPORT = 1e-4, 3
#: Hashed features of a token's own; the first SHAPES are shapes, which neighbours see too.
FEATURES, SHAPES = 1 << 17, 5
#: Tokens of a piece, characters looked at together, words whose evidence a Python worker keeps.
PIECE, CHUNK, CACHE_WORDS = 64, 1_000_000, 500_000

TOKEN = re.compile(r"\w+|[.!?\n]")


def features(word: str) -> list[int]:
    """Features of a token: its shape (stop, number, lower, capitalised, upper), then hashed word, prefixes and suffix."""
    low = word.lower()
    shape = 0 if not (word[0].isalnum() or word[0] == "_") else 1 if word.isdigit() else 2 if low == word else 4 if word.isupper() and len(word) > 1 else 3
    names = ["w " + low, "e " + low[-4:], *["p " + low[:n] for n in (4, 5, 7) if len(low) > n]]
    return [shape, *[SHAPES + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (FEATURES - SHAPES) for x in names]]


class Vocabulary:
    """Numbers of distinct tokens, their shapes, and their features in one array with starts."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.shapes: list[int] = []
        self.found: list[int] = []
        self.starts: list[int] = [0]

    def tokens(self, text: str) -> np.ndarray:
        words = TOKEN.findall(text)
        number = self.number
        for w in sorted(set(words).difference(number)):  # in one order, so that a fit does not depend on string hashes
            number[w] = len(number)
            mine = features(w)
            self.shapes.append(mine[0])
            self.found += mine
            self.starts.append(len(self.found))
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _grid(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of all chains: index of the token at (place, piece), -1 beyond the end; owner chain; number of the piece in its chain."""
    pieces = -(-count // PIECE)
    owner = np.repeat(np.arange(len(count)), pieces)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    place = np.arange(PIECE)[:, None]
    at = nth * PIECE + place
    return np.where(at < count[owner], (np.cumsum(count) - count)[owner] + at, -1), owner, nth


def _carried(maps: np.ndarray, nth: np.ndarray, first: float, backwards: bool) -> np.ndarray:
    """The ratio at the start (or end, if backwards) of every piece, given the product of maps of each piece."""
    out = np.full(len(nth), first)
    last = np.r_[nth[1:] == 0, True] if len(nth) else np.zeros(0, bool)
    left = np.zeros(len(nth), dtype=np.int64)  # pieces still to come in the chain
    stops = np.flatnonzero(last)
    left[:] = stops[np.searchsorted(stops, np.arange(len(nth)))] - np.arange(len(nth))
    rank = left if backwards else nth
    order = np.argsort(rank, kind="stable")
    bounds = np.searchsorted(rank[order], np.arange(1, (rank.max() + 2) if len(rank) else 1))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        now = order[lo:hi]
        before = now + 1 if backwards else now - 1
        m, r = maps[:, before], out[before]
        out[now] = (m[0] * r + m[1]) / (m[2] * r + m[3])
    return out


def marginals(odds: np.ndarray, count: np.ndarray, enter: float, leave: float, stay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of every token, log P(all clean) of every chain, and the expected pairs (enter, leave, stay) of every token with the one before.

    `odds` are the potentials of the toxic state, `enter`, `leave`, `stay` those of clean-toxic, toxic-clean and toxic-toxic.
    """
    at, _, nth = _grid(count)
    e = np.where(at >= 0, np.r_[odds, 1.0][at], 1.0)
    inside = at >= 0
    # forward: r' = e (enter + stay r) / (1 + leave r); backward: b = (leave + stay e b') / (1 + enter e b')
    size = e.shape[1]
    forward, backward = np.array([np.ones(size), np.zeros(size), np.zeros(size), np.ones(size)]), None
    backward = forward.copy()
    for t in range(PIECE):
        f, b, i = forward, backward, inside[t]
        step = np.array([e[t] * (stay * f[0] + enter * f[2]), e[t] * (stay * f[1] + enter * f[3]), leave * f[0] + f[2], leave * f[1] + f[3]])
        forward = np.where(i, step / (np.abs(step).sum(0) + 1e-300), f)
        s = PIECE - 1 - t
        i = inside[s]
        step = np.array([stay * e[s] * b[0] + leave * b[2], stay * e[s] * b[1] + leave * b[3], enter * e[s] * b[0] + b[2], enter * e[s] * b[1] + b[3]])
        backward = np.where(i, step / (np.abs(step).sum(0) + 1e-300), b)
    r, b = _carried(forward, nth, 0.0, False), _carried(backward, nth, 1.0, True)
    before, ahead = np.zeros_like(e), np.ones_like(e)
    for t in range(PIECE):
        before[t] = r
        r = np.where(inside[t], e[t] * (enter + stay * r) / (1 + leave * r), r)
        s = PIECE - 1 - t
        ahead[s] = b
        b = np.where(inside[s], (leave + stay * e[s] * b) / (1 + enter * e[s] * b), b)
    rows = at[inside]
    n = len(odds)
    flat_before, flat_ahead = np.zeros(n), np.zeros(n)
    flat_before[rows], flat_ahead[rows] = before[inside], ahead[inside]
    up = odds * flat_ahead
    pair = np.array([enter * up, leave * flat_before, stay * flat_before * up])
    pair /= 1 + pair.sum(0)
    owner = np.repeat(np.arange(len(count)), count)
    clean = -np.bincount(owner, np.log1p(enter * up), len(count))
    return pair[0] + pair[2], clean, pair


@dataclass
class Tagger:
    """Weights of a token's features and of the shapes before and after it, log transitions, and the curve of document scores."""

    weights: np.ndarray
    near: np.ndarray
    transitions: np.ndarray
    curve: np.ndarray
    words: Vocabulary = field(default_factory=Vocabulary)
    sums: np.ndarray = field(default_factory=lambda: np.zeros(0))
    shapes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def _forget(self) -> None:
        self.words, self.sums, self.shapes = Vocabulary(), np.zeros(0), np.zeros(0, dtype=np.int64)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": Vocabulary(), "sums": np.zeros(0), "shapes": np.zeros(0, dtype=np.int64)}

    def _learn(self) -> None:
        known, every = len(self.sums), len(self.words.number)
        if known < every:
            start = np.array(self.words.starts[known:-1]) - self.words.starts[known]
            new = np.add.reduceat(self.weights[self.words.found[self.words.starts[known] :]], start)
            self.sums = np.concatenate([self.sums, new])
            self.shapes = np.array(self.words.shapes)

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Score of every text, expected number of toxic tokens, and the marginals of its tokens."""
        if len(self.words.number) > CACHE_WORDS:
            self._forget()
        tokens = [self.words.tokens(t) for t in texts]
        self._learn()
        count = np.array([len(t) for t in tokens], dtype=np.int64)
        word = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        toxic, clean, _ = marginals(np.exp(_evidence(self.sums[word], self.shapes[word], self.near, count)), count, *np.exp(self.transitions))
        owner = np.repeat(np.arange(len(texts)), count)
        expected = np.bincount(owner, toxic, len(texts))
        score = 1 / (1 + np.exp(-_summary(clean, expected) @ self.curve))
        return score, expected, np.split(toxic, np.cumsum(count)[:-1]) if texts else []

    def spans(self, text: str, toxic: np.ndarray) -> list[tuple[int, int, float]]:
        """(start, end, mean marginal) of the runs of toxic tokens, as code point offsets."""
        out: list[tuple[int, int, list[float]]] = []
        linked = False
        for found, p in zip(TOKEN.finditer(text), toxic, strict=True):
            if p >= 0.5:
                if linked:
                    out[-1] = (out[-1][0], found.end(), [*out[-1][2], float(p)])
                else:
                    out.append((found.start(), found.end(), [float(p)]))
            linked = p >= 0.5
        return [(a, b, sum(p) / len(p)) for a, b, p in out]


def _evidence(own: np.ndarray, shape: np.ndarray, near: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Log potential of the toxic state: the token's own sum and the shapes of its neighbours; kept within what exp can hold."""
    if not len(own):
        return np.zeros(0)
    ends = np.cumsum(count)[count > 0]
    left, right = np.r_[0.0, near[0, shape[:-1]]], np.r_[near[1, shape[1:]], 0.0]
    left[np.r_[0, ends[:-1]]], right[ends - 1] = 0, 0
    return np.clip(own + left + right, -60, 60)


def _summary(clean: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """What a document's score looks at: constant, log odds of any toxic token, log of their expected number."""
    logit = np.log(-np.expm1(np.minimum(clean, -1e-12))) - clean
    return np.column_stack([np.ones(len(clean)), np.clip(logit, -20, 20), np.log(expected + 0.01)])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge."""
    theta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        gradient = x.T @ (weight * (y - p)) - 1e-1 * theta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(len(theta)), gradient)
        theta = theta + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return theta


def fit_tagger(texts: list[str], labels: list[int], weights: list[float] | None = None) -> Tagger:
    """Maximum likelihood of the document labels with hidden tokens, by Adam over the whole sample.

    `weights` are the documents each stands for. With one kind of label only, every score is the share of that label.
    """
    y, weight = np.array(labels, dtype=float), np.array(weights if weights is not None else np.ones(len(labels)), dtype=float)
    model = Tagger(np.zeros(FEATURES), np.zeros((2, SHAPES)), np.array([-4.0, 0.0, 0.0]), np.zeros(3))
    if len(set(labels)) < 2:
        share = (weight @ y + 1) / (weight.sum() + 2)
        model.curve[0] = np.log(share / (1 - share))
        return model
    words = Vocabulary()
    tokens = [words.tokens(t) for t in texts]
    count = np.array([len(t) for t in tokens], dtype=np.int64)
    word = np.concatenate(tokens)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), count)
    shape, vocabulary = np.array(words.shapes), len(words.shapes)
    found, starts = np.array(words.found), np.array(words.starts)
    fan = np.diff(starts)
    support = np.zeros(FEATURES, dtype=np.int64)
    for part in tokens:
        mine = np.unique(part)
        of = np.repeat(starts[mine] - np.r_[0, np.cumsum(fan[mine])[:-1]], fan[mine]) if len(mine) else mine
        support[np.unique(found[np.arange(len(of)) + of])] += 1
    keep = np.flatnonzero(support >= SUPPORT)
    place = np.full(FEATURES, -1)
    place[keep] = np.arange(len(keep))
    used = place[found] >= 0
    feature, of_word, width = place[found][used], np.repeat(np.arange(vocabulary), fan)[used], len(keep)
    follows = np.ones(len(word), dtype=bool)
    follows[(np.cumsum(count) - count)[count > 0]] = False
    follows = np.flatnonzero(follows)
    kind = shape[word]
    start = np.r_[np.zeros(width + 2 * SHAPES), model.transitions]
    theta, m, v = start.copy(), np.zeros(len(start)), np.zeros(len(start))

    def run() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.bincount(of_word, theta[feature], vocabulary)[word]
        near = theta[width : width + 2 * SHAPES].reshape(2, SHAPES)
        return marginals(np.exp(_evidence(own, kind, near, count)), count, *np.exp(theta[-3:]))

    for step in range(1, STEPS + 1):
        toxic, clean, pairs = run()
        # The gradient of a log likelihood is a multiple of the expected features: -1 for a clean document's label.
        explained = UNEXPLAINED - (1 - UNEXPLAINED) * np.expm1(clean)
        factor = np.where(y > 0, (1 - UNEXPLAINED) * np.exp(clean) / explained, -1.0)[owner]
        pull = factor * toxic
        gradient = np.concatenate([
            np.bincount(feature, np.bincount(word, pull, vocabulary)[of_word], width),
            np.bincount(kind[follows - 1], pull[follows], SHAPES), np.bincount(kind[follows], pull[follows - 1], SHAPES),
            (factor * pairs).sum(1),
        ])
        gradient = gradient / len(texts) - PENALTY * (theta - start)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    toxic, clean, _ = run()
    model.weights[keep], model.near, model.transitions = theta[:width], theta[width : width + 2 * SHAPES].reshape(2, SHAPES), theta[-3:]
    model.curve = _logistic(_summary(clean, np.bincount(owner, toxic, len(texts))), y, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, documents: int = TRAIN_DOCUMENTS) -> Tagger:
    """Fit on a bounded sample of each label, never on held-out documents.

    A document with several labels counts as toxic if any says so; of several texts under one doc_id the smallest is taken.
    """
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    )
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows at most
    part = lambda label: known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    chosen = part(0).unionByName(part(1))
    sample = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text").between(1, TRAIN_CHARS))
        .join(F.broadcast(chosen), "doc_id")  # at most two times `documents` rows
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").select("text", "toxic").toPandas()
    )
    share = {label: sizes[label] / min(sizes[label], documents) for label in sizes}
    return fit_tagger(sample["text"].tolist(), sample["toxic"].tolist(), [share[x] for x in sample["toxic"]])


RESULT = "score double, spans array<struct<start:int,end:int,score:double>>"


def tag(docs: DataFrame, model: Tagger, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `held_out`, `score`, `predicted` and `spans` (these replace columns of that name).

    Spans are the offsets of toxic tokens in code points, whatever the document's score is. A null or empty text, or one without
    tokens, has no spans and the score of a document without evidence; a null doc_id is not held out; repeated rows are scored
    each; an empty table gives no rows.
    """

    @F.pandas_udf(RESULT)
    def tagged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch]
            scores, spans, i = [], [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
                    size += len(texts[j])
                    j += 1
                score, _, toxic = model.documents(texts[i:j])
                scores.append(score)
                for text, p in zip(texts[i:j], toxic, strict=True):
                    spans.append([{"start": a, "end": b, "score": s} for a, b, s in model.spans(text, p)] if (p >= 0.5).any() else [])
                i = j
            yield pd.DataFrame({"score": np.concatenate(scores) if scores else np.zeros(0), "spans": spans})

    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted", "spans")]
    done = docs.select(*[F.col(f"`{c}`") for c in names], held_out().alias("held_out"), tagged("text").alias("_tagged"))
    return done.select(
        *[F.col(f"`{c}`") for c in names], "held_out", F.col("_tagged.score").alias("score"),
        (F.col("_tagged.score") >= threshold).cast("int").alias("predicted"), F.col("_tagged.spans").alias("spans"),
    )
