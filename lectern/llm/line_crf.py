"""Document quality from a linear-chain conditional random field over lines.

Every line gets a state, good or bad. A line's evidence are its own features and those of its neighbours, and
transition weights tie adjacent states. A document's score is the mean of its lines' forward-backward
marginals for good, weighted by line length. Lines have no labels of their own: in training each takes its document's.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents the classifier is fitted on: the first by a hash of their id.
TRAIN_DOCUMENTS = 4000
#: A longer labelled text takes no part in fitting (it is scored whole), so that the driver's share is bounded.
TRAIN_CHARS = 20_000
THRESHOLD = 0.3
STEPS, RATE, PENALTY = 200, 0.1, 1e-3
#: Characters looked at together.
CHUNK = 2_000_000

# The classes of characters that are counted.
UPPER, LOWER, OTHER_LETTER, DIGIT, SPACE, STOP, MARK, REST = range(8)
STOPS = ".,;:'\"?-()’“”«»¿¡"
OWN = ["length", "words", "word length", "upper", "lower", "other letters", "digits", "stops", "marks", "rest", "letters before stops",
       "distinct words", "seen in document", "same as previous", "first upper", "ends with stop"]


@cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, REST, dtype=np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))
        if kind == "Lu" or kind == "Lt":
            table[i] = UPPER
        elif kind == "Ll":
            table[i] = LOWER
        elif kind[0] == "L":
            table[i] = OTHER_LETTER
        elif kind[0] == "N":
            table[i] = DIGIT
        elif kind[0] == "Z" or chr(i).isspace():
            table[i] = SPACE
        elif chr(i) in STOPS:
            table[i] = STOP
        elif kind[0] in "PS":
            table[i] = MARK
    return table


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (neighbours included), their lengths, and the number of lines per text.

    An empty text has no lines; a text of n line ends has n + 1.
    """
    split = [t.split("\n") if t else [] for t in texts]
    count = np.array([len(x) for x in split], dtype=np.int64)
    lines = [line for x in split for line in x]
    if not lines:
        return np.zeros((0, 3 * len(OWN) + 3)), np.zeros(0), count
    length = np.array([len(line) for line in lines], dtype=np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = _classes()[codes]
    owner = np.repeat(np.arange(len(lines)), length)
    counts = np.bincount(owner * 8 + kinds, minlength=8 * len(lines)).reshape(-1, 8).astype(float)
    share = counts / np.maximum(length, 1)[:, None]
    words, distinct, seen, same = np.zeros(len(lines)), np.ones(len(lines)), np.zeros(len(lines)), np.zeros(len(lines))
    i = 0
    for own in split:
        times, previous = Counter(own), None
        for line in own:
            w = line.split()
            if w:
                words[i], distinct[i] = len(w), len(set(w)) / len(w)
            seen[i], same[i], previous = times[line] > 1, line == previous, line
            i += 1
    letters = counts[:, :3].sum(1)
    own = np.column_stack([
        np.log1p(length), np.log1p(words), np.log1p(letters / np.maximum(words, 1)),
        share[:, UPPER], share[:, LOWER], share[:, OTHER_LETTER], share[:, DIGIT], share[:, STOP], np.sqrt(share[:, MARK]), share[:, REST],
        letters / np.maximum(length, 1), distinct, seen, same,
        [line[:1].isupper() for line in lines], [line[-1:] in STOPS and line != "" for line in lines],
    ])
    first = np.zeros(len(lines), dtype=bool)
    stops = np.cumsum(count)
    first[(stops - count)[count > 0]] = True
    last = np.zeros(len(lines), dtype=bool)
    last[(stops - 1)[count > 0]] = True
    before = np.where(first[:, None], 0, np.roll(own, 1, axis=0))
    after = np.where(last[:, None], 0, np.roll(own, -1, axis=0))
    return np.column_stack([own, before, after, first, last, np.ones(len(lines))]), length.astype(float), count


@dataclass
class LineCrf:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray
    prior: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log potential of the states bad (0) and good (1) of each line."""
        return np.column_stack([np.zeros(len(x)), ((x - self.mean) / self.scale) @ self.weights])

    def scores(self, texts: list[str]) -> np.ndarray:
        x, length, count = line_features(texts)
        good = chains(self.evidence(x), self.transitions, count)[0][:, 1] if len(x) else np.zeros(0)
        owner = np.repeat(np.arange(len(texts)), count)
        weight = np.bincount(owner, length, len(texts))
        total = np.bincount(owner, length * good, len(texts))
        return np.clip(np.where(weight > 0, total / np.maximum(weight, 1), self.prior), 0, 1)


def chains(evidence: np.ndarray, transitions: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once: marginals of every line, and the summed marginals of every pair of states.

    Chains are sorted by length, so that step t works on those that still have a line t.
    """
    n = len(evidence)
    start = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    begin, size = start[order], count[order]
    alive = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), side="right")
    forward, backward = np.array(evidence), np.zeros((n, 2))
    for t in range(1, len(alive)):
        at = begin[: alive[t]] + t
        into = np.logaddexp(forward[at - 1, 0][:, None] + transitions[0], forward[at - 1, 1][:, None] + transitions[1])
        forward[at] = evidence[at] + into - into.max(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(len(alive) - 1, 0, -1):
        at = begin[: alive[t]] + t
        out = evidence[at] + backward[at]
        joint = forward[at - 1][:, :, None] + transitions + out[:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        back = np.logaddexp(out[:, 0][:, None] + transitions[:, 0], out[:, 1][:, None] + transitions[:, 1])
        backward[at - 1] = back - back.max(1, keepdims=True)
    both = forward + backward
    both = np.exp(both - both.max(1, keepdims=True))
    return both / both.sum(1, keepdims=True), pairs


def fit(texts: list[str], labels: list[int]) -> LineCrf:
    """Maximum likelihood with a small penalty, by Adam on the whole sample; every document counts alike."""
    x, _, count = line_features(texts)
    y = np.repeat(np.array(labels, dtype=np.int64), count)
    prior = float(np.mean(labels)) if labels else 0.5
    width = x.shape[1] or 3 * len(OWN) + 3
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(width), np.ones(width))
    mean[-1] = 0
    scale[scale < 1e-6] = 1
    model = LineCrf(mean, scale, np.zeros(width), np.zeros((2, 2)), prior)
    if not len(x) or len(set(labels)) < 2:
        return model
    z = (x - mean) / scale
    starts = np.cumsum(count) - count
    inner = np.ones(len(y), dtype=bool)
    inner[starts[count > 0]] = False
    seen_pairs = np.bincount(2 * y[np.flatnonzero(inner) - 1] + y[inner], minlength=4).reshape(2, 2)
    theta, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, STEPS + 1):
        model.weights, model.transitions = theta[:width], theta[width:].reshape(2, 2)
        marginals, pairs = chains(np.column_stack([np.zeros(len(z)), z @ model.weights]), model.transitions, count)
        gradient = np.concatenate([z.T @ (y - marginals[:, 1]), (seen_pairs - pairs).ravel()]) / len(y) - PENALTY * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights, model.transitions = theta[:width], theta[width:].reshape(2, 2)
    return model


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, documents: int = TRAIN_DOCUMENTS) -> LineCrf:
    """Fit on a bounded sample of labelled documents that are not held out; a document with several labels takes the smallest."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    )
    sample = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text").between(1, TRAIN_CHARS))
        .join(F.broadcast(chosen), "doc_id")  # at most `documents` rows
        .dropDuplicates(["doc_id"]).orderBy("doc_id").select("text", "quality").toPandas()
    )
    return fit(sample["text"].tolist(), sample["quality"].tolist())


def score(docs: DataFrame, model: LineCrf, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `held_out`, `score` and `predicted` (these replace columns of that name).

    An empty or null text, or one of line ends only, gets the share of good labels in training as its score; a null
    doc_id is not held out; repeated rows are scored each; an empty table gives no rows.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t or "" for t in batch]
            out, i = [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
                    size += len(texts[j])
                    j += 1
                out.append(model.scores(texts[i:j]))
                i = j
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    done = docs.select(*[F.col(f"`{c}`") for c in names], held_out().alias("held_out"), scored("text").alias("score"))
    return done.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
