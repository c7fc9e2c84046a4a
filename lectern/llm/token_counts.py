"""Token counts under a unigram language model, shared over the prefixes of distinct words.

The distinct pre-tokens of a batch are put in a trie, which is walked depth first: sorted words are that order,
so the walk keeps one path only. A node's forward score is the best score of any segmentation of its prefix into vocabulary
pieces; it needs the nodes of its own path alone, so a prefix shared by many words is scored once. A word's
terminal node gives its number of tokens.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks the start of a word in the vocabulary.
MARK = "▁"
#: Words a Python worker keeps between batches.
CACHE_WORDS = 600_000


class Unigram:
    """Log probabilities of the pieces of a public vocabulary.

    The file lists pieces by rank, without probabilities; a piece of rank r gets Zipf's 1 / (r + 1), normalised. A
    character outside the vocabulary costs one token per UTF-8 byte, each less likely than any piece.
    """

    def __init__(self, name: str):
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        pieces = [
            model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
        self.score = {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}
        self.byte = 2 * min(self.score.values())
        lengths: dict[str, set[int]] = {}
        for p in pieces:
            lengths.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: tuple(sorted(v)) for c, v in lengths.items()}

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of each distinct word on its best path; ties go to fewer tokens."""
        out: dict[str, int] = {}
        score, lengths, byte = self.score, self.lengths, self.byte
        best, tokens, last = [0.0], [0], ""
        for word in sorted(set(words)):
            path = MARK + word
            shared, top = 0, min(len(path), len(last))
            while shared < top and path[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for d in range(shared, len(path)):
                char = path[d]
                high, fewest = -math.inf, 0
                for m in lengths.get(char, ()):
                    if m > d + 1:
                        break
                    p = score.get(path[d + 1 - m : d + 1])
                    if p is not None:
                        s, n = best[d + 1 - m] + p, tokens[d + 1 - m] + 1
                        if s > high or (s == high and n < fewest):
                            high, fewest = s, n
                if high == -math.inf:
                    size = len(char.encode("utf-8", "surrogatepass"))
                    high, fewest = best[d] + byte * size, tokens[d] + size
                best.append(high)
                tokens.append(fewest)
            out[word] = tokens[-1]
            last = path
        return out


@lru_cache(maxsize=2)
def _unigram(name: str) -> Unigram:
    return Unigram(name)


def _count(vocabulary: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unigram, known = _unigram(vocabulary), {}
        for batch in batches:
            split = [t.split() for t in batch["text"]]
            if len(known) > CACHE_WORDS:
                known = {}
            known |= unigram.counts({w for words in split for w in words if w not in known})
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "n_pretokens": [len(words) for words in split],
                "n_tokens": [sum([known[w] for w in words]) for words in split],
            })

    return run


def token_counts(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """`doc_id`, number of words and number of tokens of every whole text.

    Other columns are ignored. A null or empty text, or one of white space only, has no tokens; repeated rows are
    counted each; a null doc_id stays null; an empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(
        _count(vocabulary), "doc_id long, n_pretokens long, n_tokens long"
    )
