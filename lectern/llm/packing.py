"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A piece of length n belongs to the reciprocal class k = capacity // n, and every sequence of class k
holds exactly k pieces, so that no sequence ever has to be searched for: the position of a piece in its class
tells its sequence. Each worker numbers its own pieces; a prefix sum over (worker, class) counts makes the numbers global.

A document may be cut freely, so lengths that would leave a sequence half empty are cut to the next
reciprocal length capacity // k first (a 3000 token document gives 2048 + 819 + 132 + 1 of 4096).
"""

from __future__ import annotations

import array
import json
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.session import cut_lineage

CAPACITY = 4096
END_ID = 2
#: Lengths below this are classes of their own and never cut: k pieces of length n < 64 leave less than 64 tokens.
SHORT = 64
#: A piece is not cut if k pieces of its length leave at most capacity / TOLERANCE tokens unused.
TOLERANCE = 128
#: Pre-tokens whose ids a Python worker keeps between batches.
CACHE_WORDS = 600_000
#: Characters of text whose pre-tokens are looked up together.
BLOCK_CHARS = 2_000_000

# The pre-token pattern of word_bpe_49k.json, and control characters that Python counts as
# white space but the tokenizer does not.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ODD_SPACES = re.compile("[\x1c-\x1f]")
SPECIALS = ("<|startoftext|>", "<|endoftext|>")


class WordEncoder:
    """Token ids of whole texts, pre-token by pre-token: this tokenizer never looks across their borders.

    The ids of every distinct pre-token are kept as bytes (little-endian unsigned 32 bit), so a text is one join of known
    byte strings. Texts with control characters or with a special token's string go through the tokenizer as they are.
    """

    def __init__(self, name: str):
        path = public_tokenizers.path(name)
        with open(path) as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.ends = np.zeros(self.whole.get_vocab_size(), dtype=bool)
        for token, i in self.whole.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.parts = Tokenizer.from_str(json.dumps(spec))
        self.find = regex.compile(PRE_TOKEN).findall
        self.pre: dict[str, bytes] = {}

    def _learn(self, unseen: list[str]) -> None:
        for i in range(0, len(unseen), 2000):
            part = unseen[i : i + 2000]
            ids = np.array(self.parts.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            if len(stops) == len(part):
                self.pre.update((p, raw[start:stop]) for p, start, stop in zip(part, [0, *stops], stops))
                continue
            for p in part:  # one of them has no end mark: one by one
                self.pre[p] = np.array(self.parts.encode([p], is_pretokenized=True, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _split(self, text: str) -> list[str] | None:
        if ODD_SPACES.search(text) or any(s in text for s in SPECIALS):
            return None
        if not text.isascii():  # the tokenizer lowers character by character, so a last sigma is a plain one
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.find(text.lower())

    def _encode_block(self, texts: list[str]) -> Iterator[bytes]:
        split = [self._split(t) for t in texts]
        plain = [parts for parts in split if parts is not None]
        new = set().union(*plain).difference(self.pre)
        if len(self.pre) + len(new) > CACHE_WORDS and self.pre:
            self.pre = {}
            new = set().union(*plain)
        self._learn(list(new))
        of = self.pre.__getitem__
        for text, parts in zip(texts, split, strict=True):
            if parts is None:
                yield array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                yield b"".join(map(of, parts))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of every text; the unseen pre-tokens of a block of texts are learnt together."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK_CHARS):
                size += len(texts[j])
                j += 1
            yield from self._encode_block(texts[i:j])
            i = j


@lru_cache(maxsize=2)
def _encoder(name: str) -> WordEncoder:
    return WordEncoder(name)


@lru_cache(maxsize=2 * CAPACITY)
def _cut_rest(rest: int, capacity: int) -> tuple[int, ...]:
    pieces = []
    while rest:
        k = capacity // rest
        if rest < SHORT or capacity - k * rest <= capacity // TOLERANCE:
            pieces.append(rest)
            break
        piece = capacity // -(-capacity // rest)
        pieces.append(piece)
        rest -= piece
    return tuple(pieces)


def cut(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of one document, in order; all but short ones are close to capacity / k."""
    return [capacity] * (length // capacity) + list(_cut_rest(length % capacity, capacity))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int, worker int, at long"


def _numbered(k: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Running number of every piece in its class, from the numbers `seen` so far, which are moved on."""
    order = np.argsort(k, kind="stable")
    first = np.searchsorted(k[order], k[order])
    out = np.empty(len(k), dtype=np.int64)
    out[order] = seen[k[order]] + np.arange(len(k)) - first
    seen += np.bincount(k, minlength=len(seen))
    return out


def _pieces(tokenizer: str, capacity: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            size, count, crc, start, length = [], [], [], [], []
            for ids in encoder.encode(batch["text"].tolist()):
                view, at = memoryview(ids + end), 0
                pieces = cut(len(view) // 4, capacity)
                size.append(len(view) // 4)
                count.append(len(pieces))
                length += pieces
                for n in pieces:
                    start.append(at)
                    crc.append(zlib.crc32(view[4 * at : 4 * (at + n)]))
                    at += n
            length, count = np.array(length, dtype=np.int64), np.array(count, dtype=np.int64)
            k = capacity // length
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64").repeat(count).array,
                "start": np.array(start, dtype=np.int64),
                "length": length,
                "ids_crc32": np.array(crc, dtype=np.int64),
                "doc_tokens": np.repeat(np.array(size, dtype=np.int64), count),
                "k": k.astype(np.int32),
                "worker": batch["worker"].to_numpy().repeat(count),
                "at": _numbered(k, seen),
            })

    return run


def _fit(rest: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """First-fit decreasing for the last, incomplete sequence of every class: fewer rows than the sum of all k."""
    rest = rest.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], ignore_index=True)
    used = np.zeros(len(rest) + 1, dtype=np.int64)
    sequence, offset = [], []
    for n in rest["length"]:
        i = int(np.argmax(used + n <= capacity))
        sequence.append(i)
        offset.append(used[i])
        used[i] += n
    return rest.assign(sequence_id=np.array(sequence, dtype=np.int64), offset=np.array(offset, dtype=np.int64))


RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    Input: `doc_id`, `text`; other columns are ignored. A null or empty text is the end token alone; a null
    doc_id stays null; repeated rows are packed each; an empty table gives no rows.
    """
    pieces = cut_lineage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("worker"))
        .mapInPandas(_pieces(tokenizer, capacity), PIECES)
    )
    counts = pieces.groupBy("k", "worker").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("k")
    before = counts.select(
        "k", "worker",
        (F.sum("n").over(by_class.orderBy("worker")) - F.col("n")).alias("before"),
        F.sum("n").over(by_class).alias("all"),
    )
    placed = pieces.join(before, ["k", "worker"]).withColumn("at", F.col("at") + F.col("before"))
    placed = placed.withColumns({"bin": F.expr("at div k"), "slot": F.col("at") % F.col("k")})
    full = placed.where("bin < all div k")
    in_bin = Window.partitionBy("k", "bin").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumns({
        "sequence_id": F.shiftleft(F.col("k").cast("long"), 44) + F.col("bin"),
        "offset": F.coalesce(F.sum("length").over(in_bin), F.lit(0)),
    })
    rest = placed.where("bin >= all div k").select(*RESULT[:5]).groupBy().applyInPandas(
        lambda x: _fit(x, capacity)[RESULT], ", ".join(f"{c} long" for c in RESULT)
    )
    return full.select(*RESULT).unionByName(rest)
