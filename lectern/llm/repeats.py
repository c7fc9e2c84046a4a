"""Removal of long repeated byte strings: every byte in a string of LENGTH bytes that also starts anywhere else.

A suffix array over all positions is what finds these in memory. Its distributed form by a difference cover sorts the
suffixes at sampled positions by names, recurses on the names, merges the remaining suffixes by their offset to
a sample, and compares neighbours. Here the four steps are the following.

1. Sample. The cover is taken from content, not from positions modulo 3: of any LENGTH - NAME + 1 successive strings of NAME bytes
   the one with the smallest hash is a sample. Every string of LENGTH bytes holds a sample, and equal strings hold it at
   the same offset, which is the property of a difference cover that merging needs, with 1 % of all positions in place of 67 %.
2. Names. Samples are shuffled by name (the hash of NAME bytes); a name that occurs once cannot be in a repeat.
3. Names of names. The suffixes that start between two samples belong to the later one and need no bytes but its context:
   those from the first such suffix to the end of the last string of LENGTH bytes. Equal contexts get equal second names; all
   strings in a context that occurs twice are repeated.
4. Merge and compare. Of each other context, and of one of each that occurs twice, the bytes are brought together by name. Two contexts
   share the strings between their common extensions left and right of the sample; where many contexts share a name,
   their strings are named by hash and counted, so no task compares all pairs of a large group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.ngram_join import SPANS, mixed
from lectern.llm.tables import small
from lectern.session import cut_lineage

LENGTH = 400
NAME = 200
#: Bytes of a text looked at together; pieces overlap, so nothing is cut.
CHUNK = 1_000_000
#: Contexts of a name that are compared in pairs; more are named string by string.
PAIRWISE = 32
#: Occurrences of a context from which on its rows are found without shuffling them.
HOT = 1000


def samples(text: bytes, length: int, name: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Samples of a text: hash, context hash, first and last string start that belongs to the sample, position.

    Piece after piece; each piece's strings start in a range of its own, and a sample that serves both pieces is given twice with
    the strings of each.
    """
    for begin in range(0, len(text) - length + 1, CHUNK):
        data = np.frombuffer(text, dtype=np.uint8, count=min(CHUNK + length - 1, len(text) - begin), offset=begin)
        prefix = SPANS.prefix(data)
        grams = len(data) - name + 1
        at = np.arange(grams)
        hashes = SPANS.of(prefix, at, at + name)
        width, starts = length - name + 1, len(data) - length + 1
        # Smallest hash of each window by doubling, leftmost on ties: the place is kept along with the value.
        value, place, span = hashes, at, 1
        while span < width:
            step = min(span, width - span)
            left, right = value[:-step], value[step:]
            later = right < left
            value, place = np.where(later, right, left), np.where(later, place[step:], place[:-step])
            span += step
        place = place[:starts]
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:], starts) - 1
        spot = place[first]
        context = mixed(SPANS.of(prefix, first, last + length) ^ mixed((spot - first).astype(np.uint64)))
        yield hashes[spot], context, first + begin, last + begin, spot + begin


def _sample_rows(length: int, name: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for doc, text in zip(batch["row"], batch["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for h, c, first, last, spot in samples(raw, length, name) if len(raw) >= length else ():
                    out.append((h.view(np.int64), c.view(np.int64), np.full(len(h), doc), first, last - first, spot - first))
                    size += len(h)
                if size > 100_000:
                    yield _frame(out)
                    out, size = [], 0
            yield _frame(out)

    return run


SAMPLE = "name long, context long, row long, first long, more int, spot int"


def _frame(parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    names = [x.split()[0] for x in SAMPLE.split(", ")]
    return pd.DataFrame({n: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for i, n in enumerate(names)})


def _contexts(length: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The bytes of the open contexts of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, text, wanted in zip(batch["row"], batch["text"], batch["wanted"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(w["name"], w["twice"], w["many"], row, w["first"], w["more"], w["spot"], raw[w["first"] : w["first"] + w["more"] + length]) for w in wanted]
                if len(out) > 5000:
                    yield pd.DataFrame(out, columns=CONTEXT_NAMES)
                    out = []
            yield pd.DataFrame(out, columns=CONTEXT_NAMES)

    return run


CONTEXT = "name long, twice boolean, many boolean, row long, first long, more int, spot int, bytes binary"
CONTEXT_NAMES = [x.split()[0] for x in CONTEXT.split(", ")]


def shared(a: tuple[int, int, bytes], b: tuple[int, int, bytes], name: int, length: int) -> tuple[int, int] | None:
    """Offsets before the sample (most, least) at which the same string of `length` bytes starts in both contexts (more, spot, bytes)."""
    (more_a, spot_a, x), (more_b, spot_b, y) = a, b
    if x[spot_a : spot_a + name] != y[spot_b : spot_b + name]:
        return None  # equal hashes of different bytes
    left = min(spot_a, spot_b)
    u = np.frombuffer(x, dtype=np.uint8)[spot_a - left : spot_a][::-1] != np.frombuffer(y, dtype=np.uint8)[spot_b - left : spot_b][::-1]
    left = int(u.argmax()) if u.any() else left
    right = min(len(x) - spot_a, len(y) - spot_b)
    v = np.frombuffer(x, dtype=np.uint8)[spot_a : spot_a + right] != np.frombuffer(y, dtype=np.uint8)[spot_b : spot_b + right]
    right = int(v.argmax()) if v.any() else right
    least = max(length - right, spot_a - more_a, spot_b - more_b)
    return (left, least) if left >= least else None


def _compare(name: int, length: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Contexts sorted by name to ranges of repeated string starts of those contexts that occur once."""

    def group(rows: list[tuple], out: list[tuple[int, int, int]]) -> None:
        for i in range(len(rows)):
            for j in range(i):
                if rows[i][0] and rows[j][0]:
                    continue
                both = shared(rows[i][3:], rows[j][3:], name, length)
                if both:
                    for twice, row, first, _, spot, _ in (rows[i], rows[j]):
                        if not twice:
                            out.append((row, first + spot - both[0], first + spot - both[1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, rows, out = None, [], []
        for batch in batches:
            for key, twice, row, first, more, spot, data in batch[["name", "twice", "row", "first", "more", "spot", "bytes"]].itertuples(index=False, name=None):
                if key != last:
                    group(rows, out)
                    last, rows = key, []
                rows.append((twice, row, first, more, spot, data))
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=["row", "start", "stop"])
                out = []
        group(rows, out)
        yield pd.DataFrame(out, columns=["row", "start", "stop"])

    return run


def _strings(length: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The hash of every string of a context."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for twice, row, first, more, data in zip(batch["twice"], batch["row"], batch["first"], batch["more"], batch["bytes"], strict=True):
                at = np.arange(more + 1)
                h = SPANS.of(SPANS.prefix(np.frombuffer(data, dtype=np.uint8)), at, at + length).view(np.int64)
                parts.append((h, np.full(len(at), twice), np.full(len(at), row), first + at))
                if len(parts) > 2000:
                    yield pd.DataFrame({n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(("hash", "twice", "row", "start"))})
                    parts = []
            if parts:
                yield pd.DataFrame({n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(("hash", "twice", "row", "start"))})

    return run


RESULT = "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(length: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, text, starts, stops in zip(batch["row"], batch["text"], batch["starts"], batch["stops"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                kept, at, removed, spans, end = hashlib.sha256(), 0, 0, 0, -1
                for start, stop in sorted(zip(starts, stops, strict=True)):
                    if start > end:
                        spans += 1
                        kept.update(raw[at:start])
                        removed += stop + length - start
                    else:
                        removed += max(0, stop + length - end)
                    at = end = max(end, stop + length)
                kept.update(raw[at:])
                out.append((row, len(raw), removed, spans, kept.hexdigest()))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")])

    return run


def repeated_ranges(texts: DataFrame, length: int = LENGTH, name: int = NAME) -> DataFrame:
    """`row`, `start`, `stop`: ranges of starts of strings of `length` bytes that also start elsewhere. Input: `row`, `text`, without nulls."""
    found = cut_lineage(texts.mapInPandas(_sample_rows(length, name), SAMPLE))
    # A common passage falls together here, before anything is shuffled by its name.
    classes = cut_lineage(
        found.groupBy("name", "context").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "more", "spot")).alias("one"))
    )
    copied = classes.where("n > 1").select("name", "context", "n")
    hot = small(copied.where(F.col("n") >= HOT).select("name", "context"))
    others = found.join(hot, ["name", "context"], "left_anti").join(copied.where(F.col("n") < HOT), ["name", "context"], "left_semi")
    whole = found.join(hot, ["name", "context"], "left_semi").unionByName(others).select(
        "row", F.col("first").alias("start"), (F.col("first") + F.col("more")).alias("stop")
    )
    several = classes.groupBy("name").agg(F.count("*").alias("classes"), F.min("n").alias("least")).where("classes > 1 and least = 1")
    opened = classes.join(several, "name").select("name", (F.col("n") > 1).alias("twice"), (F.col("classes") > PAIRWISE).alias("many"), "one.*")
    wanted = cut_lineage(
        opened.groupBy("row").agg(F.collect_list(F.struct("name", "twice", "many", "first", "more", "spot")).alias("wanted"))
    )
    few_rows = texts.join(small(wanted.select("row")), "row", "left_semi")
    contexts = cut_lineage(few_rows.join(wanted, "row").select("row", "text", "wanted").mapInPandas(_contexts(length), CONTEXT))
    pairs = (
        contexts.where("not many").repartition("name").sortWithinPartitions("name", "row", "first")
        .mapInPandas(_compare(name, length), "row long, start long, stop long")
    )
    strings = contexts.where("many").mapInPandas(_strings(length), "hash long, twice boolean, row long, start long")
    strings = cut_lineage(strings)
    twice = strings.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    single = strings.where("not twice").join(twice, "hash", "left_semi").select("row", "start", F.col("start").alias("stop"))
    return whole.unionByName(pairs).unionByName(single)


def remove_repeats(docs: DataFrame, length: int = LENGTH, name: int = NAME) -> DataFrame:
    """`doc_id`, `n_bytes`, `n_removed`, `n_spans` and `kept_sha256` of every row, texts as UTF-8 bytes.

    A null text is empty; a null doc_id stays null and a repeated one has a row for each; equal rows count as texts of their own, so both
    lose what they share; other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = texts.select("doc_id")
    if ids.where("doc_id is null").isEmpty() and ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = texts.withColumnRenamed("doc_id", "row")
        numbers = None
    else:  # rows need a number that stays: it is written with them
        numbered = cut_lineage(texts.withColumn("row", F.monotonically_increasing_id()))
        rows, numbers = numbered.select("row", "text"), numbered.select("row", "doc_id")
    ranges = repeated_ranges(rows.where(F.octet_length("text") >= length), length, name)
    by_row = cut_lineage(ranges.groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")))
    hit = small(by_row.select("row"))
    changed = rows.join(hit, "row", "left_semi").join(by_row, "row").select("row", "text", "starts", "stops").mapInPandas(_remove(length), RESULT)
    same = rows.join(hit, "row", "left_anti").select(
        "row", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )
    done = changed.unionByName(same)
    if numbers is None:
        return done.withColumnRenamed("row", "doc_id")
    return done.join(numbers, "row").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
