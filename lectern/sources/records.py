"""CSV records over several lines, read by many tasks.

A file is scanned as lines, so it splits anywhere. Whether a split begins inside a quoted field depends on all splits before
it: a first pass finds for every split where it would end if it began outside and if it began inside a field, the
driver composes these two-valued maps along each file, and a second pass builds the records of every split from its known
state. Only the pieces of records that cross a split are shuffled.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_QUOTED = r'"(?:[^"]|"")*+"[^,]*'
#: A line that begins outside and ends outside a quoted field, and the rest of a field that a line begins inside of.
_WHOLE = re.compile(rf'(?:(?:{_QUOTED}|(?!")[^,]*),)*+(?:{_QUOTED}|(?!")[^,]*)$')
_CLOSING = re.compile(r'(?:[^"]|"")*+"[^,]*(?:,|$)')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the line end after `line` lies in a quoted field. A quote opens a field only at its first character."""
    at = 0
    if inside:
        closing = _CLOSING.match(line)
        if closing is None:
            return True
        if closing.end() == len(line):
            return False
        at = closing.end()
    return _WHOLE.match(line, at) is None


def _lines(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """`path`, `start` of the split, `value`; the order of lines in a split is that of the rows."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    value = F.col("value") if encoding == "utf-8" else F.decode(F.col("value").cast("binary"), encoding)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), value.alias("value"))


def _splits(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of every split in a batch."""
    path, start = batch["path"].to_numpy(), batch["start"].to_numpy()
    edges = np.flatnonzero((path[1:] != path[:-1]) | (start[1:] != start[:-1])) + 1
    for lo, hi in zip([0, *edges], [*edges, len(batch)], strict=True):
        if hi > lo:
            yield batch.iloc[lo:hi]


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """State at the end of each split for both states at its start."""
    now, states, out = None, [False, True], []
    for batch in batches:
        for part in _splits(batch):
            split = (part["path"].iat[0], int(part["start"].iat[0]))
            if split != now:
                if now:
                    out.append((*now, *states))
                now, states = split, [False, True]
            for line in part["value"]:
                states = [ends_inside(line, s) for s in states]
    if now:
        out.append((*now, *states))
    yield pd.DataFrame(out, columns=["path", "start", "from_outside", "from_inside"])


def _changes(ends: DataFrame) -> dict[str, list[int]]:
    """For every file the starts of the splits after which the state is another one than before them."""
    out: dict[str, list[int]] = {}
    path, inside = None, False
    for r in ends.orderBy("path", "start").toLocalIterator():
        if r["path"] != path:
            path, inside = r["path"], False
        after = r["from_inside"] if inside else r["from_outside"]
        if after != inside:
            out.setdefault(path, []).append(r["start"])
            inside = after
    return out


def _build(changes: dict[str, list[int]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Records of every split: `at` is the number in the split, -1 for the end of one that began earlier; `open` ones go on in the next split."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, inside, at, pending = None, False, -1, None

        def flush() -> list[tuple]:
            return [(*now, at, "\n".join(pending), inside)] if pending is not None else []

        for batch in batches:
            out = []
            for part in _splits(batch):
                split = (part["path"].iat[0], int(part["start"].iat[0]))
                if split != now:
                    out += flush()
                    now, at, pending = split, -1, None
                    inside = bisect.bisect_left(changes.get(split[0], []), split[1]) % 2 == 1
                for line in part["value"]:
                    if inside:
                        pending = [line] if pending is None else [*pending, line] if len(pending) < 2 else (pending.append(line) or pending)
                    else:
                        out += flush()
                        at, pending = at + 1, [line]
                    if inside or '"' in line:
                        inside = ends_inside(line, inside)
            yield pd.DataFrame(out, columns=["path", "start", "at", "record", "open"])
        if now:
            yield pd.DataFrame(flush(), columns=["path", "start", "at", "record", "open"])

    return run


def read_records(spark: SparkSession, paths: list[str], encoding: str = "utf-8") -> DataFrame:
    """`path`, `start`, `at`, `record`: all CSV records of the files in the order of (path, start, at), headers included.

    Records keep the line ends inside of their fields; empty lines between records are no records. A field that is never closed
    reaches to the end of its file.
    """
    lines = _lines(spark, paths, encoding)
    quoted = lines.where(F.contains("value", F.lit('"')))  # no other line changes the state
    ends = quoted.mapInPandas(_ends, "path string, start long, from_outside boolean, from_inside boolean")
    built = lines.mapInPandas(_build(_changes(ends)), "path string, start long, at long, record string, open boolean")
    whole = built.where("at >= 0 AND NOT open").drop("open")
    # The rest: beginnings that go on (open, at >= 0) and what follows them (at = -1). At most two rows per split.
    pieces = built.where("at < 0 OR open")
    owner = F.last(F.when(F.col("at") >= 0, F.struct("start", "at")), ignorenulls=True).over(Window.partitionBy("path").orderBy("start", "at"))
    joined = (
        pieces.withColumn("owner", owner).groupBy("path", "owner")
        .agg(F.sort_array(F.collect_list(F.struct("start", "at", "record"))).alias("parts"))
        .select("path", "owner.start", "owner.at", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    )
    record = F.regexp_replace("record", "\r$", "")
    return whole.unionByName(joined).withColumn("record", record).where(F.trim("record") != "")
