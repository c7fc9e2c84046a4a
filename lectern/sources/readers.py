"""CSV readers for learner exports and student sources.

All columns are read as text, so nothing depends on schema inference over a sample;
the cleaning step decides the types in one pass over the data.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lectern.functions.exprs import q
from lectern.functions.fixed import (
    EXPORT_FILE_WORDS,
    EXPORT_HEADERS,
    EXPORT_REQUIRED,
    STUDENT_REQUIRED,
)
from lectern.session import cut_lineage, side_by_side
from lectern.sources.records import read_records

ROW_ID = "_row_id"
#: Columns that the readers add; no other column is treated in a special way.
PROVENANCE = (ROW_ID, "_source_file", "_source_type")
CORRUPT = "_corrupt"
#: Bits of a row number, shared by the file's number and the place in the largest file; files whose numbers are broadcast at most.
ROW_BITS, BROADCAST_FILES = 62, 100_000


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Files in a folder of any Hadoop file system, by name; a folder of parts named *.csv counts as one."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(f"Not a directory: {folder}")
    found = [(s.getPath().toString(), s.isFile()) for s in fs.listStatus(path)]
    return sorted(name for name, is_file in found if is_file or name.lower().endswith(".csv"))


def exists(spark: SparkSession, file: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _base(file: str) -> str:
    return file.rstrip("/").rsplit("/", 1)[-1]


def read_csv(spark: SparkSession, file: str | list[str], encoding: str = "utf-8", multiline: bool = False) -> DataFrame:
    """CSV as text columns; empty fields are null. A file whose header differs from the first one's is an error, not a swap."""
    return (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", False)
        .csv(file)
    )


def inspect_csv(spark: SparkSession, file: str) -> list[Row]:
    """One row per file, from one pass: path, header line, size in bytes, lines that are not utf-8, lines with an odd number of quotes."""
    lines = spark.read.text(file).select("value", "_metadata.file_path", "_metadata.file_size", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    return (
        lines.groupBy("file_path").agg(
            F.min_by("value", F.struct("file_block_start", "at")).alias("header"),
            F.max("file_size").alias("size"),
            F.count_if(~F.is_valid_utf8("value")).alias("not_utf8"),
            F.count_if((F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1).alias("odd_quotes"),
        ).orderBy("file_path").collect()
    )


def _parsed_records(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """Files with records over several lines, read by as many tasks as they have splits."""
    schema = read_csv(spark, paths, encoding, multiline=True).schema.add(CORRUPT, "string")
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": "true"}
    rows = read_records(spark, paths, encoding).where("start > 0 OR at > 0")  # the first record is the header
    parsed = rows.select(F.from_csv("record", F.lit(schema.toDDL()), options).alias("_fields"), F.col("path").alias("_path"), F.col("start").alias("_start"), F.col("at").alias("_at"))
    return parsed.select("_fields.*", "_path", "_start", "_at")


def _parsed_lines(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    schema = read_csv(spark, paths, encoding).schema.add(CORRUPT, "string")
    df = (
        spark.read.schema(schema).option("header", True).option("encoding", encoding)
        .option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(paths)
    )
    return df.select(
        "*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"),
    )


def _read_parts(spark: SparkSession, file: str, multiline: bool | None) -> tuple[DataFrame | None, dict[str, int], int]:
    """All part files as text columns with the corrupt record, `_path`, `_start`, `_at`; the number of each path in order; the largest size."""
    parts = inspect_csv(spark, file)
    encoding = "ISO-8859-1" if any(p["not_utf8"] for p in parts) else "utf-8"
    multiline = any(p["odd_quotes"] for p in parts) if multiline is None else multiline
    headers: dict[str, list[str]] = {}
    for p in parts:
        headers.setdefault(p["header"].lstrip("\ufeff").rstrip("\r"), []).append(unquote(p["file_path"]))
    out = None
    for paths in headers.values():
        df = _parsed_records(spark, paths, encoding) if multiline else _parsed_lines(spark, paths, encoding)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, {p["file_path"]: i for i, p in enumerate(parts)}, max((p["size"] for p in parts), default=0)


def read_csv_any_encoding(spark: SparkSession, file: str, multiline: bool | None = None) -> DataFrame:
    """A file or a folder of part files, with `_row_id` in the order of files and of their lines.

    The encoding is utf-8, or latin-1 if any line does not decode. With `multiline` None, records over several lines are expected
    if a line has an odd number of quotes; such files are split like others. Part files with the same header are
    read together, and the groups joined by column name. See `malformed_records` for records with too few or too many fields.
    """
    out, number, size = _read_parts(spark, file, multiline)
    if out is None:
        return read_csv(spark, file).withColumn(ROW_ID, F.lit(None).cast("long"))
    # A task reads one block, or several small files, and never more rows than a block has bytes: twice the block's
    # start leaves room for its rows.
    place_bits = (2 * size + 2).bit_length()
    if len(number) >> (ROW_BITS - place_bits):
        raise ValueError(f"{len(number)} files of up to {size} bytes have more places than {ROW_BITS} bits can number")
    files = spark.createDataFrame(list(number.items()), "_path string, _file long")  # one row per file
    files = F.broadcast(files) if len(number) <= BROADCAST_FILES else files
    names = [c for c in out.columns if c not in (CORRUPT, "_path", "_start", "_at")]
    numbered = out.join(files, "_path")
    return numbered.select(*[F.col(q(c)) for c in names], (F.shiftleft("_file", place_bits) + F.col("_start") * 2 + F.col("_at")).alias(ROW_ID))


def malformed_records(spark: SparkSession, file: str, multiline: bool | None = None) -> DataFrame:
    """`file` and `record` of every record that has too few or too many fields; readers keep such records, with nulls for what is missing."""
    out, _, _ = _read_parts(spark, file, multiline)
    if out is None:
        return spark.createDataFrame([], "file string, record string")
    # written first: the parser counts the fields only where all columns are read
    return cut_lineage(out.withColumnsRenamed({c: f"c{i}" for i, c in enumerate(out.columns) if not c.startswith("_")})).where(F.col(CORRUPT).isNotNull()).select(
        F.element_at(F.split("_path", "/"), -1).alias("file"), F.col(CORRUPT).alias("record")
    )


def rename_existing(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns and k != v})


def normalise_headers(df: DataFrame, kind: str) -> DataFrame:
    """Rename export headers to internal ones; unknown kinds stay as they are."""
    return rename_existing(df, EXPORT_HEADERS.get(kind, {}))


def check_export(df: DataFrame, kind: str, file: str = "") -> None:
    missing = [c for c in EXPORT_REQUIRED.get(kind, []) if c not in df.columns]
    if missing:
        raise ValueError(
            f"Schema validation failed for {file} ({kind}): missing required columns: {missing}. "
            f"Available: {df.columns}"
        )


def check_student_source(
    df: DataFrame, source: str, required: dict[str, Iterable[str]] | None = None
) -> bool:
    """Required columns of a student source; a source without a schema passes."""
    wanted = (required or STUDENT_REQUIRED).get(source)
    missing = sorted(set(wanted or []) - set(df.columns))
    if missing:
        raise ValueError(f"Schema validation failed for '{source}'. Missing required columns: {missing}")
    return True


def with_provenance(df: DataFrame, file: str, source_type: str | None) -> DataFrame:
    """Add the row order, file and kind that later steps may need."""
    return df.select(
        "*",
        F.lit(_base(file)).alias("_source_file"),
        F.lit(source_type).alias("_source_type"),
    )


def _open(spark: SparkSession, file: str, multiline: bool | None = None) -> DataFrame:
    if not exists(spark, file):
        raise FileNotFoundError(f"File not found: {file}")
    name = _base(file).lower()
    if not name.endswith(".csv"):
        raise ValueError(f"Unsupported format: {name[name.rfind('.'):] if '.' in name else name}")
    return read_csv_any_encoding(spark, file, multiline)


def read_export(spark: SparkSession, file: str, kind: str, multiline: bool | None = None) -> DataFrame:
    """One course, program, specialization or video export, with internal headers."""
    df = _open(spark, file, multiline)
    df = normalise_headers(df, kind)
    check_export(df, kind, _base(file))
    return with_provenance(df, file, kind)


def read_student_source(spark: SparkSession, file: str, source: str | None = None, multiline: bool | None = None) -> DataFrame:
    df = _open(spark, file, multiline)
    if source:
        check_student_source(df, source)
    return with_provenance(df, file, source)


def read_directory(
    spark: SparkSession, folder: str, pattern: str = "*.csv", source: str | None = None
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """All matching files by name without extension, and the errors of those that failed; files are inspected side by side."""
    frames: dict[str, DataFrame] = {}
    errors: dict[str, str] = {}

    def read(file: str) -> DataFrame | Exception:
        try:
            return read_student_source(spark, file, source)
        except Exception as e:
            return e

    files = [file for file in list_files(spark, folder) if fnmatch.fnmatch(_base(file), pattern)]
    for name, found in zip(map(_base, files), side_by_side(read, files), strict=True):
        if isinstance(found, Exception):
            errors[name] = str(found)
        else:
            frames[name.rsplit(".", 1)[0]] = found
    return frames, errors


def export_candidates(files: list[str], kind: str) -> list[str]:
    """Files whose names tell this kind; "modified" copies only if there is no original."""
    named = [f for f in files if any(w in _base(f).lower() for w in EXPORT_FILE_WORDS[kind])]
    return [f for f in named if "modified" not in _base(f).lower()] or named


def read_exports(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Detect and read one export of each kind from a folder.

    The first candidate with the required columns is taken, and serves no other kind.
    """
    free = [f for f in list_files(spark, folder) if f.lower().endswith(".csv")]
    if not free:
        raise FileNotFoundError(f"No CSV files found in {folder}")
    frames: dict[str, DataFrame] = {}
    for kind in EXPORT_FILE_WORDS:
        for file in export_candidates(free, kind):
            try:
                frames[kind] = read_export(spark, file, kind)
            except ValueError:
                continue
            free.remove(file)
            break
    if not frames:
        raise ValueError(f"No valid datasets found in {folder}")
    return frames


def load_log(frames: dict[str, DataFrame]) -> DataFrame:
    """File, kind, rows and columns of every frame that was read."""
    out = None
    for kind, df in frames.items():
        data_columns = [c for c in df.columns if c not in PROVENANCE]
        part = (
            df.groupBy(F.col("_source_file").alias("file"))
            .agg(F.count(F.lit(1)).alias("rows"))
            .select("file", F.lit(kind).alias("source_type"), "rows", F.lit(len(data_columns)).alias("columns"))
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no frames")
    return out


def read_id_map(spark: SparkSession, file: str) -> DataFrame:
    """Student id map: the canonical id and one id column per source."""
    return read_csv_any_encoding(spark, file).drop(ROW_ID)
