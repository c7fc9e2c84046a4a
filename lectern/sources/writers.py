"""Writers for result tables: one folder per table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.exprs import q


#: To the microsecond, as `exprs.timestamp` reads them back.
TIMESTAMPS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats that only hold plain values."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(q(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(q(f.name))
            for f in df.schema.fields
        ]
    )


def export_table(df: DataFrame, folder: str, name: str, fmt: str = "csv", stamp: datetime | None = None) -> str:
    """Write a table under `folder`, with a time stamp in its name if one is given."""
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"Unsupported format: {fmt}")
    suffix = f"_{stamp:%Y%m%d_%H%M%S}" if stamp else ""
    path = f"{folder.rstrip('/')}/{name}{suffix}"
    if fmt == "csv":
        flat(df).write.mode("error").option("header", True).option("escape", '"').option("timestampFormat", TIMESTAMPS).csv(path)
    else:
        df.write.mode("error").parquet(path)
    return path


def export_named(tables: dict[str, DataFrame], name: str, folder: str, fmt: str = "csv") -> str:
    if name not in tables:
        raise KeyError(f"Table '{name}' not found")
    return export_table(tables[name], folder, name, fmt)


def export_report(results: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Distribution and correlation tables of a report, where present."""
    files = {"distributions": "distribution_stats", "correlations": "correlations"}
    return {k: export_table(results[k], folder, f) for k, f in files.items() if k in results}


def export_workbook(
    tables: dict[str, DataFrame],
    folder: str,
    *,
    kpis: DataFrame | None = None,
    engagement: DataFrame | None = None,
    insights: DataFrame | None = None,
    predictions: DataFrame | None = None,
    fmt: str = "csv",
) -> dict[str, str]:
    """Every table, and the summary tables that are given, each in its own folder."""
    sheets = dict(tables)
    extra = {"kpis": kpis, "engagement_scores": engagement, "insights": insights, "prediction_models": predictions}
    sheets.update({k: v for k, v in extra.items() if v is not None})
    return {name: export_table(df, folder, name, fmt) for name, df in sheets.items()}
