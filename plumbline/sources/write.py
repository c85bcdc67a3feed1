"""Sinks (SNK-01, SNK-02, SNK-05, SNK-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.functions.cells import finite, q


def write(df: DataFrame, path: str, kind: str = "parquet", one_file: bool = False, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Parquet, CSV (with a header) or JSON lines. one_file suits small exports only."""
    out = (df.coalesce(1) if one_file else df).write.mode(mode)
    out = out.partitionBy(*partition_by) if partition_by else out
    if kind == "csv":
        out.option("header", True).csv(path)
    elif kind in ("json", "parquet"):
        getattr(out, kind)(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def preview(df: DataFrame, n: int = 5, order: list[str] | None = None) -> list[str]:
    """SNK-06: n rows as JSON, NaN and infinities null."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    df = df.orderBy(*[q(o) for o in order]) if order else df
    return df.limit(n).select(*[(finite(q(c)) if c in floats else q(c)).alias(c) for c in df.columns]).toJSON().collect()
