"""Tables that several plans read, written once where all executors see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, as in tests, a folder of this machine where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(shared_folder, "own", None)
    if own is None:
        own = shared_folder.own = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return own


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """df as Parquet in the shared folder, read back: worked out once, and not again if an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows that the driver holds, as a local relation: to read it takes no tasks and no Python workers."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = T.StructType.fromDDL(schema)
    form = to_arrow_schema(kinds)
    columns = list(zip(*rows)) or [()] * len(form)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, form)], schema=form), kinds)
