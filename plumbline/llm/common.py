"""Shared pieces: materialised intermediate tables, connected components, table readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. In local mode, as in tests, one of this machine where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(shared_dir, "own", None)
        if found is None:
            found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return found


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts are long rows: batches to Python workers hold at most so many of them from here on, in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def lean(batches):
    """The batches of a task's generator. Before and after, what the Python worker has freed goes back to the system: Spark keeps workers for later tasks, which can't fill the gaps that others leave."""
    import ctypes

    import pyarrow as pa

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc

    def hand_back():
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)

    hand_back()
    yield from batches
    hand_back()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    The files survive the loss of any executor; a later stage never recomputes df.
    """
    path = f"{shared_dir(df.sparkSession)}/plumbline-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    _written.append(path)
    return out


_written: list[str] = []  # paths only: a kept DataFrame would keep its plan in the driver


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Delete all settled tables of this process, once their results have been written elsewhere."""
    while _written:
        _delete(spark, _written.pop())


def release(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    path = getattr(df, "_settled_at", None)
    if path:
        _delete(df.sparkSession, path)
        if path in _written:
            _written.remove(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files that no plan refers to any more go when the driver collects its garbage, which may be much later than its disks fill: now."""
    spark.sparkContext._jvm.System.gc()


def unnamed(df: DataFrame, *columns: str) -> tuple:
    """df with its columns called c0, c1, ... (whatever they were, they clash with nothing then), and the new names of `columns`."""
    new = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*new.values()), *[new[c] for c in columns]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each a
    partial aggregate and an equi-join that AQE can split at a hot centre. Every
    round is written to the shared folder. Nodes without an edge to another node
    are absent. Nothing but a count and a checksum reaches the driver.
    """
    links = settle(
        edges.where("a <> b and a is not null and b is not null")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = _mark(links)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = links.union(links.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        ).distinct()
        after = settle(small)
        release(links)
        links, before = after, mark
        mark = _mark(links)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
