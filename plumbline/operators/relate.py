"""Joins and referential integrity (JN-01..07)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.cells import INTEGERS, of_type, q
from plumbline.functions.names import rename_all, snake_case

HOW = {"inner": "inner", "left": "left", "full": "full", "outer": "full", "right": "right", "semi": "left_semi", "anti": "left_anti"}


def join_tables(tables: dict[str, DataFrame], key: str | None, how: str = "inner") -> DataFrame:
    """JN-01..04: left-deep join on one key, matched by snake-cased name in any case; the k-th table's clashing columns get suffix _k.

    Null keys match nothing. how: inner, left, full (outer), right, semi, anti; cross needs no key.
    The key is one column of the result. No join type is forced: Spark picks by size.
    """
    if not tables:
        raise ValueError("no tables to join")
    if len(tables) == 1:
        return next(iter(tables.values()))
    how = how.lower()
    if how != "cross" and how not in HOW:
        raise ValueError(f"unknown join {how!r}")
    (_, base), *others = tables.items()
    on = None if how == "cross" else _key(base, key)

    def step(left: DataFrame, numbered: tuple[int, DataFrame]) -> DataFrame:
        k, right = numbered
        if how != "cross":
            theirs = _key(right, key)
            right = right.withColumnRenamed(theirs, on) if theirs != on else right
        clash = {c: f"{c}_{k}" for c in right.columns if c in left.columns and c != on}
        right = right.withColumnsRenamed(clash)
        return left.crossJoin(right) if how == "cross" else left.join(right, [on], HOW[how])

    return rename_all(reduce(step, enumerate((t for _, t in others), 2), base))


def _key(df: DataFrame, key: str) -> str:
    wanted = snake_case(key)
    for c in df.columns:
        if c == key or snake_case(c) == wanted:
            return c
    raise KeyError(f"join key {key!r} not found in columns {df.columns}")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """JN-05: child rows whose key is known but has no parent."""
    keys = parent.select(q(pk).alias("_pk")).where("_pk is not null").distinct()
    return child.where(q(fk).isNotNull()).join(keys, q(fk) == F.col("_pk"), "left_anti")


def without_orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """JN-06."""
    keys = parent.select(q(pk).alias("_pk")).where("_pk is not null")
    return child.join(keys, q(fk) == F.col("_pk"), "left_semi")


def integrity(child: DataFrame, fk: str, parent: DataFrame, pk: str, sample: int = 10) -> DataFrame:
    """JN-05: orphan_count, orphan_pct of all child rows, completeness_pct, sample of distinct orphan keys (the smallest)."""
    keys = parent.select(q(pk).alias("_pk")).where("_pk is not null").distinct().withColumn("_has", F.lit(True))
    seen = child.select(q(fk).alias("fk")).groupBy("fk").count().join(keys, F.col("fk") == F.col("_pk"), "left")
    lost = F.col("fk").isNotNull() & F.col("_has").isNull()
    lost_keys = seen.where(lost).orderBy("fk").limit(sample).agg(F.array_sort(F.collect_list(F.col("fk").cast("string"))).alias("sample"))
    n = F.coalesce(F.sum(F.when(lost, F.col("count"))), F.lit(0))
    total = F.sum("count")
    pct = F.coalesce(F.round(F.try_divide(n * 100.0, total), 2), F.lit(0.0))
    return seen.agg(n.cast("long").alias("orphan_count"), pct.alias("orphan_pct"), F.round(100.0 - pct, 2).alias("completeness_pct")).crossJoin(lost_keys)


def infer_foreign_keys(df: DataFrame, limit: int = 5) -> DataFrame:
    """JN-07, SC-06: source, target, confidence: integer columns whose distinct values are a proper part (< 90 %) of another's.

    One pass collects nothing but counts: each value carries the set of columns it occurs in.
    """
    columns = of_type(df, INTEGERS)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), q(c).cast("long").alias("v")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
    per_value = long.distinct().groupBy("v").agg(F.collect_set("c").alias("cs"))
    known = F.col("v").isNotNull()
    has = lambda i: F.array_contains("cs", i)
    aggs = [F.count_if(has(i)).alias(f"n{i}") for i in range(len(columns))] + [F.count_if(has(i) & known).alias(f"k{i}") for i in range(len(columns))]
    pairs = [(i, j) for i in range(len(columns)) for j in range(len(columns)) if i != j]
    aggs += [F.count_if(has(i) & has(j) & known).alias(f"b{i}_{j}") for i, j in pairs if i < j]
    out = []
    if len(columns) > 1:
        got = per_value.agg(*aggs).first().asDict()
        for i in range(len(columns)):
            for j in range(i + 1, len(columns)):
                if got[f"n{i}"] == got[f"n{j}"]:
                    continue
                fk, pk = (i, j) if got[f"n{i}"] < got[f"n{j}"] else (j, i)
                n, of = got[f"k{fk}"], got[f"k{pk}"]
                if n and got[f"b{i}_{j}"] == n and n / of < 0.9:
                    out.append((columns[fk], columns[pk], 0.7))
    return df.sparkSession.createDataFrame(out[:limit], "source string, target string, confidence double")
