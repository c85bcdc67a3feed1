"""Registry, and the dirty tables that queries and SQL derive alike from the clean ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Both engines run these select lists.
DIRTY = """
  l_orderkey as order_id,
  l_linenumber as line_no,
  case when l_linenumber = 3 then null else l_quantity end as quantity,
  case when l_orderkey % 7 = 0 then null else l_extendedprice end as price,
  l_discount as discount_rate,
  case when l_linenumber = 5 then '  N/A ' when l_linenumber = 6 then null when l_linenumber = 2 then concat(' ', l_returnflag) when l_linenumber = 1 then lower(l_returnflag) else l_returnflag end as status,
  case when l_linenumber = 4 then concat('($', cast(cast(l_quantity as int) as string), ')') when l_linenumber = 5 then 'n/a' else concat('$1,', lpad(cast(cast(l_quantity as int) as string), 3, '0'), '.50') end as amount,
  case when l_linenumber = 4 then 'bad-address' else concat('u', cast(l_orderkey as string), '@example.org') end as email,
  case when l_linenumber = 7 then 150 when l_linenumber = 6 then -3 else l_linenumber * 10 end as age,
  case when l_linenumber = 2 then 'unknown' when l_linenumber = 3 then '-' else l_linestatus end as flag
"""
DIRTY_SQL = f"(select {DIRTY} from lineitem)"
REPEATED_SQL = "(select * from orders union all select * from orders where o_orderkey % 10 = 0)"


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"select {DIRTY} from {{t}}", t=table(spark, sf_dir, "lineitem"))


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with each tenth key twice."""
    orders = table(spark, sf_dir, "orders")
    return orders.unionByName(orders.where("o_orderkey % 10 = 0"))


def near(c: str, q: float) -> str:
    """SQL of the nearest-rank quantile."""
    return f"list_sort(list({c}) filter (where {c} is not null))[cast(floor((count({c}) - 1) * {q} + 0.5) as bigint) + 1]"
