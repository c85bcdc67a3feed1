"""Join and integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, table
from plumbline.functions.cells import q
from plumbline.operators import relate

_O = "(select o_orderkey, o_custkey as cust_key, o_totalprice as amount from orders)"
_C = "(select c_custkey as cust_key, c_name as name, c_acctbal as amount from customer where c_custkey % 3 = 0)"


def _pair(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cust_key"), F.col("o_totalprice").alias("amount"))
    c = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("CustKey"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))
    return {"orders": o, "customers": c}


for _how in ("inner", "left", "full"):

    def _join(spark, d, how=_how):
        return relate.join_tables(_pair(spark, d), "cust_key", how)

    query(f"join_{_how}", f"select cust_key, o_orderkey, o.amount as amount, name, c.amount as amount_2 from {_O} o {_how} join {_C} c using (cust_key)")(_join)

for _how in ("semi", "anti"):

    def _filter(spark, d, how=_how):
        return relate.join_tables(_pair(spark, d), "cust_key", how)

    query(f"join_{_how}", f"select cust_key, o_orderkey, amount from {_O} o {_how} join {_C} c using (cust_key)")(_filter)


@query("join_cross", "select r_regionkey, r_name, n_nationkey, n_name, n_regionkey from region, nation")
def join_cross(spark, d):
    return relate.join_tables({"region": table(spark, d, "region"), "nation": table(spark, d, "nation")}, None, "cross")


@query(
    "join_three",
    "select c.cust_key, c.name, o.o_orderkey, o.amount, l.n from (select c_custkey as cust_key, c_name as name from customer) c join (select o_custkey as cust_key, o_orderkey, o_totalprice as amount from orders) o using (cust_key) join (select c_custkey as cust_key, c_nationkey as n from customer) l using (cust_key)",
)
def join_three(spark, d):
    c = table(spark, d, "customer")
    return relate.join_tables(
        {
            "c": c.selectExpr("c_custkey as cust_key", "c_name as name"),
            "o": table(spark, d, "orders").selectExpr("o_custkey as cust_key", "o_orderkey", "o_totalprice as amount"),
            "l": c.selectExpr("c_custkey as cust_key", "c_nationkey as n"),
        },
        "cust_key",
    )


@query(
    "fk_orphans",
    "with p as (select c_custkey from customer where c_custkey % 10 <> 0), o as (select o_custkey from orders where o_custkey not in (select c_custkey from p)) select (select count(*) from o) as orphan_count, round((select count(*) from o) * 100.0::double / count(*), 2) as orphan_pct, round(100.0::double - round((select count(*) from o) * 100.0::double / count(*), 2), 2) as completeness_pct from orders",
)
def fk_orphans(spark, d):
    parent = table(spark, d, "customer").where("c_custkey % 10 <> 0")
    x = relate.integrity(table(spark, d, "orders"), "o_custkey", parent, "c_custkey")
    return x.select("orphan_count", F.col("orphan_pct").cast("double").alias("orphan_pct"), F.col("completeness_pct").cast("double").alias("completeness_pct"))


@query("fk_orphan_rows", "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_custkey % 10 <> 0)")
def fk_orphan_rows(spark, d):
    return relate.orphans(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").where("c_custkey % 10 <> 0"), "c_custkey").select("o_orderkey", "o_custkey")


@query("fk_semi", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_custkey % 10 <> 0)")
def fk_semi(spark, d):
    return relate.without_orphans(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").where("c_custkey % 10 <> 0"), "c_custkey").select("o_orderkey", "o_custkey")


@query("fk_infer", "select 'n_regionkey' as source, 'n_nationkey' as target, 0.7::double as confidence")
def fk_infer(spark, d):
    return relate.infer_foreign_keys(table(spark, d, "nation"))


@query("keep_first", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as r from orders) where r = 1")
def keep_first(spark, d):
    from plumbline.operators.issues import Fix

    return Fix("keep_first", "o_custkey").apply(table(spark, d, "orders"), ["o_orderkey"]).select(q("o_custkey"), q("o_orderkey"))
