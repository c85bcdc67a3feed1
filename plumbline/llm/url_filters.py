"""URL allow and block rules by a sorted sweep over reversed-host keys (DataFrame operations only).

Null url, or one without "://": host and path are empty, no rule fits and the
default verdict holds. Repeated rows are judged each on its own; the columns
of the input that the caller names are carried along, others are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host runs from the first "://" to "/", "?", "#" or the end, the path from there to "?", "#" or the end."""
    found = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by a dot: a host and all its subdomains share one prefix, hence one interval of keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _rule_events(rules: DataFrame) -> DataFrame:
    """Change points (at, active) of a sweep over the rules' host intervals: from key `at` on, `active` are the rules of all open intervals.

    The sweep holds a stack of open intervals: a start pushes, an end pops. The
    rules are settings, not corpus data: they are swept as one array.
    """
    rules = rules.select("verdict", ascii_lower(F.col("host")).alias("host"), "path")
    node = rules.groupBy(host_key(F.col("host")).alias("at")).agg(
        F.array_sort(F.collect_set(F.struct(F.col("path"), F.concat("host", "path").alias("rule"), F.col("verdict")))).alias("own")
    )
    # "." + 1 = "/": the first key after everything that starts with `at`.
    starts = node.select(F.col("at"), F.lit(1).alias("kind"), F.col("own"))
    ends = node.select(F.concat(F.expr("left(at, length(at) - 1)"), F.lit("/")).alias("at"), F.lit(0).alias("kind"), F.col("own"))
    events = starts.union(ends).agg(F.array_sort(F.collect_list(F.struct("at", "kind", "own"))).alias("events"))
    active = "array<struct<path:string,rule:string,verdict:string>>"
    step = """
        aggregate(events,
          named_struct('stack', cast(array() as array<{a}>), 'out', cast(array() as array<struct<at:string,active:{a}>>)),
          (acc, e) -> named_struct(
            'stack', if(e.kind = 1, array_append(acc.stack, cast(e.own as {a})), slice(acc.stack, 1, size(acc.stack) - 1)),
            'out', array_append(acc.out, named_struct('at', e.at, 'active',
                     flatten(if(e.kind = 1, array_append(acc.stack, cast(e.own as {a})), slice(acc.stack, 1, size(acc.stack) - 1)))))),
          acc -> acc.out)
    """.format(a=active)
    # Intervals of distinct hosts never share an end, so each change point stands alone.
    return events.select(F.explode(F.expr(step)).alias("e")).select("e.at", "e.active")


def judge(
    urls: DataFrame,
    rules: DataFrame,
    url: str = "url",
    keep: Sequence[str] = ("page_id",),
    default: str = "allow",
    salts: int | None = None,
) -> DataFrame:
    """keep + host, path, rule, verdict. rules: (verdict, host, path); the longest fitting rule wins.

    Sort-merge range join: rows are dealt to `salts` groups by a hash of the
    whole row, so no host can be hot; each group holds the rules' change points
    too, is sorted by key, and takes for each row the last change point at or
    before it. Cost of the copies: change points x salts.
    """
    spark = urls.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = split_url(F.col(url))
    rows = urls.select(*[F.col(c) for c in keep], host.alias("_host"), path.alias("_path"))
    rows = rows.select(
        "*", host_key(F.col("_host")).alias("_at"), F.pmod(F.xxhash64(*keep, "_host", "_path"), F.lit(salts)).cast("int").alias("_salt")
    )
    events = _rule_events(rules).select("at", "active", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    # At one key, change points (in their order of sweep) stand before rows.
    both = rows.select("*", F.lit(1).alias("_row"), F.lit(None).cast(events.schema["active"].dataType).alias("_active")).unionByName(
        events.select(
            F.col("at").alias("_at"), F.col("_salt").cast("int").alias("_salt"), F.lit(0).alias("_row"), F.col("active").alias("_active")
        ),
        allowMissingColumns=True,
    )
    held = F.expr("last(_active, true) over (partition by _salt order by _at, _row rows between unbounded preceding and current row)")
    swept = both.withColumn("_held", held).where("_row = 1")
    fits = F.filter(F.coalesce("_held", F.array().cast(events.schema["active"].dataType)), lambda r: F.col("_path").startswith(r["path"]))
    best = F.element_at(F.array_sort(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))), -1)
    best = F.when(F.size(fits) > 0, best)
    return swept.select(
        *keep,
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        best["rule"].alias("rule"),
        F.coalesce(best["verdict"], F.lit(default)).alias("verdict"),
    )
