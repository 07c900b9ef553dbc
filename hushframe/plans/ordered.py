"""Whole-table order without a single task.

A window without a partition puts all rows into one task. Here rows are dealt by range of their
order, each range is scanned by itself, and what earlier ranges leave behind (a sum, a last value)
comes from a table with one row for each range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep


def number(df: DataFrame, by: list[Column], bucket: str, place: str) -> DataFrame:
    """``df`` with the range of each row and its place (from 1) in the whole order. ``by`` should be
    unique, or ties are placed as they come."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = keep(df.repartitionByRange(n, *by).withColumn(bucket, F.spark_partition_id()), "ordered")
    sizes = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("__n"))  # one row a range
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    begin = sizes.select(bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"))
    own = Window.partitionBy(bucket).orderBy(*by)
    return df.join(F.broadcast(begin), bucket).withColumn(place, F.col("__begin") + F.row_number().over(own)).drop("__begin")


#: For each running kind: the window function and aggregate, and how a carry meets the local value.
KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda c, v: F.coalesce(c + v, v, c)),
    "product": (F.product, lambda c, v: F.coalesce(c * v, v, c)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def running(df: DataFrame, bucket: str, place: str, column: str, out: str, kind: str) -> DataFrame:
    """``df`` with the running sum, product, max or min of ``column`` up to each row."""
    f, meet = KINDS[kind]
    own = Window.partitionBy(bucket).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(bucket).agg(f(F.col(column)).alias("__t"))
    carry = totals.select(bucket, f(F.col("__t")).over(before).alias("__carry"))
    local = df.withColumn("__local", f(F.col(column)).over(own))
    return local.join(F.broadcast(carry), bucket).withColumn(out, meet(F.col("__carry"), F.col("__local"))).drop("__carry", "__local")


def nearest(df: DataFrame, bucket: str, place: str, column: str, out: str, ahead: bool = False) -> DataFrame:
    """``df`` with the last value of ``column`` that is not missing up to each row (or the next)."""
    turn = (lambda c: F.col(c).desc()) if ahead else F.col
    own = Window.partitionBy(bucket).orderBy(turn(place)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy(turn(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col(column).isNotNull(), F.col(place))
    pick = F.min_by if ahead else F.max_by
    totals = df.groupBy(bucket).agg(pick(F.col(column), known).alias("__t"))
    carry = totals.select(bucket, F.last("__t", True).over(before).alias("__carry"))
    local = df.withColumn("__local", F.last(column, True).over(own))
    return local.join(F.broadcast(carry), bucket).withColumn(out, F.coalesce("__local", "__carry")).drop("__carry", "__local")


def moved(df: DataFrame, place: str, column: str, out: str, by: int) -> DataFrame:
    """``df`` with the value of ``column`` ``by`` rows before each row (after it, if negative)."""
    other = df.select((F.col(place) + by).alias("__at"), F.col(column).alias(out))
    return df.join(other, df[place] == other["__at"], "left").drop("__at")


def edges(df: DataFrame, order: str) -> list[float]:
    """Values of a column that cut its rows into about as many ranges as there are partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / n for i in range(1, n)] or [0.5])).first()[0]
    return sorted(set(found or []))


def running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, str], cuts: list[float], down: bool = False) -> DataFrame:
    """``df`` (one row for each keys and ``order``) with running sums along ``order`` for each of the
    keys: new column to summed column. Rows are summed by range of the order, and what the ranges
    before leave comes from a table with one row for each keys and range."""
    turn = F.desc if down else F.asc
    bucket = F.aggregate(F.array(*[F.lit(float(c)) for c in cuts]), F.lit(0), lambda n, c: n + (c < F.col(order)).cast("int")) if cuts else F.lit(0)
    df = df.withColumn("__range", bucket)
    own = Window.partitionBy(*keys, "__range").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys, F.lit(0)).orderBy(turn("__range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "__range").agg(*[F.sum(c).alias(f"__t_{new}") for new, c in sums.items()])
    carry = totals.select(*keys, "__range", *[F.coalesce(F.sum(f"__t_{new}").over(before), F.lit(0)).alias(f"__c_{new}") for new in sums])
    local = df.withColumns({f"__l_{new}": F.sum(c).over(own) for new, c in sums.items()})
    return local.join(F.broadcast(carry), [*keys, "__range"]).withColumns({new: F.col(f"__l_{new}") + F.col(f"__c_{new}") for new in sums}).drop(
        "__range", *[f"__l_{new}" for new in sums], *[f"__c_{new}" for new in sums]
    )
