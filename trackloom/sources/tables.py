"""The given tables read as tracks, observations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as box samples: a user is a track, an hour a second, the value a position."""
    v, u = F.col("value"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("V"), (u % 8).cast("string")).alias("video_id"), u.alias("track"),
        F.element_at(F.array(*map(F.lit, ("person", "bag", "car", "person"))), (u % 4 + 1).cast("int")).alias("object_type"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600.0).alias("t"),
        v.alias("x1"), (v / 2).alias("y1"), (v + 20.0).alias("x2"), (v / 2 + 40.0).alias("y2"))


#: The same in SQL.
SAMPLES = """samples as (
    select 'V' || (user_id % 8)::varchar as video_id, user_id as track,
           list_value('person', 'bag', 'car', 'person')[(user_id % 4 + 1)::int] as object_type,
           epoch_us(ts)::double / 1e6::double / 3600.0::double as t,
           value as x1, value / 2 as y1, value + 20.0::double as x2, value / 2 + 40.0::double as y2 from events)"""


def order_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events that last from the order's date to its last shipment, in days."""
    day = lambda c: F.unix_micros(c.cast("timestamp")) / 86_400e6
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(day(F.col("l_shipdate"))).alias("end"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", day(F.col("o_orderdate")).alias("start"))
    return orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


ORDER_INTERVALS = """order_intervals as (
    select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, epoch_us(o_orderdate)::double / 86400e6::double as start, "end"
    from orders join (select l_orderkey, max(epoch_us(l_shipdate)::double / 86400e6::double) as "end" from lineitem group by 1) on o_orderkey = l_orderkey)"""
