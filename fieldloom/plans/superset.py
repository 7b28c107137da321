"""Relational queries on the star schema and the event stream: a superset, not part of the corpus engine itself."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from fieldloom.plans.registry import query
from fieldloom.sources.tables import table


def t(name):
    return lambda spark, sf: table(spark, sf, name)


LINE, ORD, CUST, NAT, REG, EV, PART, SUP = (t(n) for n in ("lineitem", "orders", "customer", "nation", "region", "events", "part", "supplier"))
def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))



@query("x_pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def x_pricing_summary(spark, sf):
    return LINE(spark, sf).where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.sum(revenue()), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count("*").alias("n"))


@query("x_local_supplier", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def x_local_supplier(spark, sf):
    j = LINE(spark, sf).join(ORD(spark, sf), F.col("l_orderkey") == F.col("o_orderkey")).join(CUST(spark, sf), F.col("c_custkey") == F.col("o_custkey"))
    j = j.join(SUP(spark, sf), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(NAT(spark, sf), F.col("s_nationkey") == F.col("n_nationkey")).join(REG(spark, sf), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(revenue()), 2).alias("revenue"))


@query("x_cube", "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def x_cube(spark, sf):
    c = ORD(spark, sf).cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return c.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n", "total")


@query("x_windows", "SELECT o_orderkey, rank() OVER w AS r, ntile(4) OVER w AS quartile, coalesce(round(o_totalprice - lag(o_totalprice) OVER w, 2), 0) AS step FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def x_windows(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return ORD(spark, sf).select("o_orderkey", F.rank().over(w).alias("r"), F.ntile(4).over(w).alias("quartile"), F.coalesce(F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2), F.lit(0.0)).alias("step"))


@query("x_semi_anti", "SELECT 'with' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def x_semi_anti(spark, sf):
    c, o = CUST(spark, sf), ORD(spark, sf).select(F.col("o_custkey").alias("c_custkey"))
    n = lambda kind, how: c.join(o, "c_custkey", how).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n("with", "left_semi").unionAll(n("without", "left_anti"))


@query("x_as_of", "SELECT e.event_id, p.event_id AS previous FROM events e ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type <> 'purchase'")
def x_as_of(spark, sf):
    """Each event with its user's latest purchase up to then: one window over the union of both sides."""
    e = EV(spark, sf).select("event_id", "user_id", "ts", "event_type")
    bought = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    return e.withColumn("last", F.max(bought).over(w)).where("event_type <> 'purchase' and last is not null").select("event_id", F.col("last.event_id").alias("previous"))


@query("x_sessions", "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g) SELECT user_id, min(ts) AS opened, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid")
def x_sessions(spark, sf):
    """Sessions of a user, closed by six quiet hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = EV(spark, sf).withColumn("new", F.when(us - F.lag(us).over(w) <= 21600000000, 0).otherwise(1)).withColumn("sid", F.sum("new").over(w))
    return g.groupBy("user_id", "sid").agg(F.min("ts").alias("opened"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).drop("sid")


@query("x_range_join", "SELECT p_partkey, count(*) AS n FROM part JOIN orders ON o_totalprice BETWEEN p_retailprice * 100 AND p_retailprice * 100 + 500 GROUP BY 1")
def x_range_join(spark, sf):
    """Range join by buckets of the range's width: an equi-join on two buckets and the exact condition."""
    width = 500.0
    p = PART(spark, sf).select("p_partkey", (F.col("p_retailprice") * 100).alias("lo"))
    p = p.select("p_partkey", "lo", F.explode(F.array(F.floor(F.col("lo") / width), F.floor(F.col("lo") / width) + 1)).alias("bucket"))
    o = ORD(spark, sf).select("o_totalprice", F.floor(F.col("o_totalprice") / width).alias("bucket"))
    return p.join(o, "bucket").where("o_totalprice between lo and lo + 500").groupBy("p_partkey").agg(F.count("*").alias("n"))


@query("x_pivot", "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS f, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS o FROM lineitem GROUP BY 1")
def x_pivot(spark, sf):
    return LINE(spark, sf).groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity")).select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"))


@query("x_percentiles", "SELECT event_type, count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS spread FROM events GROUP BY 1")
def x_percentiles(spark, sf):
    return EV(spark, sf).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.stddev_pop("value"), 6).alias("spread"))


@query("x_hourly", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def x_hourly(spark, sf):
    return EV(spark, sf).groupBy(F.window("ts", "6 hours").start.alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("x_top_customers", "WITH s AS (SELECT n_name, c_custkey, round(sum(o_totalprice), 2) AS spent FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT n_name, c_custkey, spent FROM (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY spent DESC, c_custkey) AS r FROM s) WHERE r <= 3")
def x_top_customers(spark, sf):
    s = ORD(spark, sf).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent")).join(CUST(spark, sf), "c_custkey").join(NAT(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc("spent"), "c_custkey"))).where("r <= 3").select("n_name", "c_custkey", "spent")
