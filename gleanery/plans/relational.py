"""The relational primitives that the operators are made of, over the star schema and the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.operators.retrieval import small
from gleanery.operators import serving
from gleanery.plans.registry import query
from gleanery.session import table


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


@query(
    """select l_returnflag, l_linestatus, cast(count(*) as bigint) as n, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus"""
)
def rel_filtered_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lineitem,) = _tables(spark, sf_dir, "lineitem")
    kept = lineitem.filter("l_shipdate <= timestamp_ntz '1998-09-02'")
    return kept.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc")
    )


@query(
    """select n_name, cast(count(distinct o_orderkey) as bigint) as n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name in ('ASIA', 'EUROPE') group by n_name"""
)
def rel_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations are broadcast after their size is checked; orders meet lines by their key."""
    region, nation, customer, orders, lineitem = _tables(spark, sf_dir, "region", "nation", "customer", "orders", "lineitem")
    places = nation.join(small(region.filter("r_name in ('ASIA', 'EUROPE')")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    buyers = customer.join(small(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    joined = orders.select("o_orderkey", "o_custkey").join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("select c_custkey, cast(count(o_orderkey) as bigint) as n_orders from customer left join orders on c_custkey = o_custkey group by c_custkey")
def rel_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = _tables(spark, sf_dir, "customer", "orders")
    counts = orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    return customer.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R')")
def rel_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, lineitem = _tables(spark, sf_dir, "part", "lineitem")
    return part.join(lineitem.filter("l_returnflag = 'R'"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("select s_suppkey from supplier where exists (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity > 49)")
def rel_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, lineitem = _tables(spark, sf_dir, "supplier", "lineitem")
    return supplier.join(lineitem.filter("l_quantity > 49"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query(
    "select coalesce(a.c_nationkey, b.s_nationkey) as nationkey, coalesce(a.n, 0) as n_customers, coalesce(b.n, 0) as n_suppliers from (select c_nationkey, cast(count(*) as bigint) as n from customer where c_acctbal > 9000 group by 1) a full join (select s_nationkey, cast(count(*) as bigint) as n from supplier where s_acctbal > 5000 group by 1) b on c_nationkey = s_nationkey"
)
def rel_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier = _tables(spark, sf_dir, "customer", "supplier")
    a = customer.filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n_customers"))
    b = supplier.filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "nationkey", "full").na.fill(0, ["n_customers", "n_suppliers"])


@query(
    "select case when grouping(o_orderpriority) = 1 then '(all)' else o_orderpriority end as priority, case when grouping(o_orderstatus) = 1 then '(all)' else o_orderstatus end as status, cast(count(*) as bigint) as n, round(sum(o_totalprice), 2) as total from orders group by grouping sets ((), (o_orderpriority), (o_orderpriority, o_orderstatus))"
)
def rel_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = _tables(spark, sf_dir, "orders")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    made = orders.groupingSets([[], [p], [p, s]], p, s).agg(F.grouping(p).alias("gp"), F.grouping(s).alias("gs"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return made.select(F.when(F.col("gp") == 1, "(all)").otherwise(p).alias("priority"), F.when(F.col("gs") == 1, "(all)").otherwise(s).alias("status"), "n", "total")


@query(
    "select c_custkey, o_orderkey, cast(row_number() over w as integer) as place, round(o_totalprice - lag(o_totalprice) over w, 2) as change, round(sum(o_totalprice) over (w rows between unbounded preceding and current row), 2) as running from customer join orders on c_custkey = o_custkey where c_mktsegment = 'BUILDING' window w as (partition by c_custkey order by o_orderdate, o_orderkey)"
)
def rel_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = _tables(spark, sf_dir, "customer", "orders")
    w = Window.partitionBy("c_custkey").orderBy("o_orderdate", "o_orderkey")
    joined = customer.filter("c_mktsegment = 'BUILDING'").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    return joined.select("c_custkey", "o_orderkey", F.row_number().over(w).alias("place"), F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("change"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))


@query("select l_suppkey, l_orderkey, l_linenumber, l_extendedprice, cast(place as integer) as place from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as place from lineitem) where place <= 3")
def rel_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lineitem,) = _tables(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")
    return lineitem.withColumn("place", F.row_number().over(w)).filter("place <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "place")


@query("select o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 2) as median, round(quantile_cont(o_totalprice, 0.9), 2) as p90, round(stddev_samp(o_totalprice), 2) as sd from orders group by o_orderpriority")
def rel_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = _tables(spark, sf_dir, "orders")
    points = serving.latency_report(orders.select("o_orderpriority", F.col("o_totalprice").alias("duration_ms")), "o_orderpriority", points=(0.5, 0.9))
    spread = orders.groupBy("o_orderpriority").agg(F.round(F.stddev_samp("o_totalprice"), 2).alias("sd"))
    return spread.join(points, "o_orderpriority").select("o_orderpriority", F.round("p50", 2).alias("median"), F.round("p90", 2).alias("p90"), "sd")


@query("select c_custkey as k, 'both' as kind from customer intersect select o_custkey, 'both' from orders union all (select c_custkey, 'customer' from customer except select o_custkey, 'customer' from orders)")
def rel_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = _tables(spark, sf_dir, "customer", "orders")
    a, b = customer.select(F.col("c_custkey").alias("k")), orders.select(F.col("o_custkey").alias("k"))
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.subtract(b).withColumn("kind", F.lit("customer")))


@query("select event_type, cast(count(*) filter (where k < 50) as bigint) as low, cast(count(*) filter (where k >= 50) as bigint) as high from (select event_type, cast(props ->> '$.k' as integer) as k from events) group by event_type")
def rel_json_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = _tables(spark, sf_dir, "events")
    parsed = events.select("event_type", F.from_json("props", "k int").k.alias("k")).withColumn("side", F.when(F.col("k") < 50, "low").otherwise("high"))
    return parsed.groupBy("event_type").pivot("side", ["low", "high"]).agg(F.count("k")).na.fill(0)


@query(
    """with s as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events), n as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as sess from s)
select user_id, min(ts) as session_start, cast(count(*) as bigint) as n_events, round(sum("value"), 2) as total from n group by user_id, sess"""
)
def rel_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: sessions of each user, ended by half an hour without an event."""
    (events,) = _tables(spark, sf_dir, "events")
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    made = timed.groupBy("user_id", F.session_window("at", "30 minutes").alias("s")).agg(F.min("ts").alias("session_start"), F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("total"))
    return made.select("user_id", "session_start", "n_events", "total")
