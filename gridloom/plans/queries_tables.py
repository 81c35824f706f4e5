"""Queries of scalars, statistics, sketches, samples and user functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import tables
from gridloom.plans.registry import Registry
from gridloom.sources import fixtures as fx

REGISTRY = Registry(digits=4)
add = REGISTRY.add


@add("string_scalars", "p_partkey kind word size letters", "first", "p AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS word, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS size, length(replace(p_name, ' ', '')) AS letters, lower(p_type) AS kind FROM part) :: SELECT p_partkey, kind, word, size, letters, size * 1.0 AS first FROM p")
def _(spark, sf):
    p = fx.table(spark, sf, "part")
    size = F.regexp_extract("p_brand", "([0-9]+)", 1)
    text = F.concat(F.lit(" "), size, F.lit("X2x 3"))
    return p.select("p_partkey", F.lower("p_type").alias("kind"), F.lower(F.split("p_name", " ")[0]).alias("word"), size.cast("bigint").alias("size"), F.length(F.replace("p_name", F.lit(" "))).cast("bigint").alias("letters"), tables.dimensions(text)[0].alias("first"))


@add("option_texts", "name n", "", "SELECT lower(p_type) AS name, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    p = fx.table(spark, sf, "part").select(F.concat("p_type", F.lit("[4,"), F.col("p_size").cast("string"), F.lit("]")).alias("o"), "p_size")
    name, arguments = tables.option("o")
    return p.select(name.alias("name"), arguments.alias("a"), "p_size").filter((F.size("a") == 2) & (F.col("a")[1].cast("int") == F.col("p_size"))).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@add("date_scalars", "year quarter weekday n", "days", "SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(quarter(o_orderdate) AS INT) AS quarter, CAST(isodow(o_orderdate) AS INT) AS weekday, count(*) AS n, sum(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))) AS days FROM orders GROUP BY ALL")
def _(spark, sf):
    o = fx.table(spark, sf, "orders")
    weekday = (F.weekday("o_orderdate") + 1).cast("int")
    return o.groupBy(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"), weekday.alias("weekday")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.datediff("o_orderdate", F.lit("1995-01-01"))).alias("days"))


@add("json_and_map_scalars", "event_type n", "k", "SELECT event_type, count(*) AS n, sum(CAST(props ->> '$.k' AS DOUBLE)) AS k FROM events GROUP BY event_type")
def _(spark, sf):
    e = fx.table(spark, sf, "events").withColumn("m", tables.json_numbers("props", ["k"]))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.element_at("m", "k")).alias("k"))


@add("table_statistics", "event_type n", "mean variance skewness kurtosis r slope", "e AS (SELECT event_type, value AS v, CAST(user_id AS DOUBLE) AS w FROM events), m AS (SELECT event_type, avg(v) AS m FROM e GROUP BY 1), c AS (SELECT event_type, avg(pow(v - m, 2)) AS m2, avg(pow(v - m, 3)) AS m3, avg(pow(v - m, 4)) AS m4 FROM e JOIN m USING (event_type) GROUP BY 1), s AS (SELECT event_type, count(*) AS n, avg(v) AS mean, var_samp(v) AS variance, corr(v, w) AS r, regr_slope(v, w) AS slope FROM e GROUP BY 1) :: SELECT event_type, n, mean, variance, m3 / pow(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3 AS kurtosis, r, slope FROM s JOIN c USING (event_type)")
def _(spark, sf):
    e = fx.table(spark, sf, "events").select("event_type", F.col("value").alias("v"), F.col("user_id").cast("double").alias("w"))
    return tables.summary(e, "v", "w", ["event_type"])


#: The sketches are held against the exact values: quantiles by their ranks, distinct counts within a tenth.
@add("approximate_aggregates", "event_type near", "", "SELECT event_type, TRUE AS near FROM events GROUP BY event_type")
def _(spark, sf):
    e = fx.table(spark, sf, "events").select("event_type", "value", "user_id")
    got = tables.approximate(e, "value", "user_id", ["event_type"])
    rank = [F.avg((F.col("value") <= F.col("q")[i]).cast("double")).alias(f"r{i}") for i in range(3)]
    exact = e.join(F.broadcast(got), "event_type").groupBy("event_type", "distinct").agg(*rank, F.count_distinct("user_id").alias("d"), F.count(F.lit(1)).alias("n"))
    ok = F.abs(F.col("distinct") / F.col("d") - 1) < 0.1
    for i, p in enumerate((0.05, 0.5, 0.95)):
        ok = ok & (F.abs(F.col(f"r{i}") - p) < 0.01 + 2 / F.col("n"))
    return exact.select("event_type", ok.alias("near"))


@add("hashed_sample", "l_orderkey l_linenumber l_partkey", "l_quantity", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE ('0x' || substr(md5('5|' || l_orderkey || '|' || l_linenumber), 1, 8))::BIGINT < 0.1 * 4294967296")
def _(spark, sf):
    return tables.sample(fx.table(spark, sf, "lineitem"), 0.1, 5, ["l_orderkey", "l_linenumber"])


@add("user_function", "event_id", "v", "SELECT event_id, value / (1 + abs(value / 100)) AS v FROM events")
def _(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", tables.soft_clip(F.col("value"), F.lit(100.0)).alias("v"))


@add("user_aggregate", "event_type", "v", "r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) :: SELECT event_type, avg(value) AS v FROM r WHERE k > n // 10 AND k <= n - n // 10 GROUP BY event_type", 3)
def _(spark, sf):
    return fx.table(spark, sf, "events").groupBy("event_type").agg(tables.trimmed_mean("value").alias("v"))


@add("user_table_function", "user_id start stop length", "", "d AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d FROM events), g AS (SELECT user_id, d, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS g FROM d) :: SELECT user_id, CAST(min(d) AS BIGINT) AS start, CAST(max(d) AS BIGINT) AS stop, count(*) AS length FROM g GROUP BY user_id, g")
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    days = e.groupBy("user_id").agg(F.array_sort(F.collect_set(F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("bigint"))).alias("days"))  # a user's days
    return days.lateralJoin(tables.Runs(F.col("days").outer())).select("user_id", "start", "stop", "length")


@add("rollup_of_sales", "l_returnflag l_linestatus n", "q", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(spark, sf):
    return fx.table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@add("labels_in_both", "label", "", f"{fx.PART_SQL} :: SELECT la AS label FROM img INTERSECT SELECT lb FROM img")
def _(spark, sf):
    a = fx.part_image(spark, sf)
    return a.select(F.col("la").alias("label")).intersect(a.select(F.col("lb").alias("label")))


@add("labels_in_one", "label", "", f"{fx.PART_SQL} :: SELECT la AS label FROM img EXCEPT SELECT lb FROM img")
def _(spark, sf):
    a = fx.part_image(spark, sf)
    return a.select(F.col("la").alias("label")).subtract(a.select(F.col("lb").alias("label")))


@add("largest_orders", "o_orderkey", "o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf):
    return fx.table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")
