"""Chart data: what plots of the tables are drawn from."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.operators import binning, charts
from tidewheel.plans.base import Catalogue, rounded

C = Catalogue()


@C.add("histogram_edges", """WITH e(i, lo, hi) AS (VALUES (0, 0.0, 50000.0), (1, 50000.0, 100000.0), (2, 100000.0, 300000.0), (3, 300000.0, 600000.0))
    SELECT CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, count(o_orderkey) AS n FROM e LEFT JOIN orders ON o_totalprice >= lo AND (o_totalprice < hi OR (i = 3 AND o_totalprice = hi)) GROUP BY 1, 2""")
def _(read):
    return charts.histogram(read("orders"), "o_totalprice", [0, 50000, 100000, 300000, 600000])


@C.add("histogram_counted", "SELECT l_quantity - 0.0 AS quantity, count(*) AS n FROM lineitem GROUP BY 1")
def _(read):
    h = charts.histogram(read("lineitem"), "l_quantity", [k + 0.5 for k in range(51)])
    return h.where("n > 0").select((F.col("lo") + 0.5).alias("quantity"), "n")


@C.add("box_summary", "SELECT l_returnflag, count(l_extendedprice) AS n, min(l_extendedprice) AS low, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, max(l_extendedprice) AS high FROM lineitem GROUP BY 1")
def _(read):
    return charts.box_summary(read("lineitem"), ["l_returnflag"], "l_extendedprice").withColumns(rounded("q25", "median", "q75", digits=4))


@C.add("percentile_trim", "WITH q AS (SELECT quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events) SELECT event_id FROM events, q WHERE value BETWEEN a AND b")
def _(read):
    return charts.trimmed(read("events"), "value").select("event_id")


@C.add("heatmap_day_hour", f"""SELECT CAST(isodow(ts) AS INTEGER) AS "row", {", ".join(f'round(coalesce(sum(value) FILTER (WHERE hour(ts) = {h}), 0), 4) AS "{h}"' for h in range(24))} FROM events GROUP BY 1""")
def _(read):
    out = charts.heatmap(read("events"), F.weekday("ts") + 1, F.hour("ts"), list(range(24)), F.sum("value"), 0.0)
    return out.select("row", *(F.round(str(h), 4).alias(str(h)) for h in range(24)))


@C.add("share_per_day", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY CAST(ts AS DATE)), 6) AS percent FROM events GROUP BY CAST(ts AS DATE), event_type")
def _(read):
    return charts.share_per_day(read("events"), F.to_date("ts").cast("string"), "event_type").withColumns(rounded("percent"))


@C.add("yearly_overlay", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(dayofyear(o_orderdate) AS INTEGER) AS day_of_year, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 1, 2")
def _(read):
    return charts.yearly_overlay(read("orders"), "o_orderdate", "o_totalprice").withColumns(rounded("value"))


@C.add("error_change", "SELECT l_returnflag, round(avg(abs(1000.0 * l_quantity - l_extendedprice) - abs(1500.0 * l_quantity - l_extendedprice)), 4) AS gain, count(*) AS n FROM lineitem GROUP BY 1")
def _(read):
    rows = read("lineitem").select("l_returnflag", "l_extendedprice", (1000.0 * F.col("l_quantity")).alias("a"), (1500.0 * F.col("l_quantity")).alias("b"))
    return charts.error_change(rows, ["l_returnflag"], "l_extendedprice", "a", "b").withColumns(rounded("gain", digits=4))


@C.add("row_percent", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS percent FROM orders GROUP BY 1, 2")
def _(read):
    return charts.row_percent(read("orders"), "o_orderstatus", "o_orderpriority").withColumns(rounded("percent"))


@C.add("median_per_rank", "WITH r AS (SELECT l_quantity, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate) AS INTEGER) AS stop FROM lineitem) SELECT stop, median(l_quantity) AS median_quantity, count(*) AS n FROM r GROUP BY 1")
def _(read):
    from pyspark.sql import Window

    stop = F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate"))
    return read("lineitem").select("l_quantity", stop.alias("stop")).groupBy("stop").agg(F.percentile("l_quantity", 0.5).alias("median_quantity"), F.count(F.lit(1)).alias("n"))


@C.add("rank_by_mean_top20", """WITH m AS (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS mean, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY l_returnflag ORDER BY mean DESC) AS INTEGER) AS place FROM m)
    SELECT l_returnflag, l_suppkey, round(mean, 6) AS mean, place FROM k WHERE place < 21""")
def _(read):
    from pyspark.sql import Window

    m = read("lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_quantity").alias("mean"))
    place = F.dense_rank().over(Window.partitionBy("l_returnflag").orderBy(F.desc("mean")))
    return m.withColumn("place", place).where("place < 21").withColumns(rounded("mean"))


@C.add("wide_totals", """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) FILTER (WHERE event_type = 'view') AS "view", count(*) FILTER (WHERE event_type = 'click') AS click FROM events GROUP BY 1""")
def _(read):
    rows = read("events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type")
    return rows.groupBy("hour").pivot("event_type", ["view", "click"]).count().na.fill(0)


@C.add("equal_width_bins", """WITH r AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), b AS (SELECT p_partkey, greatest(1, len(list_filter(range(0, 9), lambda k: k * ((hi - lo) / 9) + lo < p_retailprice))) - 1 AS i FROM part, r) SELECT CAST(i AS INTEGER) AS bin, count(*) AS n FROM b GROUP BY 1""")
def _(read):
    b = binning.Bins.equal(read("part"), "p_retailprice", 10)
    return read("part").groupBy(b.number().alias("bin")).agg(F.count(F.lit(1)).alias("n"))


QUERIES, ORACLE_SQL = C.queries, C.sql
