"""Resampling, rolling and lagged features, events and outliers on the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.functions import dates
from tidewheel.operators import clean, events, normalize, outliers, resample, series
from tidewheel.operators.statespace import impute_sarima
from tidewheel.plans.base import Catalogue, rounded

C = Catalogue()

_HOURLY = "SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, avg(value) AS value FROM events GROUP BY 1, 2"
_GRID = """SELECT event_type, unnest(generate_series(min(CAST(date_trunc('hour', ts) AS TIMESTAMP)), max(CAST(date_trunc('hour', ts) AS TIMESTAMP)), INTERVAL 1 HOUR)) AS hour FROM events GROUP BY 1"""


def hourly(read):
    """Mean value per event type and hour, an asset's hourly reading."""
    return read("events").groupBy("event_type", dates.truncated(F.col("ts"), "hour").alias("hour")).agg(F.avg("value").alias("value"))


def hourly_grid(read):
    """Hourly readings with empty hours as nulls."""
    return resample.resample(read("events"), "ts", "1 hour", {"value": F.avg("value")}, ["event_type"]).withColumnRenamed("bin", "hour")


def flagged(read):
    return read("events").select("event_type", "event_id", "ts", "value", (F.col("value") > 80).alias("high"))


for _agg, _fn, _zero in (("mean", F.avg, False), ("median", lambda c: F.percentile(c, 0.5), False), ("sum", F.sum, True)):
    _expr = {"mean": "avg(value)", "median": "median(value)", "sum": "sum(value)"}[_agg]

    @C.add(f"resample_6h_{_agg}_spine", f"""
    WITH b AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS bin, {_expr} AS v FROM events GROUP BY 1, 2),
    g AS (SELECT user_id, unnest(generate_series(min(bin), max(bin), INTERVAL 6 HOUR)) AS bin FROM b GROUP BY 1)
    SELECT g.user_id, g.bin, round({"coalesce(v, 0)" if _zero else "v"}, 6) AS v FROM g LEFT JOIN b ON g.user_id = b.user_id AND g.bin = b.bin""")
    def _(read, fn=_fn, zero=_zero):
        out = resample.resample(read("events"), "ts", "6 hours", {"v": fn("value")}, ["user_id"], ("v",) if zero else ())
        return out.select("user_id", "bin", F.round("v", 6).alias("v"))


@C.add("rolling_median_6h", "SELECT event_id, round(median(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 21599999999 MICROSECONDS PRECEDING AND CURRENT ROW), 6) AS rolling FROM events")
def _(read):
    return resample.rolling_values(read("events").select("event_id", "event_type", "ts", "value"), "ts", 6, {"rolling": ("median", "value")}, ["event_type"]).select("event_id", F.round("rolling", 6).alias("rolling"))


@C.add("rolling_mean_30m", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1799999999 MICROSECONDS PRECEDING AND CURRENT ROW), 6) AS rolling FROM events")
def _(read):
    return resample.rolling_values(read("events").select("event_id", "event_type", "ts", "value"), "ts", 0.5, {"rolling": ("mean", "value")}, ["event_type"]).select("event_id", F.round("rolling", 6).alias("rolling"))


@C.add("calendar_lag_1d_7d", f"""WITH h AS ({_HOURLY})
    SELECT h.event_type, h.hour, round(d.value, 6) AS past_day, round(w.value, 6) AS past_week FROM h
    LEFT JOIN h d ON d.event_type = h.event_type AND d.hour = h.hour - INTERVAL 1 DAY LEFT JOIN h w ON w.event_type = h.event_type AND w.hour = h.hour - INTERVAL 7 DAY""")
def _(read):
    out = resample.calendar_lag(hourly(read), "hour", "value", {"past_day": "1 DAY", "past_week": "7 DAYS"}, ["event_type"])
    return out.select("event_type", "hour", F.round("past_day", 6).alias("past_day"), F.round("past_week", 6).alias("past_week"))


@C.add("lag_feature_matrix", f"""WITH h AS ({_HOURLY}), l AS (SELECT event_type, hour,
      lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2, lag(value, 24) OVER w AS value_lag24, lead(value, 1) OVER w AS value_lead1 FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour))
    SELECT event_type, hour, round(value_lag1, 6) AS value_lag1, round(value_lag2, 6) AS value_lag2, round(value_lag24, 6) AS value_lag24, round(value_lead1, 6) AS value_lead1
    FROM l WHERE value_lag1 IS NOT NULL AND value_lag2 IS NOT NULL AND value_lag24 IS NOT NULL AND value_lead1 IS NOT NULL""")
def _(read):
    out = resample.row_lags(hourly(read), "value", "hour", [1, 2, 24], ["event_type"], [1])
    names = ["value_lag1", "value_lag2", "value_lag24", "value_lead1"]
    return out.select("event_type", "hour", *(F.round(n, 6).alias(n) for n in names))


@C.add("trailing_7d_mean", """
    WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2)
    SELECT user_id, CAST(day AS VARCHAR) AS day, round(coalesce(avg(v) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0), 6) AS trailing FROM d""")
def _(read):
    d = read("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return resample.trailing_mean(d, "v", "day", 7, ["user_id"]).select("user_id", F.col("day").cast("string").alias("day"), F.round("trailing", 6).alias("trailing"))


@C.add("sessionize_gap", """
    WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session, ts FROM f)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2 HAVING count(*) > 2""")
def _(read):
    s = events.sessions(read("events"), "ts", 4 * 3600, ["user_id"])
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).where("n > 2")


_FLAG = "f AS (SELECT event_type, event_id, ts, value, value > 80 AS high FROM events)"
_RUNS = f"""{_FLAG}, s AS (SELECT *, CASE WHEN high AND NOT coalesce(lag(high) OVER w, false) THEN 1 ELSE 0 END AS st FROM f WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    r AS (SELECT *, CAST(CASE WHEN high THEN sum(st) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) ELSE 0 END AS INTEGER) AS label FROM s)"""


@C.add("label_islands", f"WITH {_RUNS} SELECT event_id, label FROM r")
def _(read):
    return events.label_runs(flagged(read), "high", "ts", ["event_type"]).select("event_id", "label")


_MERGED = f"""{_FLAG}, p AS (SELECT *, lag(high) OVER w AS ph, max(CASE WHEN high THEN ts END) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt FROM f WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    q AS (SELECT *, CASE WHEN high AND NOT coalesce(ts - pt <= INTERVAL 60 MINUTE AND (ts - pt > INTERVAL 10 MINUTE OR ph), false) THEN 1 ELSE 0 END AS nw FROM p),
    u AS (SELECT *, sum(nw) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM q),
    x AS (SELECT *, min(CASE WHEN high THEN run END) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nr,
      max(CASE WHEN high THEN run END) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS lr FROM u),
    m AS (SELECT *, CAST(CASE WHEN high OR nr = lr THEN run ELSE 0 END AS INTEGER) AS label FROM x)"""


@C.add("label_islands_merged", f"WITH {_MERGED} SELECT event_id, label FROM m")
def _(read):
    return events.label_runs_merged(flagged(read), "high", "ts", 60, ["event_type"], period_minutes=10).select("event_id", "label")


@C.add("event_summary", f"""WITH {_MERGED} SELECT event_type, label, min(ts) AS "start", max(ts) AS "end", round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0, 4) AS duration,
    CAST(sum(CASE WHEN high THEN 1 ELSE 0 END) AS BIGINT) AS flagged, count(*) AS n_rows, round(avg(CASE WHEN high THEN 1.0 ELSE 0 END), 6) AS rat_labeled, max(value) AS peak FROM m WHERE label > 0 GROUP BY 1, 2""")
def _(read):
    rows = events.label_runs_merged(flagged(read), "high", "ts", 60, ["event_type"], period_minutes=10)
    return events.summarize(rows, "label", "ts", "high", ["event_type"], extra={"peak": F.max("value")}).withColumns(rounded("rat_labeled") | rounded("duration", digits=4))


@C.add("boxplot_bounds", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75 FROM events GROUP BY 1)
    SELECT event_type, round(q25, 6) AS q25, round(q75, 6) AS q75, round(q25 - 1.5 * (q75 - q25), 6) AS low, round(q75 + 1.5 * (q75 - q25), 6) AS high FROM q""")
def _(read):
    return outliers.group_fences(read("events"), ["event_type"], "value", 1.5).withColumns(rounded("q25", "q75", "low", "high"))


@C.add("boxplot_flags_by_group", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75 FROM events GROUP BY 1)
    SELECT event_id, value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25) AS outlier FROM events JOIN q USING (event_type)""")
def _(read):
    return outliers.group_outlier_flags(read("events"), ["event_type"], "value", 1.5).select("event_id", "outlier")


@C.add("boxplot_flags_global", """WITH q AS (SELECT quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75 FROM events)
    SELECT event_id, value < q25 - 3 * (q75 - q25) OR value > q75 + 3 * (q75 - q25) AS outlier FROM events, q""")
def _(read):
    return outliers.outlier_flags(read("events"), "value").select("event_id", "outlier")


@C.add("fleet_outliers", f"""WITH h AS ({_HOURLY}), r AS (SELECT *, value - median(value) OVER (PARTITION BY hour) AS residual, count(*) OVER (PARTITION BY hour) - 1 AS others FROM h),
    q AS (SELECT quantile_cont(abs(residual), 0.25) AS q25, quantile_cont(abs(residual), 0.75) AS q75 FROM r)
    SELECT event_type, hour, round(value, 6) AS value, round(residual, 6) AS residual, others FROM r, q WHERE others >= 3 AND abs(residual) > q75 + 3 * (q75 - q25)""")
def _(read):
    h = hourly(read)
    fleet = h.groupBy("hour").agg(F.percentile("value", 0.5).alias("_mid"), F.count(F.lit(1)).alias("_n"))
    r = h.join(fleet, "hour").withColumns({"residual": F.col("value") - F.col("_mid"), "others": F.col("_n") - 1}).withColumn("_size", F.abs("residual"))
    out = outliers.outlier_flags(r, "_size", 3.0).where("outlier and others >= 3 and _size > 0")
    return out.select("event_type", "hour", F.round("value", 6).alias("value"), F.round("residual", 6).alias("residual"), "others")


@C.add("interpolate_linear", f"""WITH g AS ({_GRID}), h AS ({_HOURLY}), j AS (SELECT g.event_type, g.hour, h.value, row_number() OVER (PARTITION BY g.event_type ORDER BY g.hour) AS i FROM g LEFT JOIN h USING (event_type, hour)),
    k AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY event_type ORDER BY i ROWS UNBOUNDED PRECEDING) AS pi, min(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM j)
    SELECT k.event_type, k.hour, round(CASE WHEN k.value IS NOT NULL THEN k.value WHEN n.value IS NULL THEN p.value ELSE p.value + (n.value - p.value) * (k.i - p.i) / (n.i - p.i) END, 6) AS value
    FROM k LEFT JOIN j p ON p.event_type = k.event_type AND p.i = k.pi LEFT JOIN j n ON n.event_type = k.event_type AND n.i = k.ni""")
def _(read):
    return resample.interpolate(hourly_grid(read), "value", "hour", ["event_type"]).select("event_type", "hour", F.round("value", 6).alias("value"))


@C.add("upsample_linear", """WITH h AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS hour, avg(value) AS value FROM events GROUP BY 1, 2), g AS (SELECT user_id, unnest(generate_series(min(hour), max(hour), INTERVAL 6 HOUR)) AS hour FROM h GROUP BY 1),
    j AS (SELECT g.user_id, g.hour, h.value, row_number() OVER (PARTITION BY g.user_id ORDER BY g.hour) AS i FROM g LEFT JOIN h USING (user_id, hour)),
    k AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS pi, min(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM j)
    SELECT k.user_id, k.hour AS bin, round(CASE WHEN k.value IS NOT NULL THEN k.value ELSE p.value + (n.value - p.value) * (k.i - p.i) / (n.i - p.i) END, 6) AS value FROM k JOIN j p ON p.user_id = k.user_id AND p.i = k.pi JOIN j n ON n.user_id = k.user_id AND n.i = k.ni""")
def _(read):
    return resample.upsample(read("events"), "ts", "value", "6 hours", ["user_id"]).select("user_id", "bin", F.round("value", 6).alias("value"))


@C.add("resample_scaled", """WITH b AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS bin, sum(value) AS v FROM events GROUP BY 1, 2), g AS (SELECT user_id, unnest(generate_series(min(bin), max(bin), INTERVAL 6 HOUR)) AS bin FROM b GROUP BY 1),
    f AS (SELECT g.user_id, g.bin, coalesce(v, 0) AS v FROM g LEFT JOIN b ON g.user_id = b.user_id AND g.bin = b.bin)
    SELECT user_id, bin, round((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 6) AS n_value FROM f WINDOW w AS (PARTITION BY user_id)""")
def _(read):
    return normalize.resampled_scaled(read("events"), "ts", "6 hours", ["value"], ["user_id"]).select("user_id", "bin", F.round("n_value", 6).alias("n_value"))


@C.add("scaled_without_outliers", """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events), r AS (SELECT event_id, value FROM events, q WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))
    SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS n_value FROM r""")
def _(read):
    return normalize.scaled_within_fences(read("events"), "value", 1.5).select("event_id", F.round("n_value", 6).alias("n_value"))


@C.add("fleet_mean_imputation", f"""WITH g AS ({_GRID}), h AS ({_HOURLY}), m AS (SELECT hour, avg(value) AS fleet FROM h GROUP BY 1)
    SELECT g.event_type, g.hour, round(coalesce(h.value, m.fleet), 6) AS value FROM g LEFT JOIN h USING (event_type, hour) LEFT JOIN m ON m.hour = g.hour""")
def _(read):
    g = hourly_grid(read)
    fleet = g.groupBy("hour").agg(F.avg("value").alias("_fleet"))
    return g.join(fleet, "hour", "left").select("event_type", "hour", F.round(F.coalesce("value", "_fleet"), 6).alias("value"))


@C.add("pattern_imputation", f"""WITH g AS ({_GRID}), h AS ({_HOURLY}), s AS (SELECT g.event_type, g.hour, CAST(floor(epoch(g.hour) / 3600) AS BIGINT) AS i, h.value AS v FROM g LEFT JOIN h ON h.event_type = g.event_type AND h.hour = g.hour),
    n AS (SELECT *, max(i) FILTER (v IS NOT NULL) OVER (PARTITION BY event_type ORDER BY i) AS before, min(i) FILTER (v IS NOT NULL) OVER (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM s),
    f AS (SELECT n.event_type, n.hour, n.i, n.v, n.before + 1 AS gap, a.v + (b.v - a.v) * (n.i - n.before) / greatest(n.after - n.before, 1) AS y FROM n JOIN s a ON a.event_type = n.event_type AND a.i = n.before JOIN s b ON b.event_type = n.event_type AND b.i = n.after),
    d AS (SELECT *, y - lag(y) OVER (PARTITION BY event_type ORDER BY i) AS d FROM f), w AS (SELECT *, d - lag(d, 24) OVER (PARTITION BY event_type ORDER BY i) AS w FROM d), z AS (SELECT *, lag(w, 24) OVER (PARTITION BY event_type ORDER BY i) AS x FROM w),
    o AS (SELECT q.event_type, q.gap, min(k.i) AS first FROM (SELECT DISTINCT event_type, gap FROM f WHERE v IS NULL) q JOIN s k ON k.event_type = q.event_type AND k.v IS NOT NULL AND k.i < q.gap AND k.i >= q.gap - 360 GROUP BY 1, 2),
    p AS (SELECT o.event_type, o.gap, o.gap - o.first AS n, sum(z.w * z.x) AS wx, sum(z.x * z.x) AS xx FROM o LEFT JOIN z ON z.event_type = o.event_type AND z.i >= o.first + 49 AND z.i < o.gap GROUP BY ALL),
    r AS (SELECT event_type, gap, n, CASE WHEN n > 51 AND xx > 0 THEN greatest(-0.99, least(0.99, wx / xx)) ELSE 0 END AS phi FROM p),
    m AS (SELECT f.event_type, f.hour, f.i, f.gap, r.n, l.y AS last, CASE WHEN r.n < 50 THEN 0 ELSE b.d + b.w * r.phi * (1 - r.phi ** ((f.i - f.gap) // 24 + 1)) / (1 - r.phi) END AS step FROM f JOIN r ON r.event_type = f.event_type AND r.gap = f.gap JOIN f l ON l.event_type = f.event_type AND l.i = f.gap - 1
    LEFT JOIN w b ON b.event_type = f.event_type AND b.i = f.gap - 24 + (f.i - f.gap) % 24 WHERE f.v IS NULL),
    c AS (SELECT event_type, i, last + sum(step) OVER (PARTITION BY event_type, gap ORDER BY i) AS value FROM m)
    SELECT s.event_type, s.hour, round(coalesce(s.v, c.value), 6) AS value, s.v IS NULL AND c.value IS NOT NULL AS imputed FROM s LEFT JOIN c ON c.event_type = s.event_type AND c.i = s.i""")
def _(read):
    return series.impute_pattern(hourly_grid(read), ["event_type"], "hour", "value").select("event_type", "hour", F.round("value", 6).alias("value"), "imputed")


@C.add("pattern_imputation_sarima")
def _(read):
    return impute_sarima(hourly_grid(read), ["event_type"], "hour", "value").select("event_type", "hour", F.round("value", 6).alias("value"), "imputed")


@C.add("threshold_severity", """SELECT event_id, round(100 * value / 120.0, 6) AS value_pct,
    CASE WHEN 100 * value / 120.0 > 100 THEN 'incident' WHEN 100 * value / 120.0 > 60 AND 100 * value / 120.0 < 101 THEN 'warning' ELSE 'No event' END AS severity FROM events""")
def _(read):
    rows = clean.threshold_percent(read("events").select("event_id", "value"), {"value": 120.0})
    kind = clean.severity(["value_pct"], [("warning", 60, 101), ("incident", 100, float("inf"))])
    return rows.select("event_id", F.round("value_pct", 6).alias("value_pct"), kind.alias("severity"))


@C.add("others_active_count", f"WITH h AS ({_HOURLY}) SELECT event_type, hour, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY hour) - CASE WHEN value > 50 THEN 1 ELSE 0 END AS BIGINT) AS others FROM h")
def _(read):
    on = (F.col("value") > 50).cast("long")
    return hourly(read).select("event_type", "hour", (F.sum(on).over(Window.partitionBy("hour")) - on).alias("others"))


@C.add("sequence_windows", """WITH n AS (SELECT user_id, ts, value, row_number() OVER w AS i, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b, lag(value, 3) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT user_id, ts, round(a + b + c, 6) AS window_sum, value AS label FROM n WHERE i > 3""")
def _(read):
    w = resample.sequence_windows(read("events").withColumn("label", F.col("value")), ["value"], "ts", 3, ["user_id"], "label")
    total = F.aggregate("window", F.lit(0.0), lambda s, x: s + x["value"])
    return w.select("user_id", "ts", F.round(total, 6).alias("window_sum"), "label")


@C.add("rush_hour_flag", """WITH d AS (SELECT CAST(ts AS DATE) AS day, hour(ts) AS hour, count(DISTINCT user_id) AS n FROM events WHERE isodow(ts) <= 5 GROUP BY 1, 2),
    t AS (SELECT quantile_cont(n, 0.75) AS cut FROM d), h AS (SELECT hour, max(n) AS n FROM d GROUP BY 1) SELECT CAST(hour AS INTEGER) AS hour, n, n > cut AS rush FROM h, t""")
def _(read):
    from tidewheel.operators.quantiles import exact_quantiles

    d = read("events").where(F.weekday("ts") < 5).groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.countDistinct("user_id").alias("n"))
    cut = exact_quantiles(d, "n", [0.75])[0]
    return d.groupBy("hour").agg(F.max("n").alias("n")).withColumn("rush", F.col("n") > cut)


@C.add("date_parts", """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(month(ts) AS INTEGER) AS month, strftime(ts, '%a') AS day_name, strftime(ts, '%H') AS hour_text, isodow(ts) >= 6 AS weekend FROM events""")
def _(read):
    p = dates.parts(F.col("ts"))
    return read("events").select("event_id", *(p[k].alias(k) for k in ("hour", "weekday", "month", "day_name", "hour_text", "weekend")))


@C.add("cyclic_encoding", "SELECT event_id, round(sin(hour(ts) * 2 * pi() / 24), 6) + 0.0 AS hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 6) + 0.0 AS hour_cos FROM events")
def _(read):
    s, c = dates.cyclic(F.hour("ts"), 24)
    return read("events").select("event_id", (F.round(s, 6) + 0.0).alias("hour_sin"), (F.round(c, 6) + 0.0).alias("hour_cos"))


@C.add("drift_flags", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sqrt(avg(value * value)) AS rmse FROM events GROUP BY 1, 2), t AS (SELECT user_id, avg(rmse) + stddev_samp(rmse) AS cut FROM d GROUP BY 1),
    f AS (SELECT d.user_id, d.day, coalesce(rmse > cut, false) AS over_ FROM d JOIN t USING (user_id))
    SELECT user_id, CAST(day AS VARCHAR) AS day, over_ AS over_threshold, count(*) OVER w >= 2 AND min(CAST(over_ AS INTEGER)) OVER w = 1 AS drift FROM f WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS 1 PRECEDING)""")
def _(read):
    from tidewheel.operators.learning import drift_flags

    d = read("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rmse"))
    return drift_flags(d, "user_id", "day", "rmse", spread=1.0, days=2).withColumn("day", F.col("day").cast("string"))


@C.add("drift_days", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sqrt(avg(value * value)) AS rmse FROM events GROUP BY 1, 2), t AS (SELECT user_id, avg(rmse) + stddev_samp(rmse) AS cut FROM d GROUP BY 1),
    f AS (SELECT d.user_id, d.day, coalesce(rmse > cut, false) AS over_ FROM d JOIN t USING (user_id)),
    g AS (SELECT user_id, day, count(*) OVER w >= 2 AND min(CAST(over_ AS INTEGER)) OVER w = 1 AS drift FROM f WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS 1 PRECEDING)),
    u AS (SELECT user_id, user_id % 7 AS c, min(day) FILTER (drift) AS gone FROM g GROUP BY 1),
    k AS (SELECT a.c, b.day FROM (SELECT DISTINCT c FROM u) a, (SELECT DISTINCT day FROM g) b WHERE (SELECT count(*) FROM u WHERE u.c = a.c AND (gone IS NULL OR gone > b.day)) / CAST((SELECT count(*) FROM u) AS DOUBLE) <= 0.13),
    e AS (SELECT c, min(day) AS closed FROM k GROUP BY 1), m AS (SELECT least(gone, closed) AS day, count(*) AS n_new FROM u LEFT JOIN e USING (c) WHERE gone IS NOT NULL OR closed IS NOT NULL GROUP BY 1)
    SELECT CAST(day AS VARCHAR) AS day, n_new, CAST(sum(n_new) OVER (ORDER BY day) AS BIGINT) AS n_waiting, sum(n_new) OVER (ORDER BY day) / CAST((SELECT count(*) FROM u) AS DOUBLE) >= 0.16 AS retrain FROM m""")
def _(read):
    from tidewheel.operators.learning import drift_days, drift_flags

    d = read("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rmse"))
    clusters = read("events").select("user_id", (F.col("user_id") % 7).alias("cluster")).distinct()
    return drift_days(drift_flags(d, "user_id", "day", "rmse", spread=1.0, days=2), clusters, "user_id", "day", support=0.13).withColumn("day", F.col("day").cast("string"))


def _sdt(dev: float | None, last: bool) -> str:
    """Tables of SQL: z, the readings in order; w, the doors walked reading by reading; k, the readings kept."""
    limit = f"SELECT DISTINCT event_type, {dev}::DOUBLE AS dev FROM z" if dev is not None else """SELECT event_type, coalesce(avg(slope) FILTER (slope <> 0), 0) AS dev
    FROM (SELECT event_type, coalesce(abs((v - lag(v) OVER o) / nullif(t - lag(t) OVER o, 0)), 0) AS slope, lag(t) OVER o AS before FROM z WINDOW o AS (PARTITION BY event_type ORDER BY i)) WHERE before IS NOT NULL GROUP BY 1"""
    return f"""z AS (SELECT event_type, event_id, ts, value AS v, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events WHERE value IS NOT NULL),
    dv AS ({limit}),
    s AS (SELECT z.event_type, z.i, z.t, z.v, dev FROM z JOIN dv USING (event_type)),
    w AS (SELECT event_type, i, t AS pt, v AS pv, i AS at_, '-inf'::DOUBLE AS hi, 'inf'::DOUBLE AS lo, i AS kept FROM s WHERE i = 0
    UNION ALL SELECT event_type, i, CASE WHEN turn THEN bt ELSE pt END, CASE WHEN turn THEN bv ELSE pv END, CASE WHEN turn THEN i - 1 ELSE at_ END,
    CASE WHEN turn THEN CASE WHEN t > bt THEN (v - bv - dev) / (t - bt) ELSE '-inf'::DOUBLE END WHEN t = pt THEN hi ELSE greatest(hi, (v - pv - dev) / (t - pt)) END,
    CASE WHEN turn THEN CASE WHEN t > bt THEN (v - bv + dev) / (t - bt) ELSE 'inf'::DOUBLE END WHEN t = pt THEN lo ELSE least(lo, (v - pv + dev) / (t - pt)) END, CASE WHEN turn THEN i - 1 END
    FROM (SELECT w.event_type, s.i, s.t, s.v, s.dev, w.pt, w.pv, w.at_, w.hi, w.lo, b.t AS bt, b.v AS bv, s.t <> w.pt AND greatest(w.hi, (s.v - w.pv - s.dev) / nullif(s.t - w.pt, 0)) > least(w.lo, (s.v - w.pv + s.dev) / nullif(s.t - w.pt, 0)) AS turn
    FROM w JOIN s ON s.event_type = w.event_type AND s.i = w.i + 1 JOIN s b ON b.event_type = w.event_type AND b.i = w.i)),
    k AS (SELECT event_type, kept AS i FROM w WHERE kept IS NOT NULL{' UNION SELECT event_type, max(i) FROM z GROUP BY 1' if last else ''})"""


@C.add("sdt_compress", f"WITH RECURSIVE {_sdt(None, False)} SELECT z.event_type, event_id, ts, v AS value FROM z JOIN (SELECT DISTINCT event_type, i FROM k) k ON k.event_type = z.event_type AND k.i = z.i")
def _(read):
    return series.compress(read("events").select("event_type", "event_id", "ts", "value"), ["event_type"], "ts", "value", ties=["event_id"])


@C.add("sdt_ratio", f"WITH RECURSIVE {_sdt(50.0, False)} SELECT (SELECT count(*) FROM events) AS rows_before, count(*) AS rows_after, round((SELECT count(*) FROM events) / count(*)::DOUBLE, 6) AS ratio FROM (SELECT DISTINCT event_type, i FROM k)")
def _(read):
    rows = read("events").select("event_type", "event_id", "ts", "value")
    return series.compression_ratio(rows, series.compress(rows, ["event_type"], "ts", "value", dev=50.0, ties=["event_id"])).withColumns(rounded("ratio"))


@C.add("sdt_reconstruction_rmse", f"""WITH RECURSIVE {_sdt(20.0, True)}, q AS (SELECT DISTINCT z.event_type, z.i, z.t, z.v FROM z JOIN k ON k.event_type = z.event_type AND k.i = z.i), l AS (SELECT *, lead(t) OVER o AS t2, lead(v) OVER o AS v2 FROM q WINDOW o AS (PARTITION BY event_type ORDER BY i)),
    j AS (SELECT z.event_type, z.t, z.v, l.t AS t1, l.v AS v1, l.t2, l.v2 FROM z ASOF JOIN l ON z.event_type = l.event_type AND z.t >= l.t)
    SELECT event_type, round(sqrt(avg((CASE WHEN t2 IS NULL OR t = t1 THEN v1 ELSE v1 + (v2 - v1) / (t2 - t1) * (t - t1) END - v) ** 2)), 6) AS rmse FROM j GROUP BY 1""")
def _(read):
    rows = read("events").select("event_type", "event_id", "ts", "value")
    return series.reconstruction_error(rows, series.compress(rows, ["event_type"], "ts", "value", dev=20.0, keep_last=True, ties=["event_id"]), ["event_type"], "ts", "value").withColumns(rounded("rmse"))


@C.add("stl_components")
def _(read):
    return series.decompose(hourly_grid(read), ["event_type"], "hour", "value", 24)


@C.add("savgol_smooth", f"""WITH h AS ({_HOURLY}), n AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour)),
    s AS (SELECT *, (least(11, n - 1 + n % 2) - 1) // 2 AS m FROM n), c AS (SELECT *, greatest(0, least(i - m, n - 2 * m - 1)) AS a FROM s),
    p AS (SELECT c.event_type, c.hour, c.value, c.m, c.i - c.a - c.m AS x, sum(o.value) AS y0, sum(o.value * (o.i - c.a - c.m)) AS y1, sum(o.value * (o.i - c.a - c.m) * (o.i - c.a - c.m)) AS y2,
    2 * c.m + 1.0 AS k, c.m * (c.m + 1) * (2 * c.m + 1) / 3.0 AS x2, c.m * (c.m + 1) * (2 * c.m + 1) * (3 * c.m * c.m + 3 * c.m - 1) / 15.0 AS x4
    FROM c JOIN c o ON o.event_type = c.event_type AND o.i BETWEEN c.a AND c.a + 2 * c.m GROUP BY ALL)
    SELECT event_type, hour, round(value, 6) AS value, round(CASE WHEN m = 0 THEN value ELSE (x4 * y0 - x2 * y2) / (k * x4 - x2 * x2) + y1 / x2 * x + (k * y2 - x2 * y0) / (k * x4 - x2 * x2) * x * x END, 6) AS smooth FROM p""")
def _(read):
    return series.smooth(hourly(read), ["event_type"], "hour", "value", "savgol", 11).withColumns(rounded("value", "smooth"))


@C.add("gaussian_smooth", f"""WITH h AS ({_HOURLY}), n AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour)),
    r AS (SELECT n.*, d, exp(-0.5 * (d / 1.125) * (d / 1.125)) AS w, ((i + d) % (2 * n) + 2 * n) % (2 * n) AS q FROM n, range(-5, 6) t(d)), j AS (SELECT *, CASE WHEN q < n THEN q ELSE 2 * n - 1 - q END AS at FROM r)
    SELECT j.event_type, j.hour, round(j.value, 6) AS value, round(sum(j.w * o.value) / sum(j.w), 6) AS smooth FROM j JOIN n o ON o.event_type = j.event_type AND o.i = j.at GROUP BY j.event_type, j.hour, j.value""")
def _(read):
    return series.smooth(hourly(read), ["event_type"], "hour", "value", "gaussian", 11).withColumns(rounded("value", "smooth"))


def _rise(part: str, i: str) -> str:
    """SQL of a part's value: the mean root of what its readings lie below their running peak, times the peak's rise."""
    peak = f"list_max({part}[1:{i}])"
    return f"list_avg(list_transform(range(1, len({part}) + 1), lambda {i}: sqrt(greatest(({peak} - {part}[1]) * ({peak} - {part}[{i}]), 0))))"


@C.add("aib_splits", f"""WITH RECURSIVE d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS value FROM events GROUP BY 1, 2), y AS (SELECT event_type, list(value ORDER BY day) FILTER (value IS NOT NULL) AS y FROM d GROUP BY 1),
    t AS (SELECT event_type, y, 0 AS a, len(y) AS b, NULL::BIGINT AS split FROM y
    UNION ALL SELECT event_type, y, unnest([a, best.k]), unnest([best.k + 1, b]), best.k FROM (SELECT *, list_max(list_transform(range(a + 1, b - 1), lambda k: {{'score': {_rise('y[a + 1:k + 1]', 'i')} + {_rise('y[k + 1:b]', 'j')}, 'least': -k, 'k': k}})) AS best FROM t WHERE b - a >= 3)
    WHERE best.score > {_rise('y[a + 1:b]', 'm')})
    SELECT DISTINCT event_type, CAST(split AS INTEGER) AS split FROM t WHERE split IS NOT NULL""")
def _(read):
    daily = read("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    return series.split_points(daily, ["event_type"], "day", "value")


QUERIES, ORACLE_SQL = C.queries, C.sql
