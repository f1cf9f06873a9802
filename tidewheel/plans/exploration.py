"""Exploration: shares, curves, correlations, relevancy, metrics, scalar functions, name patterns."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidewheel.functions import angles, geo, text
from tidewheel.operators import aggregate, metrics, patterns
from tidewheel.plans.base import Catalogue, half_up, rounded

C = Catalogue()
_KINDS = ["click", "error", "purchase", "signup", "view"]


@C.add("pivot_day_hour", f"""SELECT CAST(isodow(ts) AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, {", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in _KINDS)} FROM events GROUP BY 1, 2""")
def _(read):
    rows = read("events").select((F.weekday("ts") + 1).alias("weekday"), F.hour("ts").alias("hour"), "event_type")
    return aggregate.pivoted(rows, ["weekday", "hour"], "event_type", _KINDS, F.count(F.lit(1)), 0)


@C.add("unpivot_long", "SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount' AS variable, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax FROM lineitem")
def _(read):
    return read("lineitem").unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["l_discount", "l_tax"], "variable", "value")


@C.add("share_within_group", "SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS percent FROM events GROUP BY 1, 2")
def _(read):
    return aggregate.share_within(read("events").select("event_type", F.hour("ts").alias("hour")), ["event_type", "hour"], ["event_type"]).withColumns(rounded("percent"))


@C.add("cumulative_curve", """WITH n AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, l_quantity, n, CAST(sum(n) OVER w AS BIGINT) AS running, round(100.0 * n / sum(n) OVER (PARTITION BY l_returnflag), 6) AS percent,
      round(100.0 * sum(n) OVER w / sum(n) OVER (PARTITION BY l_returnflag), 6) AS running_percent FROM n WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity ROWS UNBOUNDED PRECEDING)""")
def _(read):
    return aggregate.cumulative_curve(read("lineitem"), "l_quantity", ["l_returnflag"]).withColumns(rounded("percent", "running_percent"))


@C.add("value_counts", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def _(read):
    n = read("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_t")))).select("event_type", "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))


@C.add("top_bottom_n", """WITH t AS (SELECT p_partkey, p_retailprice FROM part), a AS (SELECT *, 'top' AS side FROM t ORDER BY p_retailprice DESC, p_partkey LIMIT 5), b AS (SELECT *, 'bottom' AS side FROM t ORDER BY p_retailprice, p_partkey LIMIT 5) SELECT * FROM a UNION ALL SELECT * FROM b""")
def _(read):
    return aggregate.top_bottom(read("part").select("p_partkey", "p_retailprice"), "p_retailprice", 5, ["p_partkey"])


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@C.add("corr_matrix_long", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]))
def _(read):
    return aggregate.correlations(read("lineitem"), _COLS).withColumns(rounded("r"))


@C.add("autocorr_lags", """WITH h AS (SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, avg(value) AS v FROM events GROUP BY 1, 2), l AS (SELECT v, lag(v, 1) OVER w AS a, lag(v, 24) OVER w AS b FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour))
    SELECT 1 AS lag, round(corr(v, a), 6) AS r FROM l UNION ALL SELECT 24, round(corr(v, b), 6) FROM l""")
def _(read):
    h = read("events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("v"))
    return aggregate.autocorrelation(h, "v", "hour", [1, 24], ["event_type"]).withColumns(rounded("r"))


@C.add("linear_fit", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def _(read):
    return aggregate.linear_fit(read("lineitem"), "l_quantity", "l_extendedprice").select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r", 6).alias("r"))


@C.add("relevancy_tfidf", """WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT *, n / max(n) OVER (PARTITION BY user_id) AS tf FROM n),
    i AS (SELECT event_type, ln((SELECT count(DISTINCT user_id) FROM n) / count(*)) AS idf FROM n GROUP BY 1) SELECT user_id, event_type, round(tf, 6) AS tf, round(idf, 6) AS idf, round(tf * idf, 6) AS score FROM t JOIN i USING (event_type)""")
def _(read):
    return aggregate.relevancy(read("events"), "user_id", "event_type").withColumns(rounded("tf", "idf", "score"))


@C.add("mode_per_group", "SELECT c_mktsegment, CAST(min(c_nationkey) AS INTEGER) AS mode FROM (SELECT c_mktsegment, c_nationkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC) AS r FROM customer GROUP BY 1, 2) WHERE r = 1 GROUP BY 1")
def _(read):
    return read("customer").groupBy("c_mktsegment").agg(F.mode("c_nationkey", deterministic=True).alias("mode"))


_OBS = "WITH t AS (SELECT l_extendedprice AS obs, 2000.0 * l_quantity AS pred FROM lineitem), m AS (SELECT avg(obs) AS m FROM t)"


@C.add("regression_metrics", f"""{_OBS} SELECT round(sqrt(avg((obs - pred) * (obs - pred))), 4) AS rmse, round(sqrt(avg((obs - pred) * (obs - pred))) / avg(obs), 6) AS nrmse, round(avg(abs(obs - pred)), 4) AS mae,
    round(sum(abs(obs - pred)) / sum(abs(m - obs)), 6) AS rae, round(sqrt(sum((obs - pred) * (obs - pred)) / sum((m - obs) * (m - obs))), 6) AS rrse, round(avg(abs((obs - pred) / obs)), 6) AS mape FROM t, m""")
def _(read):
    t = read("lineitem").select(F.col("l_extendedprice").alias("obs"), (2000.0 * F.col("l_quantity")).alias("pred"))
    return metrics.regression_errors(t, "obs", "pred").withColumns(rounded("nrmse", "rae", "rrse", "mape") | rounded("rmse", "mae", digits=4))


_ROC = "WITH t AS (SELECT CAST(n_chars AS DOUBLE) AS s, quality AS y FROM documents JOIN labels USING (doc_id)), g AS (SELECT s AS threshold, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS n FROM t GROUP BY 1), c AS (SELECT threshold, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM g WINDOW w AS (ORDER BY threshold DESC))"


def _scored(read):
    return read("documents").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(read("labels").select("doc_id", "quality"), "doc_id")


@C.add("roc_curve", f"{_ROC} SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / pp, 6) AS tpr, round(fp / nn, 6) AS fpr FROM c")
def _(read):
    return metrics.roc_curve(_scored(read), "score", "quality").withColumns(rounded("tpr", "fpr"))


@C.add("roc_auc", f"{_ROC} SELECT round(sum(n * (tp - p / 2)) / (max(pp) * max(nn)), 6) AS auc FROM c")
def _(read):
    return metrics.auc(_scored(read), "score", "quality").withColumns(rounded("auc"))


@C.add("tpr_at_fpr", f"{_ROC} SELECT round(max(tp / pp), 6) AS tpr FROM c WHERE fp / nn <= 0.1")
def _(read):
    return metrics.tpr_at_fpr(metrics.roc_curve(_scored(read), "score", "quality"), 0.1).withColumns(rounded("tpr"))


@C.add("confusion_metrics", """WITH t AS (SELECT quality AS y, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p <> 1) AS fn, count(*) FILTER (WHERE y <> 1 AND p <> 1) AS tn FROM t)
    SELECT tp, fp, fn, tn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""")
def _(read):
    rows = _scored(read).withColumn("predicted", (F.col("score") > 500).cast("int"))
    return metrics.binary_scores(rows, "quality", "predicted").withColumns(rounded("accuracy", "precision", "recall", "f1"))


@C.add("confusion_matrix", "SELECT quality, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS predicted, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def _(read):
    return metrics.confusion(_scored(read).withColumn("predicted", (F.col("score") > 500).cast("int")), "quality", "predicted")


@C.add("hist_intersection", """WITH a AS (SELECT floor(l_quantity / 5) AS b, count(*) / sum(count(*)) OVER () AS h FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT floor(l_quantity / 5) AS b, count(*) / sum(count(*)) OVER () AS h FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT round(sum(least(a.h, r.h)), 6) AS intersection FROM a JOIN r ON a.b = r.b""")
def _(read):
    def hist(flag):
        n = read("lineitem").where(F.col("l_returnflag") == flag).groupBy(F.floor(F.col("l_quantity") / 5).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("b", (F.col("n") / F.col("t")).alias("h"))

    return metrics.histogram_intersection(hist("A"), hist("R"), "b", "h").withColumns(rounded("intersection"))


@C.add("kde_density", """WITH r AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi, count(s_acctbal) AS n FROM supplier), g AS (SELECT i, lo + (hi - lo) * i / 49 AS x, n FROM r, (SELECT unnest(generate_series(0, 49)) AS i))
    SELECT round(x, 4) AS x, round(sum(exp(-0.5 * ((x - s_acctbal) / 500) * ((x - s_acctbal) / 500))) / (max(n) * 500 * sqrt(2 * pi())), 10) AS density FROM g, supplier GROUP BY i, x""")
def _(read):
    return metrics.kde(read("supplier"), "s_acctbal", 500.0, 50).select(F.round("x", 4).alias("x"), F.round("density", 10).alias("density"))


@C.add("matrix_distances", """WITH a AS (SELECT l_returnflag AS i, l_linenumber AS j, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT l_returnflag AS i, l_linenumber AS j, avg(l_discount) * 500 AS v FROM lineitem GROUP BY 1, 2), d AS (SELECT coalesce(a.v, 0) AS x, coalesce(b.v, 0) AS y FROM a FULL JOIN b ON a.i = b.i AND a.j = b.j)
    SELECT round(sum((x - y) * (x - y)), 6) AS frobenius_squared, round(sum(abs(x - y)), 6) AS manhattan, round(1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS cosine, round(sqrt(sum((x - y) * (x - y))), 6) AS frobenius, round(sqrt(sqrt(sum((x - y) * (x - y)))), 6) AS frobenius_root FROM d""")
def _(read):
    m = lambda v: read("lineitem").groupBy(F.col("l_returnflag").alias("i"), F.col("l_linenumber").alias("j")).agg(v.alias("v"))
    return metrics.matrix_distances(m(F.avg("l_quantity")), m(F.avg("l_discount") * 500), ["i", "j"], "v").withColumns(rounded("frobenius_squared", "manhattan", "cosine", "frobenius", "frobenius_root"))


_ANGLE = "SELECT l_orderkey, l_linenumber, l_partkey, CAST((l_orderkey * 37) % 360 AS DOUBLE) AS a, CAST((l_partkey * 53) % 360 AS DOUBLE) AS b, l_returnflag, l_quantity FROM lineitem"


def _angles(read):
    d = lambda c, k: ((F.col(c) * k) % 360).cast("double")
    return read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", d("l_orderkey", 37).alias("a"), d("l_partkey", 53).alias("b"), "l_returnflag", "l_quantity")


@C.add("fpr_at_tpr", f"{_ROC} SELECT round(min(fp / nn), 6) AS fpr FROM c WHERE tp / pp > 0.9")
def _(read):
    return metrics.fpr_at_tpr(metrics.roc_curve(_scored(read), "score", "quality"), 0.9).withColumns(rounded("fpr"))


@C.add("pearson_test", "WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL) SELECT round(r, 6) AS r, n, round(r * sqrt(n - 2) / sqrt(1 - r * r), 3) AS t FROM c")
def _(read):
    return metrics.pearson_test(read("lineitem"), "l_quantity", "l_extendedprice").select(F.round("r", 6).alias("r"), "n", F.round("t", 3).alias("t"))


@C.add("all_groups_padded", """WITH c AS (SELECT event_type, CAST(dayofyear(ts) AS INTEGER) AS day, count(*) AS n FROM events WHERE value > 200 GROUP BY 1, 2)
    SELECT a.event_type, b.day, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT event_type FROM c) a CROSS JOIN (SELECT DISTINCT day FROM c) b LEFT JOIN c ON c.event_type = a.event_type AND c.day = b.day""")
def _(read):
    from tidewheel.operators import aggregate

    counts = read("events").where("value > 200").groupBy("event_type", F.dayofyear("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return aggregate.padded(counts, ["event_type", "day"], ["n"])


_PLACES = "SELECT s_suppkey AS k, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y, CAST(s_suppkey * 37 % 360 AS DOUBLE) AS w FROM supplier"


def _places(read):
    return read("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"), (F.col("s_suppkey") * 37 % 360).cast("double").alias("w"))


@C.add("pairwise_euclidean", f"WITH p AS ({_PLACES}) SELECT a.k AS a, b.k AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 4) AS distance FROM p a, p b")
def _(read):
    p = _places(read)
    return metrics.pairwise(p, p, ("k", "k"), ["x", "y"]).withColumn("distance", half_up("distance", 4))


@C.add("pairwise_mixed", f"WITH p AS ({_PLACES}) SELECT a.k AS a, b.k AS b, round(abs(a.x - b.x) + abs(a.y - b.y) + CASE WHEN a.w - b.w < -180 THEN a.w - b.w + 360 WHEN a.w - b.w >= 180 THEN a.w - b.w - 360 ELSE a.w - b.w END, 4) AS distance FROM p a, p b")
def _(read):
    p = _places(read)
    return metrics.pairwise(p, p, ("k", "k"), ["x", "y"], ["w"], kind="mixed").withColumn("distance", half_up("distance", 4))


@C.add("angular_distance", f"WITH t AS ({_ANGLE}) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a - b < -180 THEN a - b + 360 WHEN a - b >= 180 THEN a - b - 360 ELSE a - b END AS distance FROM t")
def _(read):
    return _angles(read).select("l_orderkey", "l_linenumber", "l_partkey", angles.angular_distance(F.col("a"), F.col("b")).alias("distance"))


@C.add("circular_mean_by_group", f"""WITH t AS ({_ANGLE}), m AS (SELECT l_returnflag, degrees(atan2(avg(sin(radians(a))), avg(cos(radians(a))))) AS d, sqrt(avg(sin(radians(a))) ** 2 + avg(cos(radians(a))) ** 2) AS r FROM t GROUP BY 1)
    SELECT l_returnflag, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 4) AS mean, round(degrees(sqrt(-2 * ln(r))), 4) AS sd FROM m""")
def _(read):
    rows = _angles(read).groupBy("l_returnflag")
    return rows.agg(F.round(angles.circular_mean(F.col("a")), 4).alias("mean"), F.round(angles.circular_std(F.col("a")), 4).alias("sd"))


@C.add("wind_vectors", f"WITH t AS ({_ANGLE}) SELECT l_orderkey, l_linenumber, l_partkey, round(sin(radians(a)) * l_quantity, 6) + 0.0 AS u, round(cos(radians(a)) * l_quantity, 6) + 0.0 AS v, l_quantity AS speed, a AS direction FROM t")
def _(read):
    rows = _angles(read)
    u, v = angles.wind_vector(F.col("a"), F.col("l_quantity"))
    rows = rows.withColumns({"_u": u, "_v": v})
    d, s = angles.direction_speed(F.col("_u"), F.col("_v"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", (F.round("_u", 6) + 0.0).alias("u"), (F.round("_v", 6) + 0.0).alias("v"), F.round(s, 6).alias("speed"), F.pmod(F.round(d, 4), F.lit(360.0)).alias("direction"))


@C.add("triangular_uv_roundtrip", f"""WITH t AS ({_ANGLE}) SELECT l_orderkey, l_linenumber, l_partkey,
    round(CASE WHEN a <= 90 THEN a / 90 WHEN a <= 270 THEN 2 - a / 90 ELSE a / 90 - 4 END, 6) AS s, a AS angle FROM t""")
def _(read):
    rows = _angles(read).withColumns({"_s": angles.triangular_s(F.col("a")), "_c": angles.triangular_c(F.col("a"))})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round("_s", 6).alias("s"), F.pmod(F.round(angles.from_triangular(F.col("_s"), F.col("_c")), 6), F.lit(360.0)).alias("angle"))


_POINT = "SELECT n_nationkey AS k, CAST(n_nationkey * 7 % 120 - 60 AS DOUBLE) AS lat, CAST(n_nationkey * 29 % 340 - 170 AS DOUBLE) AS lon FROM nation"


@C.add("haversine_pairs", f"""WITH p AS ({_POINT}) SELECT x.k AS a, y.k AS b, round(2 * 6371 * asin(sqrt(least(1, sin((radians(y.lat) - radians(x.lat)) / 2) ** 2 + cos(radians(x.lat)) * cos(radians(y.lat)) * sin((radians(y.lon) - radians(x.lon)) / 2) ** 2))), 4) AS km FROM p x, p y WHERE x.k < y.k""")
def _(read):
    p = read("nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 7 % 120 - 60).cast("double").alias("lat"), (F.col("n_nationkey") * 29 % 340 - 170).cast("double").alias("lon"))
    q = F.broadcast(p.toDF("b", "lat2", "lon2"))  # a dimension of 25 rows
    return p.toDF("a", "lat1", "lon1").join(q, F.col("a") < F.col("b")).select("a", "b", F.round(geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 4).alias("km"))


#: Flattening of WGS84, in SQL.
_FLAT = "(1 / 298.257223563)"


@C.add("geodesic_pairs", f"""WITH RECURSIVE p AS (SELECT n_nationkey AS k, CAST(n_nationkey * 7 % 120 - 60 AS DOUBLE) AS lat, CAST(n_nationkey * 29 % 340 - 170 AS DOUBLE) AS lon FROM nation), q AS (SELECT a.k AS a, b.k AS b, atan((1 - {_FLAT}) * tan(radians(a.lat))) AS u, atan((1 - {_FLAT}) * tan(radians(b.lat))) AS v, radians(b.lon - a.lon) AS l FROM p a JOIN p b ON a.k < b.k),
    it AS (SELECT a, b, u, v, l, l AS lam, 0 AS i, NULL::DOUBLE AS sin_s, NULL::DOUBLE AS cos_s, NULL::DOUBLE AS cos2a, NULL::DOUBLE AS cos_m, 1.0 AS moved FROM q
    UNION ALL SELECT a, b, u, v, l, l + (1 - k) * f * sin_a * (sigma + k * sin_s * (cos_m + k * cos_s * (2 * cos_m * cos_m - 1))) AS new, i + 1, sin_s, cos_s, cos2a, cos_m, abs(l + (1 - k) * f * sin_a * (sigma + k * sin_s * (cos_m + k * cos_s * (2 * cos_m * cos_m - 1))) - lam)
    FROM (SELECT *, f / 16 * cos2a * (4 + f * (4 - 3 * cos2a)) AS k FROM (SELECT *, CASE WHEN cos2a > 1e-15 THEN cos_s - 2 * sin(u) * sin(v) / cos2a ELSE 0 END AS cos_m FROM (SELECT *, 1 - sin_a * sin_a AS cos2a
    FROM (SELECT *, atan2(sin_s, cos_s) AS sigma, CASE WHEN sin_s > 0 THEN cos(u) * cos(v) * sin(lam) / sin_s ELSE 0 END AS sin_a FROM (SELECT a, b, u, v, l, lam, i, {_FLAT} AS f,
    sqrt((cos(v) * sin(lam)) ** 2 + (cos(u) * sin(v) - sin(u) * cos(v) * cos(lam)) ** 2) AS sin_s, sin(u) * sin(v) + cos(u) * cos(v) * cos(lam) AS cos_s FROM it WHERE i < 60)))))),
    e AS (SELECT *, cos2a * (6378137.0 ** 2 - (6378137.0 * (1 - {_FLAT})) ** 2) / (6378137.0 * (1 - {_FLAT})) ** 2 AS w, min(moved) OVER (PARTITION BY a, b) < 1e-12 AS settled FROM it WHERE i > 0 QUALIFY i = 60),
    g AS (SELECT *, 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))) AS big_a, w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))) AS big_b FROM e),
    d AS (SELECT *, big_b * sin_s * (cos_m + big_b / 4 * (cos_s * (2 * cos_m ** 2 - 1) - big_b / 6 * cos_m * (4 * sin_s ** 2 - 3) * (4 * cos_m ** 2 - 3))) AS ds, degrees(atan2(cos(v) * sin(lam), cos(u) * sin(v) - sin(u) * cos(v) * cos(lam))) AS az FROM g),
    r AS (SELECT *, az - 360 * floor(az / 360) AS turn FROM d)
    SELECT a, b, CASE WHEN settled THEN round(6378137.0 * (1 - {_FLAT}) * big_a * (atan2(sin_s, cos_s) - ds) / 1000, 4) END AS km, CASE WHEN settled THEN round(CASE WHEN turn = 0 THEN 360.0 ELSE turn END, 6) END AS azimuth FROM r""")
def _(read):
    p = read("nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 7 % 120 - 60).cast("double").alias("lat"), (F.col("n_nationkey") * 29 % 340 - 170).cast("double").alias("lon"))
    q = F.broadcast(p.toDF("b", "lat2", "lon2"))
    g = p.toDF("a", "lat1", "lon1").join(q, F.col("a") < F.col("b")).withColumn("g", geo.geodesic("lat1", "lon1", "lat2", "lon2"))
    return g.select("a", "b", F.round("g.km", 4).alias("km"), F.round("g.azimuth", 6).alias("azimuth"))


@C.add("prettify_names", "SELECT p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array(p_type, '[ _]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ') AS pretty FROM part")
def _(read):
    return read("part").select("p_partkey", text.prettify(F.col("p_type")).alias("pretty"))


@C.add("filename_numbers", r"""WITH f AS (SELECT o_orderkey AS id, 'order_' || o_orderkey || '_' || o_orderstatus || '_' || CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) || 'usd.' || CAST(o_custkey % 7 AS VARCHAR) AS name FROM orders),
    l AS (SELECT id, regexp_extract_all(name, '[0-9]+[.][0-9]+|[0-9]+|[A-Za-z]+|[^A-Za-z0-9]+') AS t FROM f),
    u AS (SELECT id, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS position, array_to_string(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+[.]') THEN '\d.\d' WHEN regexp_matches(x, '^[0-9]') THEN '\d' ELSE x END), '') AS template FROM l),
    w AS (SELECT *, CASE WHEN regexp_matches(tok, '^[A-Za-z]+$') THEN tok END AS word FROM u),
    p AS (SELECT *, coalesce(lead(word) OVER o, lag(word) OVER o, last_value(word IGNORE NULLS) OVER (PARTITION BY id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'part' || position) AS part FROM w WINDOW o AS (PARTITION BY id ORDER BY position))
    SELECT template, CAST(position AS INTEGER) AS position, part, CASE WHEN contains(tok, '.') THEN 'float' ELSE 'int' END AS kind, count(*) AS n, count(DISTINCT tok) AS n_values, min(CAST(tok AS DOUBLE)) AS low, max(CAST(tok AS DOUBLE)) AS high
    FROM p WHERE regexp_matches(tok, '^[0-9]') GROUP BY ALL""")
def _(read):
    name = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit("_"), "o_orderstatus", F.lit("_"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("usd."), (F.col("o_custkey") % 7).cast("string"))
    return patterns.numbered_parts(read("orders").select(name.alias("name")), "name")


@C.add("filename_template", r"""SELECT regexp_replace(c_name, '[0-9]+', '\\d{' || CAST(length(regexp_extract(c_name, '[0-9]+')) AS VARCHAR) || '}') AS template, count(*) AS n FROM customer GROUP BY 1""")
def _(read):
    return patterns.exact_templates(read("customer"), "c_name")


@C.add("filename_template_merged", r"""WITH s AS (SELECT regexp_replace(url, '[0-9]+', '\\d', 'g') AS shape, regexp_extract_all(url, '[0-9]+') AS runs FROM pages WHERE url IS NOT NULL),
    r AS (SELECT shape, length(unnest(runs)) AS width, generate_subscripts(runs, 1) AS pos FROM s), w AS (SELECT shape, pos, min(width) AS lo, max(width) AS hi FROM r GROUP BY 1, 2),
    t AS (SELECT shape, string_agg('\d{' || lo || CASE WHEN hi > lo THEN ', ' || hi ELSE '' END || '}', '|' ORDER BY pos) AS widths FROM w GROUP BY 1)
    SELECT shape, count(*) AS n, coalesce(any_value(widths), '') AS widths FROM s LEFT JOIN t USING (shape) GROUP BY 1""")
def _(read):
    return patterns.templates(read("pages"), "url")


@C.add("filename_regex", r"""WITH t AS (SELECT page_id, regexp_replace(url, '[0-9]+', chr(1), 'g') AS shape, unnest(regexp_extract_all(url, '[0-9]+|[^0-9]+')) AS tok, generate_subscripts(regexp_extract_all(url, '[0-9]+|[^0-9]+'), 1) AS i FROM pages),
    p AS (SELECT shape, i, CASE WHEN regexp_matches(min(tok), '^[0-9]') THEN '\d{' || min(length(tok)) || CASE WHEN max(length(tok)) > min(length(tok)) THEN ',' || max(length(tok)) ELSE '' END || '}' ELSE regexp_replace(min(tok), '([.^$|?*+(){}\[\]\\])', '\\\1', 'g') END AS part FROM t GROUP BY 1, 2),
    r AS (SELECT shape, string_agg(part, '' ORDER BY i) AS regex FROM p GROUP BY 1) SELECT DISTINCT page_id, regex FROM t JOIN r USING (shape)""")
def _(read):
    return patterns.named(read("pages").select("page_id", "url"), "url").select("page_id", "regex")


@C.add("name_positions", "WITH p AS (SELECT unnest(list_filter(regexp_split_to_array(c_name, '[^A-Za-z0-9]+'), lambda x: x <> '')) AS part, generate_subscripts(list_filter(regexp_split_to_array(c_name, '[^A-Za-z0-9]+'), lambda x: x <> ''), 1) - 1 AS pos FROM customer) SELECT CAST(pos AS INTEGER) AS pos, count(DISTINCT part) AS n_values, bool_and(regexp_full_match(part, '[A-Za-z]+')) AS alpha FROM p GROUP BY 1")
def _(read):
    return patterns.positions(read("customer"), "c_name")


def _votes() -> str:
    """SQL of the votes: a constant pattern per date, for RE2, which can't look around."""
    tail = f"([ T_-]?)({'|'.join(map(patterns.matcher, patterns.TIMES))})"
    kinds = " ".join(f"WHEN '{re.sub('[A-Za-z]', '0', t)}' THEN '{t}'" for t in patterns.TIMES)
    whole = {d: f"(^|[^0-9]){patterns.matcher(d)}{tail}([^0-9]|$)" for d in patterns.DATES}
    tried = " UNION ALL ".join(f"SELECT name, '{d}' AS d, regexp_extract(name, '(^|[^0-9])({patterns.matcher(d)}({tail})?)([^0-9]|$)', 2) AS m, regexp_extract(name, '{w}', 2) AS j, regexp_extract(name, '{w}', 3) AS t FROM n" for d, w in whole.items())
    return f"""WITH n AS (SELECT CASE event_id % 5 WHEN 0 THEN 'log_' || strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%d/%m/%Y') || ' log' WHEN 2 THEN 'a' || strftime(ts, '%Y%m%d_%H%M%S') WHEN 3 THEN strftime(ts, '%m-%d-%YT%H:%M') ELSE 'part-' || event_id END || '.txt' AS name FROM events),
    h AS ({tried}), b AS (SELECT *, max(length(m)) OVER (PARTITION BY name) AS longest FROM h)
    SELECT d || CASE WHEN j = 'T' THEN '''T''' ELSE j END || CASE regexp_replace(t, '[0-9]', '0', 'g') {kinds} ELSE '' END AS format, count(*) AS votes FROM b WHERE m <> '' AND length(m) = longest GROUP BY 1"""


@C.add("timestamp_format_vote", _votes())
def _(read):
    k, written = F.col("event_id") % 5, lambda f: F.date_format("ts", f)
    name = F.when(k == 0, F.concat(F.lit("log_"), written("yyyy-MM-dd HH:mm:ss"))).when(k == 1, F.concat(written("dd/MM/yyyy"), F.lit(" log"))).when(k == 2, F.concat(F.lit("a"), written("yyyyMMdd_HHmmss")))
    name = name.when(k == 3, written("MM-dd-yyyy'T'HH:mm")).otherwise(F.concat(F.lit("part-"), F.col("event_id").cast("string")))
    return patterns.time_format_votes(read("events").select(F.concat(name, F.lit(".txt")).alias("name")), "name")


@C.add("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(read):
    return read("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


QUERIES, ORACLE_SQL = C.queries, C.sql
