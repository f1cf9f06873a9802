"""Clustering, components, forecasting and federated learning; results are models, so there is mostly no SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.operators import federated, kernels, learning, linkage, metrics
from tidewheel.plans.base import Catalogue, rounded
from tidewheel.plans.timeseries import hourly_grid

C = Catalogue()


def embedded(read):
    return read("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


@C.add("cosine_to_centroid", """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY 1, 2)
    SELECT vec_id, round(1 - sum(CAST(x AS DOUBLE) * m) / (sqrt(sum(CAST(x AS DOUBLE) * x)) * sqrt(sum(m * m))), 5) AS distance FROM e JOIN c ON e.label = c.label AND e.i = c.i GROUP BY 1""")
def _(read):
    e = embedded(read)
    long = e.select("label", F.posexplode("x").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    centre = long.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return e.join(centre, "label").select("vec_id", F.round(metrics.cosine(F.col("x"), F.col("c")), 5).alias("distance"))


@C.add("connectivity_score", """WITH p AS (SELECT a.vec_id, b.label <> a.label AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
    SELECT round(sum(CASE WHEN other THEN 1.0 / r ELSE 0 END), 4) AS connectivity FROM p WHERE r <= 10""")
def _(read):
    return learning.connectivity(embedded(read), "x", "label", "vec_id").withColumns(rounded("connectivity", digits=4))


@C.add("cluster_scores", """WITH e AS (SELECT label, vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), c AS (SELECT label, d, avg(x) AS m FROM e GROUP BY 1, 2), o AS (SELECT d, avg(x) AS m FROM e GROUP BY 1),
    q AS (SELECT e.label, e.vec_id, sum((e.x - c.m) ** 2) AS sq FROM e JOIN c ON c.label = e.label AND c.d = e.d GROUP BY 1, 2), n AS (SELECT label, count(*) AS n, sum(sq) AS w, avg(sqrt(sq)) AS s FROM q GROUP BY 1),
    b AS (SELECT sum(n.n * (c.m - o.m) ** 2) AS between_ FROM c JOIN o ON o.d = c.d JOIN n ON n.label = c.label), t AS (SELECT count(*) AS k, sum(n) AS total, sum(w) AS w FROM n),
    g AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m - b.m) ** 2)) AS gap FROM c a JOIN c b ON a.d = b.d AND a.label <> b.label GROUP BY 1, 2),
    r AS (SELECT g.a, max((x.s + y.s) / gap) AS worst FROM g JOIN n x ON x.label = g.a JOIN n y ON y.label = g.b GROUP BY 1)
    SELECT CAST(k AS INTEGER) AS clusters, round(w, 4) AS inertia, round(between_ / (k - 1) / (w / (total - k)), 4) AS calinski_harabasz, (SELECT round(avg(worst), 4) FROM r) AS davies_bouldin FROM t, b""")
def _(read):
    return learning.cluster_scores(embedded(read), "x", "label").withColumns(rounded("inertia", "calinski_harabasz", "davies_bouldin", digits=4))


@C.add("kmeans_sweep")
def _(read):
    return learning.kmeans_sweep(embedded(read), "x", "vec_id", range(2, 5))


@C.add("gmm_profiles")
def _(read):
    days = read("events").groupBy("user_id").agg(*(F.avg(F.when(F.hour("ts").between(6 * k, 6 * k + 5), F.col("value"))).alias(f"q{k}") for k in range(4))).na.fill(0.0)
    return learning.gaussian_clusters(days.select("user_id", F.array(*(f"q{k}" for k in range(4))).alias("x")), "x")


@C.add("kmedoids")
def _(read):
    return learning.kmedoids(embedded(read), "x", "vec_id", 4)


@C.add("kmedoids_starts")
def _(read):
    return learning.kmedoids_starts(embedded(read), "x", "vec_id", 4, 3)[1]


@C.add("pca_feature_importance")
def _(read):
    return learning.pca_importance(read("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@C.add("pca_explained_variance", """WITH m AS (SELECT var_samp(l_quantity) AS a, var_samp(l_discount) AS b, var_samp(l_tax) AS c, covar_samp(l_quantity, l_discount) AS d, covar_samp(l_discount, l_tax) AS e, covar_samp(l_quantity, l_tax) AS f FROM lineitem),
    q AS (SELECT *, (a + b + c) / 3 AS q, sqrt(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM m),
    r AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - e * e) - d * (d * (c - q) - e * f) + f * (d * e - (b - q) * f)) / (2 * p ** 3)))) / 3 AS phi FROM q),
    v AS (SELECT unnest([1, 2, 3]) AS component, unnest([q + 2 * p * cos(phi), 3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3)), q + 2 * p * cos(phi + 2 * pi() / 3)]) / (3 * q) AS variance FROM r),
    s AS (SELECT *, sum(variance) OVER (ORDER BY component) AS running FROM v)
    SELECT component, round(variance, 7) AS variance, round(running, 7) AS running, component = 1 OR running - variance < 0.95 AS enough FROM s""")
def _(read):
    return learning.explained_variance(read("lineitem"), ["l_quantity", "l_discount", "l_tax"]).withColumns(rounded("variance", "running", digits=7))


@C.add("pca_projection", """WITH m AS (SELECT var_samp(p_size) AS a, covar_samp(p_size, p_retailprice) AS b, var_samp(p_retailprice) AS c FROM part), l AS (SELECT a, b, (a + c + sqrt((a - c) ** 2 + 4 * b * b)) / 2 AS top FROM m),
    v AS (SELECT b / sqrt(b * b + (top - a) ** 2) AS x, (top - a) / sqrt(b * b + (top - a) ** 2) AS y FROM l), w AS (SELECT x, y, CASE WHEN (CASE WHEN abs(x) > abs(y) THEN x ELSE y END) < 0 THEN -1 ELSE 1 END AS one, CASE WHEN (CASE WHEN abs(y) > abs(x) THEN y ELSE -x END) < 0 THEN -1 ELSE 1 END AS two FROM v)
    SELECT p_partkey, round(one * (p_size * x + p_retailprice * y), 4) AS pc1, round(two * (p_size * y - p_retailprice * x), 4) AS pc2 FROM part, w""")
def _(read):
    return learning.projected(read("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"]).select("p_partkey", F.round("pc1", 4).alias("pc1"), F.round("pc2", 4).alias("pc2"))


def _profiles(read):
    kinds = ["click", "error", "purchase", "signup", "view"]
    return read("events").groupBy("user_id").agg(*(F.sum(F.when(F.col("event_type") == k, F.col("value")).otherwise(0.0)).alias(k) for k in kinds)).select("user_id", F.array(*kinds).alias("x"))


@C.add("nmf_profile")
def _(read):
    p = _profiles(read)
    return learning.nmf_weights(p, "user_id", "x", learning.nmf_fitted(p, "x", 3))


@C.add("nmf_component_errors")
def _(read):
    return learning.nmf_errors(_profiles(read), "x", [1, 2, 3, 4])


@C.add("spectral_bands", """WITH b AS (SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, avg(value) AS v FROM events GROUP BY 1, 2),
    g AS (SELECT event_type, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM b GROUP BY 1),
    h AS (SELECT g.event_type, row_number() OVER (PARTITION BY g.event_type ORDER BY g.hour) - 1 AS i, coalesce(v, 0) AS v FROM g LEFT JOIN b ON b.event_type = g.event_type AND b.hour = g.hour),
    s AS (SELECT event_type, i, v, unnest([i // 120, i // 120 - 1]) AS segment FROM h), c AS (SELECT event_type, segment, i - segment * 120 AS j, v - avg(v) OVER p AS v, count(*) OVER p AS n FROM s WINDOW p AS (PARTITION BY event_type, segment)),
    d AS (SELECT event_type, segment, k, sum(v * (0.5 - 0.5 * cos(2 * pi() * j / 240)) * cos(2 * pi() * (j * k % 240) / 240)) AS re, sum(v * (0.5 - 0.5 * cos(2 * pi() * j / 240)) * sin(2 * pi() * (j * k % 240) / 240)) AS im FROM c, range(121) r(k) WHERE n = 240 GROUP BY 1, 2, 3),
    f AS (SELECT event_type, CAST(k AS DOUBLE) / 10 AS frequency, avg((re * re + im * im) / (24 * 90) * CASE WHEN k IN (0, 120) THEN 1 ELSE 2 END) AS power FROM d GROUP BY event_type, k)
    SELECT event_type, lo + 0.5 AS lo, lo + 1.5 AS hi, round(sum(power), 3) AS total, count(*) AS n FROM f, (SELECT CAST(unnest(range(10)) AS DOUBLE) AS lo) e WHERE frequency BETWEEN lo + 0.5 AND lo + 1.5 GROUP BY 1, 2, 3""")
def _(read):
    psd = learning.spectra(hourly_grid(read).na.fill(0.0, ["value"]), ["event_type"], "hour", "value", 24.0, 240)
    return learning.bands(psd, ["event_type"], "frequency", "power", [(k + 0.5, k + 1.5) for k in range(10)]).withColumns(rounded("total", digits=3))


@C.add("short_time_spectra", """WITH b AS (SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, avg(value) AS v FROM events GROUP BY 1, 2),
    g AS (SELECT event_type, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM b GROUP BY 1),
    h AS (SELECT g.event_type, CAST(epoch(g.hour) / 3600 AS BIGINT) AS i, coalesce(v, 0) AS v FROM g LEFT JOIN b USING (event_type, hour)),
    s AS (SELECT event_type, i, v, unnest([i // 24, i // 24 - 1]) AS segment FROM h),
    c AS (SELECT event_type, segment, i - segment * 24 AS j, v - avg(v) OVER p AS v, count(*) OVER p AS n FROM s WINDOW p AS (PARTITION BY event_type, segment)),
    d AS (SELECT event_type, segment, k, sum(v * (0.5 - 0.5 * cos(2 * pi() * j / 48)) * cos(2 * pi() * j * k / 48)) AS re, sum(v * (0.5 - 0.5 * cos(2 * pi() * j / 48)) * sin(2 * pi() * j * k / 48)) AS im FROM c, range(25) r(k) WHERE n = 48 GROUP BY 1, 2, 3)
    SELECT event_type, segment, CAST(k AS DOUBLE) / 2 AS frequency, round((re * re + im * im) / (24 * 18) * CASE WHEN k IN (0, 24) THEN 1 ELSE 2 END, 4) AS power FROM d""")
def _(read):
    rows = hourly_grid(read).na.fill(0.0, ["value"]).withColumn("i", F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01', hour)"))
    return learning.short_time_spectra(rows, ["event_type"], "i", "value", 24.0, 48).withColumns(rounded("power", digits=4))


@C.add("dunn_index", """WITH p AS (SELECT a.label AS x, b.label AS y, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
    SELECT round(min(d) FILTER (x <> y) / max(d) FILTER (x = y), 6) AS dunn FROM p""")
def _(read):
    return learning.dunn(read("embeddings"), "embedding", "label", "vec_id").withColumns(rounded("dunn"))


@C.add("knee", """WITH h AS (SELECT event_type, CAST(hour(ts) AS INTEGER) AS h, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT event_type, row_number() OVER w AS x, sum(n) OVER w AS y FROM h WINDOW w AS (PARTITION BY event_type ORDER BY n DESC, h)),
    d AS (SELECT event_type, x, round(CAST(y - min(y) OVER p AS DOUBLE) / CAST(max(y) OVER p - min(y) OVER p AS DOUBLE) - CAST(x - min(x) OVER p AS DOUBLE) / (max(x) OVER p - min(x) OVER p), 12) AS d FROM r WINDOW p AS (PARTITION BY event_type)),
    t AS (SELECT *, d >= lag(d) OVER o AND d >= lead(d) OVER o AS top FROM d WINDOW o AS (PARTITION BY event_type ORDER BY x))
    SELECT event_type, min(x) FILTER (top) AS knee FROM t GROUP BY 1""")
def _(read):
    counts = read("events").groupBy("event_type", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy(F.desc("n"), "h").rowsBetween(Window.unboundedPreceding, 0)
    return learning.knee(counts.select("event_type", F.row_number().over(w).cast("long").alias("x"), F.sum("n").over(w).alias("y")), "x", "y", ["event_type"])


@C.add("pso_clusters")
def _(read):
    return learning.swarm_assigned(_profiles(read), "x", "user_id")


def _forecast_rows(read):
    from tidewheel.operators import resample

    h = hourly_grid(read).na.fill(0.0, ["value"])
    h = resample.calendar_lag(h, "hour", "value", {"past_day": "1 DAY", "past_week": "7 DAYS"}, ["event_type"])
    return h.withColumns({"hour_of_day": F.hour("hour"), "weekday": F.weekday("hour"), "fold": F.floor(F.dayofyear("hour") / 7).cast("int")})


@C.add("rf_walk_forward")
def _(read):
    return learning.walk_forward(_forecast_rows(read), ["event_type"], "hour", ["past_day", "past_week", "hour_of_day", "weekday"], "value", "fold")


@C.add("svr_walk_forward")
def _(read):
    return learning.walk_forward(_forecast_rows(read), ["event_type"], "hour", ["past_day", "past_week", "hour_of_day", "weekday"], "value", "fold", kernels.svr_model)


@C.add("fourier_walk_forward")
def _(read):
    return kernels.fourier_walk_forward(_forecast_rows(read), ["event_type"], ["past_day", "past_week", "hour_of_day", "weekday"], "value", "fold")


@C.add("persistence_walk_forward", """WITH b AS (SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, avg(value) AS v FROM events GROUP BY 1, 2),
    g AS (SELECT event_type, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM b GROUP BY 1), h AS (SELECT g.event_type, g.hour, coalesce(v, 0) AS v, CAST(floor(dayofyear(g.hour) / 7) AS INTEGER) AS fold FROM g LEFT JOIN b USING (event_type, hour)),
    j AS (SELECT h.*, d.v AS day FROM h JOIN h d ON d.event_type = h.event_type AND d.hour = h.hour - INTERVAL 1 DAY JOIN h w ON w.event_type = h.event_type AND w.hour = h.hour - INTERVAL 7 DAY)
    SELECT event_type, fold, round(avg(abs(day - v)), 6) AS mae, count(*) AS n FROM j WHERE fold > (SELECT min(fold) FROM j) GROUP BY 1, 2""")
def _(read):
    out = learning.walk_forward(_forecast_rows(read), ["event_type"], "hour", ["past_day", "past_week"], "value", "fold", learning.persistence_model)
    return out.withColumns(rounded("mae"))


_DAYS = "WITH b AS (SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, avg(value) AS v FROM events GROUP BY 1, 2), h AS (SELECT *, CAST(dayofyear(hour) AS INTEGER) AS fold FROM b), d AS (SELECT event_type, fold, row_number() OVER (PARTITION BY event_type ORDER BY fold) AS i FROM (SELECT DISTINCT event_type, fold FROM h))"
_WINDOWS = {"1_month": "t.i - 1 AND t.i - 1", "6_months": "t.i - 6 AND t.i - 1", "1_year": "t.i - 12 AND t.i - 1", "1_month_year_before": "t.i - 12 AND t.i - 12", "all_before": "1 AND t.i - 1", "train_test_split": "1 AND (SELECT max(i) FROM d e WHERE e.event_type = t.event_type AND e.fold <= 15)"}
_LEAST = {"1_month": 2, "6_months": 7, "1_year": 13, "1_month_year_before": 13, "all_before": 2}

for _strategy, _window in _WINDOWS.items():
    _whole = "t.fold > 15" if _strategy == "train_test_split" else f"t.i >= {_LEAST[_strategy]}"

    @C.add(f"walk_forward_{_strategy}", f"""{_DAYS}, m AS (SELECT t.event_type, t.fold, avg(h.v) AS p FROM d t JOIN d s ON s.event_type = t.event_type AND s.i BETWEEN {_window} JOIN h ON h.event_type = s.event_type AND h.fold = s.fold WHERE {_whole} GROUP BY 1, 2)
        SELECT event_type, fold, round(avg(abs(p - v)), 6) AS mae, count(*) AS n FROM m JOIN h USING (event_type, fold) GROUP BY 1, 2""")
    def _(read, strategy=_strategy):
        from tidewheel.plans.timeseries import hourly

        rows = hourly(read).withColumns({"fold": F.dayofyear("hour"), "hour_of_day": F.hour("hour")})
        return learning.walk_forward(rows, ["event_type"], "hour", ["hour_of_day"], "value", "fold", learning.mean_model, strategy, split=15).withColumns(rounded("mae"))


@C.add("mahalanobis_distance", """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_extendedprice AS y FROM lineitem), s AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM e)
    SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(((x - mx) * (x - mx) * c - 2 * (x - mx) * (y - my) * b + (y - my) * (y - my) * a) / (a * c - b * b)), 5) AS distance FROM e, s""")
def _(read):
    return metrics.mahalanobis(read("lineitem"), ["l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", F.round("distance", 5).alias("distance"))


@C.add("federated_losses")
def _(read):
    rows = read("events").select("user_id", F.hour("ts").cast("double").alias("h"), F.weekday("ts").cast("double").alias("d"), "value")
    forest = learning.local_forests(rows, "user_id", ["h", "d"], "value", trees=2, depth=3)
    return learning.federated_losses(forest, rows, "user_id", ["h", "d"], "value")


@C.add("clustermap_merges")
def _(read):
    return linkage.complete_linkage(_profiles(read), "x", "user_id")[0]


@C.add("clustermap_order")
def _(read):
    return linkage.complete_linkage(_profiles(read), "x", "user_id")[1]


@C.add("federated_global_forest")
def _(read):
    rows = read("events").select("event_id", "user_id", F.hour("ts").cast("double").alias("h"), F.weekday("ts").cast("double").alias("d"), "value")
    forest = learning.local_forests(rows, "user_id", ["h", "d"], "value", trees=2, depth=3)
    return federated.global_predictions(forest, rows, "event_id", ["h", "d"])


QUERIES, ORACLE_SQL = C.queries, C.sql
