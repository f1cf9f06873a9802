"""Filters, joins, set operations and grouped statistics on the order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.operators import aggregate, binning, clean, normalize, sampling
from tidewheel.plans.base import Catalogue, rounded

C = Catalogue()


@C.add("scan_project_filter", "SELECT l_orderkey AS order_id, l_quantity AS quantity, l_extendedprice AS price FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag = 'R'")
def _(read):
    rows = read("lineitem").where(F.col("l_quantity").between(10, 20) & (F.col("l_returnflag") == "R"))
    return clean.renamed(rows, {"l_orderkey": "order_id", "l_quantity": "quantity", "l_extendedprice": "price"})


@C.add("regex_reject", "SELECT p_partkey, p_type FROM part WHERE NOT regexp_matches(p_brand, '[13579]$')")
def _(read):
    return clean.reject_pattern(read("part"), "p_brand", "[13579]$").select("p_partkey", "p_type")


@C.add("sentinel_drop", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def _(read):
    return clean.reject_values(read("orders"), "o_orderstatus", ["F", "P"]).select("o_orderkey", "o_orderpriority")


@C.add("sentinel_to_null", "SELECT l_returnflag, count(*) AS n_rows, count(nullif(l_linenumber, 1)) AS n_kept FROM lineitem GROUP BY 1")
def _(read):
    rows = clean.sentinel_to_null(read("lineitem"), "l_linenumber", 1)
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"), F.count("l_linenumber").alias("n_kept"))


@C.add("impute_mean_min_count", """
    WITH h AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)
    SELECT c_custkey, round(coalesce(bal, CASE WHEN (SELECT count(bal) FROM h) >= 10 THEN (SELECT avg(bal) FROM h) END), 6) AS bal FROM h""")
def _(read):
    rows = read("customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"))
    return clean.impute(rows, ["bal"], least=10).withColumns(rounded("bal"))


@C.add("period_slice", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def _(read):
    return clean.half_open(read("orders"), "o_orderdate", "1996-03-01", "1997-01-01").select("o_orderkey", "o_orderdate")


@C.add("whole_month_slice", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-06-01'")
def _(read):
    return clean.period_slice(read("orders"), "o_orderdate", "1996-03", "1996-05").select("o_orderkey")


@C.add("group_size_filter", "SELECT o_orderkey, o_custkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 12")
def _(read):
    return clean.groups_larger_than(read("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], 12).select("o_orderkey", "o_custkey")


@C.add("same_group_subset", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 2")
def _(read):
    return clean.same_group(read("lineitem"), {"l_returnflag": "A", "l_linestatus": "F", "l_linenumber": 2}).select("l_orderkey", "l_linenumber")


@C.add("semi_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(read):
    return clean.semi(read("customer"), read("orders").where("o_totalprice > 300000"), "c_custkey", "o_custkey").select("c_custkey", "c_mktsegment")


@C.add("anti_join", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def _(read):
    return clean.anti(read("customer"), read("orders"), "c_custkey", "o_custkey").select("c_custkey")


@C.add("union_all", "SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def _(read):
    return read("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).unionByName(read("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


@C.add("union_distinct", "SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier")
def _(read):
    return read("customer").select(F.col("c_nationkey").alias("key")).union(read("supplier").select("s_nationkey")).distinct()


@C.add("intersect_keys", "SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(read):
    return read("customer").select(F.col("c_nationkey").alias("key")).intersect(read("supplier").select("s_nationkey"))


@C.add("except_list", "SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(read):
    return read("nation").select("n_nationkey").subtract(read("supplier").where("s_acctbal > 5000").select("s_nationkey"))


@C.add("cross_grid", "SELECT r_regionkey, m AS month FROM region, (VALUES (1), (4), (7), (10)) v(m)")
def _(read):
    months = clean.grid(read("region").sparkSession, {"month": [1, 4, 7, 10]}).withColumn("month", F.col("month").cast("int"))
    return read("region").select("r_regionkey").crossJoin(F.broadcast(months))


@C.add("role_playing_join", """
    SELECT cn.n_name AS from_nation, sn.n_name AS to_nation, count(*) AS n, round(sum(l_extendedprice), 2) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2""")
def _(read):
    flows = _flows(read)
    return flows.groupBy("from_nation", "to_nation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("value"))


def _flows(read):
    """Order lines with the customer's and the supplier's nation; nation is 25 rows, read in both roles."""
    n = read("nation").select("n_nationkey", "n_name")
    role = lambda key, name: F.broadcast(n.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name)))
    lines = read("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    lines = lines.join(read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"), "l_orderkey")
    lines = lines.join(read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    lines = lines.join(read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return lines.join(role("c_nationkey", "from_nation"), "c_nationkey").join(role("s_nationkey", "to_nation"), "s_nationkey")


_FLOW = """WITH f AS (SELECT cn.n_name AS from_nation, sn.n_name AS to_nation, l_quantity, l_extendedprice, o_orderdate
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey) """


@C.add("group_ratio", """
    WITH t AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1),
    s AS (SELECT sum(f) AS sf, sum(o) AS so FROM t)
    SELECT o_orderpriority, round(f / sf, 6) AS share_f, round(o / so, 6) AS share_o, round((f / sf) / (o / so), 6) AS ratio FROM t, s""")
def _(read):
    n = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    t = read("orders").groupBy("o_orderpriority").agg(n("F").alias("f"), n("O").alias("o"))
    s = t.agg(F.sum("f").alias("sf"), F.sum("o").alias("so"))
    t = t.crossJoin(F.broadcast(s)).select("o_orderpriority", (F.col("f") / F.col("sf")).alias("share_f"), (F.col("o") / F.col("so")).alias("share_o"))
    return t.withColumn("ratio", F.col("share_f") / F.col("share_o")).withColumns(rounded("share_f", "share_o", "ratio"))


@C.add("topk_morning", """
    SELECT user_id, count(*) AS n, min(ts) AS first_ts FROM events WHERE hour(ts) IN (7, 8, 9) AND isodow(ts) <= 5
    GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10""")
def _(read):
    morning = read("events").where(F.hour("ts").isin(7, 8, 9) & (F.weekday("ts") < 5))
    return morning.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts")).orderBy(F.desc("n"), "user_id").limit(10)


@C.add("unbalanced_topn", _FLOW + """, a AS (SELECT from_nation AS nation, count(*) AS n_from FROM f GROUP BY 1), b AS (SELECT to_nation AS nation, count(*) AS n_to FROM f GROUP BY 1)
    SELECT nation, n_from, n_to, abs(n_to - n_from) AS unbalance FROM a JOIN b USING (nation) ORDER BY unbalance DESC, nation LIMIT 5""")
def _(read):
    f = _flows(read)
    a = f.groupBy(F.col("from_nation").alias("nation")).agg(F.count(F.lit(1)).alias("n_from"))
    b = f.groupBy(F.col("to_nation").alias("nation")).agg(F.count(F.lit(1)).alias("n_to"))
    return a.join(b, "nation").withColumn("unbalance", F.abs(F.col("n_to") - F.col("n_from"))).orderBy(F.desc("unbalance"), "nation").limit(5)


@C.add("od_asymmetry", _FLOW + """, m AS (SELECT from_nation, to_nation, median(l_quantity) AS q FROM f WHERE from_nation <> to_nation GROUP BY 1, 2)
    SELECT x.from_nation, x.to_nation, round(x.q - y.q, 6) AS asymmetry FROM m x JOIN m y ON x.from_nation = y.to_nation AND x.to_nation = y.from_nation WHERE x.from_nation < x.to_nation""")
def _(read):
    m = _flows(read).where("from_nation != to_nation").groupBy("from_nation", "to_nation").agg(F.percentile("l_quantity", 0.5).alias("q"))
    back = m.select(F.col("from_nation").alias("to_nation"), F.col("to_nation").alias("from_nation"), F.col("q").alias("r"))
    return m.where("from_nation < to_nation").join(back, ["from_nation", "to_nation"]).select("from_nation", "to_nation", F.round(F.col("q") - F.col("r"), 6).alias("asymmetry"))


@C.add("od_durations", _FLOW + "SELECT from_nation, to_nation, median(l_quantity) AS median_quantity, count(*) AS n FROM f WHERE from_nation <> to_nation GROUP BY 1, 2")
def _(read):
    return _flows(read).where("from_nation != to_nation").groupBy("from_nation", "to_nation").agg(F.percentile("l_quantity", 0.5).alias("median_quantity"), F.count(F.lit(1)).alias("n"))


@C.add("full_outer_signals", """
    WITH a AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, round(avg(value), 6) AS view_value FROM events WHERE event_type = 'view' GROUP BY 1),
    b AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, round(avg(value), 6) AS click_value FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT coalesce(a.hour, b.hour) AS hour, view_value, click_value FROM a FULL JOIN b ON a.hour = b.hour""")
def _(read):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    side = lambda kind: read("events").where(F.col("event_type") == kind).groupBy(hour).agg(F.round(F.avg("value"), 6).alias(f"{kind}_value"))
    return side("view").join(side("click"), "hour", "full")


@C.add("completeness", """
    WITH h AS (SELECT c_mktsegment, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS bal FROM customer)
    SELECT c_mktsegment, round(100.0 * count(bal) / count(*), 6) AS bal FROM h GROUP BY 1""")
def _(read):
    rows = read("customer").select("c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"))
    return aggregate.completeness(rows, ["c_mktsegment"], ["bal"]).withColumns(rounded("bal"))


@C.add("null_ratio", "SELECT round(avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0 END), 6) AS bal FROM customer")
def _(read):
    return aggregate.null_ratios(read("customer").select(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal")), ["bal"]).withColumns(rounded("bal"))


_DESCRIBE = "SELECT '{0}' AS \"column\", count({0}) AS count, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS sd, min({0}) AS min, quantile_cont({0}, 0.25) AS q25, quantile_cont({0}, 0.5) AS median, quantile_cont({0}, 0.75) AS q75, max({0}) AS max FROM lineitem"


@C.add("describe", f"{_DESCRIBE.format('l_quantity')} UNION ALL {_DESCRIBE.format('l_discount')}")
def _(read):
    return aggregate.describe(read("lineitem"), ["l_quantity", "l_discount"]).withColumns(rounded("mean", "sd"))


_SCALE = "SELECT l_orderkey, l_linenumber, round({}, 6) AS n_l_extendedprice FROM lineitem"
_W = "OVER (PARTITION BY l_returnflag)"
for _name, _method, _sql in (
    ("zscore_group", "zscore", f"(l_extendedprice - avg(l_extendedprice) {_W}) / stddev_samp(l_extendedprice) {_W}"),
    ("minmax_group", "minmax", f"(l_extendedprice - min(l_extendedprice) {_W}) / (max(l_extendedprice) {_W} - min(l_extendedprice) {_W})"),
    ("max_group", "max", f"l_extendedprice / max(l_extendedprice) {_W}"),
):

    @C.add(_name, _SCALE.format(_sql))
    def _(read, method=_method):
        rows = read("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
        return normalize.scaled(rows, ["l_extendedprice"], ["l_returnflag"], method).select("l_orderkey", "l_linenumber", F.round("n_l_extendedprice", 6).alias("n_l_extendedprice"))


@C.add("standard_scale_global", "SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER (), 6) AS n_s_acctbal FROM supplier")
def _(read):
    return normalize.scaled(read("supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"], (), "standard").select("s_suppkey", F.round("n_s_acctbal", 6).alias("n_s_acctbal"))


@C.add("row_normalize", "SELECT l_orderkey, l_linenumber, round(l_discount / (l_discount + l_tax), 6) AS l_discount, round(l_tax / (l_discount + l_tax), 6) AS l_tax FROM lineitem WHERE l_discount + l_tax > 0")
def _(read):
    rows = read("lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax").where("l_discount + l_tax > 0")
    return normalize.row_shares(rows, ["l_discount", "l_tax"]).withColumns(rounded("l_discount", "l_tax"))


_Q = binning.Bins("l_quantity", (1.0, 10.0, 20.0, 30.0, 40.0, 50.0))
_D = binning.Bins("l_discount", (0.0, 0.025, 0.05, 0.075, 0.1))


def _bin_sql(column: str, bins: binning.Bins) -> str:
    cases = " ".join(f"WHEN {column} <= {b} THEN {m}" for b, m in zip(bins.edges[1:], bins.mids, strict=True))
    return f"CASE WHEN {column} < {bins.edges[0]} THEN NULL {cases} END"


_BINNED = f"WITH b AS (SELECT *, CAST({_bin_sql('l_quantity', _Q)} AS DOUBLE) AS l_quantity_bin, CAST({_bin_sql('l_discount', _D)} AS DOUBLE) AS l_discount_bin FROM lineitem) "


@C.add("bin_variable", _BINNED + "SELECT l_quantity_bin, count(*) AS n FROM b GROUP BY 1")
def _(read):
    return read("lineitem").select(_Q.label().alias("l_quantity_bin")).groupBy("l_quantity_bin").agg(F.count(F.lit(1)).alias("n"))


@C.add("bin2d_counts", _BINNED + f""", g AS (SELECT q, d, qi, di FROM (VALUES {", ".join(f"({m}, {i})" for i, m in enumerate(_Q.mids))}) a(q, qi), (VALUES {", ".join(f"({m}, {i})" for i, m in enumerate(_D.mids))}) c(d, di))
    SELECT CAST(q AS DOUBLE) AS l_quantity, CAST(d AS DOUBLE) AS l_discount, CAST(qi * {len(_D.mids)} + di AS INTEGER) AS cell_id, count(b.l_orderkey) AS n
    FROM g LEFT JOIN b ON b.l_quantity_bin = CAST(q AS DOUBLE) AND b.l_discount_bin = CAST(d AS DOUBLE) GROUP BY 1, 2, 3""")
def _(read):
    return binning.histogram_2d(read("lineitem"), _Q, _D)


@C.add("hypercube_stats", _BINNED + """, g AS (SELECT l_quantity_bin, l_discount_bin, median(l_extendedprice) AS med, avg(l_extendedprice) AS mean, count(l_extendedprice) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
      quantile_cont(l_extendedprice, 0.4) AS lower_bound, quantile_cont(l_extendedprice, 0.6) AS upper_bound FROM b WHERE l_quantity_bin IS NOT NULL AND l_discount_bin IS NOT NULL GROUP BY 1, 2)
    SELECT l_quantity_bin, l_discount_bin, round(med, 4) AS med, round(mean, 4) AS mean, n, lo, hi, round(lower_bound, 4) AS lower_bound, round(upper_bound, 4) AS upper_bound,
      CAST(row_number() OVER (ORDER BY mean DESC, l_quantity_bin, l_discount_bin) - 1 AS INTEGER) AS cube_id FROM g""")
def _(read):
    keys, t = ["l_quantity_bin", "l_discount_bin"], "l_extendedprice"
    cube = binning.numbered(binning.cells(read("lineitem"), [_Q, _D], [t]), f"{t}_mean", keys)
    names = {"median": "med", "mean": "mean", "lower_bound": "lower_bound", "upper_bound": "upper_bound"}
    return cube.select(*keys, *(F.round(f"{t}_{k}", 4).alias(v) for k, v in names.items()), F.col(f"{t}_count").alias("n"), F.col(f"{t}_min").alias("lo"), F.col(f"{t}_max").alias("hi"), "cube_id")


@C.add("hypercube_residuals", _BINNED + """, g AS (SELECT l_quantity_bin, l_discount_bin, median(l_extendedprice) AS med FROM b WHERE l_quantity_bin IS NOT NULL AND l_discount_bin IS NOT NULL GROUP BY 1, 2 HAVING count(l_extendedprice) > 5)
    SELECT l_orderkey, l_linenumber, round(med - l_extendedprice, 4) AS res_l_extendedprice FROM b LEFT JOIN g USING (l_quantity_bin, l_discount_bin)""")
def _(read):
    return binning.residuals(read("lineitem"), [_Q, _D], "l_extendedprice", least=5).select("l_orderkey", "l_linenumber", F.round("res_l_extendedprice", 4).alias("res_l_extendedprice"))


@C.add("nearest_cube", _BINNED + """, g AS (SELECT l_quantity_bin AS q, l_discount_bin AS d, CAST(row_number() OVER (ORDER BY avg(l_extendedprice) DESC, l_quantity_bin, l_discount_bin) - 1 AS INTEGER) AS cube_id FROM b WHERE l_quantity_bin IS NOT NULL AND l_discount_bin IS NOT NULL GROUP BY 1, 2)
    SELECT p_partkey, cube_id, round(dist, 6) AS distance FROM (SELECT p_partkey, cube_id, sqrt((p_size - q) * (p_size - q) + (0.05 - d) * (0.05 - d)) AS dist,
      row_number() OVER (PARTITION BY p_partkey ORDER BY (p_size - q) * (p_size - q) + (0.05 - d) * (0.05 - d), cube_id) AS rn FROM part, g) WHERE rn = 1""")
def _(read):
    cube = binning.numbered(binning.cells(read("lineitem"), [_Q, _D], ["l_extendedprice"]), "l_extendedprice_mean", ["l_quantity_bin", "l_discount_bin"])
    cube = cube.select("cube_id", F.col("l_quantity_bin").alias("q"), F.col("l_discount_bin").alias("d"))
    rows = read("part").select("p_partkey", F.col("p_size").cast("double").alias("q"), F.lit(0.05).alias("d"))
    return binning.nearest_cell(rows, cube, ["q", "d"]).select("p_partkey", "cube_id", F.round("distance", 6).alias("distance"))


def _mesh_sql(stats: str = "", names: str = "", start: int = 4, levels: int = 3) -> str:
    """Leaves of the mesh over l_quantity and l_extendedprice, a query per level."""
    unit = "(l_quantity - lq) / (hq - lq) AS u, (l_extendedprice - lp) / (hp - lp) AS v, l_discount AS t"
    parts = ["e AS (SELECT min(l_quantity) AS lq, max(l_quantity) AS hq, min(l_extendedprice) AS lp, max(l_extendedprice) AS hp, greatest(1, ceil(0.05 * count(*))) AS most FROM lineitem)", f"o0 AS (SELECT {unit} FROM lineitem, e)"]
    for k in range(levels + 1):
        w = start * 2**k
        parts.append(f"k{k} AS (SELECT *, CAST(least(floor(u * {w}), {w - 1}) AS INTEGER) AS i0, CAST(least(floor(v * {w}), {w - 1}) AS INTEGER) AS i1 FROM o{k})")
        parts.append(f"c{k} AS (SELECT i0, i1, count(*) AS n{stats} FROM k{k} GROUP BY 1, 2)")
        parts.append(f"o{k + 1} AS (SELECT u, v, t FROM k{k} JOIN c{k} USING (i0, i1), e WHERE c{k}.n >= most)")
    leaves = [f"SELECT CAST({k} AS INTEGER) AS level, i0, i1, n{names} FROM c{k}, e" + (f" WHERE n < most" if k < levels else "") for k in range(levels + 1)]
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(leaves)}"


@C.add("mesh_leaf_counts", _mesh_sql())
def _(read):
    return binning.refine(read("lineitem"), ["l_quantity", "l_extendedprice"], bins=4, tolerance=0.05, levels=3)


@C.add("mesh_cell_stats", _mesh_sql(", round(median(t), 6) AS median, round(stddev_samp(t), 6) AS std, min(t) AS min, max(t) AS max", ", median, std, min, max"))
def _(read):
    out = binning.refine(read("lineitem"), ["l_quantity", "l_extendedprice"], bins=4, tolerance=0.05, levels=3, target="l_discount")
    return out.withColumns({c: F.round(c, 6) for c in ("median", "std")})


@C.add("hypercube_model", _BINNED + """, g AS (SELECT l_quantity_bin AS q, l_discount_bin AS d, median(l_extendedprice) AS med, median(l_tax) AS tax, count(*) AS n, row_number() OVER (ORDER BY avg(l_extendedprice) DESC, l_quantity_bin, l_discount_bin) - 1 AS cube_id FROM b WHERE l_quantity_bin IS NOT NULL AND l_discount_bin IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT * FROM g WHERE n > (SELECT quantile_cont(n, 0.5) FROM g)), near AS (SELECT l_quantity AS x, l_discount AS y, cube_id FROM (SELECT x.l_quantity, x.l_discount, k.cube_id, row_number() OVER (PARTITION BY x.l_quantity, x.l_discount ORDER BY (l_quantity - q) * (l_quantity - q) + (l_discount - d) * (l_discount - d), cube_id) AS rn FROM (SELECT DISTINCT l_quantity, l_discount FROM lineitem) x, k) WHERE rn = 1),
    r AS (SELECT b.*, coalesce(o.cube_id, near.cube_id) AS id FROM b LEFT JOIN k o ON o.q = l_quantity_bin AND o.d = l_discount_bin JOIN near ON near.x = l_quantity AND near.y = l_discount)
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(id AS INTEGER) AS cube_id, round(l_extendedprice - med, 4) AS res_l_extendedprice, round(l_tax - tax, 6) AS res_l_tax FROM r JOIN k ON k.cube_id = r.id""")
def _(read):
    from tidewheel.operators.quantiles import exact_quantiles

    rows = read("lineitem")
    counts = rows.groupBy(_Q.label().alias("q"), _D.label().alias("d")).agg(F.count("l_tax").alias("l_tax_count")).na.drop(subset=["q", "d"])
    least = int(exact_quantiles(counts, "l_tax_count", [0.5])[0])
    out, _ = binning.cube_model(rows, [_Q, _D], ["l_extendedprice", "l_tax"], least=least)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "cube_id", F.round("res_l_extendedprice", 4).alias("res_l_extendedprice"), F.round("res_l_tax", 6).alias("res_l_tax"))


@C.add("single_pass_runs", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1")
def _(read):
    return read("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n = 1")


@C.add("dense_rank_stop", "SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate) AS INTEGER) AS stop FROM lineitem")
def _(read):
    return read("lineitem").select("l_orderkey", "l_linenumber", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate")).alias("stop"))


@C.add("running_sum_run", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey ROWS UNBOUNDED PRECEDING), 6) AS running FROM lineitem")
def _(read):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey").rowsBetween(Window.unboundedPreceding, 0)
    return read("lineitem").select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(w), 6).alias("running"))


@C.add("prev_stop", "SELECT l_orderkey, l_linenumber, lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey) AS previous FROM lineitem")
def _(read):
    return read("lineitem").select("l_orderkey", "l_linenumber", F.lag("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey")).alias("previous"))


@C.add("max_per_entity", "SELECT l_orderkey, l_linenumber, max(l_linenumber) OVER (PARTITION BY l_orderkey) - l_linenumber AS remaining FROM lineitem")
def _(read):
    return read("lineitem").select("l_orderkey", "l_linenumber", (F.max("l_linenumber").over(Window.partitionBy("l_orderkey")) - F.col("l_linenumber")).alias("remaining"))


@C.add("last_rows_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def _(read):
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return read("orders").withColumn("_rn", rn).where("_rn <= 3").select("o_custkey", "o_orderkey")


@C.add("long_delay_label", """
    WITH s AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) AS a FROM lineitem GROUP BY 1, 2), t AS (SELECT quantile_cont(a, 0.9) AS cut FROM s)
    SELECT l.l_orderkey, l.l_linenumber, coalesce(s.a > t.cut, false) AS long_delay FROM lineitem l LEFT JOIN s USING (l_suppkey, l_returnflag), t""")
def _(read):
    from tidewheel.operators.quantiles import exact_quantiles

    lines = read("lineitem")
    s = lines.groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("a"))
    cut = exact_quantiles(s, "a", [0.9])[0]
    slow = s.where(F.col("a") > cut).select("l_suppkey", "l_returnflag", F.lit(True).alias("_slow"))
    return lines.join(slow, ["l_suppkey", "l_returnflag"], "left").select("l_orderkey", "l_linenumber", F.coalesce("_slow", F.lit(False)).alias("long_delay"))


@C.add("change_frequency", """
    WITH d AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS f FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, round(avg(f), 6) AS frequency FROM d GROUP BY 1""")
def _(read):
    d = read("lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("f"))
    return d.groupBy("l_suppkey").agg(F.round(F.avg("f"), 6).alias("frequency"))


@C.add("run_totals", "SELECT l_orderkey, round(sum(l_quantity), 6) AS total, max_by(l_quantity, l_linenumber * 1000000000.0 + l_extendedprice) AS last_quantity FROM lineitem GROUP BY 1")
def _(read):
    return read("lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 6).alias("total"), F.max_by("l_quantity", F.struct("l_linenumber", "l_extendedprice")).alias("last_quantity"))


@C.add("operating_modes", "SELECT p_size, p_brand, 'OM ' || CAST(row_number() OVER (ORDER BY p_size, p_brand) AS VARCHAR) AS mode FROM (SELECT DISTINCT p_size, p_brand FROM part)")
def _(read):
    modes = read("part").select("p_size", "p_brand").distinct()
    return modes.withColumn("mode", F.concat(F.lit("OM "), F.row_number().over(Window.orderBy("p_size", "p_brand")).cast("string")))


@C.add("sample_with_replacement", """WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('0/' || c_custkey) || c_custkey) AS i, count(*) OVER () AS total FROM customer),
    d AS (SELECT CAST(floor(CAST(CAST('0x' || substr(md5('0:' || id), 1, 13) AS BIGINT) AS DOUBLE) * (SELECT count(*) FROM customer) / 4503599627370496) AS BIGINT) + 1 AS i, count(*) AS n FROM range(2000) t(id) GROUP BY 1)
    SELECT c_custkey, unnest(range(1, n + 1)) AS copy FROM r JOIN d USING (i)""")
def _(read):
    return sampling.with_replacement(read("customer").select("c_custkey"), 2000, "c_custkey")


QUERIES, ORACLE_SQL = C.queries, C.sql
