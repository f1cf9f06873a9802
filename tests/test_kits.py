import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.kits import bikes, crossings, energy, engines, fleet, gearbox, retention, trains
from tidewheel.operators import events, learning

D = dt.date(2020, 1, 6)  # a Monday
at = lambda day, h, m=0: dt.datetime.combine(D + dt.timedelta(day), dt.time(h, m))


@pytest.fixture(scope="module")
def arrived(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("kit") / "otp.csv"
    rows = ["train_id,direction,origin,next_station,date,status,timeStamp"]
    for day in range(9):
        date = D + dt.timedelta(day)
        for train, hour in (("101", 7), ("102", 7), ("103", 12)):
            for k, station in enumerate("ABC"):
                late = day + k if train == "101" else 0
                rows.append(f"{train},N,A,{station},{date},{f'{late} min' if late else 'On Time'},{date} {hour:02d}:{10 * k:02d}:00")
    rows += [f"9x9,N,A,B,{D},On Time,{D} 07:00:00", f"104,N,A,None,{D},On Time,{D} 07:00:00", f"105,N,A,B,{D},999 min,{D} 07:00:00", f"106,S,A,B,{D},None,{D} 07:00:00", f"103,N,A,B,{D},On Time,{D} 13:00:00"]
    path.write_text("\n".join(rows) + "\n")
    return trains.arrivals(spark, str(path)).cache()


@pytest.fixture(scope="module")
def placed(spark):
    rows = [("101", "1", s, "A", "C", -75.0, 40.0 + k / 10, c, D) for k, s in enumerate("ABC") for c in ("-1", "2" if s == "B" else "-1")]
    rows += [("102", "3", "B", "A", "C", -75.0, 40.1, "-1", D)]
    return spark.createDataFrame(rows, "train_id string, status string, next_station string, source string, dest string, lon double, lat double, track_change string, date date")


def test_trains(arrived, placed):
    good = trains.valid(arrived)
    assert {r.train_id for r in good.select("train_id").distinct().collect()} == {"101", "102", "103", "105", "106"}
    timed = trains.time_features(trains.running(trains.with_delay(good)))
    assert {r.train_id for r in timed.select("train_id").distinct().collect()} == {"101", "102", "103"}
    seen = trains.overview(timed).first()
    assert (seen.n_stations, seen.n_trains, seen.n_runs, seen.first_date) == (3, 3, 27, D) and 0 < seen.percent_on_time < 100
    once = trains.single_passes(timed, timed)
    assert once.count() == timed.count() - 2 and once.where(f"train_id = '103' and next_station = 'B' and date = '{D}'").count() == 0
    assert {r["hour"]: r.n_trains for r in trains.hourly_trains(once).collect()} == {"07": 2, "12": 1}
    rush = trains.with_rush_hour(once, 0.4)
    assert {(r["hour"], r.weekend) for r in rush.where("rush_hour").collect()} == {("07", False)}
    ranked = trains.with_rank(once)
    far = {(r.train_id, r.date, r.next_station): r for r in trains.with_distance(ranked, placed).collect()}
    b, c = far["101", D, "B"], far["101", D, "C"]
    assert b.previous_station == "A" and b.distance == pytest.approx(11.1, abs=0.05) and c.running_distance == pytest.approx(b.distance + c.distance)
    assert far["101", D, "A"].distance is None and far["101", D, "A"].running_distance == 0
    total = {(r.train_id, r.date): r for r in trains.run_totals(trains.with_distance(ranked, placed)).collect()}["101", D + dt.timedelta(2)]
    assert (total.delay, total.last_delay) == (2 + 3 + 4, 4)
    assert {r.next_station: r.running_delay for r in trains.with_running_delay(ranked).where(f"train_id = '101' and date = '{D}'").collect()} == {"A": 0, "B": 1, "C": 3}
    assert {r.next_station for r in trains.with_long_delay_station(once, 0.6).where("long_delay_station").collect()} == {"C"}
    week = {(r.next_station, r.date): r.last_week_delay for r in trains.with_last_week_delay(once).where("train_id = '101'").collect()}
    assert week["A", D] == 0 and week["A", D + dt.timedelta(8)] == pytest.approx(np.mean(range(1, 8)))
    changes = trains.track_changes(trains.with_delay(placed))
    assert {(r.train_id, r.next_station): (r.changed, r.delay) for r in changes.collect()}["101", "B"] == (1, 2)
    out = trains.mean_change_frequency(trains.change_frequency(changes)).collect()
    assert [(r.next_station, r.frequency) for r in out] == [("B", 0.5), ("A", 0.0), ("C", 0.0)]


def test_bikes(spark, tmp_path):
    head = "trip_id,starttime,stoptime,bikeid,tripduration,from_station_name,to_station_name,from_station_id,to_station_id,usertype,gender,birthyear\n"
    line = "{},1/{}/2020 {}:05,1/{}/2020 {}:25,b{},{},{},{},{},{},Member,{},1990\n"
    made = [("P", "Q", "Female", 6, 8, 600), ("P", "Q", "Male", 6, 8, 1200), ("Q", "P", "Female", 7, 17, 300), ("P", "P", "Male", 11, 12, 60), ("P", "R", "Male", 8, 9, 900), ("X", "P", "", 8, 9, 900)]
    (tmp_path / "t.csv").write_text(head + "".join(line.format(k, d, h, d, h, k % 2, s, a, b, a, b, g) for k, (a, b, g, d, h, s) in enumerate(made)))
    (tmp_path / "s.csv").write_text("name,terminal,lat,long,dockcount,online,elevation\n" + "".join(f"{n},{n},47.{k},-122.{k},10,2014,{k}\n" for k, n in enumerate("PQR")))
    all_ = bikes.enriched(bikes.trips(spark, str(tmp_path / "t.csv")))
    assert {r.gender for r in all_.select("gender").distinct().collect()} == {"Female", "Male", "Unknown"}
    trips = bikes.located(all_, bikes.stations(spark, str(tmp_path / "s.csv")), elevation=True)
    assert trips.count() == 5 and trips.where("from_station_elevation = 1").count() == 1
    r = trips.where("trip_id = 0").first()
    assert (r.minutes, r.age, r.day, r.month, r["hour"]) == (10.0, 30, "Mon", "Jan", 8)
    stats = bikes.dataset_stats(trips).first()
    assert (stats.n_trips, stats.n_bikes, stats.n_stations) == (5, 2, 2)
    assert {r.gender: (r.n_trips, r.minutes) for r in bikes.by_gender(trips).collect()} == {"Female": (2, 7.5), "Male": (3, 12.0)}
    ratio = {r.to_station_name: r.first_to_second for r in bikes.destination_popularity(trips).collect()}
    assert ratio == {"Q": pytest.approx(1.5), "P": pytest.approx(1.5)}
    assert [(r.to_station_name, r.n) for r in bikes.morning_destinations(trips).collect()] == [("Q", 2), ("R", 1)]
    assert [(r.to_station_name, r.n) for r in bikes.evening_destinations(trips).collect()] == [("P", 1)]
    assert [r.to_station_name for r in bikes.popular_with(trips, "Female").collect() if r.to_station_name == "Q"] == ["Q"]
    assert [(r.station, r.departures, r.arrivals, r.difference) for r in bikes.unbalanced(trips).collect()] == [("P", 4, 2, -2), ("Q", 1, 2, 1)]
    assert {(r.from_station_name, r.to_station_name): (r.median_minutes, r.n) for r in bikes.unbalanced_durations(trips).collect()} == {("P", "Q"): (15.0, 2), ("Q", "P"): (5.0, 1)}
    assert {r["hour"]: r.n for r in bikes.per_hour(trips, bikes.WEEKDAYS).collect()} == {8: 0.4, 17: 0.2, 9: 0.2}
    assert {r.day: r.n_trips for r in bikes.per_period(trips, "day").collect()} == {"Mon": 2, "Tue": 1, "Sat": 1, "Wed": 1}


def test_sessions_without_key(spark):
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.choice([1, 4, 5, 6, 40], 400)).tolist()
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1) + dt.timedelta(seconds=int(x)),) for x in t], "at timestamp_ntz")
    got = [r.session for r in events.sessions_unkeyed(df, "at", 5, bucket_seconds=60).orderBy("at").collect()]
    assert got == [r.session for r in events.sessions(df, "at", 5).orderBy("at").collect()] and len(set(got)) > 10


def test_retention(spark, tmp_path):
    rng = np.random.default_rng(0)
    lines, t = ["time," + ",".join(["minXAcc", "maxXAcc", "minYAcc", "maxYAcc", "minZAcc", "maxZAcc"])], 0
    for drive, n in enumerate((40, 5, 60)):
        t += 100
        for k in range(n):
            t += 1
            low, high = rng.normal(0, 0.1, 3) - 0.3, rng.normal(0, 0.1, 3) + 0.3
            if drive == 2 and k == 30:
                high[0] = 2.0  # 133 % of the limit
            if drive == 0 and k == 20:
                low[1] = -4.5  # 250 %
            lines.append(f"{dt.datetime(2020, 1, 1) + dt.timedelta(seconds=t)}," + ",".join(f"{v:.4f}" for p in zip(low, high) for v in p))
    (tmp_path / "d.csv").write_text("\n".join(lines) + "\n")
    rows = retention.drives(spark, str(tmp_path / "d.csv")).cache()
    assert {r.drive: r["count"] for r in rows.groupBy("drive").count().collect()} == {0: 40, 2: 60}
    assert sorted((r.drive, r.event) for r in retention.detected(rows).collect()) == [(0, "Hard_incident"), (2, "Warning")]
    apart, both = retention.compressed_apart(rows).cache(), retention.compressed_by_end(rows).cache()
    for kept in (apart, both):
        assert 0 < kept.count() <= rows.count() and kept.groupBy("drive", "t").count().where("count > 1").count() == 0
        error = retention.reconstruction_rmse(rows, kept).first()
        assert 0 <= error.rmse < 0.6
    full = retention.reconstruction_rmse(rows, rows.select("drive", "t", *retention.SIGNALS)).first()
    assert full.rmse == 0
    assert {(r.original, r.compressed): r.n for r in retention.event_confusion(rows, rows).collect()} == {("Hard_incident", "Hard_incident"): 1, ("Warning", "Warning"): 1}


def test_engines(spark, tmp_path):
    rng = np.random.default_rng(1)
    make = lambda ids, n: [(i, c, *[0.0] * 3, float(c + rng.normal()), *rng.normal(0, 1, 20).tolist()) for i in ids for c in range(1, n + 1)]
    (tmp_path / "train.txt").write_text("\n".join(" ".join(map(str, r)) + "  " for r in make((1, 2), 80)) + "\n")
    (tmp_path / "truth.txt").write_text("12 \n40 \n")
    train = engines.with_label(engines.with_remaining(engines.cycles(spark, str(tmp_path / "train.txt"))))
    assert train.where("label = 1").count() == 2 * 31 and train.where("cycle = 80").select("rul").distinct().first().rul == 0
    left = engines.truth(spark, str(tmp_path / "truth.txt"))
    assert [(r.id, r.more) for r in left.orderBy("id").collect()] == [(1, 12), (2, 40)]
    assert engines.with_remaining(train.drop("rul"), left).where("id = 2 and cycle = 80").first().rul == 40
    scaled = engines.scaled_like(train, train, engines.INPUTS)
    ends = scaled.agg(F.min("s1"), F.max("s1"), F.max("setting1")).first()
    assert tuple(ends) == (0.0, 1.0, 0.0)
    w = engines.windows(scaled, ["s1", "s2"], 10)
    assert w.count() == 2 * 70 and {len(r.window) for r in w.collect()} == {10}
    last = engines.last_windows(scaled, ["s1"], 50).orderBy("id").collect()
    assert [(r.id, r.label, r.window[0].cycle) for r in last] == [(1, 1, 31), (2, 1, 31)] and not engines.last_windows(scaled, ["s1"], 81).count()
    x = engines.window_features(w, ["s1"]).cache()
    out = engines.predicted(engines.fitted(x, ["s1"], rounds=5), x, ["s1"]).collect()
    assert np.mean([r.label == r.predicted for r in out]) > 0.9
    assert engines.sensor_curves(train, [1, 2], ["s1", "s2"]).count() == 80 * 2


def test_gearbox(spark):
    rate, rows = 1000.0, []
    for sample, rpm, torque, tone in (("a_1", 600, 50, 3.0), ("a_2", 600, 50, 3.0), ("b_1", 1200, 50, 7.0), ("pitting_level_3_x", 600, 50, 9.0), ("slow", 5, 50, 3.0)):
        f = tone * rpm / 60
        rows += [(sample, rpm, torque, i, *(math.sin(2 * math.pi * f * i / rate) * (1 + k) + 0.01 * math.cos(i * i) for k in range(3))) for i in range(1000)]
    long = gearbox.by_direction(spark.createDataFrame(rows, "sample string, rpm int, torque int, i int, x double, y double, z double"))
    banded = gearbox.orders(long, rate=rate, segment=500)
    prof = gearbox.profiles(banded).cache()
    got = {(r.sample, r.direction): np.array(r.profile) for r in prof.collect()}
    assert len(got) == 12 and all(p.sum() == pytest.approx(1) for p in got.values())
    assert int(got["a_1", "x"].argmax()) == 1 and int(got["b_1", "z"].argmax()) == 3
    h = gearbox.components(prof.where("not sample like 'pitting%'"), 3)
    weighted = gearbox.weights(prof, h).cache()
    healthy = weighted.where("not sample like 'pitting%'")
    assert [(r.torque, r.rpm, r["mode"]) for r in gearbox.operating_modes(healthy).orderBy("mode").collect()] == [(50, 600, 1), (50, 1200, 2)]
    away = gearbox.distances(weighted, gearbox.fingerprints(healthy))
    assert away.count() == 4 * 2
    own = {r.sample: r for r in gearbox.own_distances(away, gearbox.operating_modes(healthy)).collect()}
    assert own["a_1"].distance < 0.05 and own["b_1"].distance < 0.05 and own["pitting_level_3_x"].distance > own["a_1"].distance
    assert (own["pitting_level_3_x"].pitting_level, own["pitting_level_3_x"].pitting, own["a_1"].pitting) == (3, True, False)


def test_energy(spark):
    minutes = spark.createDataFrame([(at(0, 0) + dt.timedelta(minutes=30 * k), 1.2) for k in range(48 * 70) if k % 7], "datetime timestamp_ntz, Global_active_power double")
    hourly = energy.hourly_consumption(minutes)
    assert hourly.count() == 24 * 70 and hourly.agg(F.max("consumption")).first()[0] == pytest.approx(40)
    degrees = spark.createDataFrame([(at(0, 0) + dt.timedelta(hours=k), -9999.0 if k == 200 else 10.0) for k in range(24 * 70)], "datetime timestamp_ntz, temperature double")
    x = energy.forecast_features(hourly, degrees)
    assert x.count() == 24 * 63 - 1 and x.columns == ["time", "consumption", *energy.FEATURES]
    errors = energy.forecast_errors(x, model=learning.persistence_model).collect()
    assert [r.fold for r in errors] == ["2020-02", "2020-03"] and all(r.mae < 40 for r in errors)

    rows = spark.createDataFrame([(c, at(0, 0) + dt.timedelta(minutes=30 * k), float((k + len(c)) % 48)) for c in ("a", "bb") for k in range(400)], "consumer string, ts timestamp_ntz, consumption double")
    scaled = energy.scaled_per_household(rows, "2020-01-10")
    assert tuple(scaled.agg(F.min("consumption"), F.max("consumption")).first()) == (0.0, 1.0)
    f = energy.household_features(scaled).cache()
    assert f.count() == 2 * (400 - 337 - 1)
    split = energy.parts(f, "2020-01-13", "2020-01-14")
    assert sum(p.count() for p in split.values()) == f.count()
    lags = [f"consumption_lag{k}" for k in energy.LAGS]
    forest = learning.local_forests(f, "consumer", lags, "target", trees=2, depth=2)
    vectors = energy.evaluation_vectors(learning.federated_losses(forest, f, "consumer", lags, "target", 2)).collect()
    assert {len(r.vector) for r in vectors} == {4} and all(abs(sum(r.vector)) < 1e-9 for r in vectors)
    daily = energy.daily_errors(f.withColumn("predicted", F.col("target") + 1)).collect()
    assert all(r.rmse == pytest.approx(1) for r in daily)
    flags = spark.createDataFrame([("a", True), ("a", False), ("bb", False)], "consumer string, drift boolean")
    groups = spark.createDataFrame([("a", 0), ("bb", 1), ("c", 1)], "consumer string, cluster int")
    out = {r.cluster: r for r in energy.maintenance(flags, groups).collect()}
    assert (out[0].supported, out[0].retrain, out[1].supported, out[1].retrain) == (False, True, True, False)


def test_crossings(spark, tmp_path):
    lines = ["row,Node,Timestamp,Date,Time,Hour,DayOfWeek,direction_0,direction_1,Total"]
    k = 0
    for day in range(28):
        d = D + dt.timedelta(day)
        quiet = d.weekday() >= 5 or d == dt.date(2020, 1, 20)  # a federal holiday
        for h in range(24):
            for node in ("n", "m"):
                total = (20 if h == 12 else 2) if quiet else (90 if h in (8, 17) else 5)
                lines.append(f"{k},{node},{d} {h:02d}:00:00,{d},{h:02d}:00,{h},{d.isoweekday()},1,1,{total + day % 3}")
                k += 1
    (tmp_path / "c.csv").write_text("\n".join(lines) + "\n")
    df = crossings.crossings(spark, str(tmp_path / "c.csv")).cache()
    assert {r.node: (r.first_ts, r.last_ts) for r in crossings.node_ranges(df).collect()} == {n: (at(0, 0), at(27, 23)) for n in "nm"}
    grid = crossings.week_grid(df).orderBy("day_of_week").collect()
    assert len(grid) == 7 and grid[0]["8"] > grid[0]["12"] and crossings.week_grid(df, True).count() == 14
    assert crossings.daily_totals(df).count() == 28 and crossings.time_of_day(df).count() == 48
    assert crossings.node_totals(df, ["m", "n"]).count() == 28
    days = crossings.day_profiles(df)
    assert days.count() == 28 and len(days.columns) == 26
    clustered = crossings.day_clusters(days)
    assert clustered.columns == ["date", "day_of_week", "pc1", "pc2", "cluster"] and clustered.count() == 28
    by_hand = days.select("date", "day_of_week", (F.col("h12") < 40).cast("int").alias("x"), (F.col("h8") > 40).cast("int").alias("cluster"))
    odd = crossings.unlike_their_weekday(by_hand).collect()
    assert [(r.date, r.holiday) for r in odd] == [(dt.date(2020, 1, 20), "Martin Luther King")]


def test_fleet(spark):
    rows = []
    for k in range(6 * 24 * 3):
        for n, t in enumerate("abcd"):
            power = 100.0 + 10 * math.sin(k / 9) + n + 0.1 * (k * (n + 3) % 7)
            if t == "b" and 100 <= k <= 106:
                power = 20.0
            if t == "c" and k == 300:
                power = 5.0
            rows.append((t, at(0, 0) + dt.timedelta(minutes=10 * k), power, 5.0, 9.0, 350.0 if k % 2 else 10.0))
    df = spark.createDataFrame(rows, "turbine string, datetime timestamp_ntz, power double, wind_speed double, temperature double, wind_direction double").cache()
    mean = fleet.averages(df, {"power": (50, 500)}).collect()
    assert [r.turbine for r in mean] == list("abcd") and min(mean[0].wind_direction % 360, 360 - mean[0].wind_direction % 360) < 0.1
    found = fleet.fleet_events(df).collect()
    assert [(r.turbine, r.start, r.duration, r.flagged, r.event_id) for r in found] == [("b", at(0, 0) + dt.timedelta(minutes=1000), 60.0, 7, "b_2020-01-06 16:40")]
    spike = at(0, 0) + dt.timedelta(minutes=3000)
    assert any(r.turbine == "c" and r.start <= spike <= r.end for r in fleet.residual_events(df, 12, merge_minutes=10).collect())
    gone = fleet.made_missing(df, 20).cache()
    taken = {(r.turbine, r.datetime): r.missing_event for r in gone.where("missing_event > 0").collect()}
    n = len(taken)
    assert gone.count() == df.count() and gone.where("power is null").count() == n and gone.where("original is null").count() == 0
    assert 20 <= n <= 20 * 23 and taken == {(r.turbine, r.datetime): r.missing_event for r in fleet.made_missing(df, 20).where("missing_event > 0").collect()}
    for e in set(taken.values()):
        when = sorted(t for (_, t), k in taken.items() if k == e)
        assert len({u for (u, _), k in taken.items() if k == e}) == 1 and when[-1] - when[0] < dt.timedelta(minutes=230)
    assert fleet.made_missing(df.limit(0), 20).count() == 0
    for how in ("linear", "fleet"):
        errors = fleet.imputation_errors(gone, how).collect()
        assert sum(r.n for r in errors) == n and all(r.rmse is None or r.rmse < 90 for r in errors)
    assert sum(r.n for r in fleet.gap_lengths(gone).collect()) > 0
