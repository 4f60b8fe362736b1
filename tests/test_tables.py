import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tracklathe.functions import scalars as s
from tracklathe.operators import dates, features, scaling, slices, spatial, weather
from tracklathe.plans import metrics, model
from tracklathe.sources import airports as ports
from tracklathe.sources import readers, sinks

T0 = dt.datetime(2022, 1, 1)


def minute(m):
    return T0 + dt.timedelta(minutes=m)


def planar(lat1, lon1, lat2, lon2):
    return 60 * F.hypot(lat1 - lat2, lon1 - lon2)


@pytest.fixture
def flights(spark):
    rows = [(1, "A", "B", minute(0), minute(60), 10.0), (2, "A", "Z", minute(0), minute(60), 5.0)]
    return spark.createDataFrame(rows, "flight_id long, adep string, ades string, actual_offblock_time timestamp, arrival_time timestamp, taxiout_time double")


@pytest.fixture
def airports(spark):
    return spark.createDataFrame([("A", 0.0, 0.0, "Europe/Paris"), ("B", 1.0, 0.0, None)], "icao_code string, latitude_deg double, longitude_deg double, time_zone string")


def points(spark, known=True):
    h = lambda x: x if known else None
    rows = [(1, minute(12), 0.0, 0.0, 500.0), (1, minute(14), 0.1, 0.0, h(2000.0)), (1, minute(40), 0.9, 0.0, h(3000.0)), (1, minute(45), 0.95, 0.0, 1000.0), (2, minute(7), None, 0.0, 100.0), (2, minute(8), 5.0, 0.0, 200.0)]
    return spark.createDataFrame(rows, "flight_id long, timestamp timestamp, latitude double, longitude double, altitude double")


@pytest.mark.parametrize(("known", "wanted"), [(True, (12, 43)), (False, (10, 60))])
def test_corrected_dates(spark, flights, airports, known, wanted):
    got = {r["flight_id"]: (r["t_adep"], r["t_ades"]) for r in dates.corrected_dates(flights, points(spark, known), airports, planar).collect()}
    assert got == {1: tuple(map(minute, wanted)), 2: (minute(5), minute(60))}


def test_cruise_slices(spark):
    moments = spark.createDataFrame([(1, minute(12), minute(43)), (3, minute(0), minute(1))], "flight_id long, t_adep timestamp, t_ades timestamp")
    row, other = slices.cruise(points(spark).withColumn("tas", F.lit(400.0)), moments, 4).orderBy("flight_id").collect()
    assert [row[f"Cruisemachcount_{i}"] for i in range(4)] == [2, None, None, 1]
    assert [row[f"CruiseDeltaAlt_{i}"] for i in range(4)] == [1500, None, None, 0]
    assert other["f_duration"] == 60 and other["Cruisemachcount_0"] is None


def test_rows_on_an_edge_count_twice(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.25), (1, 0.5), (1, 1.0), (1, 1.5)], "k long, t double").withColumn("ts", F.timestamp_seconds("t"))
    row = slices.closed_slices(df, "k", F.col("t"), 4, {"n": ("count", F.col("t")), "m": ("median", F.col("t"))}, "ts").first()
    assert [row[f"n_{i}"] for i in range(4)] == [2, 2, 1, 1]


def test_slice_edges_and_buckets(spark):
    assert slices.slice_edges() == 48
    df = spark.createDataFrame([(x * 0.3048,) for x in (-500.0, 499.999, 500.0, 46500.0)], "h double")
    assert [r[0] for r in df.select(slices.altitude_bucket(F.col("h"))).collect()] == [0, 0, 1, 47]


def climb_points(spark):
    rows = [(1, minute(i), 500.0 + 100.0 * i, 5.0, 100.0, 280.0, 0.0, 0.0, 100.0, 0.0, 50.0) for i in range(20)]
    return spark.createDataFrame(rows, "flight_id long, timestamp timestamp, altitude double, vertical_rate double, tas double, temperature double, u_component_of_wind double, v_component_of_wind double, tasx double, tasy double, daltitude double")


def test_climbing(spark):
    moments = spark.createDataFrame([(1, "A320", minute(0), minute(40)), (2, "A320", minute(0), minute(40))], "flight_id long, aircraft_type string, t_adep timestamp, t_ades timestamp")
    limits = spark.createDataFrame([("A320", 40000.0, 78000.0)], "aircraft_type string, mass_min double, mass_max double")
    out = slices.climbing(climb_points(spark), moments, limits)
    (row,) = out.collect()
    assert row["mass_max"] == 78000 and len(out.columns) == 3 + 11 * 49
    assert row["climbmasscount_2"] == 0 and row["climbmasscount_40"] is None
    assert row["climbROCD_2"] == 5 and row["climbmassadepdate_2"] == 0
    assert row["takeoffmasscount_0"] is None
    down = slices.climbing(climb_points(spark), moments.withColumn("t_ades", F.col("t_adep") + F.expr("INTERVAL 20 MINUTES")), limits, climb=False, rate=60.0)
    assert down.count() == 1 and "descentROCD_3" in down.columns


def test_wind_skips_zero_speed(spark):
    rows = [(1, minute(1), 3.0, 4.0, 2.0, 1.0, 0.0), (1, minute(2), 3.0, 4.0, 2.0, 1.0, 5.0), (1, minute(90), 9.0, 9.0, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "flight_id long, timestamp timestamp, gsx double, gsy double, u_component_of_wind double, v_component_of_wind double, groundspeed double")
    moments = spark.createDataFrame([(1, minute(0), minute(60))], "flight_id long, t_adep timestamp, t_ades timestamp")
    assert slices.wind_effect(df, moments).first()["wind_effect"] == 2


def test_units(spark):
    df = spark.createDataFrame([(1000.0, 500.0, 100.0, 180.0, 500.0, 1.0)], "altitude double, vertical_rate double, tas double, track double, daltitude double, wind double")
    row = s.to_si(df).first()
    assert [row[c] for c in row.asDict()] == pytest.approx([304.8, 2.54, 51.4444444, math.pi, 500, 1])
    assert list(s.from_si(s.to_si(df)).first()) == pytest.approx(list(df.first()))


def test_polynomials_and_mass(spark):
    df = spark.createDataFrame([(200e3, 30e3, 2e-6, 150.0, 12.0)], "t double, c0 double, c2 double, v double, e double")
    args = [F.col(c) for c in ("t", "c0", "c2", "v", "e")]
    c, b, a = s.total_energy(*args)
    row = df.select(s.equivalent_mass(*args), *s.quadratic_roots(c, b, a), s.poly_eval([c, b, a], s.equivalent_mass(*args))).first()
    assert row[0] == pytest.approx(272232.78392405) and row[1] == pytest.approx(row[0]) and row[2] == pytest.approx(-312232.78392405)
    assert abs(row[3]) < 1
    none = df.select(s.quadratic_roots(F.lit(1.0), F.lit(0.0), F.lit(1.0))[0], s.poly_eval(s.poly_sub([F.lit(1.0)], [F.lit(1.0), F.lit(2.0)]), F.lit(3.0))).first()
    assert none[0] is None and none[1] == -6


def test_rounding_and_recoding(spark):
    df = spark.createDataFrame([(500.0,), (1500.0,), (2500.0,)], "x double")
    assert [r[0] for r in df.select(s.round_thousand(F.col("x"))).collect()] == [0, 2000, 2000]
    rows = spark.createDataFrame([(1.0, 300.0, 50), (1.0, 300.0, 100), (1.0, -300.0, 100), (1.0, 0.0, 100), (1.0, None, 100)], "x double, d double, n int")
    assert [r[0] for r in rows.select(s.recode_slice(F.col("x"), F.col("d"), F.col("n"))).collect()] == [None, -10000, -20000, 1, 1]


def test_atmosphere(spark):
    row = spark.range(1).select(s.isa_temperature(F.lit(0.0)), s.isa_temperature(F.lit(15000.0)), s.isa_density(F.lit(0.0)), s.mach(F.lit(661.47), F.lit(0.0)), s.great_circle_nm(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), s.clip(F.lit(None).cast("double"), 0, 1)).first()
    assert row[0] == 288.15 and row[1] == 216.65 and row[2] == pytest.approx(1.225, abs=1e-3) and row[3] == pytest.approx(1, abs=1e-3) and row[4] == pytest.approx(60.04, abs=0.01) and row[5] is None


def metars(spark):
    rows = [("S", minute(60), 0.0, 1.0, "+TSRA", 10.0), ("S", minute(240), 0.0, 1.0, "FG", 20.0), ("R", minute(0), 0.0, 0.0, None, 30.0)]
    df = spark.createDataFrame(rows, "station string, valid timestamp, lon double, lat double, wxcodes string, tmpf double")
    return df


def test_weather_and_thunder(spark, flights, airports):
    found = weather.weather(flights, airports, metars(spark), ["tmpf"])
    assert [tuple(r) for r in found.collect()] == [(1, 30.0, 10.0)]  # flight 2 has an unknown airport
    row = weather.thunder(flights, airports, metars(spark)).first()
    assert row["thunder_max_TS_1_ades"] == 1 and row["thunder_max_pTS_1_ades"] == 1
    assert row["thunder_max_FG_2_ades"] == 0 and row["thunder_max_FG_3_ades"] == 1 and row["thunder_max_VCTS_6_ades"] == 0


def test_neighbours_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.uniform(-30, 30, (60, 3)), rng.uniform(-30, 30, (80, 3))
    left = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(a)], "id long, x double, y double, z double")
    right = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(b)], "id long, x double, y double, z double")
    at = [F.col(c) for c in "xyz"]
    d = np.linalg.norm(a[:, None] - b, axis=2)
    got = {(r["i"], r["rank"]): r["j"] for r in spatial.nearest(left, right, at, at, "id", ("id",), 3).select(F.col("l.id").alias("i"), "rank", F.col("r.id").alias("j")).collect()}
    assert got == {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.argsort(d[i])[:3])}
    pairs = {(r[0], r[1]) for r in spatial.within_radius(left, right, at, at, 7.0).select("l.id", "r.id").collect()}
    assert pairs == set(zip(*map(lambda x: x.tolist(), np.nonzero(d <= 7))))
    assert spatial.nearest(left, right.where("false"), at, at, "id", ("id",)).count() == 0


@pytest.mark.parametrize("k,radius", [(1, math.inf), (3, math.inf), (2, 1.5), (3, 0.0)])
def test_neighbours_across_blocks(spark, monkeypatch, k, radius):
    """Uneven tables with copies and ties, in many small blocks that are copied for few rows each; no cells, no list of pairs."""
    import numpy as np

    monkeypatch.setattr(spatial, "BLOCK", 20)
    monkeypatch.setattr(spatial, "ROWS", 30)
    monkeypatch.setattr(spatial, "met", lambda *_: pytest.fail("pairs by cells"))
    rng = np.random.default_rng(k)
    b = np.concatenate([rng.integers(-4, 5, (150, 3)) / 2, rng.normal(0, 30, (40, 3)), np.zeros((70, 3))])
    a = np.concatenate([rng.integers(-4, 5, (100, 3)) / 2, rng.normal(0, 60, (40, 3)), b[:20]])
    table = lambda rows: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(rows)] + [(900, None, 1.0, 1.0), (901, math.inf, 1.0, 1.0)], "id long, x double, y double, z double")
    at = [F.col(c) for c in "xyz"]
    out = spatial.nearest(table(a), table(b), at, at, "id", ("id",), k, radius=radius)
    got = {(r["i"], r["rank"]): (r["j"], r["distance"]) for r in out.select(F.col("l.id").alias("i"), "rank", F.col("r.id").alias("j"), "distance").collect()}
    d = np.sqrt(((a[:, None] - b) ** 2).sum(2))
    assert got == {(i, n + 1): (int(j), pytest.approx(d[i, j])) for i in range(len(a)) for n, j in enumerate(np.argsort(d[i], kind="stable")[:k]) if d[i, j] <= radius}


def test_few_candidates_where_many_sites_lie():
    import numpy as np

    rng = np.random.default_rng(5)
    x, sites = rng.normal(0, 1, (3000, 3)), rng.normal(0, 1, (20_000, 3))
    row, site, distance, reach = spatial.closest(x, sites, 2, np.full(3000, math.inf))
    assert len(row) == 6000 and (np.bincount(row) == 2).all()
    for i in range(0, 3000, 100):
        assert sorted(distance[row == i]) == pytest.approx(np.sort(np.sqrt(((x[i] - sites) ** 2).sum(1)))[:2].tolist()) and reach[i] == max(distance[row == i])


def test_thunder_lists_no_pairs(spark, flights, airports, monkeypatch):
    monkeypatch.setattr(spatial, "met", lambda *_: pytest.fail("pairs by cells"))
    row = weather.thunder(flights, airports, metars(spark), ("FG", "+TS", "none"), (2, 3)).first()
    assert [row[f"thunder_max_{c}_{r}_ades"] for r in (2, 3) for c in ("FG", "pTS", "none")] == [0, 1, 0, 1, 1, 0]


def test_airports(spark, flights):
    raw = spark.createDataFrame([("A", "X", 1.0, 2.0), ("Q", "B", 1.0, 2.0), ("EGSY", "A", 0.0, 0.0), ("U", "V", 0.0, 0.0)], "ident string, gps_code string, latitude_deg double, longitude_deg double")
    used = ports.used_airports([flights])
    made = ports.resolve_airports(raw, used, lambda lat, lon: F.lit("UTC"))
    assert sorted(r["icao_code"] for r in made.collect()) == ["A", "B"]
    assert [tuple(r) for r in ports.airport_faults(made, used).collect()] == [("Z", "missing")]


def test_local_times(spark, flights, airports):
    row = ports.add_local_times(flights, airports).where("flight_id = 1").first()
    assert row["local_hour_adep"] == 60 and row["local_hour_ades"] is None


def test_scalers(spark):
    masses = spark.createDataFrame([("A", 100.0, 50.0), ("B", 200.0, 100.0), ("C", 150.0, 70.0), ("D", 300.0, 140.0)], "aircraft_type string, mtow double, oew double")
    rows = [(t, m + i) for t, m in (("A", 70.0), ("B", 140.0), ("C", 100.0)) for i in range(12)]
    df = spark.createDataFrame(rows, "aircraft_type string, tow double")
    for scaler in (scaling.Identity(), scaling.Standard(), scaling.oew_mtow(masses), scaling.Observed(), scaling.Learned(masses=masses)):
        made = scaler.fit(df).transform(df)
        back = scaler.inverse(made.withColumn("prediction", F.col("label")), "prediction", "again")
        assert back.where("abs(again - tow) > 1e-9").count() == 0
    row = scaling.oew_mtow(masses).transform(df).where("tow = 70").first()
    assert row["label"] == 0.4 and row["weight"] == 2500
    with pytest.raises(Exception, match="no scale"):
        scaling.oew_mtow(masses).transform(spark.createDataFrame([("Z", 1.0)], df.schema)).collect()
    with pytest.raises(ValueError, match="rows or fewer"):
        scaling.Observed().fit(df.limit(3))
    small = df.unionByName(spark.createDataFrame([("S", 5.0)], df.schema))
    grouped = scaling.GroupFeatureScaler(["tow"], {"S": "A"}).fit(small)
    assert grouped.inverse(grouped.transform(small)).where("abs(tow) > 1000").count() == 0
    with pytest.raises(ValueError, match="without synonym"):
        scaling.GroupFeatureScaler(["tow"], {}).fit(small)


def test_features(spark):
    cruise = spark.createDataFrame([(1, 10.0, 300.0, 150, 1500.0, 0.7, 0.0, 50, 2500.0, 0.8)], "flight_id long, f_duration double, CruiseDeltaAlt_0 double, Cruisemachcount_0 long, CruiseMedianAlt_0 double, Cruisemach_0 double, CruiseDeltaAlt_1 double, Cruisemachcount_1 long, CruiseMedianAlt_1 double, Cruisemach_1 double")
    made = features.cruise_features(cruise)
    row = made.df.first()
    assert row["CruiseMedianAlt_0"] == -10000 and row["Cruisemach_1"] is None and "flight_id" not in made.numeric
    mass = spark.createDataFrame([(1, 10.0, 20.0, 15.0, 3.0)], "flight_id long, mass_min double, mass_max double, climbmass_0 double, climbROCD_0 double")
    got = features.mass_features(mass)
    assert got.df.first()["climbmass_0"] == 0.5 and got.numeric == ["climbROCD_0", "climbmass_0"]
    base = features.FeatureSet(spark.createDataFrame([(1, "A320"), (2, "A310")], "flight_id long, aircraft_type string"), ["aircraft_type"])
    both = features.union(base, [got, features.all_categorical(spark.createDataFrame([(1, "x")], "flight_id long, kind string"))])
    assert both.df.count() == 1 and both.categorical == ["aircraft_type", "kind"]


def test_model(spark):
    rows = [(i, "A" if i % 2 else "B", float(i % 10), 100.0 + 5 * (i % 10) + (20 if i % 2 else 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "flight_id long, kind string, x double, tow double")
    train, held = model.split(df, "flight_id", 3)
    assert held.count() == 40 and train.count() == 160
    fitted = model.fit(features.FeatureSet(train, ["kind"], ["x"]), scaling.Standard(), model.Params(trees=6, depth=3, features="all", rows=1.0))
    assert metrics.rmse(fitted.predict(held.withColumnRenamed("tow", "truth"), "tow"), "truth", "tow").first()["rmse"] < 6
    curve = fitted.staged(held, "tow", 2)
    assert [n for n, _ in curve] == [2, 4, 6] and curve[-1][1] <= curve[0][1]
    assert {n for n, _ in fitted.importance()} == {"kind", "x"}
    odd = spark.createDataFrame([(1, "new", None), (2, None, 3.0)], "flight_id long, kind string, x double")
    assert fitted.predict(odd).where("tow IS NULL").count() == 0


def test_a_fit_holds_even_parts(spark, monkeypatch):
    monkeypatch.setattr(model, "ROWS", 20)
    parts = []
    whole = model.GBTRegressor.fit
    monkeypatch.setattr(model.GBTRegressor, "fit", lambda self, df: parts.append(df.rdd.glom().map(len).collect()) or whole(self, df))
    df = spark.createDataFrame([(i, float(i % 10), 100.0 + i) for i in range(200)], "flight_id long, x double, tow double").coalesce(1)
    model.fit(features.FeatureSet(df, [], ["x"]), scaling.Standard(), model.Params(trees=2, depth=2))
    assert sum(parts[0]) == 200 and max(parts[0]) <= 40 and len(parts[0]) == 10


def test_search():
    space = {"a": [1, 2, 3, 4], "b": [10, 20]}
    score = lambda c: (c["a"] - 3) ** 2 + c["b"]
    known = {}
    assert model.climb(score, {"a": 1, "b": 20}, space, known)[0] == {"a": 3, "b": 10}
    assert model.search(score, model.candidates(space, 20, 1), known)[1] >= 10


def test_metrics(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 4.0), (2, 6.0)], "flight_id long, tow double")
    assert {tuple(r) for r in metrics.ensemble(df).collect()} == {(1, 15.0), (2, 5.0)}
    with pytest.raises(ValueError):
        metrics.ensemble(df.limit(3))
    with pytest.raises(ValueError):
        dates.require_unique(df, "flight_id")


def test_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.csv").write_text("#DEBUG\nstation,valid,lon,lat,tmpf,wxcodes\nAAA,2022-01-01 00:00,1,2,M,TS\n")
    row = readers.metars(spark, str(tmp_path / "m")).first()
    assert row["tmpf"] is None and row["lat"] == 2 and row["valid"] == T0
    (tmp_path / "CONFIG").write_text("# c\na = b # d\nfolder = $(x)/y\n")
    config = readers.read_config(str(tmp_path / "CONFIG"))
    assert config.a == "b" and config.folder == "$(x)/y"
    assert readers.read_json(str(tmp_path / "none"), {"team": "t"}) == {"team": "t"}
    df = spark.createDataFrame([(2, 1.5), (1, 2.5)], "flight_id long, tow double")
    assert sinks.submission(df, str(tmp_path / "s")).endswith("team_v0_.csv")
    (tmp_path / "s/averaged_10.csv").write_text("x\n")
    assert sinks.submission(df, str(tmp_path / "s")).endswith("team_v1_.csv")
    assert readers.predictions(spark, str(tmp_path / "s"), 0, 2).count() == 4
    with pytest.raises(ValueError):
        sinks.submission(spark.createDataFrame([(1, None)], df.schema), str(tmp_path / "s"))
    sinks.log_experiment(str(tmp_path / "log"), {"a": 1, "score": 2.0})
    assert model.remembered(readers.experiments(spark, str(tmp_path / "log")), ["a"], "score") == {(("a", 1),): 2.0}
    nan = spark.createDataFrame([(1, float("nan"))], "flight_id long, x double")
    sinks.parquet(nan, str(tmp_path / "p"))
    assert readers.raw_trajectories(spark, str(tmp_path / "p")).first()["x"] is None
    assert [s.coerce(x) for x in ("1", "1.5", "a")] == [1, 1.5, "a"]


def test_stream(spark, tmp_path):
    from tracklathe.streaming import ingest

    df = spark.createDataFrame([(1, minute(0), 1.0), (1, minute(0), 1.0), (1, minute(0) + dt.timedelta(seconds=5), 3.0)], "flight_id long, timestamp timestamp, x double")
    df.write.parquet(str(tmp_path / "in"))
    query = ingest.points(spark, str(tmp_path / "in"), df.schema).writeStream.format("memory").queryName("points").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("points").count() == 2


def test_readers_of_flights_airports_and_masses(spark, tmp_path):
    (tmp_path / "f.csv").write_text("flight_id,adep,tow,actual_offblock_time,arrival_time,taxiout_time\n7,LFPG,60000.5,2024-01-01 23:30:00,2024-01-02 01:05:00,12\n")
    row = readers.flights_csv(spark, str(tmp_path / "f.csv")).first()
    assert (row["flight_id"], row["tow"], row["taxiout_time"]) == (7, 60000.5, 12.0)
    readers.flights_csv(spark, str(tmp_path / "f.csv")).write.parquet(str(tmp_path / "f"))
    row = readers.flights(spark, str(tmp_path / "f")).first()
    assert (row["dayofweek"], row["weekofyear"], row["arrival_minutes"], row["actual_offblock_minutes"]) == (1, 1, 65, 23 * 60 + 30)
    (tmp_path / "a.csv").write_text("ident,latitude_deg,longitude_deg,elevation_ft\nLFPG,49.01,2.55,392\n")
    row = readers.airports_csv(spark, str(tmp_path / "a.csv")).first()
    assert (row["ident"], row["latitude_deg"], row["elevation_ft"]) == ("LFPG", 49.01, 392.0)
    (tmp_path / "m.csv").write_text("aircraft_type,mtow,oew,source,range\nA320,78000,42600,x,\n")
    row = readers.aircraft_masses(spark, str(tmp_path / "m.csv")).first()
    assert (row["mtow"], row["oew"], row["range"]) == (78000.0, 42600.0, None)
    spark.createDataFrame([(1, 9, "2024-01-01", 1000.0, float("nan"))], "flight_id int, icao24 long, timestamp string, altitude double, track double").write.parquet(str(tmp_path / "t"))
    row = readers.trajectories(spark, str(tmp_path / "t")).first()
    assert row["altitude"] == pytest.approx(304.8) and row["track"] is None
    assert readers.table_folder(spark, str(tmp_path / "t")).first()["track"] is None


def test_synonyms_and_thrust(spark):
    df = spark.createDataFrame([("BCS3",), ("b738",), (None,)], "kind string")
    assert [r[0] for r in df.select(s.synonyms(F.col("kind"))).collect()] == ["a319", "b738", None]
    assert len(s.SYNONYMS) == 12
    h, v = F.lit(3000.0), F.lit(150.0)
    full, idle = spark.range(1).select(s.max_climb_thrust(h, v, F.lit(2e5)), s.idle_thrust(h, v, F.lit(2e5))).first()
    assert 0 < idle < full < 2e5


def test_a_constant_target_has_scale_one(spark):
    df = spark.createDataFrame([(1, "A", 5.0), (2, "A", 5.0)], "flight_id long, aircraft_type string, tow double")
    for scaler in (scaling.Standard(), scaling.Observed(least=1)):
        assert [tuple(r) for r in scaler.fit(df).transform(df).select("label", "weight").collect()] == [(0.0, 1.0)] * 2
