import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tracklathe.functions import scalars as s
from tracklathe.operators import features
from tracklathe.plans import flow, model
from tracklathe.sources import readers

T0 = dt.datetime(2022, 1, 3)
N = 6  # flights
MINUTES = 60


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


@pytest.fixture(scope="module")
def tables(spark):
    flights = [(i, T0, f"C{i}", "AAAA", "BBBB", "A320" if i % 2 else "B738", "M", "XX", at(0), at(MINUTES + 10), 60.0, 10.0, 300.0, 60000.0 + 1000 * i) for i in range(N)]
    names = "flight_id long, date timestamp, callsign string, adep string, ades string, aircraft_type string, wtc string, airline string, actual_offblock_time timestamp, arrival_time timestamp, flight_duration double, taxiout_time double, flown_distance double, tow double"
    flights = spark.createDataFrame(flights, names).withColumns({"country_code_adep": F.lit("XX"), "country_code_ades": F.lit("YY")})
    points = []
    for i in range(N):
        for k in range(MINUTES * 12):
            x = k / (MINUTES * 12)
            altitude = 35000 * min(1, 3 * x, 3 * (1 - x)) + 5 * math.sin(k + i)
            points.append((i, 100 + i, at(10 + k / 12), 50 + 5 * x, 1e-4 * math.sin(k), altitude, 450.0 + math.sin(k), 0.5 + 0.3 * math.sin(k / 9), 100.0 + k % 7, 5.0 + k % 3 * 0.01, 1.0, 280.0 - altitude * 0.002, 0.001))
    raw = spark.createDataFrame(points, "flight_id long, icao24 long, timestamp timestamp, latitude double, longitude double, altitude double, groundspeed double, track double, vertical_rate double, u_component_of_wind double, v_component_of_wind double, temperature double, specific_humidity double")
    airports = spark.createDataFrame([("AAAA", 50.0, 0.0, 30.0, "Europe/Paris"), ("BBBB", 55.0, 0.0, 60.0, "UTC")], "icao_code string, latitude_deg double, longitude_deg double, elevation_ft double, time_zone string")
    metars = spark.createDataFrame([("AAAA", at(5), 0.0, 50.0, "TS"), ("BBBB", at(70), 0.0, 55.0, None)], "station string, valid timestamp, lon double, lat double, wxcodes string")
    metars = metars.withColumns({c: F.lit(1.0) for c in "alti drct gust mslp relh sknt skyl1 skyl2 skyl3 skyl4 tmpf vsby".split()} | {c: F.lit("x") for c in "skyc1 skyc2 skyc3 skyc4".split()})
    smoothed = flow.clean_trajectories(raw)
    return raw, smoothed, flow.Tables(readers.with_date_parts(flights), airports, metars, smoothed)


def test_smoothing_keeps_rows_and_follows(tables):
    raw, smoothed, _ = tables
    assert smoothed.count() == raw.count()
    both = raw.select("flight_id", "timestamp", F.col("altitude").alias("was")).join(smoothed, ["flight_id", "timestamp"])
    row = both.agg(F.avg(F.abs(F.col("was") - F.col("altitude"))).alias("off"), F.count("altitude").alias("n"), F.max("tas").alias("tas")).first()
    assert row["off"] < 60 and row["n"] > 0.9 * raw.count() and 400 < row["tas"] < 500
    assert "track" not in smoothed.columns and "daltitude" in smoothed.columns


def test_features_and_predictions(spark, tables):
    _, _, t = tables
    made = flow.feature_tables(t)
    assert len(made.names) == 680
    assert len(made.names) == len(set(made.names)) and set(made.names) <= set(made.df.columns)
    kept = ["aircraft_type", "dayofweek", "flight_duration", "bird_distance", "CruiseMedianAlt_10", "thunder_max_TS_1_ades", "wind_effect", "climbROCD_10"]
    rows = made.df.select("flight_id", "tow", *kept).toPandas()
    assert len(rows) == N and (rows["thunder_max_TS_1_ades"] == 0).all()
    assert rows["CruiseMedianAlt_10"].isna().all()  # under 100 points
    assert rows["bird_distance"].iloc[0] == pytest.approx(300.2, abs=0.5) and rows["wind_effect"].notna().all() and rows["climbROCD_10"].notna().all()
    small = features.FeatureSet(spark.createDataFrame(rows), ["aircraft_type"], ["flight_duration", "bird_distance", "climbROCD_10"], ["dayofweek", "wind_effect"])
    masses = spark.createDataFrame([("A320", 78000.0, 42000.0), ("B738", 79000.0, 41000.0)], "aircraft_type string, mtow double, oew double")
    out = flow.predict(small, small, masses, [0, 1], lambda seed: model.Params(trees=2, depth=2, seed=seed, features="all"))
    assert out.count() == N and out.where("tow BETWEEN 55000 AND 76000").count() == N


def test_mass_expression(spark):
    df = spark.createDataFrame([(3000.0, 150.0, 12.0, 122.6, 0.02, 0.04, 240e3)], "altitude double, tas double, e_rate double, area double, cd0 double, k double, static_thrust double")
    mass = df.select(flow.aircraft_mass({c: F.col(c) for c in ("area", "cd0", "k", "static_thrust")}), s.isa_density(F.col("altitude"))).first()
    assert 20e3 < mass[0] < 200e3 and mass[1] == pytest.approx(0.909, abs=0.01)
