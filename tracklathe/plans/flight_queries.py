"""The operators on flights and trajectories, over benchmark tables read as such, with the same results in DuckDB's SQL.

A user's events are a flight's points, an hour counting as a second; orders are flights between nations read as airports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklathe.functions import scalars as s
from tracklathe.operators import dates, features, scaling, sequence, slices, spatial, weather
from tracklathe.sources import airports, readers

START, STEP = -0.5, 8.0

#: Points in SI units, as SQL; the same in Spark below.
POINTS = """(SELECT user_id AS flight_id, epoch_us(ts) // 3600 AS us, event_id, event_type, value, value * 120 AS altitude, CAST(event_id % 13 - 6 AS DOUBLE) AS daltitude, value / 7 AS vertical_rate,
  220.0::DOUBLE + event_id % 70 AS temperature, 100.0::DOUBLE + event_id % 50 AS tas, 60.0::DOUBLE + event_id % 30 AS tasx, 80.0::DOUBLE - event_id % 40 AS tasy, event_id % 11 - 5.0::DOUBLE AS u, event_id % 7 - 3.0::DOUBLE AS v,
  (event_id % 90) / 2.0::DOUBLE AS latitude, (event_id % 140) / 2.0::DOUBLE - 35 AS longitude FROM events)"""
FLIGHTS = "(SELECT user_id AS flight_id, min(epoch_us(ts) // 3600) AS a, max(epoch_us(ts) // 3600) AS b, 'T' || (user_id % 4) AS aircraft_type FROM events GROUP BY user_id)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = readers.raw_trajectories(spark, f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    return e.select(
        F.col("user_id").alias("flight_id"), F.timestamp_micros(F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 3600")).alias("timestamp"), "event_id", "event_type", "value",
        (F.col("value") * 120).alias("altitude"), (i % 13 - 6).cast("double").alias("daltitude"), (F.col("value") / 7).alias("vertical_rate"), (i % 70 + 220.0).alias("temperature"),
        (i % 50 + 100.0).alias("tas"), (i % 30 + 60.0).alias("tasx"), (80.0 - i % 40).alias("tasy"), (i % 11 - 5.0).alias("u_component_of_wind"), (i % 7 - 3.0).alias("v_component_of_wind"),
        (i % 90 / 2.0).alias("latitude"), (i % 140 / 2.0 - 35).alias("longitude"),
    )


def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir).groupBy("flight_id").agg(F.min("timestamp").alias("t_adep"), F.max("timestamp").alias("t_ades"))
    return found.withColumn("aircraft_type", F.concat(F.lit("T"), (F.col("flight_id") % 4).cast("string")))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def energy(spark, sf_dir):
    out = sequence.energy_rate(points(spark, sf_dir))
    return out.select("event_id", F.round("e_rate", 4).alias("e_rate"))


# nulls pass: DuckDB's least and greatest skip them
RATE = """SELECT *, CASE WHEN abs(dt) <= 40 AND power / nullif(dt, 0) IS NOT NULL THEN greatest(-400.0::DOUBLE, least(300.0::DOUBLE, power / nullif(dt, 0))) END AS e_rate FROM (
  SELECT *, (us - lag(us, 5) OVER w) / 1e6 AS dt, 9.80665::DOUBLE * (altitude - lag(altitude, 5) OVER w) * (temperature / greatest(288.15::DOUBLE - 0.0065::DOUBLE * altitude, 216.65)) + 0.5::DOUBLE * (tas * tas - lag(tas * tas, 5) OVER w)
    + (u - lag(u, 5) OVER w) * tasx + (v - lag(v, 5) OVER w) * tasy AS power FROM {points} WINDOW w AS (PARTITION BY flight_id ORDER BY us))""".format(points=POINTS)


def limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("T0", 10.0, 20.0), ("T1", 30.0, 70.0), ("T2", 5.0, 9.5)], "aircraft_type string, mass_min double, mass_max double")


def slices_of_climb(spark, sf_dir):
    return rounded(slices.climbing(points(spark, sf_dir), instants(spark, sf_dir), limits(spark), F.col("tas") * 600, True, start=START, step=STEP), 6)


def slices_of_descent(spark, sf_dir):
    return rounded(slices.climbing(points(spark, sf_dir), instants(spark, sf_dir), limits(spark), F.col("tas") * 600, False, start=START, step=STEP), 6)


def phase_sql(climb: bool) -> str:
    n = slices.slice_edges(START, STEP)
    half = "a <= us AND us < a + (b - a) // 2" if climb else "us < b AND us > a + (b - a) // 2"
    stats = {
        "mass": "round(median(tas * 600) FILTER ({w}), 6)", "masscount": "CASE WHEN count(*) FILTER ({w}) > 0 THEN count(*) FILTER ({w}) END", "massadepdate": "round((min(us) FILTER ({w}) - min(a)) / 1e6, 6)", "massadesdate": "round((max(b) - max(us) FILTER ({w})) / 1e6, 6)",
        "DeltaROCD": "round(max(vertical_rate) FILTER ({w}) - min(vertical_rate) FILTER ({w}), 6)", "ROCD": "round(median(vertical_rate) FILTER ({w}), 6)", "e_rate_median": "round(median(e_rate) FILTER ({w}), 6)", "tas_median": "round(median(tas) FILTER ({w}), 6)",
        "DeltaT_median": "round(median(temperature - greatest(288.15::DOUBLE - 0.0065::DOUBLE * altitude, 216.65)) FILTER ({w}), 6)", "e_rate_max": "round(max(e_rate) FILTER ({w}), 6)", "e_rate_min": "round(min(e_rate) FILTER ({w}), 6)",
    }
    edge = lambda k: f"{(START + k * STEP) * 304.8!r}::DOUBLE"
    tests = [(f"{'climb' if climb else 'descent'}{{}}_{k}", f"daltitude {'>' if climb else '<'} 2.54 AND altitude >= {edge(k)} AND altitude < {edge(k + 1)}") for k in range(n)]
    if climb:
        tests.append(("takeoff{}_0", "daltitude BETWEEN -2.54 AND 2.54 AND altitude >= -10000 AND altitude < 609.6::DOUBLE"))
    columns = ", ".join(f"{sql.format(w=w)} AS {name.format(stat)}" for name, w in tests for stat, sql in stats.items())
    return f"""WITH e AS ({RATE}), l AS (SELECT * FROM (VALUES ('T0', 10.0::DOUBLE, 20.0::DOUBLE), ('T1', 30.0, 70.0), ('T2', 5.0, 9.5)) AS t(aircraft_type, mass_min, mass_max))
SELECT flight_id, max(mass_min) AS mass_min, max(mass_max) AS mass_max, {columns} FROM e JOIN {FLIGHTS} USING (flight_id) LEFT JOIN l USING (aircraft_type) WHERE {half} GROUP BY flight_id"""


def cruise_slices(spark, sf_dir):
    made = features.cruise_features(slices.cruise(points(spark, sf_dir), instants(spark, sf_dir), 4))
    return rounded(made.df)


def cruise_sql() -> str:
    parts = []
    for i in range(4):
        w = f"t BETWEEN {i} / 4.0::DOUBLE AND {i + 1} / 4.0::DOUBLE"
        n = f"count(mach) FILTER ({w})"
        delta = f"arg_max(altitude, us) FILTER ({w}) - arg_min(altitude, us) FILTER ({w})"
        few = f"CASE WHEN count(*) FILTER ({w}) > 0 AND {n} < 100 THEN NULL WHEN {delta} < -200 THEN -20000.0::DOUBLE WHEN {delta} > 200 THEN -10000.0::DOUBLE ELSE {{}} END"
        median = f"round_even(median(altitude) FILTER ({w}) / 1000, 0) * 1000"
        parts += [f"round({few.format(f'median(mach) FILTER ({w})')}, 4) AS Cruisemach_{i}", f"CASE WHEN count(*) FILTER ({w}) > 0 THEN {n} END AS Cruisemachcount_{i}", f"round({delta}, 4) AS CruiseDeltaAlt_{i}", f"round({few.format(median)}, 4) AS CruiseMedianAlt_{i}"]
    return f"""WITH p AS (SELECT *, (us - a)::DOUBLE / nullif((b - a)::DOUBLE, 0) AS t, tas * (1852.0::DOUBLE / 3600) / sqrt(1.4::DOUBLE * 287.05287::DOUBLE * greatest(288.15::DOUBLE - 0.0065::DOUBLE * altitude * 0.3048::DOUBLE, 216.65)) AS mach FROM {POINTS} JOIN {FLIGHTS} USING (flight_id))
SELECT flight_id, round(max(b - a) / 1e6, 4) AS f_duration, {', '.join(parts)} FROM p GROUP BY flight_id"""


def wind_on_track(spark, sf_dir):
    rows = points(spark, sf_dir).withColumnsRenamed({"tasx": "gsx", "tasy": "gsy"}).withColumn("groundspeed", F.col("event_id") % 9 + 0.0)
    return rounded(slices.wind_effect(rows, instants(spark, sf_dir).where("flight_id % 5 <> 0")))


def cleaned_values(spark, sf_dir):
    """The filter of isolated points and the cascade to wind and temperature, after duplicates; rows out of order counted."""
    rows = points(spark, sf_dir).withColumns({"latitude": F.when(F.col("event_type") != "error", F.col("latitude")), "altitude": F.when(F.col("event_type") != "view", F.col("altitude"))})
    rows = sequence.mask_isolated(sequence.dedup(rows, ties=("event_id",)), 6.0, columns=("latitude", "altitude"))
    return sequence.cascade(rows).select("event_id", "latitude", "altitude", "temperature", F.col("u_component_of_wind").alias("u"), F.col("v_component_of_wind").alias("v"))


def lone(c: str) -> str:
    at = f"CASE WHEN {c} IS NOT NULL THEN us / 1e6 END"
    before = f"CASE WHEN row_number() OVER w = 1 THEN 10000.0 ELSE us / 1e6 - last_value({at} IGNORE NULLS) OVER (PARTITION BY flight_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END"
    after = f"CASE WHEN lead(1) OVER w IS NULL THEN 10000.0 ELSE first_value({at} IGNORE NULLS) OVER (PARTITION BY flight_id ORDER BY us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - us / 1e6 END"
    return f"{before} AS {c}_before, {after} AS {c}_after"


CLEANED = f"""
WITH p AS (SELECT * REPLACE (CASE WHEN event_type <> 'error' THEN latitude END AS latitude, CASE WHEN event_type <> 'view' THEN altitude END AS altitude) FROM {POINTS}),
q AS (SELECT *, {lone('latitude')}, {lone('altitude')} FROM p WINDOW w AS (PARTITION BY flight_id ORDER BY us)),
r AS (SELECT *, {', '.join(f"CASE WHEN {c}_before IS NOT NULL AND {c}_after IS NOT NULL AND least({c}_before, {c}_after) <= 6 THEN {c} END AS {c}_kept" for c in ('latitude', 'altitude'))} FROM q)
SELECT event_id, latitude_kept AS latitude, altitude_kept AS altitude, {', '.join(f"CASE WHEN latitude_kept IS NOT NULL AND altitude_kept IS NOT NULL THEN {c} END AS {c}" for c in ('temperature', 'u', 'v'))} FROM r"""


def order_faults(spark, sf_dir):
    """Events whose hour isn't after that of the event before."""
    rows = readers.raw_trajectories(spark, f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("flight_id"), "event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("timestamp"))
    return sequence.out_of_order(rows.withColumn("timestamp", F.timestamp_micros(F.unix_micros("timestamp") + F.col("event_id") % 2))).groupBy("flight_id").agg(F.count("*").alias("n"))


def atmosphere(spark, sf_dir):
    line = readers.table_folder(spark, f"{sf_dir}/lineitem.parquet")
    h, v, t = F.col("l_extendedprice") / 10, F.col("l_quantity") * 4, F.col("l_quantity") + 220
    c0, c2 = s.drag_terms(v, s.isa_density(h), F.lit(120.0), F.lit(0.02), F.lit(0.04))
    polynomial = s.total_energy(F.lit(90_000.0), c0, c2, v, F.col("l_tax") * 100)
    mass = s.equivalent_mass(F.lit(90_000.0), c0, c2, v, F.col("l_tax") * 100)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("BCS3", "A310", "b738", "E290", "C56X")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    made = {
        "isa": s.isa_temperature(h), "deviation": s.temperature_deviation(t, h), "density": s.isa_density(h), "mach": s.mach(v, h), "c0": c0, "c2": c2 * 1e6,
        "balance": s.poly_eval(polynomial, mass), "mass": mass, "share": s.scale_mass(F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_quantity") * 900),
        "added": s.poly_eval(s.poly_sub(s.poly_add([h, v, t], [v, t]), [t]), F.lit(2.0)), "distance": s.great_circle_nm(F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 100, F.col("l_quantity") * 3),
    }
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(c, 7 if k in ("isa", "deviation") else 4).alias(k) for k, c in made.items()], s.synonyms(kind, s.SYNONYMS).alias("kind"), s.contains_any(F.col("l_returnflag"), "R").alias("returned"),
        F.unix_micros(s.midpoint(F.col("l_shipdate").cast("timestamp"), s.shift_minutes(F.col("l_shipdate"), F.col("l_quantity") * 60.5))).alias("middle"), F.round(s.seconds_between(F.col("l_shipdate"), s.shift_minutes(F.col("l_shipdate"), F.col("l_quantity"))), 3).alias("elapsed"),
    )


ATMOSPHERE = """
WITH a AS (SELECT *, l_extendedprice / 10 AS h, l_quantity * 4 AS v, l_quantity + 220 AS t, l_tax * 100 AS e FROM lineitem),
b AS (SELECT *, greatest(288.15::DOUBLE - 0.0065::DOUBLE * h, 216.65) AS isa FROM a),
c AS (SELECT *, CASE WHEN h <= 11000 THEN 101325.0::DOUBLE * pow(isa / 288.15::DOUBLE, 9.80665::DOUBLE / (0.0065::DOUBLE * 287.05287::DOUBLE)) ELSE 22632.06::DOUBLE * exp(-9.80665::DOUBLE * (h - 11000) / (287.05287::DOUBLE * 216.65::DOUBLE)) END / (287.05287::DOUBLE * isa) AS density FROM b),
d AS (SELECT *, 0.5::DOUBLE * density * v * v * 120 * 0.02::DOUBLE AS c0, 0.04::DOUBLE * 9.80665::DOUBLE * 9.80665::DOUBLE / (0.5::DOUBLE * density * v * v * 120) AS c2 FROM c),
f AS (SELECT *, e * e + 4 * c2 * v * v * (90000 - c0) AS root FROM d),
g AS (SELECT *, CASE WHEN root >= 0 THEN (sqrt(greatest(root, 0)) - e) / nullif(2 * c2 * v, 0) END AS mass,
  pow(sin((radians(l_discount * 100) - radians(l_quantity)) / 2), 2) + cos(radians(l_quantity)) * cos(radians(l_discount * 100)) * pow(sin(radians(l_quantity * 3 - l_tax * 100) / 2), 2) AS hav FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(isa, 7) AS isa, round(t - isa, 7) AS deviation, round(density, 4) AS density, round(v * (1852.0::DOUBLE / 3600) / sqrt(1.4::DOUBLE * 287.05287::DOUBLE * greatest(288.15::DOUBLE - 0.0065::DOUBLE * (h * 0.3048::DOUBLE), 216.65)), 4) AS mach,
  round(c0, 4) AS c0, round(c2 * 1e6::DOUBLE, 4) AS c2, round((90000 - c0) * v - e * mass - c2 * v * mass * mass, 4) + 0.0 AS balance, round(mass, 4) AS mass, round((l_extendedprice - l_quantity) / nullif(l_quantity * 900 - l_quantity, 0), 4) AS share,
  round(h + v - t + (v + t) * 2 + t * 4, 4) AS added, round(2 * 6371008.8::DOUBLE * asin(sqrt(least(hav, 1))) / 1852, 4) AS distance,
  (['a319', 'a319', 'b738', 'e190', 'c550'])[l_partkey % 5 + 1] AS kind, l_returnflag = 'R' AS returned,
  epoch_us(l_shipdate) + CAST(floor(round(l_quantity * 60.5::DOUBLE * 60e6::DOUBLE) / 2) AS BIGINT) AS middle, round(l_quantity * 60, 3) AS elapsed FROM g"""


def ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = readers.table_folder(spark, f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey")
    zone = F.when(k % 2 == 0, "Europe/Paris").otherwise("Asia/Tokyo")
    return n.where("n_nationkey < 23").select(F.concat(F.lit("N"), k.cast("string")).alias("icao_code"), (k * 1.5).alias("latitude_deg"), (k * 2.5 - 30).alias("longitude_deg"), (k * 10.0).alias("elevation_ft"), zone.alias("time_zone"))


PORTS = "(SELECT 'N' || n_nationkey AS icao_code, CAST(n_nationkey * 1.5 AS DOUBLE) AS lat, CAST(n_nationkey * 2.5 - 30 AS DOUBLE) AS lon, n_nationkey * 10.0::DOUBLE AS elevation, CASE WHEN n_nationkey % 2 = 0 THEN 'Europe/Paris' ELSE 'Asia/Tokyo' END AS zone FROM nation WHERE n_nationkey < 23)"


def order_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = readers.table_folder(spark, f"{sf_dir}/orders.parquet")
    k, code = F.col("o_orderkey"), lambda c: F.concat(F.lit("N"), (c % 25).cast("string"))
    on = F.lit(1_704_067_200_000_000) + k % 29 * 86_400_000_000  # days of the events
    taxi = F.when(k % 3 != 0, (k % 20).cast("double"))
    return o.select(k.alias("flight_id"), code(F.col("o_custkey")).alias("adep"), code(k).alias("ades"), F.timestamp_micros(on + k % 1440 * 60_000_000).alias("actual_offblock_time"), F.timestamp_micros(on + (k % 1440 + 180) * 60_000_000).alias("arrival_time"), taxi.alias("taxiout_time"))


ORDERS = "(SELECT o_orderkey AS flight_id, 'N' || (o_custkey % 25) AS adep, 'N' || (o_orderkey % 25) AS ades, 1704067200000000 + o_orderkey % 29 * 86400000000 + o_orderkey % 1440 * 60000000 AS off, 1704067200000000 + o_orderkey % 29 * 86400000000 + (o_orderkey % 1440 + 180) * 60000000 AS on_, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 20)::DOUBLE END AS taxi FROM orders)"


def flights_placed(spark, sf_dir):
    out = weather.placed(order_flights(spark, sf_dir), ports(spark, sf_dir))
    return out.select("flight_id", "adep", "ades", "lat_adep", "lon_adep", "lat_ades", "lon_ades")


def flights_featured(spark, sf_dir):
    reports = readers.table_folder(spark, f"{sf_dir}/orders.parquet").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("flight_id"), F.col("o_totalprice").alias("tmpf_adep"))
    df = features.flight_features(order_flights(spark, sf_dir), ports(spark, sf_dir), reports).df
    return rounded(df.select("flight_id", "tmpf_adep", "local_hour_adep", "local_hour_ades", "elevation_ft_adep", "elevation_ft_ades", "bird_distance"))


FEATURED = f"""
WITH f AS (SELECT o.*, CASE WHEN flight_id % 2 = 0 THEN o_totalprice END AS tmpf, a.lat AS la, a.lon AS oa, a.elevation AS ea, a.zone AS za, b.lat AS lb, b.lon AS ob, b.elevation AS eb, b.zone AS zb FROM {ORDERS} o
  LEFT JOIN orders ON o_orderkey = flight_id LEFT JOIN {PORTS} a ON adep = a.icao_code LEFT JOIN {PORTS} b ON ades = b.icao_code),
g AS (SELECT *, timezone(za, timezone('UTC', make_timestamp(off))) AS ta, timezone(zb, timezone('UTC', make_timestamp(on_))) AS tb, pow(sin((radians(lb) - radians(la)) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin(radians(ob - oa) / 2), 2) AS hav FROM f)
SELECT flight_id, round(tmpf, 4) AS tmpf_adep, CAST(hour(ta) * 60 + minute(ta) AS INT) AS local_hour_adep, CAST(hour(tb) * 60 + minute(tb) AS INT) AS local_hour_ades, ea AS elevation_ft_adep, eb AS elevation_ft_ades, round(2 * 6371008.8::DOUBLE * asin(sqrt(CASE WHEN hav > 1 THEN 1 ELSE hav END)) / 1852, 4) AS bird_distance FROM g"""


def corrected(spark, sf_dir):
    """Users as flights between nations; the radius is wide, as points lie anywhere."""
    rows = points(spark, sf_dir).withColumn("altitude", F.when(F.col("event_id") % 4 != 0, F.col("value") * 30))
    code = lambda c: F.concat(F.lit("N"), (c % 25).cast("string"))
    on = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("flight_id") * 1000)
    flights = instants(spark, sf_dir).select("flight_id", code(F.col("flight_id")).alias("adep"), code(F.col("flight_id") * 7).alias("ades"), on.alias("actual_offblock_time"), on.alias("arrival_time"), F.when(F.col("flight_id") % 2 == 0, 15.0).alias("taxiout_time"))
    out = dates.corrected_dates(dates.require_unique(flights, "flight_id"), rows, ports(spark, sf_dir), radius=600.0)
    return out.select("flight_id", F.unix_micros("t_adep").alias("start_us"), F.unix_micros("t_ades").alias("end_us"))


NEAR = "2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin((radians({e}.lat) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians({e}.lat)) * pow(sin(radians({e}.lon - longitude) / 2), 2))) / 1852 < 600"
CORRECTED = f"""
WITH p AS (SELECT flight_id, us, CASE WHEN event_id % 4 <> 0 THEN value * 30 END AS h, latitude, longitude FROM {POINTS}),
q AS (SELECT p.*, coalesce({NEAR.format(e='a')}, false) AS near_a, coalesce({NEAR.format(e='b')}, false) AS near_b FROM p LEFT JOIN {PORTS} a ON a.icao_code = 'N' || (flight_id % 25) LEFT JOIN {PORTS} b ON b.icao_code = 'N' || (flight_id * 7 % 25)),
r AS (SELECT flight_id, arg_max({{'t': us, 'h': h}}, us) FILTER (near_a) AS a, arg_min({{'t': us, 'h': h}}, us) FILTER (near_b) AS b FROM q GROUP BY flight_id)
SELECT flight_id, coalesce(a.t - CAST(round(a.h / 1000 * 60e6::DOUBLE) AS BIGINT), CASE WHEN flight_id % 2 = 0 THEN 1700000000000000 + flight_id * 1000 + 900000000 END) AS start_us,
  coalesce(b.t + CAST(round(b.h / 1000 * 60e6::DOUBLE) AS BIGINT), 1700000000000000 + flight_id * 1000) AS end_us FROM r"""


def airports_resolved(spark, sf_dir):
    """Nations as airports: known by one code or the other; with the faults of codes in use."""
    n = readers.table_folder(spark, f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey")
    code = lambda c: F.concat(F.lit("N"), c.cast("string"))
    raw = n.select(F.when(k % 3 == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise(code(k)).alias("ident"), F.when(k % 3 == 0, code(k)).when(k == 4, code(F.lit(5))).alias("gps_code"), (k * 1.5).alias("latitude_deg"), (k * 2.5).alias("longitude_deg"))
    used = airports.used_airports([order_flights(spark, sf_dir).select("adep", F.concat("ades", F.when(F.col("flight_id") % 1000 == 7, "?").otherwise("")).alias("ades"))])
    found = airports.resolve_airports(raw, used, lambda lat, lon: F.when(lon < 30, "west").otherwise("east"), exclude=("N1",))
    faults = airports.airport_faults(found, used)
    return found.select("icao_code", F.lit("none").alias("fault"), "latitude_deg", "time_zone").unionByName(faults.select("icao_code", "fault", F.lit(None).cast("double").alias("latitude_deg"), F.lit(None).cast("string").alias("time_zone")))


RESOLVED = f"""
WITH raw AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'X' || n_nationkey ELSE 'N' || n_nationkey END AS ident, CASE WHEN n_nationkey % 3 = 0 THEN 'N' || n_nationkey WHEN n_nationkey = 4 THEN 'N5' END AS gps, CAST(n_nationkey * 1.5 AS DOUBLE) AS lat, n_nationkey * 2.5 AS lon FROM nation),
used AS (SELECT adep AS c FROM {ORDERS} UNION SELECT ades || CASE WHEN flight_id % 1000 = 7 THEN '?' ELSE '' END FROM {ORDERS}),
found AS (SELECT CASE WHEN ident IN (SELECT c FROM used) THEN ident ELSE gps END AS code, lat, CASE WHEN lon < 30 THEN 'west' ELSE 'east' END AS zone FROM raw WHERE ident <> 'N1' AND (ident IN (SELECT c FROM used) OR coalesce(gps IN (SELECT c FROM used), false)))
SELECT code AS icao_code, 'none' AS fault, lat AS latitude_deg, zone AS time_zone FROM found
UNION ALL SELECT c, 'missing', NULL, NULL FROM used WHERE c NOT IN (SELECT code FROM found)
UNION ALL SELECT code, 'several', NULL, NULL FROM found GROUP BY code HAVING count(*) > 1"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = readers.raw_trajectories(spark, f"{sf_dir}/events.parquet").where("event_id % 4 = 0")
    codes = F.when(F.col("event_type") == "error", "+TSRA").when(F.col("event_type") == "view", "VCTS FG")
    return e.select(F.col("event_id").alias("station"), (F.col("event_id") % 34 + 0.25).alias("lat"), (F.col("user_id") % 60 - 30.0).alias("lon"), F.col("ts").cast("timestamp").alias("valid"), codes.alias("wxcodes"), F.col("value").alias("tmpf"), F.col("event_type").alias("skyc1"))


REPORTS = "(SELECT event_id AS station, event_id % 34 + 0.25::DOUBLE AS x, user_id % 60 - 30.0::DOUBLE AS y, epoch_us(ts) / 3.6e9::DOUBLE / 24 AS z, CASE event_type WHEN 'error' THEN '+TSRA' WHEN 'view' THEN 'VCTS FG' END AS codes, value, event_type FROM events WHERE event_id % 4 = 0)"
APART = "sqrt((f.x - r.x) ** 2 + (f.y - r.y) ** 2 + (f.z - r.z) ** 2)"
ASKED = f"(SELECT flight_id, lat AS x, lon AS y, {{t}} / 3.6e9::DOUBLE / 24 AS z FROM {ORDERS} JOIN {PORTS} ON icao_code = {{e}} WHERE flight_id % 10 = 0 AND adep IN (SELECT icao_code FROM {PORTS}) AND ades IN (SELECT icao_code FROM {PORTS}))"


def few_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_flights(spark, sf_dir).where("flight_id % 10 = 0")


def thunder_flags(spark, sf_dir):
    return weather.thunder(few_flights(spark, sf_dir), ports(spark, sf_dir), reports(spark, sf_dir), ("FG", "TS", "+TS"), (2, 4, 6), hour_scale=24.0)


THUNDER = f"""SELECT f.flight_id, {', '.join(f"max(CASE WHEN {APART} <= {r} AND contains(codes, '{c}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS thunder_max_{c.replace('+', 'p')}_{r}_ades" for r in (2, 4, 6) for c in ("FG", "TS", "+TS"))}
FROM {ASKED.format(t='on_', e='ades')} f LEFT JOIN {REPORTS} r ON codes IS NOT NULL AND {APART} <= 6 GROUP BY 1"""


def weather_nearest(spark, sf_dir):
    return weather.weather(few_flights(spark, sf_dir), ports(spark, sf_dir), reports(spark, sf_dir), ("tmpf", "skyc1"), hour_scale=24.0)


def nearest_sql(t: str, e: str) -> str:
    return f"(SELECT f.flight_id, arg_min(value, ({APART}, r.z, r.station)) AS tmpf_{e}, arg_min(event_type, ({APART}, r.z, r.station)) AS skyc1_{e} FROM {ASKED.format(t=t, e=e)} f, {REPORTS} r GROUP BY 1)"


WEATHER = f"SELECT * FROM {nearest_sql('off', 'adep')} JOIN {nearest_sql('on_', 'ades')} USING (flight_id)"


def nearest_three(spark, sf_dir):
    rows = points(spark, sf_dir)
    at = spatial.scaled(F.col("latitude"), F.col("longitude"), F.col("timestamp"), 1.0, 0.1)
    found = spatial.nearest(rows.where("event_id % 20 = 1"), rows.where("event_id % 20 = 2"), at, at, "event_id", ("event_id",), 3)
    return found.select(F.col("l.event_id").alias("event_id"), F.col("r.event_id").alias("near"), F.round("distance", 5).alias("distance"))


THREE = f"""WITH p AS (SELECT event_id, latitude AS x, longitude AS y, us / 3.6e9::DOUBLE / 0.1::DOUBLE AS z FROM {POINTS})
SELECT f.event_id, r.event_id AS near, round({APART}, 5) AS distance FROM p f, p r WHERE f.event_id % 20 = 1 AND r.event_id % 20 = 2 QUALIFY row_number() OVER (PARTITION BY f.event_id ORDER BY {APART}, r.event_id) <= 3"""


def target_scalers(spark, sf_dir):
    """The target by each scaler, and back; features by group, with synonyms."""
    part = readers.table_folder(spark, f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("aircraft_type"), F.col("p_retailprice").alias("tow"), F.col("p_size").cast("double").alias("size"), F.lit(5.0).alias("same"))
    masses = part.groupBy("aircraft_type").agg(F.min("tow").alias("oew"), (F.max("tow") + 10).alias("mtow"))
    out = part
    for name, scaler in {"identity": scaling.Identity(), "standard": scaling.Standard(), "range": scaling.oew_mtow(masses), "observed": scaling.Observed(least=1)}.items():
        made = scaler.fit(part).transform(part)
        back = scaler.inverse(made.withColumn("prediction", F.col("label")), out="back")
        out = out.join(back.select("p_partkey", F.round("label", 5).alias(name), F.round("weight", 2).alias(f"{name}_weight"), F.round("back", 4).alias(f"{name}_back")), "p_partkey")
    groups = scaling.GroupFeatureScaler(["size", "same"], {"Brand#2": "Brand#4"}, least=1).fit(part)
    z = groups.transform(part).select("p_partkey", F.round("size", 5).alias("size_z"), F.round("same", 5).alias("same_z"))
    return out.drop("size", "same", "tow").join(z, "p_partkey")


SCALERS = """
WITH p AS (SELECT p_partkey, p_brand AS aircraft_type, p_retailprice AS y, p_size::DOUBLE AS size FROM part),
g AS (SELECT aircraft_type, avg(y) AS m, stddev_pop(y) AS s, min(y) AS lo, max(y) + 10 AS hi, avg(size) AS ms, stddev_pop(size) AS ss FROM p GROUP BY 1),
a AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM p)
SELECT p_partkey, p.aircraft_type, round(y, 5) AS identity, 1.0::DOUBLE AS identity_weight, round(y, 4) AS identity_back, round((y - a.m) / a.s, 5) AS standard, 1.0::DOUBLE AS standard_weight, round(y, 4) AS standard_back,
  round((y - g.lo) / (g.hi - g.lo), 5) AS range, round((g.hi - g.lo) ** 2, 2) AS range_weight, round(y, 4) AS range_back,
  coalesce(round((y - g.m) / nullif(g.s, 0), 5), 0) AS observed, CASE WHEN g.s = 0 THEN 1 ELSE round(g.s ** 2, 2) END AS observed_weight, round(y, 4) AS observed_back,
  round((size - h.ms) / CASE WHEN h.ss = 0 THEN 1 ELSE h.ss END, 5) AS size_z, 0.0::DOUBLE AS same_z
FROM p JOIN g USING (aircraft_type) JOIN g h ON h.aircraft_type = CASE p.aircraft_type WHEN 'Brand#2' THEN 'Brand#4' ELSE p.aircraft_type END, a"""


def mass_shares(spark, sf_dir):
    part = readers.table_folder(spark, f"{sf_dir}/part.parquet")
    df = part.select(F.col("p_partkey").alias("flight_id"), (F.col("p_retailprice") + F.col("p_size")).alias("climbmass_0"), F.col("p_size").cast("double").alias("ROCD"), F.col("p_retailprice").alias("mass_min"), (F.col("p_retailprice") + F.col("p_size") % 7 * 10.0).alias("mass_max"))
    return rounded(features.mass_features(df).df)


FUNCTIONS = (energy, slices_of_climb, slices_of_descent, cruise_slices, wind_on_track, cleaned_values, order_faults, atmosphere, flights_placed, flights_featured, airports_resolved, thunder_flags, weather_nearest, nearest_three, target_scalers, mass_shares)
QUERIES = {f.__name__: f for f in FUNCTIONS} | {"corrected_window": corrected, "seq_lag5_rate": energy, "dim_join_inner": flights_placed, "dim_join_left": flights_featured}
for _name in ("energy", "flights_placed", "flights_featured"):
    del QUERIES[_name]

SQL = {
    "seq_lag5_rate": f"SELECT event_id, round(e_rate, 4) AS e_rate FROM ({RATE})",
    "slices_of_climb": phase_sql(True),
    "slices_of_descent": phase_sql(False),
    "cruise_slices": cruise_sql(),
    "wind_on_track": f"SELECT flight_id, round(avg((tasx * u + tasy * v) / nullif(event_id % 9 + 0.0::DOUBLE, 0)), 4) AS wind_effect FROM {POINTS} WHERE flight_id % 5 <> 0 GROUP BY 1",
    "cleaned_values": CLEANED,
    "order_faults": "WITH p AS (SELECT user_id AS flight_id, epoch_us(date_trunc('hour', ts)) + event_id % 2 AS us FROM events), q AS (SELECT *, lag(us) OVER (PARTITION BY flight_id ORDER BY us) AS before FROM p) SELECT flight_id, count(*) AS n FROM q WHERE us <= before GROUP BY 1",
    "atmosphere": ATMOSPHERE,
    "dim_join_inner": f"SELECT flight_id, adep, ades, a.lat AS lat_adep, a.lon AS lon_adep, b.lat AS lat_ades, b.lon AS lon_ades FROM {ORDERS} JOIN {PORTS} a ON adep = a.icao_code JOIN {PORTS} b ON ades = b.icao_code",
    "dim_join_left": FEATURED,
    "corrected_window": CORRECTED,
    "airports_resolved": RESOLVED,
    "thunder_flags": THUNDER,
    "weather_nearest": WEATHER,
    "nearest_three": THREE,
    "target_scalers": SCALERS,
    "mass_shares": "SELECT p_partkey AS flight_id, round(p_size / nullif(p_size % 7 * 10.0::DOUBLE, 0), 4) AS climbmass_0, round(p_size::DOUBLE, 4) AS ROCD FROM part",
}
