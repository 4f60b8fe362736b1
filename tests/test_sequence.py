import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklathe.operators import sequence, spline

COLUMNS = "flight_id long, t double, icao24 long, latitude double, longitude double, altitude double, vertical_rate double, groundspeed double, track double"


def flight(spark, times=None, **columns):
    n = len(next(iter(columns.values())))
    times = times or list(range(n))
    names = ["latitude", "longitude", "altitude", "vertical_rate", "groundspeed", "track"]
    rows = [(1, float(times[i]), 7, *[None if (v := columns.get(c, [None] * n)[i]) is None else float(v) for c in names]) for i in range(n)]
    return spark.createDataFrame(rows, COLUMNS).withColumn("timestamp", F.timestamp_micros((F.col("t") * 1e6).cast("long")))


def values(df, column):
    return [r[column] for r in df.orderBy("timestamp").collect()]


def test_constant_latlon_then_position(spark):
    df = flight(spark, latitude=[1, 1, 2, 2, 3, 3], longitude=[1, 1, 2, 2, 3, 3], altitude=[5] * 6)
    first = sequence.mask_constant_latlon(df)
    assert values(first, "latitude") == [None, None, 2, None, 3, None]
    second = sequence.mask_constant_position(first)
    assert values(second, "latitude") == [None] * 6
    assert values(second, "altitude") == [None] * 6


def test_single_row_position_is_left(spark):
    assert values(sequence.mask_constant_position(flight(spark, altitude=[5])), "altitude") == [5]


@pytest.mark.parametrize(
    ("times", "given_", "wanted"),
    [
        (None, [None, 1, 2, 3, 4, None], [None, None, 2, 3, None, None]),
        (None, [0, 10, 20, 30, 40, 50], [0, 10, 20, 30, 40, 50]),
        ([0, 20, 41, 42], [1, 2, 3, 4], [1, 2, 3, 4]),
        (None, [5], [None]),
    ],
)
def test_isolated(spark, times, given_, wanted):
    df = sequence.mask_isolated(flight(spark, times, altitude=given_))
    assert values(df, "altitude") == wanted


@pytest.mark.parametrize(
    ("column", "given_", "wanted"),
    [
        ("altitude", [0, 10, 20, 2000, 40, 50, 60, 70], [0, 10, None, None, None, 50, 60, 70]),
        ("altitude", [0, 10, 20, 30, 2000, 2010, 2020, 2030], [0, 10, 20, None, None, 2010, 2020, 2030]),
        ("track", [358, 359, 0, 1, 2, 3], [358, 359, 0, 1, 2, 3]),
        ("altitude", [0, 9999], [0, 9999]),
    ],
)
def test_spikes(spark, column, given_, wanted):
    assert values(sequence.mask_spikes(flight(spark, **{column: given_})), column) == wanted


def test_dedup_keeps_first_by_ties(spark):
    df = spark.createDataFrame([(1, 5, 2), (1, 5, 1), (1, 6, 3)], "flight_id long, timestamp long, x long")
    assert sorted(r["x"] for r in sequence.dedup(df).collect()) == [1, 3]


def test_cascade_spares_humidity(spark):
    df = spark.createDataFrame([(None, 1.0, 2.0, 3.0, 4.0, 5.0)], "latitude double, altitude double, u_component_of_wind double, v_component_of_wind double, temperature double, specific_humidity double")
    row = sequence.cascade(df).first()
    assert row["u_component_of_wind"] is None and row["temperature"] is None and row["specific_humidity"] == 5


def test_hole_and_fill(spark):
    df = flight(spark, altitude=[None, 1, None, None, 4, None])
    assert values(df.withColumn("h", sequence.hole_width("altitude")), "h") == [None, 0, 3, 3, 0, None]
    assert values(df.withColumn("h", sequence.fill("altitude")), "h") == [1, 1, 1, 1, 4, 4]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-720, 720), min_size=1, max_size=30))
def test_unwrap_is_numpys(spark, angles):
    got = values(sequence.unwrap(flight(spark, track=angles), "track", "out"), "out")
    assert np.allclose(got, np.unwrap(angles, period=360), atol=1e-6)


@pytest.mark.parametrize("angles", [[180.00000000000003, 0.0], [0.0, 180.00000000000003], [180.0, 0.0], [0.0, 180.0], [540.0000000000001, 0.0, 359.99999999999994]])
def test_unwrap_at_half_a_turn(spark, angles):
    got = values(sequence.unwrap(flight(spark, track=angles), "track", "out"), "out")
    assert np.allclose(got, np.unwrap(angles, period=360), atol=1e-6)


def test_energy_rate(spark):
    rows = [(1, float(i), 100.0 + i, 100.0, 288.15 - 0.0065 * (100.0 + i), 0.0, 0.0, 100.0, 0.0) for i in range(7)]
    df = spark.createDataFrame(rows, "flight_id long, t double, altitude double, tas double, temperature double, u_component_of_wind double, v_component_of_wind double, tasx double, tasy double")
    df = df.withColumn("timestamp", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    got = values(sequence.energy_rate(df), "e_rate")
    assert got[:5] == [None] * 5
    assert got[5] == pytest.approx(9.80665)


def test_order_check(spark):
    assert sequence.out_of_order(flight(spark, [0, 1, 1], altitude=[1, 2, 3])).count() == 1


def dense_spline(t, y, p):
    h = np.diff(t)
    n = len(t)
    q = np.zeros((n, n - 2))
    r = np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j, j], q[j + 1, j], q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = 2 * (h[j] + h[j + 1])
        if j + 1 < n - 2:
            r[j, j + 1] = r[j + 1, j] = h[j + 1]
    u = np.linalg.solve(6 * (1 - p) * q.T @ q + p * r, q.T @ y)
    return y - 6 * (1 - p) * q @ u, np.concatenate([[0], 6 * p * u, [0]])


@pytest.mark.parametrize("n", [3, 4, 5, 40])
@pytest.mark.parametrize("p", [0.001, 0.01, 0.9])
def test_spline_is_the_dense_solution(n, p):
    rng = np.random.default_rng(n)
    t, y = np.cumsum(rng.uniform(0.5, 3, n)), rng.normal(size=n)
    f, m = spline.smoothing_spline(t, y, p)
    wanted, second = dense_spline(t, y, p)
    assert np.allclose(f, wanted) and np.allclose(m, second)
    eps = 1e-5
    at = (t[:-1] + t[1:]) / 2
    up, _ = spline.evaluate(t, f, m, at + eps)
    down, _ = spline.evaluate(t, f, m, at - eps)
    assert np.allclose((up - down) / (2 * eps), spline.evaluate(t, f, m, at)[1], atol=1e-4)


def test_interpolate_masks_long_holes(spark):
    df = flight(spark, [0, 1, 2, 3, 4, 40, 41, 60], altitude=[0, 1, 2, 3, 4, None, 41, None], track=[350, 355, 0, 5, 10, None, 15, None])
    rows = spline.interpolate(df).orderBy("timestamp").collect()
    assert [r["altitude"] is None for r in rows] == [False] * 5 + [True, False, True]
    assert rows[2]["altitude"] == pytest.approx(2, abs=0.2)
    assert rows[2]["daltitude"] == pytest.approx(60, abs=5)
    assert 360 < rows[4]["track_unwrapped"] < 375
    assert "track" not in rows[0].asDict()


def test_two_points_stay_as_they_are(spark):
    rows = spline.interpolate(flight(spark, altitude=[1, 2])).orderBy("timestamp").collect()
    assert [r["altitude"] for r in rows] == [1, 2] and rows[0]["daltitude"] is None


def test_clean_runs_all_filters(spark):
    n = 12
    df = flight(spark, latitude=[i * 0.001 for i in range(n)], longitude=[i * 0.001 for i in range(n)], altitude=[1000 + 10 * i for i in range(n)], vertical_rate=[100 + i for i in range(n)], groundspeed=[200 + i for i in range(n)], track=[10 + i for i in range(n)])
    out = sequence.clean(df.unionByName(df))
    assert out.count() == n
    assert values(out, "altitude")[2:-1] == [1000 + 10 * i for i in range(2, n - 1)]
