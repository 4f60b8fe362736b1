"""Column expressions: dates, units, geodesy, atmosphere, polynomials and recoding. All stay in the JVM."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOOT = 0.3048
NAUTICAL_MILE = 1852.0
KNOT = NAUTICAL_MILE / 3600
GRAVITY = 9.80665
GAS = 287.05287

#: Factor to SI for each column that has one. daltitude, wind and temperature have none, on purpose.
TO_SI = {
    **dict.fromkeys(("longitude", "latitude", "track", "track_unwrapped"), math.pi / 180),
    "altitude": FOOT,
    "vertical_rate": FOOT / 60,
    **dict.fromkeys("groundspeed gsx gsy tas tasx tasy".split(), KNOT),
}


def no_nan(c: Column) -> Column:
    """NULL for NaN: aggregates then skip it, as they skip NULL."""
    return F.when(~F.isnan(c), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every float column without NaN."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[no_nan(F.col(f"`{n}`")).alias(n) if isinstance(k, (T.DoubleType, T.FloatType)) else F.col(f"`{n}`") for n, k in kinds.items()])


def cast_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Cast the named columns that exist."""
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items() if c in df.columns})


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(a: Column, b: Column) -> Column:
    """Seconds from a to b."""
    return (micros(b) - micros(a)) / 1e6


def shift_minutes(ts: Column, minutes: Column) -> Column:
    return F.timestamp_micros((micros(ts) + F.round(minutes * 60e6)).cast("long"))


def midpoint(a: Column, b: Column) -> Column:
    """The instant halfway."""
    return F.timestamp_micros(micros(a) + F.floor((micros(b) - micros(a)) / 2))


def iso_day(ts: Column) -> Column:
    """Monday is 1."""
    return F.weekday(ts) + 1


def iso_week(ts: Column) -> Column:
    return F.weekofyear(ts)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def local_time(ts: Column, zone: Column) -> Column:
    """Wall-clock time in a zone, without zone; NULL where the zone is unknown."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")


def to_si(df: DataFrame, factors: dict[str, float] = TO_SI) -> DataFrame:
    return df.withColumns({c: F.col(c) * k for c, k in factors.items() if c in df.columns})


def from_si(df: DataFrame, factors: dict[str, float] = TO_SI) -> DataFrame:
    return df.withColumns({c: F.col(c) / k for c, k in factors.items() if c in df.columns})


def velocities(df: DataFrame) -> DataFrame:
    """gsx, gsy (east and north ground speed), tasx, tasy (less the wind), tas and wind. SI units, track in radians."""
    df = df.withColumns({"gsx": F.col("groundspeed") * F.sin("track"), "gsy": F.col("groundspeed") * F.cos("track")})
    df = df.withColumns({"tasx": F.col("gsx") - F.col("u_component_of_wind"), "tasy": F.col("gsy") - F.col("v_component_of_wind")})
    return df.withColumns({"tas": F.hypot("tasx", "tasy"), "wind": F.hypot("u_component_of_wind", "v_component_of_wind")})


def great_circle_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371008.8) -> Column:
    """Nautical miles between points in degrees, on a sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h))) / NAUTICAL_MILE


def isa_temperature(height_m: Column) -> Column:
    """Kelvin in the standard atmosphere up to 20 km; NULL for NULL."""
    return F.when(height_m.isNotNull(), F.greatest(288.15 - 0.0065 * height_m, F.lit(216.65)))


def temperature_deviation(temperature: Column, height_m: Column) -> Column:
    return temperature - isa_temperature(height_m)


def mach(tas_kt: Column, altitude_ft: Column) -> Column:
    return tas_kt * KNOT / F.sqrt(1.4 * GAS * isa_temperature(altitude_ft * FOOT))


def clip(c: Column, low: float, high: float) -> Column:
    """Bounded to [low, high]; NULL stays NULL."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def wind_along_track(gsx: Column, gsy: Column, u: Column, v: Column, groundspeed: Column) -> Column:
    """Wind projected on the track; NULL at zero ground speed, which a mean then skips."""
    return F.try_divide(gsx * u + gsy * v, groundspeed)


def normalized_time(ts: Column, start: Column, end: Column) -> Column:
    return F.try_divide((micros(ts) - micros(start)).cast("double"), (micros(end) - micros(start)).cast("double"))


def round_thousand(c: Column) -> Column:
    """Nearest multiple of 1000, halves to even."""
    return F.rint(c / 1000) * 1000


def recode_slice(x: Column, delta: Column, count: Column, least: int = 100, limit: float = 200.0) -> Column:
    """NULL under ``least`` points (or unknown count), else -20000 in descent, -10000 in climb, else x."""
    return F.when(F.coalesce(count, F.lit(0)) < least, None).when(delta < -limit, -20000.0).when(delta > limit, -10000.0).otherwise(x)


def scale_mass(mass: Column, low: Column, high: Column) -> Column:
    return F.try_divide(mass - low, high - low)


def contains_any(text: Column, word: str) -> Column:
    """Literal, so "+" is a plus sign."""
    return text.contains(word)


def feature_token(word: str) -> str:
    """A weather code as part of a column name."""
    return word.replace("+", "p")


# Polynomials: lists of coefficient columns, lowest degree first.
def poly_eval(coefficients: list[Column], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + c, reversed(coefficients[:-1]), coefficients[-1])


def poly_pad(p: list[Column], size: int) -> list[Column]:
    return p + [F.lit(0.0)] * (size - len(p))


def poly_add(p: list[Column], q: list[Column]) -> list[Column]:
    n = max(len(p), len(q))
    return [a + b for a, b in zip(poly_pad(p, n), poly_pad(q, n))]


def poly_sub(p: list[Column], q: list[Column]) -> list[Column]:
    return poly_add(p, poly_scale(q, F.lit(-1.0)))


def poly_scale(p: list[Column], k: Column) -> list[Column]:
    return [a * k for a in p]


def poly_mul(p: list[Column], q: list[Column]) -> list[Column]:
    out: list[Column | None] = [None] * (len(p) + len(q) - 1)
    for i, a in enumerate(p):
        for j, b in enumerate(q):
            out[i + j] = a * b if out[i + j] is None else out[i + j] + a * b
    return out


def poly_derive(p: list[Column]) -> list[Column]:
    return [a * float(k) for k, a in enumerate(p) if k] or [F.lit(0.0)]


def quadratic_roots(c: Column, b: Column, a: Column) -> tuple[Column, Column]:
    """Roots of a x^2 + b x + c, with minus and with plus the square root; NULL where there is none."""
    d = b * b - 4 * a * c
    root = F.when(d >= 0, F.sqrt(d))
    return F.try_divide(-b - root, 2 * a), F.try_divide(-b + root, 2 * a)


def total_energy(thrust: Column, c0: Column, c2: Column, speed: Column, e: Column) -> list[Column]:
    """(thrust - drag) * speed - e * mass as a polynomial of mass, drag being c0 + c2 mass^2."""
    return [(thrust - c0) * speed, -e, -c2 * speed]


def equivalent_mass(thrust: Column, c0: Column, c2: Column, speed: Column, e: Column) -> Column:
    """The mass that accounts for energy rate e: the larger root of total_energy()."""
    d = e * e + 4 * c2 * speed * speed * (thrust - c0)
    return F.try_divide(F.when(d >= 0, F.sqrt(d)) - e, 2 * c2 * speed)


def drag_terms(speed: Column, density: Column, area: Column, cd0: Column, k: Column) -> tuple[Column, Column]:
    """Drag at level flight as c0 + c2 mass^2."""
    pressure_area = 0.5 * density * speed * speed * area
    return pressure_area * cd0, F.try_divide(k * GRAVITY * GRAVITY, pressure_area)


def isa_density(height_m: Column) -> Column:
    """kg/m^3 in the standard atmosphere."""
    t = isa_temperature(height_m)
    low = 101325.0 * F.pow(t / 288.15, F.lit(GRAVITY / (0.0065 * GAS)))
    high = 22632.06 * F.exp(-GRAVITY * (height_m - 11000) / (GAS * 216.65))
    return F.when(height_m.isNotNull(), F.when(height_m <= 11000, low).otherwise(high) / (GAS * t))


def max_climb_thrust(height_m: Column, speed: Column, static_thrust: Column, factor: float = 1.0) -> Column:
    """A plain lapse of static thrust with density and Mach number; replace it where coefficients are at hand."""
    m = speed / F.sqrt(1.4 * GAS * isa_temperature(height_m))
    return static_thrust * factor * F.pow(isa_density(height_m) / 1.225, F.lit(0.7)) * (1 - 0.35 * m)


def idle_thrust(height_m: Column, speed: Column, static_thrust: Column) -> Column:
    return 0.07 * max_climb_thrust(height_m, speed, static_thrust)


#: Types that have no limits of their own, by the type whose limits stand for theirs.
_STANDS_FOR = {"a319": "a310 a318 bcs1 bcs3", "a321": "a21n", "b739": "b39m", "b752": "b763", "b772": "b773", "c550": "c56x", "e190": "e290", "e75l": "at76 crj9"}
SYNONYMS = {own: other for other, owns in _STANDS_FOR.items() for own in owns.split()}


def synonyms(kind: Column, names: dict[str, str] = SYNONYMS) -> Column:
    """Lower-case type, by its synonym if it has one; names are read in any case."""
    low = F.lower(kind)
    if not names:
        return low
    pairs = {a.lower(): b.lower() for a, b in names.items()}
    return F.coalesce(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])[low], low)


def coerce(text: str) -> int | float | str:
    """A command-line value as int, else float, else text."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text
