"""The whole analysis as lazy plans: raw to smoothed trajectories, feature tables, predictions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklathe.functions import scalars as s
from tracklathe.operators import dates, features, sequence, slices, spline, weather
from tracklathe.operators.scaling import oew_mtow
from tracklathe.plans import metrics, model
from tracklathe.plans.lineage import checkpointed


def clean_trajectories(raw: DataFrame, smooth: float = spline.SMOOTH) -> DataFrame:
    """Filters, velocity vectors in SI, spline, and back to aviation units. One shuffle on flight_id serves all."""
    vectors = s.from_si(s.velocities(s.to_si(sequence.clean(raw))))
    return spline.interpolate(vectors, smooth)


@dataclass
class Tables:
    flights: DataFrame
    airports: DataFrame
    metars: DataFrame
    trajectories: DataFrame  # smoothed, aviation units
    limits: DataFrame | None = None
    mass: Column | None = None


def feature_tables(t: Tables, geo_scale: float = 1.0, hour_scale: float = 1.0) -> features.FeatureSet:
    """All features of each flight. The corrected instants are computed once for their three uses."""
    moments = checkpointed(dates.corrected_dates(dates.require_unique(t.flights, "flight_id"), t.trajectories, t.airports))
    typed = moments.join(t.flights.select("flight_id", "aircraft_type"), "flight_id")
    masses = slices.climbing(s.to_si(t.trajectories), typed, t.limits, t.mass)
    return features.union(
        features.flight_features(t.flights, t.airports, weather.weather(t.flights, t.airports, t.metars, geo_scale=geo_scale, hour_scale=hour_scale)),
        [
            features.mass_features(masses),
            features.all_unscaled(weather.thunder(t.flights, t.airports, t.metars, geo_scale=geo_scale, hour_scale=hour_scale)),
            features.all_unscaled(slices.wind_effect(s.to_si(t.trajectories), moments)),
            features.cruise_features(slices.cruise(t.trajectories, moments)),
        ],
    )


def predict(train: features.FeatureSet, ask: features.FeatureSet, masses: DataFrame, seeds: list[int], params: Callable[[int], model.Params] = lambda seed: model.Params(seed=seed)) -> DataFrame:
    """flight_id and tow: the mean over models that differ in their seed."""
    versions = None
    for n in seeds:
        fitted = model.fit(train, oew_mtow(masses), params(n))
        part = fitted.predict(ask.df).select("flight_id", "tow", F.lit(n).alias("version"))
        versions = part if versions is None else versions.unionByName(part)
    return metrics.ensemble(versions)


def aircraft_mass(performance: dict[str, Column], cthrust: float = 1.0) -> Column:
    """Equivalent mass of a trajectory point from columns area, cd0, k and static_thrust, SI units."""
    h, v = F.col("altitude"), F.col("tas")
    c0, c2 = s.drag_terms(v, s.isa_density(h), performance["area"], performance["cd0"], performance["k"])
    return s.equivalent_mass(s.max_climb_thrust(h, v, performance["static_thrust"], cthrust), c0, c2, v, F.col("e_rate"))
