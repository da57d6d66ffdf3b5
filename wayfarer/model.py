"""Typed tables: a DataFrame with its validation and, as methods, the operators that apply to it.

Validation looks at the schema, which costs nothing; deep=True also runs a job over the rows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.functions import crs as crs_
from wayfarer.functions import identify, labelling, metrics, modal_split, quality
from wayfarer.operators import locations, spatial, staypoints, triplegs, trips
from wayfarer.sources import tables


@dataclass(frozen=True)
class Table:
    df: DataFrame
    planar: bool = False  #: coordinates are in metres rather than in degrees
    crs: int | None = None  #: EPSG number of the coordinate system, which then says whether they are

    name = ""

    def __post_init__(self) -> None:
        if self.crs is not None:
            object.__setattr__(self, "planar", crs_.is_planar(self.crs))
        self.validate()

    def to_crs(self, crs: int) -> Table:
        """The table in another coordinate system; without one of its own it is taken to be in degrees."""
        return replace(self, df=crs_.to_crs(self.df, self.crs or crs_.WGS84, crs), crs=crs)

    def check_planar(self, transform: bool = False) -> tuple[bool, Table]:
        """Whether coordinates are planar, and the table: with transform, in degrees."""
        if transform:
            return False, self.to_crs(crs_.WGS84)
        return self.planar or crs_.is_planar(self.crs), self

    def validate(self, deep: bool = False) -> Table:
        missing = [c for c in tables.REQUIRED[self.name] if c not in self.df.columns]
        if missing:
            raise AttributeError(f"{self.name} need the columns {missing}")
        for c in tables.TIMES[self.name]:
            if not isinstance(self.df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType)):
                raise AssertionError(f"{c} is no time")
        if deep and self.df.isEmpty():
            raise ValueError(f"{self.name} are empty")
        return self

    def _with(self, df: DataFrame):
        return replace(self, df=df)

    def to_csv(self, path: str, **options) -> None:
        tables.write_csv(self.df, path, self.name, **options)

    def to_jdbc(self, url: str, name: str, **options) -> None:
        tables.write_jdbc(self.df, url, name, **options)

    def to_parquet(self, path: str, mode: str = "errorifexists") -> None:
        self.df.write.mode(mode).parquet(path)


class _Points:
    @property
    def center(self) -> tuple[float, float]:
        return metrics.centre_of(self.df)


class _Filtered:
    def spatial_filter(self, areas, method: str = "within", re_project: bool = False, areas_crs: int | None = None):
        return self._with(spatial.spatial_filter(self.df, areas, method, re_project, self.crs, areas_crs))


class _Tracked:
    def temporal_tracking_quality(self, granularity: str = "all") -> DataFrame:
        return quality.temporal_tracking_quality(self.df, granularity)


class Positionfixes(_Points, Table):
    name = "positionfixes"

    def generate_staypoints(self, **options) -> tuple[Positionfixes, Staypoints]:
        pfs, sp = staypoints.generate_staypoints(self.df, planar=self.planar, **options)
        return self._with(pfs), Staypoints(sp, self.planar, self.crs)

    def generate_triplegs(self, staypoints: Staypoints | None = None, **options) -> tuple[Positionfixes, Triplegs]:
        pfs, tpls = triplegs.generate_triplegs(self.df, staypoints.df if staypoints is not None else None, **options)
        return self._with(pfs), Triplegs(tpls, self.planar, self.crs)

    def calculate_distance_matrix(self, other: Positionfixes | None = None, **options) -> DataFrame:
        return spatial.distance_matrix(self.df, other.df if other is not None else None, **options)

    def get_speed(self, **options) -> Positionfixes:
        return self._with(labelling.get_speed_positionfixes(self.df, planar=self.planar, **options))


class Staypoints(_Points, _Filtered, _Tracked, Table):
    name = "staypoints"

    def generate_locations(self, **options) -> tuple[Staypoints, Locations]:
        sp, locs = locations.generate_locations(self.df, **options)
        return self._with(sp), Locations(locs, self.planar, self.crs)

    def merge_staypoints(self, triplegs: Triplegs, **options) -> Staypoints:
        extra = {c: "first" for c in ("lon", "lat") if c not in options.get("agg", {})}
        return self._with(staypoints.merge_staypoints(self.df, triplegs.df, **{**options, "agg": {**extra, **options.get("agg", {})}}))

    def create_activity_flag(self, **options) -> Staypoints:
        return self._with(labelling.create_activity_flag(self.df, **options))

    def generate_trips(self, triplegs: Triplegs, **options) -> tuple[Staypoints, Triplegs, Trips]:
        sp, tpls, out = trips.generate_trips(self.df, triplegs.df, **options)
        return self._with(sp), Triplegs(tpls, self.planar, self.crs), Trips(out, self.planar, self.crs)

    def radius_gyration(self, method: str = "count") -> DataFrame:
        return metrics.radius_gyration(self.df, method, self.planar)

    def jump_length(self) -> DataFrame:
        return metrics.jump_length(self.df, self.planar)

    def location_identifier(self, **options) -> Staypoints:
        return self._with(identify.location_identifier(self.df, **options))


class Triplegs(_Filtered, _Tracked, Table):
    name = "triplegs"

    def generate_trips(self, staypoints: Staypoints, **options) -> tuple[Staypoints, Triplegs, Trips]:
        return staypoints.generate_trips(self, **options)

    def calculate_distance_matrix(self, other: Triplegs | None = None, dist_metric: str = "dtw", **options) -> DataFrame:
        return spatial.distance_matrix(self.df, other.df if other is not None else None, dist_metric, **options)

    def predict_transport_mode(self, **options) -> Triplegs:
        return self._with(labelling.predict_transport_mode(self.df, planar=self.planar, **options))

    def calculate_modal_split(self, **options) -> DataFrame:
        return modal_split.calculate_modal_split(self.df, planar=self.planar, **options)

    def get_speed(self, positionfixes: Positionfixes | None = None, method: str = "tpls_speed") -> Triplegs:
        return self._with(labelling.get_speed_triplegs(self.df, positionfixes.df if positionfixes is not None else None, method, self.planar))

    def add_modes(self, labels: DataFrame, **options) -> Triplegs:
        return self._with(spatial.add_modes_to_triplegs(self.df, labels, **options))


class Locations(Table):
    name = "locations"

    def spatial_filter(self, areas, method: str = "within") -> Locations:
        pts = self.df.withColumn("lon", F.col("center.x")).withColumn("lat", F.col("center.y"))
        return self._with(spatial.spatial_filter(pts, areas, method).drop("lon", "lat"))


class Trips(_Tracked, Table):
    name = "trips"

    def generate_tours(self, staypoints: Staypoints | None = None, **options) -> tuple[Trips, Tours]:
        out, tours = trips.generate_tours(self.df, staypoints.df if staypoints is not None else None, planar=self.planar, **options)
        return self._with(out), Tours(tours, self.planar, self.crs)


class Tours(Table):
    name = "tours"

    def get_trips_grouped(self, trips_: Trips) -> DataFrame:
        return trips.get_trips_grouped(trips_.df, self.df)
