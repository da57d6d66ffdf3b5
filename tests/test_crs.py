"""Reprojection against published points, there and back, and in the spatial filter."""

import pytest
from pyspark.sql import functions as F

from tests.test_mobility import stays
from wayfarer.functions import crs
from wayfarer.model import Staypoints
from wayfarer.operators.spatial import spatial_filter

#: Published coordinates: a tower in Toronto, the survey's example in Switzerland, and corners of the systems.
POINTS = [(32617, -79.387139, 43.642567, 630084, 4833438, 1.0), (2056, 8 + 43 / 60 + 49.79 / 3600, 46 + 2 / 60 + 38.87 / 3600, 2699999.76, 1099999.97, 0.05), (32632, 9.0, 0.0, 500000, 0, 1e-6), (32733, 15.0, 0.0, 500000, 10_000_000, 1e-6), (3857, 180.0, 0.0, 20037508.342789, 0, 1e-3)]


@pytest.mark.parametrize(("system", "lon", "lat", "x", "y", "near"), POINTS)
def test_points(spark, system, lon, lat, x, y, near):
    there = crs.reproject(F.lit(lon), F.lit(lat), 4326, system)
    row = spark.range(1).select(*(c.alias(n) for c, n in zip(there, "xy", strict=True)))
    back = row.select("x", "y", *(c.alias(n) for c, n in zip(crs.reproject(F.col("x"), F.col("y"), system, 4326), ("lon", "lat"), strict=True))).first()
    assert (back["x"], back["y"]) == (pytest.approx(x, abs=near), pytest.approx(y, abs=near))
    assert (back["lon"], back["lat"]) == (pytest.approx(lon, abs=2e-5 if system == 2056 else 5e-9), pytest.approx(lat, abs=2e-5 if system == 2056 else 5e-9))


def test_tables(spark):
    sp = Staypoints(stays(spark, [(1, 0, 0, 10, 116.31, 40.0, 3), (2, 0, 15, 20, 116.4, 40.1, None)]), crs=4326)
    assert sp.check_planar() == (False, sp)
    flat = sp.to_crs(32650)
    assert (flat.planar, flat.crs, flat.check_planar()[0]) == (True, 32650, True)
    again = flat.check_planar(transform=True)[1]
    assert (again.planar, again.crs) == (False, 4326)
    for a, b in zip(sp.df.orderBy("id").collect(), again.df.orderBy("id").collect(), strict=True):
        assert (b["lon"], b["lat"]) == (pytest.approx(a["lon"], abs=1e-9), pytest.approx(a["lat"], abs=1e-9))
    with pytest.warns(UserWarning):
        assert Staypoints(sp.df).check_planar()[0] is False
    with pytest.raises(NotImplementedError):
        sp.to_crs(27700)


def test_filter_in_the_areas_system(spark):
    """An area in metres of a UTM zone takes points in degrees, which come back unchanged; so do lines."""
    sp = stays(spark, [(1, 0, 0, 10, 116.31, 40.0, 3), (2, 0, 15, 20, 116.4, 40.1, None)])
    x, y = crs.reproject(F.col("lon"), F.col("lat"), 4326, 32649)
    x, y = sp.where("id = 1").select(x, y).first()
    area = [[(x - 50, y - 50), (x + 50, y - 50), (x + 50, y + 50), (x - 50, y + 50), (x - 50, y - 50)]]
    got = Staypoints(sp, crs=4326).spatial_filter([area], re_project=True, areas_crs=32649).df
    assert got.columns == sp.columns
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in sp.where("id = 1").collect()]
    line = lambda *p: [{"x": float(a), "y": float(b)} for a, b in p]
    lines = spark.createDataFrame([(0, line((116.31, 40.0), (116.3101, 40.0001))), (1, line((116.4, 40.1), (116.41, 40.1)))], "id long, geom array<struct<x:double,y:double>>")
    assert [r["id"] for r in spatial_filter(lines, [area], "within", True, 4326, 32649).collect()] == [0]
    with pytest.raises(ValueError):
        spatial_filter(sp, [area], re_project=True)
