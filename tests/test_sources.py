"""Round trips of tables, and track files."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.test_mobility import at, fixes, stays
from wayfarer.model import Locations, Positionfixes, Staypoints
from wayfarer.sources import tables, tracks, wkt


def test_csv_round_trips(spark, tmp_path):
    pfs = fixes(spark, [("a", 0, 1, 8.5, 47.25), ("b", 1, 2, -0.125, 1e-7)])
    tables.write_csv(pfs, f"{tmp_path}/pfs", "positionfixes")
    back = tables.read_positionfixes_csv(spark, f"{tmp_path}/pfs", index_col="id", tz="UTC").select(*pfs.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pfs.collect()))
    sp = stays(spark, [(1, 0, 0, 10, 8.5, 47.25, 3), (2, 0, 15, 20, 1, 2, None)])
    tables.write_csv(sp, f"{tmp_path}/sp", "staypoints", sep=";")
    back = tables.read_staypoints_csv(spark, f"{tmp_path}/sp", index_col="id", tz="UTC", sep=";").select(*sp.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sp.collect()))
    tours = spark.createDataFrame([(0, 1, at(0), at(5), [3, 1, 2])], "id long, user_id long, started_at timestamp, finished_at timestamp, trips array<long>")
    tables.write_csv(tours, f"{tmp_path}/tours", "tours")
    assert tables.read_tours_csv(spark, f"{tmp_path}/tours", index_col="id", tz="UTC").first()["trips"] == [3, 1, 2]


def test_wkt(spark):
    rows = spark.createDataFrame([("LINESTRING (0 1, 2.5 -3)",), ("MULTIPOINT ((0 1), (2.5 -3))",), ("POLYGON ((0 1, 2.5 -3), (9 9, 8 8))",), (None,)], "t string").select(wkt.parse_points(F.col("t")).alias("p")).collect()
    assert [None if r["p"] is None else [tuple(p) for p in r["p"]] for r in rows] == [[(0.0, 1.0), (2.5, -3.0)]] * 3 + [None]
    assert spark.range(1).select(wkt.format_line(F.lit(None).cast("array<struct<x:double,y:double>>")).alias("t")).first()["t"] is None


def test_database_round_trips(spark):
    """An embedded database, in memory: geometry goes out and comes back as WKB, lists as JSON, times as instants."""
    url = "jdbc:derby:memory:wayfarer;create=true"
    point = lambda x, y: {"x": float(x), "y": float(y)}
    spot, line = "struct<x:double,y:double>", "array<struct<x:double,y:double>>"
    pfs = fixes(spark, [("a", 0, 1, 8.5, 47.25), ("b", 1, 2, -0.125, 1e-7)])
    sp = stays(spark, [(1, 0, 0, 10, 8.5, 47.25, 3), (2, 0, 15, 20, 1, 2, None)])
    tpls = spark.createDataFrame([(0, 1, at(0), at(5), [point(0, 1), point(2.5, -3)])], f"id long, user_id long, started_at timestamp, finished_at timestamp, geom {line}")
    locs = spark.createDataFrame([(0, 1, point(1, 2), [point(0, 0), point(1, 0), point(1, 1), point(0, 0)])], f"id long, user_id long, center {spot}, extent {line}")
    trips = spark.createDataFrame([(0, 1, at(0), at(5), 3, None, point(0, 1), point(5, 6))], f"id long, user_id long, started_at timestamp, finished_at timestamp, origin_staypoint_id long, destination_staypoint_id long, start_geom {spot}, end_geom {spot}")
    tours = spark.createDataFrame([(0, 1, at(0), at(5), [3, 1, 2])], "id long, user_id long, started_at timestamp, finished_at timestamp, trips array<long>")
    for table, df in {"positionfixes": pfs, "staypoints": sp, "triplegs": tpls, "locations": locs, "trips": trips, "tours": tours}.items():
        names = {c.upper(): c for c in [*df.columns, "geom"]}
        tables.write_jdbc(df, url, table, "replace")
        back = tables.read_jdbc(spark, url, f"select * from {table}", table, names, "UTC").select(*df.columns)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
        tables.write_jdbc(df, url, table, "append")
        assert tables.read_jdbc(spark, url, f"select * from {table}", table, names, "UTC").count() == 2 * df.count()
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_jdbc(pfs, url, "positionfixes")
    with pytest.raises(ValueError):
        tables.write_jdbc(pfs, url, "positionfixes", "other")


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_wkb(kind):
    pts = [(1.5, -2.0)] if kind == 1 else [(0.0, 0.0), (1.0, 0.5), (0.0, 0.0)]
    assert wkt.from_wkb(wkt.to_wkb(pts, kind, 4326)) == pts
    assert wkt.from_wkb(wkt.to_wkb(pts, kind)) == pts


def test_times(spark):
    df = spark.createDataFrame([("2024-01-01 12:00:00+02:00",), ("2024-01-01 12:00:00",)], "t string")
    got = [r["t"] for r in tables.localize(df, "t", "Europe/Berlin").collect()]
    assert got == [datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 11)]


def test_geolife(spark, tmp_path):
    d = tmp_path / "g" / "007" / "Trajectory"
    d.mkdir(parents=True)
    (d / "a.plt").write_text("Geolife trajectory\nWGS 84\nAltitude is in Feet\nReserved 3\n0,2,255,My Track,0,0,2,8421376\n0\n39.9,116.3,0,100,39744.1,2008-10-23,02:53:04\n40.0,116.4,0,200,39744.2,2008-10-23,02:53:10\n")
    pfs, labels = tracks.read_geolife(spark, f"file://{tmp_path}/g")
    assert [(r["id"], r["user_id"], r["tracked_at"], round(r["elevation"], 2), r["lon"], r["lat"]) for r in pfs.orderBy("id").collect()] == [(0, 7, datetime(2008, 10, 23, 2, 53, 4), 30.48, 116.3, 39.9), (1, 7, datetime(2008, 10, 23, 2, 53, 10), 60.96, 116.4, 40.0)]
    assert labels.isEmpty()
    (tmp_path / "g" / "007" / "labels.txt").write_text("Start Time\tEnd Time\tTransportation Mode\n2008/10/23 02:50:00\t2008/10/23 03:00:00\tbus\n")
    assert [(r["user_id"], r["mode"]) for r in tracks.read_geolife(spark, f"file://{tmp_path}/g")[1].collect()] == [(7, "bus")]


def test_gpx(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"{k}.gpx").write_text(f'<?xml version="1.0"?><gpx version="1.1"><trk><name>n</name><trkseg><trkpt lat="47.{k}" lon="8.5"><ele>400</ele><time>2024-01-0{k}T00:00:00Z</time></trkpt><trkpt lat="47.2" lon="8.6"><ele>401</ele><time>2024-01-0{k}T00:01:00Z</time></trkpt></trkseg></trk></gpx>')
    rows = tracks.read_gpx(spark, f"file://{tmp_path}").orderBy("id").collect()
    assert [(r["track_fid"], r["track_seg_point_id"], r["lat"], r["tracked_at"].day) for r in rows] == [(0, 0, 47.1, 1), (0, 1, 47.2, 1), (1, 0, 47.2, 2), (1, 1, 47.2, 2)]


def test_model(spark):
    rows = [("a", 0, 1, 0, 0), ("a", 10, 3, 0, 0), ("a", 12, 9, 0, 0.01), ("a", 13, 9, 0, 0.02), ("a", 14, 5, 0, 0.03), ("a", 40, 5, 0, 0.03), ("a", 41, 5, 0, 0.06)]
    pfs, sp = Positionfixes(fixes(spark, rows)).generate_staypoints(gap_threshold=60)
    pfs, tpls = pfs.generate_triplegs(sp)
    sp, tpls, trips = sp.create_activity_flag(time_threshold=5).generate_trips(tpls)
    trips, tours = trips.generate_tours(max_dist=10_000)
    assert (sp.df.count(), tpls.df.count(), trips.df.count(), tours.df.count()) == (2, 1, 1, 1)
    assert pfs.center[0] == 0.0
    with pytest.raises(AttributeError):
        Locations(pfs.df)
    with pytest.raises(ValueError):
        Staypoints(sp.df.where("false")).validate(deep=True)


def _shapefile(rows):
    """A shapefile's parts (shp, dbf) of lines with HHNR and ETNR."""
    import struct

    shp, dbf = bytearray(100), bytearray(struct.pack("<BBBBIHH20x", 3, 0, 0, 0, len(rows), 97, 21))
    for name in (b"HHNR", b"ETNR"):
        dbf += name.ljust(11, b"\0") + b"N" + bytes(4) + bytes([10, 0]) + bytes(14)
    dbf += b"\r"
    for k, (user, number, pts) in enumerate(rows, 1):
        body = struct.pack("<I", 0) if pts is None else struct.pack("<I4dIII", 3, 0, 0, 0, 0, 1, len(pts), 0) + b"".join(struct.pack("<2d", *p) for p in pts)
        shp += struct.pack(">II", k, len(body) // 2) + body
        dbf += b" " + str(user).rjust(10).encode() + str(number).rjust(10).encode()
    return bytes(shp), bytes(dbf)


def test_travel_survey(spark, tmp_path):
    """Two people: one goes to work by two stages and back past midnight, the other makes one trip."""
    import zipfile

    from wayfarer.sources.survey import read_mzmv

    axes = ["X", "Y", "X_CH1903", "Y_CH1903"]
    home, stop, work = (8.5, 47.0, 600, 200), (8.6, 47.1, 610, 210), (8.7, 47.2, 620, 220)
    stages = [(1, 1, 1, "08:00:00", "08:10:00", 1, home, stop), (1, 1, 2, "08:15:00", "08:30:00", 2, stop, work), (1, 2, 3, "23:50:00", "00:20:00", 3, work, home), (2, 1, 1, "10:00:00", "24:00:00", 4, stop, home)]
    head = ["HHNR", "WEGNR", "ETNR", "f51100time", "f51400time", "f52900", "W_X_CH1903", "W_Y_CH1903", *(f"{e}_{a}" for e in "SZ" for a in axes)]
    files = {
        "wege.csv": [["HHNR", "WEGNR", "f51100time", "f51400time", "ort"], [1, 1, "08:00:00", "08:30:00", "Zürich"], [1, 2, "23:50:00", "00:20:00", ""], [2, 1, "10:00:00", "24:00:00", ""]],
        "etappen.csv": [head, *([u, t, s, a, b, why, 600, 200, *p, *q] for u, t, s, a, b, why, p, q in stages)],
        "zielpersonen.csv": [["HHNR", "A_X_CH1903", "A_Y_CH1903", "AU_X_CH1903", "AU_Y_CH1903"], [1, 620, 220, -97, -97], [2, -97, -97, 600, 200]],
        "verifikationspunkte.csv": [["HHNR", "ETNR", *(f"R{k}_{a}" for k in range(1, 7) for a in axes)], [1, 1, *(8.55, 47.05, 605, 205), *([-997] * 20)]],
    }
    with zipfile.ZipFile(tmp_path / "4_DB_csv\\CH_CSV.zip", "w") as z:
        for name, rows in files.items():
            z.writestr(name, "\n".join(",".join(map(str, r)) for r in rows).encode("latin1"))
    shp, dbf = _shapefile([(1, 1, [(8.5, 47.0), (8.6, 47.1)]), (1, 2, None), (1, 3, [(1.0, 1.0), (1.0, 1.0)])])
    with zipfile.ZipFile(tmp_path / "5_Routen(Geometriefiles)\\CH_routen.zip", "w") as z:
        z.writestr("routen.shp", shp), z.writestr("routen.dbf", dbf)
    trips, sp, tpls = read_mzmv(spark, f"file://{tmp_path}")
    when = lambda d, h, m, s=0: datetime(1970, 1, d, h, m, s)
    assert [(r["id"], r["user_id"], r["started_at"], r["finished_at"], r["origin_staypoint_id"], r["destination_staypoint_id"]) for r in trips.orderBy("id").collect()] == [
        (0, 1, when(1, 8, 0), when(1, 8, 30), 0, 2), (1, 1, when(1, 23, 50), when(2, 0, 20), 2, 4), (2, 2, when(1, 10, 0), when(1, 23, 59, 59), 3, 5)]
    assert [(r["id"], r["is_activity"], r["started_at"], r["finished_at"], r["prev_trip_id"], r["trip_id"], r["next_trip_id"], r["purpose"], r["purpose_tpls"]) for r in sp.orderBy("id").collect()] == [
        (0, True, when(1, 8, 0), when(1, 8, 0), None, None, 0, "home", None), (1, False, when(1, 8, 10), when(1, 8, 15), None, 0, None, None, 1), (2, True, when(1, 8, 30), when(1, 23, 50), 0, None, 1, "work", 2),
        (3, True, when(1, 10, 0), when(1, 10, 0), None, None, 2, None, None), (4, True, when(2, 0, 20), None, 1, None, None, "home", 3), (5, True, when(1, 23, 59, 59), None, 2, None, None, "home", 4)]
    line = lambda v: None if v is None else [tuple(p) for p in v]
    got = {(r["user_id"], r["ETNR"]): (line(r["geom"]), line(r["VP_XY"])) for r in tpls.collect()}
    assert got[1, 1] == ([(8.5, 47.0), (8.6, 47.1)], [(8.5, 47.0), (8.55, 47.05), (8.6, 47.1)])
    assert got[1, 2] == (None, [(8.6, 47.1), (8.7, 47.2)])
    assert got[1, 3] == (None, [(8.7, 47.2), (8.5, 47.0)])
    assert got[2, 1] == (None, [(8.6, 47.1), (8.5, 47.0)])
    with pytest.raises(FileNotFoundError):
        read_mzmv(spark, f"file://{tmp_path}/4_DB_csv*")
