"""Known answers on small cases."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.functions import geo, labelling, metrics
from wayfarer.functions.quality import split_overlaps, temporal_tracking_quality
from wayfarer.operators.locations import generate_locations
from wayfarer.operators.spatial import distance_matrix, spatial_filter
from wayfarer.operators.staypoints import generate_staypoints, merge_staypoints
from wayfarer.operators.triplegs import generate_triplegs
from wayfarer.operators.trips import generate_tours, generate_trips

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def fixes(spark, rows):
    return spark.createDataFrame([(k, u, at(m), float(e), float(x), float(y)) for k, (u, m, e, x, y) in enumerate(rows)], "id long, user_id string, tracked_at timestamp, elevation double, lon double, lat double")


def test_haversine_and_degrees(spark):
    row = spark.range(1).select(
        geo.haversine(*map(F.lit, (8.5, 47.3, 8.7, 47.2))).alias("d"), geo.haversine(F.lit(None).cast("double"), *map(F.lit, (1.0, 2.0, 3.0))).alias("none"), geo.metres_to_degrees(F.lit(111320.0), F.lit(60.0)).alias("m")
    ).first()
    assert row["d"] == pytest.approx(18749.056277719905, abs=1e-6)
    assert row["none"] is None
    assert row["m"] == pytest.approx(2.0)


@pytest.mark.parametrize(("pts", "want"), [([(179.0, 10.0), (-179.0, 20.0)], (180.0, 15.0)), ([(0.0, 0.0), (2.0, 0.0)], (1.0, 0.0))])
def test_centre(spark, pts, want):
    c = spark.createDataFrame([([{"x": x, "y": y} for x, y in pts],)], "p array<struct<x:double,y:double>>").select(geo.centre(F.col("p")).alias("c")).first()["c"]
    assert (abs(c["x"]), c["y"]) == (pytest.approx(want[0]), pytest.approx(want[1]))


STAY = [("a", 0, 1, 0, 0), ("a", 5, 3, 0, 0.0001), ("a", 10, 2, 0, 0), ("a", 12, 9, 0, 0.01), ("a", 13, 9, 0, 0.02), ("a", 17, 5, 0, 0.03), ("a", 27, 7, 0, 0.03), ("b", 0, 0, 1, 1)]


def test_staypoints(spark):
    pfs, sp = generate_staypoints(fixes(spark, STAY), time_threshold=5)
    assert [(r["id"], r["user_id"], r["started_at"], r["finished_at"], r["elevation"]) for r in sp.collect()] == [(0, "a", at(0), at(12), 2.0)]
    assert sp.first()["lat"] == pytest.approx(0.00005)  # of places, each once
    assert {r["id"]: r["staypoint_id"] for r in pfs.collect()} == {0: 0, 1: 0, 2: 0, **dict.fromkeys(range(3, 8))}
    last = generate_staypoints(fixes(spark, STAY), time_threshold=5, include_last=True)[1].orderBy("id").collect()
    assert [(r["started_at"], r["finished_at"]) for r in last] == [(at(0), at(12)), (at(17), at(27))]
    assert generate_staypoints(fixes(spark, STAY), dist_threshold=0, time_threshold=0)[1].count() == 6
    assert generate_staypoints(fixes(spark, STAY), dist_threshold=1e9)[1].isEmpty()
    assert generate_staypoints(fixes(spark, STAY).where("false"))[1].isEmpty()
    for bad in ({"method": "other"}, {"distance_metric": "other"}):
        with pytest.raises(ValueError):
            generate_staypoints(fixes(spark, STAY), **bad)


def test_long_stay_spans_many_fixes(spark):
    rows = [("a", m, 0, 0, 0) for m in range(700)] + [("a", 700, 0, 1, 1)]
    assert [(r["started_at"], r["finished_at"]) for r in generate_staypoints(fixes(spark, rows))[1].collect()] == [(at(0), at(700))]


def test_triplegs(spark):
    rows = [("a", 0, 0, 0, 0), ("a", 1, 0, 0, 1), ("a", 2, 0, 0, 2), ("a", 3, 0, 0, 3), ("a", 40, 0, 0, 4), ("a", 41, 0, 0, 4), ("a", 80, 0, 0, 5)]
    pfs = fixes(spark, rows).withColumn("staypoint_id", F.when(F.col("id") == 2, F.lit(0).cast("bigint")))
    out, tpls = generate_triplegs(pfs)
    assert [(r["id"], r["started_at"], r["finished_at"], len(r["geom"])) for r in tpls.collect()] == [(0, at(0), at(1), 2)]  # id 1 has one place only
    assert {r["id"]: r["tripleg_id"] for r in out.collect()} == {0: 0, 1: 0, **dict.fromkeys(range(2, 7))}
    with pytest.raises(TypeError):
        generate_triplegs(pfs.drop("staypoint_id"))
    with pytest.raises(TypeError):
        generate_triplegs(pfs, method="overlap_staypoints")
    with pytest.raises(ValueError):
        generate_triplegs(pfs, method="other")


def stays(spark, rows):
    return spark.createDataFrame([(i, u, at(a), at(b), float(x), float(y), loc) for i, u, a, b, x, y, loc in rows], "id long, user_id long, started_at timestamp, finished_at timestamp, lon double, lat double, location_id long")


def test_merge(spark):
    sp = stays(spark, [(1, 0, 0, 10, 0, 0, 1), (2, 0, 15, 20, 0, 0, 1), (3, 0, 25, 30, 0, 0, 1), (4, 0, 60, 70, 0, 0, 1), (5, 0, 72, 80, 0, 0, 2), (6, 0, 81, 90, 0, 0, None), (7, 0, 91, 95, 0, 0, None), (8, 1, 0, 5, 0, 0, 1)])
    none = spark.createDataFrame([], "id long, user_id long, started_at timestamp, finished_at timestamp")
    assert [r["id"] for r in merge_staypoints(sp, none).orderBy("id").collect()] == [1, 4, 5, 6, 7, 8]
    one = spark.createDataFrame([(9, 0, at(21), at(24))], none.schema)
    assert [(r["id"], r["finished_at"]) for r in merge_staypoints(sp, one).where("user_id = 0 and id < 4").orderBy("id").collect()] == [(1, at(20)), (3, at(30))]
    assert merge_staypoints(sp, none, "2h").count() == 5
    with pytest.raises(TypeError):
        merge_staypoints(sp, none, 10)


def test_metrics(spark):
    sp = stays(spark, [(0, 0, 0, 10, 0, 0, 1), (1, 0, 20, 30, 3, 3, 1), (2, 0, 40, 50, 6, 6, 1), (3, 1, 0, 10, 5, 5, 1)])
    jumps = {r["id"]: r["jump_length"] for r in metrics.jump_length(sp, planar=True).collect()}
    assert jumps == {0: pytest.approx(math.sqrt(18)), 1: pytest.approx(math.sqrt(18)), 2: None, 3: None}
    assert {r["user_id"]: r["radius_gyration"] for r in metrics.radius_gyration(sp, planar=True).collect()} == {0: pytest.approx(math.sqrt(12)), 1: 0.0}
    with pytest.raises(ValueError):
        metrics.radius_gyration(sp, "other")


def test_modes(spark):
    tpls = spark.createDataFrame([(k, 0, at(0), at(60), [{"x": 0.0, "y": 0.0}, {"x": float(d), "y": 0.0}]) for k, d in enumerate((10_000, 50_000, 200_000))] + [(9, 0, at(0), at(0), [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}])], "id long, user_id long, started_at timestamp, finished_at timestamp, geom array<struct<x:double,y:double>>")
    assert {r["id"]: r["mode"] for r in labelling.predict_transport_mode(tpls, planar=True).collect()} == {0: "slow_mobility", 1: "motorized_mobility", 2: "fast_mobility", 9: None}


def test_quality(spark):
    sp = stays(spark, [(0, 0, 0, 720, 0, 0, 1), (1, 0, 1080, 1440, 0, 0, 1), (2, 1, 5, 5, 0, 0, 1), (3, 1, 9, 3, 0, 0, 1)])
    assert [(r["user_id"], r["quality"]) for r in temporal_tracking_quality(sp).collect()] == [(0, 0.75)]
    assert [r["quality"] for r in temporal_tracking_quality(sp, "day").collect()] == [0.75]
    assert sum(r["quality"] for r in temporal_tracking_quality(sp, "hour").collect()) == pytest.approx(18)
    assert [(r["started_at"], r["finished_at"]) for r in split_overlaps(stays(spark, [(0, 0, 1400, 3000, 0, 0, 1)])).collect()] == [(at(1400), at(1440)), (at(1440), at(2880)), (at(2880), at(3000))]
    with pytest.raises(ValueError):
        temporal_tracking_quality(sp, "year")
    with pytest.raises(KeyError):
        temporal_tracking_quality(sp.drop("finished_at"))


def trip_rows(spark, rows):
    """(id, start, end, from x, to x, origin, destination)"""
    spot = lambda x: {"x": float(x), "y": 0.0}
    return spark.createDataFrame([(i, 0, at(a), at(b), o, d, spot(p), spot(q)) for i, a, b, p, q, o, d in rows], "id long, user_id long, started_at timestamp, finished_at timestamp, origin_staypoint_id long, destination_staypoint_id long, start_geom struct<x:double,y:double>, end_geom struct<x:double,y:double>")


def members(tours):
    return [r["trips"] for r in tours.orderBy("id").collect()]


def test_tours(spark):
    nested = trip_rows(spark, [(2, 0, 10, 0, 1, 1, 2), (6, 20, 30, 1, 2, 2, 3), (100, 40, 50, 2, 3, 3, 4), (200, 60, 70, 3, 2, 4, 5), (15, 80, 90, 2, 0, 5, 6)])
    out, tours = generate_tours(nested, max_dist=100)
    assert members(tours) == [[100, 200], [2, 6, 100, 200, 15]]
    assert {r["id"]: r["tour_id"] for r in out.collect()}[100] == [0, 1]
    gap = trip_rows(spark, [(1, 0, 10, 0, 1, 1, 2), (2, 20, 30, 3, 4, 3, 4), (3, 40, 50, 4, 0, 4, 5), (4, 60, 70, 0, 0, 5, 6)])
    assert members(generate_tours(gap)[1]) == [[4]]
    assert members(generate_tours(gap, max_nr_gaps=1)[1]) == [[1, 2, 3], [4]]
    assert members(generate_tours(nested, max_time="40min")[1]) == [[100, 200]]
    assert generate_tours(nested.where("false"))[1].isEmpty()
    places = spark.createDataFrame([(1, 7), (2, 8), (3, 9), (4, 5), (5, 9), (6, 7)], "id long, location_id long")
    by_place = generate_tours(nested.drop("start_geom", "end_geom"), places)[1].orderBy("id").collect()
    assert [(r["trips"], r["location_id"]) for r in by_place] == [([100, 200], 9), ([2, 6, 100, 200, 15], 7)]
    with pytest.raises(TypeError):
        generate_tours(nested, max_time=5)


def test_trips(spark):
    sp = stays(spark, [(0, 0, 0, 10, 0, 0, 1), (1, 0, 20, 22, 1, 0, 1), (2, 0, 30, 60, 2, 0, 1), (3, 0, 200, 260, 3, 0, 1)]).withColumn("is_activity", F.col("id") != 1)
    line = lambda a, b: [{"x": float(a), "y": 0.0}, {"x": float(b), "y": 0.0}]
    tpls = spark.createDataFrame([(0, 0, at(10), at(20), line(0, 1)), (1, 0, at(22), at(30), line(1, 2)), (2, 0, at(60), at(70), line(2, 2.5))], "id long, user_id long, started_at timestamp, finished_at timestamp, geom array<struct<x:double,y:double>>")
    sp2, tpls2, trips = generate_trips(sp, tpls)
    rows = trips.orderBy("id").collect()
    assert [(r["id"], r["started_at"], r["finished_at"], r["origin_staypoint_id"], r["destination_staypoint_id"]) for r in rows] == [(0, at(10), at(30), 0, 2), (1, at(60), at(70), 2, None)]
    assert [r["end_geom"]["x"] for r in rows] == [2.0, 2.5]
    assert {r["id"]: (r["trip_id"], r["prev_trip_id"], r["next_trip_id"]) for r in sp2.collect()} == {0: (None, None, 0), 1: (0, None, None), 2: (None, 0, 1), 3: (None, None, None)}
    assert {r["id"]: r["trip_id"] for r in tpls2.collect()} == {0: 0, 1: 0, 2: 1}
    with pytest.raises(AttributeError):
        generate_trips(sp.drop("is_activity"), tpls)


def test_locations(spark):
    deg = 10 / 111_195
    sp = stays(spark, [(1, 0, 0, 1, 0, 0, None), (15, 0, 2, 3, 0, deg / 2, None), (2, 0, 4, 5, 0, 1, None), (5, 1, 0, 1, 0, 2, None), (6, 1, 2, 3, 0, 2 + deg / 2, None), (80, 2, 0, 1, 0, 2 + deg, None), (3, 2, 2, 3, 0, 2 + deg * 1.5, None), (7, 2, 4, 5, 0, 3, None)])
    by = lambda df: sorted(sorted(r["ids"]) for r in df.where("location_id is not null").groupBy("location_id").agg(F.collect_list("id").alias("ids")).collect())
    user, locs = generate_locations(sp, epsilon=10, num_samples=2)
    assert by(user) == [[1, 15], [3, 80], [5, 6]]
    assert [(r["id"], r["user_id"]) for r in locs.orderBy("id").collect()] == [(0, 0), (1, 1), (2, 2)]
    for r in locs.collect():
        ring = np.array([(p["x"], p["y"]) for p in r["extent"]])
        assert (ring[0] == ring[-1]).all()
        within, edge = geo.inside(np.array([r["center"]["x"]]), np.array([r["center"]["y"]]), [ring])
        assert within[0] and not edge[0]
    assert by(generate_locations(sp, epsilon=10, num_samples=2, agg_level="dataset")[0]) == [[1, 15], [3, 5, 6, 80]]
    with pytest.raises(ValueError):
        generate_locations(sp, agg_level="other")
    with pytest.raises(KeyError):
        generate_locations(sp, activities_only=True)


def test_spatial(spark):
    square = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]]
    pts = spark.createDataFrame([(0, 3.0, 3.0), (1, 1.5, 1.5), (2, 4.0, 2.0), (3, 9.0, 9.0)], "id long, lon double, lat double")
    got = {m: sorted(r["id"] for r in spatial_filter(pts, [square], m).collect()) for m in ("within", "intersects", "crosses")}
    assert got == {"within": [0], "intersects": [0, 2], "crosses": []}
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    lines = spark.createDataFrame([(0, line((3, 1), (3, 3))), (1, line((-1, 3), (5, 3))), (2, line((0.5, 1.5), (3, 1.5))), (3, line((8, 8), (9, 9)))], "id long, geom array<struct<x:double,y:double>>")
    got = {m: sorted(r["id"] for r in spatial_filter(lines, [square], m).collect()) for m in ("within", "intersects", "crosses")}
    assert got == {"within": [0], "intersects": [0, 1, 2], "crosses": [1, 2]}


def test_adjoining_areas(spark):
    """A line from one area into the next stays within their union."""
    box = lambda x0, x1: [[(x0, 0.0), (x1, 0.0), (x1, 4.0), (x0, 4.0), (x0, 0.0)]]
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    lines = spark.createDataFrame([(0, line((1, 1), (5, 3))), (1, line((1, 1), (5, 3), (9, 3))), (2, line((1, 2), (11, 2))), (3, line((4, 2), (5, 2)))], "id long, geom array<struct<x:double,y:double>>")
    got = {m: sorted(r["id"] for r in spatial_filter(lines, [box(0.0, 3.1), box(3.1, 6.0), box(10.0, 12.0)], m).collect()) for m in ("within", "intersects", "crosses")}
    assert got == {"within": [0, 3], "intersects": [0, 1, 2, 3], "crosses": [1, 2]}


def test_line_distances(spark):
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    lines = spark.createDataFrame([(0, line((0, 0), (1, 0), (2, 0))), (1, line((0, 1), (2, 1)))], "id long, geom array<struct<x:double,y:double>>")
    got = {m: {(r["i"], r["j"]): r["distance"] for r in distance_matrix(lines, dist_metric=m).collect()} for m in ("dtw", "frechet")}
    assert got["dtw"] == {(0, 0): 0.0, (1, 1): 0.0, (0, 1): pytest.approx(2 + math.sqrt(2)), (1, 0): pytest.approx(2 + math.sqrt(2))}
    assert got["frechet"][0, 1] == pytest.approx(math.sqrt(2))
    with pytest.raises(ValueError):
        distance_matrix(lines.select("id", F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat")), dist_metric="other")


def test_line_distances_recursion():
    """Both programmes against their recursive definitions, over lines of mixed lengths."""
    from functools import cache

    rng = np.random.default_rng(3)
    a, b = ([rng.normal(size=(rng.integers(1, 6), 2)) for _ in range(40)] for _ in range(2))
    for kind, join in (("dtw", lambda best, d: best + d), ("frechet", max)):
        got = geo.line_distances(a, b, kind)
        for k in range(40):
            x, y = a[k], b[k]

            @cache
            def at(i, j, x=x, y=y, join=join):
                d = math.dist(x[i], y[j])
                before = [at(p, q) for p, q in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if p >= 0 and q >= 0]
                return join(min(before), d) if before else d

            assert got[k] == pytest.approx(at(len(x) - 1, len(y) - 1))


def test_metric_function(spark):
    pts = spark.createDataFrame([(0, 3.0, 4.0), (1, -1.0, 2.0)], "id long, lon double, lat double")
    got = {(r["i"], r["j"]): r["distance"] for r in distance_matrix(pts, dist_metric=lambda x1, y1, x2, y2: F.abs(x1 - x2) * 10 + F.abs(y1 - y2)).collect()}
    assert got == {(0, 0): 0.0, (1, 1): 0.0, (0, 1): 42.0, (1, 0): 42.0}


def admissible(rows, max_time, max_gaps):
    """By definition, without regard to what earlier closings forget: for each closing trip the tour from its latest admissible opening."""
    out = {}
    gap = [k > 0 and abs(rows[k - 1][4] - r[3]) > 1e-6 for k, r in enumerate(rows)]
    for k, r in enumerate(rows):
        opens = [c for c in range(k + 1) if rows[c][5] is not None and sum(gap[c + 1 : k + 1]) <= max_gaps and r[2] - rows[c][1] <= max_time and abs(rows[c][3] - r[4]) < 1e-6]
        if opens and r[6] is not None and (max_gaps or not gap[k]):
            out[r[0]] = [x[0] for x in rows[max(opens) : k + 1]]
    return out


@pytest.mark.parametrize("max_gaps", [0, 1, 2])
def test_tours_random(spark, max_gaps):
    rng = np.random.default_rng(8)
    rows, users = [], {}
    for user in range(40):
        own, t = [], 0
        for k in range(int(rng.integers(1, 30))):
            p = own[-1][4] if own and rng.random() < 0.75 else int(rng.integers(0, 5))
            q, length = int(rng.integers(0, 5)), int(rng.integers(1, 90))
            own.append((user * 100 + k, t, t + length, p, q, None if rng.random() < 0.15 else 1, None if rng.random() < 0.15 else 2))
            t += length + int(rng.integers(0, 60))
        users[user] = own
        rows += [(i, user, at(a), at(b), o, d, {"x": float(p), "y": 0.0}, {"x": float(q), "y": 0.0}) for i, a, b, p, q, o, d in own]
    spot = "struct<x:double,y:double>"
    trips = spark.createDataFrame(rows, f"id long, user_id long, started_at timestamp, finished_at timestamp, origin_staypoint_id long, destination_staypoint_id long, start_geom {spot}, end_geom {spot}").repartition(3)
    want = [admissible(users[u], 300, max_gaps) for u in sorted(users)]
    got = members(generate_tours(trips, max_time="300min", max_nr_gaps=max_gaps)[1])
    assert len(got) > 50
    if max_gaps == 0:
        assert got == [t for own in want for t in own.values()]
    else:  # what is found is the latest that may be; some is forgotten
        assert all(t == want[t[0] // 100][t[-1]] for t in got)
        assert len(got) > 0.6 * sum(map(len, want))


def test_matrices_of_all_users(spark):
    """Every user stands in the matrix, against plain loops over the whole fixture."""
    from wayfarer.plans import catalog_trips, fixtures

    sf = "/root/testdata/sf0.001"
    points = {}
    for r in fixtures.positionfixes(spark, sf).select("user_id", "lon", "lat").collect():
        points.setdefault(r["user_id"], []).append((r["lon"], r["lat"]))
    centres = {u: (math.fsum(x for x, _ in p) / len(p), math.fsum(y for _, y in p) / len(p)) for u, p in points.items()}

    def great_circle(a, b):
        (x1, y1), (x2, y2) = (tuple(map(math.radians, c)) for c in (a, b))
        return 2 * 6371000 * math.asin(math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2))

    for run, plain, near in ((catalog_trips.distance_matrix_haversine_users, great_circle, 0.2), (catalog_trips.distance_matrix_euclidean_users, math.dist, 1e-8)):
        got = {(r["i"], r["j"]): r["distance"] for r in run(spark, sf).collect()}
        assert got == {(i, j): pytest.approx(plain(centres[i], centres[j]), abs=near) for i in centres for j in centres}


def test_label_looks_at_twenty():
    """A registered query runs the label join with the default number of triplegs, as its SQL does."""
    from wayfarer.plans.catalog import ORACLE_SQL, QUERIES

    assert "temp_overlap_label_join" in QUERIES
    assert "k <= 20)" in ORACLE_SQL["temp_overlap_label_join"]
    assert "k <= 3)" not in ORACLE_SQL["temp_overlap_label_join"]


def test_more_metrics(spark):
    pts = spark.createDataFrame([(0, 3.0, 4.0), (1, -1.0, 2.0), (2, 0.0, 0.0)], "id long, lon double, lat double")
    want = {"l1": (6.0, 7.0), "l2": (math.sqrt(20), 5.0), "canberra": (1 + 1 / 3, 2.0), "braycurtis": (0.75, 1.0), "cosine": (1 - 1 / math.sqrt(5), 1.0)}
    for metric, (one, zero) in want.items():
        got = {(r["i"], r["j"]): r["distance"] for r in distance_matrix(pts, dist_metric=metric).collect()}
        assert (got[0, 1], got[0, 2], got[0, 0]) == (pytest.approx(one), pytest.approx(zero), pytest.approx(0.0, abs=1e-12)), metric


def test_matrix_of_points_is_dealt_out(spark):
    """A table of few bytes makes many pairs: they are measured by tasks of a bounded number of them, whatever the table's own partitions."""
    pts = spark.range(0, 9000, 1, 1).select("id", (F.col("id") / 1000).alias("lon"), (F.col("id") % 7 / 10).alias("lat"))
    per_task = [r["count"] for r in distance_matrix(pts, dist_metric="euclidean").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 9000 * 9000
    assert max(per_task) <= 4096 * 4096


def test_matrix_of_lines_by_blocks(spark, monkeypatch):
    """Repeated lines, small blocks and lines without points, against one pair at a time; Python isn't called with pairs."""
    from wayfarer.operators import spatial

    monkeypatch.setattr(spatial, "LINES_A_TASK", 7)
    monkeypatch.setattr(spatial, "VERTICES_A_TASK", 16)
    rng = np.random.default_rng(5)
    kinds = [rng.integers(0, 4, (int(rng.integers(0, 6)), 2)).astype(float) for _ in range(9)]
    rows = [kinds[int(rng.integers(0, 9))] for _ in range(40)]
    frame = spark.createDataFrame([(k, [{"x": float(p), "y": float(q)} for p, q in r]) for k, r in enumerate(rows)], "id long, geom array<struct<x:double,y:double>>").repartition(3)
    for kind in ("dtw", "frechet"):
        matrix = distance_matrix(frame, dist_metric=kind)
        assert "ArrowEvalPython" not in matrix._jdf.queryExecution().toString()
        got = matrix.collect()
        assert len(got) == 1600
        for r in got:
            a, b = rows[r["i"]], rows[r["j"]]
            assert r["distance"] == (geo.line_distances([a], [b], kind)[0] if len(a) and len(b) else None)


def plain_clusters(x, y, order, epsilon, least):
    """By definition, with all distances at hand: the number of each point's location, or None."""
    near = geo.np_haversine(x[:, None], y[:, None], x[None], y[None]) <= epsilon
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    k = 0
    for i in order:
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                p = todo.pop()
                if label[p] < 0:
                    label[p] = k
                    todo += np.flatnonzero(near[p] & core & (label < 0)).tolist()
            k += 1
    for i in np.flatnonzero(~core):
        some = label[near[i] & core]
        label[i] = some.min() if len(some) else -1
    return [None if v < 0 else int(v) for v in label]


@pytest.mark.parametrize("least", [1, 4])
def test_dataset_clusters_by_cells(spark, least):
    """Chains, dense places, repeated points, the date line and a pole, against all distances."""
    rng = np.random.default_rng(11)
    x, y = [], []
    for lon, lat in ((8.5, 47.3), (179.9995, -20.0), (30.0, 89.9995)):
        spread = 0.004 / math.cos(math.radians(min(lat, 89.9)))
        x += (lon + rng.normal(size=150) * spread).tolist()
        y += np.minimum(90.0, lat + rng.normal(size=150) * 0.004).tolist()
    x += [8.5] * 30
    y += [47.3] * 30
    x, y = np.array([(v + 180) % 360 - 180 for v in x]), np.array(y)
    users = rng.integers(0, 9, len(x))
    rows = [(k, int(users[k]), at(k), float(x[k]), float(y[k])) for k in range(len(x))] + [(len(x), 3, at(1), None, 1.0), (len(x) + 1, 3, at(1), float("nan"), 1.0)]
    sp = spark.createDataFrame(rows, "id long, user_id long, started_at timestamp, lon double, lat double")
    want = plain_clusters(x, y, np.lexsort((np.arange(len(x)), users)), 100, least)
    sp2, locs = generate_locations(sp, num_samples=least, agg_level="dataset")
    got = {r["id"]: r["location_id"] for r in sp2.collect()}
    assert [got[k] for k in range(len(x))] == want
    assert got[len(x)] is None and got[len(x) + 1] is None
    assert {(r["id"], r["user_id"]) for r in locs.collect()} == {(w, int(u)) for w, u in zip(want, users, strict=True) if w is not None}


def test_dataset_clusters_of_one_crowd(spark):
    """20,000 staypoints within a few metres and on 10,000 spots: no table of all pairs, which would be 4e8 rows."""
    sp = spark.range(0, 20000, 1, 4).select("id", (F.col("id") % 500).alias("user_id"), F.timestamp_seconds(F.col("id")).alias("started_at"), (8.5 + F.col("id") % 100 * 1e-7).alias("lon"), (47.3 + F.floor(F.col("id") % 10000 / 100) * 1e-7).alias("lat"))
    from wayfarer.operators import graph, locations

    sizes = []
    keep = graph.saved

    def counted(df):
        out = keep(df)
        sizes.append(out.count())
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(locations, "saved", counted)
        sp2, locs = generate_locations(sp, agg_level="dataset", extent=False)
    assert max(sizes) <= 20000
    assert [tuple(r) for r in sp2.groupBy("location_id").count().collect()] == [(0, 20000)]
    assert locs.count() == 500


def test_cells_on_the_verge():
    """Two dense walls 100.2 m apart aren't linked, and one point between makes them so."""
    from wayfarer.operators.locations import _Plane

    plane = _Plane(100, True)
    rows = lambda x: np.array([(a, b, a, b, 0.0) for a in (x, x + 1) for b in np.arange(0, 60, 0.01)])
    left, right = rows(0.0), rows(101.2)
    assert not plane.linked(left, right)
    assert plane.linked(np.vstack([left, [[1.3, 30.0, 1.3, 30.0, 0.0]]]), right)


def test_extents_by_pieces(spark):
    """Rings of more rows than a piece has come out as the kernel's own, without Python objects for their corners."""
    from wayfarer.operators.locations import _hulls

    rng = np.random.default_rng(2)
    spots = [sorted({(float(a), float(b)) for a, b in rng.integers(0, 5, (int(rng.integers(1, 9)), 2))}) for _ in range(600)]
    frame = spark.createDataFrame([(k, [{"x": a, "y": b} for a, b in s], s[0][1]) for k, s in enumerate(spots)], "id long, _spots array<struct<x:double,y:double>>, _lat double")
    got = {r["id"]: [(p["x"], p["y"]) for p in r["extent"]] for r in frame.mapInArrow(_hulls(50.0, True), "id long, extent array<struct<x:double,y:double>>").collect()}
    assert len(got) == 600
    for k, s in enumerate(spots):
        assert got[k] == list(map(tuple, geo.buffered_hull(np.array(s), 50.0).tolist()))
