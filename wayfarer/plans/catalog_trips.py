"""Locations, trips, tours and analyses, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfarer.functions import identify, labelling
from wayfarer.functions.modal_split import calculate_modal_split
from wayfarer.functions.quality import split_overlaps, temporal_tracking_quality
from wayfarer.operators.locations import generate_locations
from wayfarer.operators.spatial import add_modes_to_triplegs, distance_matrix, spatial_filter
from wayfarer.operators.trips import generate_tours, generate_trips, get_trips_grouped
from wayfarer.plans import fixtures as fx
from wayfarer.plans.catalog import MODE_SQL, MODES, query, r6
from wayfarer.plans.fixtures import LOC, hav, with_sql

# -- trips and tours ---------------------------------------------------------------------------------------------------

TRIPS = f"""
    , ends as (select distinct tripleg_id, first_value(lon) over w as fx, first_value(lat) over w as fy, last_value(lon) over w as lx, last_value(lat) over w as ly
        from tpfs where tripleg_id is not null window w as (partition by tripleg_id order by t, id rows between unbounded preceding and unbounded following)),
    both_kinds as (select user_id, started_at, finished_at, id, 0 as kind, t1 - t0 > 86400000000 as act, t0, t1, lon as ax, lat as ay, lon as bx, lat as by_ from sp
        union all select user_id, started_at, finished_at, id, 1, false, ta, tb, fx, fy, lx, ly from tpl join ends on tripleg_id = id),
    gaps as (select *, coalesce(lead(t0) over w - t1 > {fx.GAP * 60_000_000}, false) as gap from both_kinds window w as (partition by user_id order by t0, kind, id)),
    starts_at as (select *, lag(id) over w is null or (act and not coalesce(lead(act) over w, false)) or coalesce(lag(gap) over w, false) as begins from gaps window w as (partition by user_id order by t0, kind, id)),
    in_run as materialized (select *, sum(cast(begins as int)) over (partition by user_id order by t0, kind, id) as trip_run from starts_at),
    trip0 as materialized (select user_id, trip_run, min(started_at) as started_at, max(finished_at) as finished_at, min(t0) as t0, max(t1) as t1, row_number() over (order by user_id, trip_run) - 1 as id,
        arg_min(ax, (t0, id)) filter (kind = 1) as fx, arg_min(ay, (t0, id)) filter (kind = 1) as fy, arg_max(bx, (t0, id)) filter (kind = 1) as lx, arg_max(by_, (t0, id)) filter (kind = 1) as ly
        from in_run where not act group by user_id, trip_run having sum(kind) > 0),
    line as (select user_id, t0, id as trip_id, null as sp_id, 2 as what, null as x, null as y from trip0
        union all select user_id, t0, null, id, 1, ax, ay from in_run where act union all select user_id, t1 + {fx.GAP * 30_000_000}, null, null, 3, null, null from in_run where gap),
    near as materialized (select what, trip_id, sp_id, lag(sp_id) over w as o, lead(sp_id) over w as d, lag(trip_id) over w as prev_trip, lead(trip_id) over w as next_trip, lag(x) over w as ox, lag(y) over w as oy, lead(x) over w as dx, lead(y) over w as dy
        from line window w as (partition by user_id order by t0, what, sp_id)),
    trips as materialized (select t.id, t.user_id, t.started_at, t.finished_at, t.t0, t.t1, n.o as origin_staypoint_id, n.d as destination_staypoint_id, coalesce(ox, fx) as ox, coalesce(oy, fy) as oy, coalesce(dx, lx) as dx, coalesce(dy, ly) as dy
        from trip0 t join near n on n.what = 2 and n.trip_id = t.id)
"""


def trips_sql(select: str) -> str:
    return with_sql("tpl", "").rstrip() + TRIPS + select


def _trips(spark, sf):
    _, sp, tpls = fx.triplegs(spark, sf)
    return generate_trips(sp, tpls, fx.GAP)


@query(trips_sql("select id, user_id, started_at, finished_at, origin_staypoint_id, destination_staypoint_id from trips"))
def trips(spark, sf):
    return _trips(spark, sf)[2].select("id", "user_id", "started_at", "finished_at", "origin_staypoint_id", "destination_staypoint_id")


@query(trips_sql("select s.id, t.id as trip_id, n.prev_trip as prev_trip_id, n.next_trip as next_trip_id from in_run s left join trip0 t on not s.act and t.user_id = s.user_id and t.trip_run = s.trip_run left join near n on n.what = 1 and n.sp_id = s.id where s.kind = 0"))
def trips_staypoint_links(spark, sf):
    return _trips(spark, sf)[0].select("id", "trip_id", "prev_trip_id", "next_trip_id")


@query(trips_sql("select s.id, t.id as trip_id from in_run s left join trip0 t on t.user_id = s.user_id and t.trip_run = s.trip_run where s.kind = 1"))
def trips_tripleg_links(spark, sf):
    return _trips(spark, sf)[1].select("id", "trip_id")


@query(trips_sql("select id, round(ox, 9) as start_x, round(oy, 9) as start_y, round(dx, 9) as end_x, round(dy, 9) as end_y from trips"))
def trips_geometry(spark, sf):
    return _trips(spark, sf)[2].select("id", r6("start_geom.x", 9).alias("start_x"), r6("start_geom.y", 9).alias("start_y"), r6("end_geom.x", 9).alias("end_x"), r6("end_geom.y", 9).alias("end_y"))


_DAY5 = 5 * 86_400_000_000


_DIST_LINK = hav("a.dx", "a.dy", "b.ox", "b.oy") + " <= 1500"
_DIST_CLOSE = hav("a.ox", "a.oy", "b.dx", "b.dy") + " <= 1500"
_TOUR_PARTS = """
    , loc as materialized (select id, {loc} as place from sp),
    ot as materialized (select t.*, row_number() over (partition by t.user_id order by t.t0, t.id) as n, t.destination_staypoint_id as ds, t.origin_staypoint_id as os, lo.place as o_loc, ld.place as d_loc
        from trips t left join loc lo on lo.id = t.origin_staypoint_id left join loc ld on ld.id = t.destination_staypoint_id),
    chain as (select b.*, case when a.id is null or coalesce({linked}, false) then 0 else 1 end as breaks from ot b left join ot a on a.user_id = b.user_id and a.n = b.n - 1),
    chained as materialized (select *, sum(breaks) over (partition by user_id order by n) as c from chain),
    cand as (select b.id as closing, a.id as opening, b.user_id, a.n as na, b.n as nb, a.n + a.c as ea from chained a join chained b on a.user_id = b.user_id and a.n <= b.n and b.c - a.c <= {gaps}
        where b.ds is not null and a.os is not null and b.t1 - a.t0 <= {longest} and {closed} {fresh}),"""


def _tour_sql(linked: str, closed: str, select: str) -> str:
    """Without gaps: a tour ends with each trip that closes on the latest candidate of its chain, which is a run of linked trips. A
    trip after a gap doesn't close a tour."""
    parts = _TOUR_PARTS.format(loc=LOC, linked=linked, closed=closed, gaps=0, longest=_DAY5, fresh="and b.breaks = 0")
    return trips_sql(f"""{parts}
    tour as (select closing, arg_max(opening, na) as opening, max(na) as na, any_value(nb) as nb, any_value(user_id) as user_id, row_number() over (order by any_value(user_id), any_value(nb)) - 1 as id from cand group by closing)
    {select}""")


def _gap_tour_sql(linked: str, closed: str, select: str) -> str:
    """With one gap: trips and gaps are numbered through, and a recursion over each user's trips carries the number up to which all is
    forgotten."""
    parts = _TOUR_PARTS.format(loc=LOC, linked=linked, closed=closed, gaps=1, longest=_DAY5, fresh="")
    return trips_sql(f"""{parts}
    gap_at as (select user_id, c as i, n + c - 1 as q from chained where breaks = 1),
    late as (select b.id, max(a.n + a.c) as tn from chained a join chained b on a.user_id = b.user_id and a.n <= b.n and b.t1 - a.t0 > {_DAY5} group by b.id),
    opens as (select closing, list(ea) as es from cand group by closing),
    step as materialized (select b.user_id, b.id, b.n, b.n + b.c as e, b.ds is not null as ends, coalesce(g.q, -1) as q, coalesce(l.tn, -1) as tn, coalesce(o.es, []) as es, b.n + b.c + 1 + coalesce(x.breaks, 0) as nxt
        from chained b left join gap_at g on g.user_id = b.user_id and g.i = b.c - 1 left join late l on l.id = b.id left join opens o on o.closing = b.id left join chained x on x.user_id = b.user_id and x.n = b.n + 1),
    scan as (
        select user_id, n, id, e, cast(1 as hugeint) as f, ends, q, tn, list_max(es) as best, nxt from step where n = 1
        union all
        select s.user_id, s.n, s.id, s.e, w.g, s.ends, s.q, s.tn, list_max(list_filter(s.es, lambda x: x >= w.g)), s.nxt
        from (select *, case when not ends or best is not null then f when q >= f and q > tn then case when f + e - q + 1 > e then nxt else f + e - q + 1 end when tn >= f then tn else f end as g from scan) w
        join step s on s.user_id = w.user_id and s.n = w.n + 1),
    tour as (select w.id as closing, w.n as nb, w.user_id, o.n as na, o.id as opening, row_number() over (order by w.user_id, w.n) - 1 as id from scan w join chained o on o.user_id = w.user_id and o.n + o.c = w.best where w.ends)
    {select}""")


_TOURS = "select t.id, t.user_id, a.started_at, b.finished_at, a.os as origin_staypoint_id, b.ds as destination_staypoint_id, t.nb - t.na + 1 as n_trips from tour t join ot a on a.id = t.opening join ot b on b.id = t.closing"


def _tours(spark, sf, **options):
    sp, _, trips_ = _trips(spark, sf)
    if options.pop("locations", False):
        options["staypoints"] = fx.located(sp)
    return generate_tours(trips_, **{"max_dist": 1500, "max_time": "5D", **options})


@query(_tour_sql(_DIST_LINK, _DIST_CLOSE, _TOURS))
def tours_maxdist(spark, sf):
    t = _tours(spark, sf)[1]
    return t.select("id", "user_id", "started_at", "finished_at", "origin_staypoint_id", "destination_staypoint_id", F.size("trips").cast("bigint").alias("n_trips"))


@query(_tour_sql(_DIST_LINK, _DIST_CLOSE, "select p.id as trip_id, t.id as tour_id from tour t join ot p on p.user_id = t.user_id and p.n between t.na and t.nb"))
def trips_tour_link(spark, sf):
    return _tours(spark, sf)[0].where("tour_id is not null").select(F.col("id").alias("trip_id"), F.explode("tour_id").alias("tour_id"))


@query(_tour_sql("a.d_loc = b.o_loc", "a.o_loc = b.d_loc", "select t.id, t.user_id, a.started_at, b.finished_at, t.nb - t.na + 1 as n_trips, a.o_loc as location_id from tour t join ot a on a.id = t.opening join ot b on b.id = t.closing"))
def tours_location(spark, sf):
    return _tours(spark, sf, locations=True)[1].select("id", "user_id", "started_at", "finished_at", F.size("trips").cast("bigint").alias("n_trips"), "location_id")


_WITHIN = "select t.id, any_value(t.user_id) as user_id, any_value(a.started_at) as started_at, any_value(b.finished_at) as finished_at, string_agg(cast(p.id as varchar), ',' order by p.n) as trips from tour t join ot a on a.id = t.opening join ot b on b.id = t.closing join ot p on p.user_id = t.user_id and p.n between t.na and t.nb group by t.id"


@query(_gap_tour_sql(_DIST_LINK, _DIST_CLOSE, _WITHIN))
def tours_gaps(spark, sf):
    return _tours(spark, sf, max_nr_gaps=1)[1].select("id", "user_id", "started_at", "finished_at", F.concat_ws(",", "trips").alias("trips"))


@query(_tour_sql(_DIST_LINK, _DIST_CLOSE, "select t.id as tour_id, p.n - t.na as position, p.id, p.started_at from tour t join ot p on p.user_id = t.user_id and p.n between t.na and t.nb"))
def trips_grouped(spark, sf):
    t, tours = _tours(spark, sf)
    return get_trips_grouped(t, tours).select("tour_id", F.col("position").cast("bigint").alias("position"), "id", "started_at")


# -- locations ---------------------------------------------------------------------------------------------------------


def _component_sql(same_user: bool, select: str, epsilon: float = 100) -> str:
    own = "a.user_id = b.user_id and" if same_user else ""
    return with_sql(
        "sp",
        f"""
    , spr as (select * replace (round(lon, 9) as lon, round(lat, 9) as lat) from sp),
    spot as (select distinct {'user_id,' if same_user else ''} lon, lat from spr),
    pt as (select *, row_number() over (order by {'user_id,' if same_user else ''} lon, lat) as k from spot),
    edge as (select a.k as a, b.k as b from pt a join pt b on {own} abs(a.lat - b.lat) < 0.002 and abs(a.lon - b.lon) < 0.003 and {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= {epsilon}),
    reach as (select a, b from edge union select r.a, e.b from reach r join edge e on e.a = r.b),
    root as (select a as k, min(b) as c from reach group by a),
    placed_sp as (select s.*, r.c from spr s join pt p on {'p.user_id = s.user_id and' if same_user else ''} p.lon = s.lon and p.lat = s.lat join root r on r.k = p.k),
    firsts as (select c, min((user_id, t0, id)) as f from placed_sp group by c),
    numbered as (select c, row_number() over (order by f) - 1 as location_id from firsts)
    {select}""",
    )


_MEMBERS = "select p.id, n.location_id from placed_sp p join numbered n using (c)"
_CENTRES = "select user_id, location_id as id, round(x, 12) as x, round(y, 12) as y from (select distinct user_id, location_id from placed_sp join numbered using (c)) join (select location_id, degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))) as x, avg(lat) as y from (select distinct location_id, lon, lat from placed_sp join numbered using (c)) group by 1) using (location_id)"


def _locations(spark, sf, level, **options):
    # rounded, so that places that are equal but for the order of a sum are one place in either engine
    sp = fx.staypoints(spark, sf)[1].withColumn("lon", r6("lon", 9)).withColumn("lat", r6("lat", 9))
    return generate_locations(sp, agg_level=level, extent=False, **options)


@query(_component_sql(True, _MEMBERS))
def locations_user(spark, sf):
    return _locations(spark, sf, "user")[0].select("id", "location_id")


@query(_component_sql(True, _CENTRES))
def locations_user_centers(spark, sf):
    return _locations(spark, sf, "user")[1].select("user_id", "id", r6("center.x", 12).alias("x"), r6("center.y", 12).alias("y"))


@query(_component_sql(False, _MEMBERS))
def locations_dataset(spark, sf):
    return _locations(spark, sf, "dataset")[0].select("id", "location_id")


@query(_component_sql(False, _CENTRES))
def locations_dataset_centers(spark, sf):
    return _locations(spark, sf, "dataset")[1].select("user_id", "id", r6("center.x", 12).alias("x"), r6("center.y", 12).alias("y"))


@query(with_sql("sp", f"""
    , deg as (select a.id, a.user_id, count(*) as n from sp a join sp b on a.user_id = b.user_id and {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 30 group by 1, 2),
    hit as (select distinct a.id from sp a join sp b on a.user_id = b.user_id and {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 30 join deg d on d.id = b.id and d.n >= 3)
    select user_id, count(*) as n_noise from sp where id not in (select id from hit) group by user_id"""))  # fmt: skip
def locations_noise_n3(spark, sf):
    sp = generate_locations(fx.staypoints(spark, sf)[1], epsilon=30, num_samples=3, extent=False)[0]
    return sp.where("location_id is null").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_noise"))


def _noise_sql(epsilon: int, least: int) -> str:
    return with_sql("sp", f"""
    , deg as (select a.id, a.user_id, count(*) as n from sp a join sp b on a.user_id = b.user_id and {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= {epsilon} group by 1, 2),
    hit as (select distinct a.id from sp a join sp b on a.user_id = b.user_id and {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= {epsilon} join deg d on d.id = b.id and d.n >= {least})
    select id from sp where id not in (select id from hit)""")


@query(_noise_sql(6, 3))
def locations_noise_rows(spark, sf):
    """Staypoints that no dense place takes, with a reach that leaves some."""
    sp = generate_locations(fx.staypoints(spark, sf)[1], epsilon=6, num_samples=3, extent=False)[0]
    return sp.where("location_id is null").select("id")


@query()
def location_extent(spark, sf):
    """Buffered convex hulls; tests hold their corners against the points they go around."""
    locs = generate_locations(fx.staypoints(spark, sf)[1])[1]
    return locs.select("id", "user_id", F.size("extent").alias("n_corners"))


# -- analyses ----------------------------------------------------------------------------------------------------------

_SLICE = {
    "day": "select *, unnest(list_concat([t0], range((t0 // 86400000000 + 1) * 86400000000, t1, 86400000000))) as a, unnest(list_concat(range((t0 // 86400000000 + 1) * 86400000000, t1, 86400000000), [t1])) as b from {0}",
    "hour": "select * exclude (a, b), unnest(list_concat([a], range((a // 3600000000 + 1) * 3600000000, b, 3600000000))) as a, unnest(list_concat(range((a // 3600000000 + 1) * 3600000000, b, 3600000000), [b])) as b from {0}",
}
_DAYS = f", byday as ({_SLICE['day'].format('sp')})"
_HOURS = f"{_DAYS}, byhour as ({_SLICE['hour'].format('byday')})"
_AT = "make_timestamp(a)"


@query(with_sql("sp", f"{_DAYS} select id, {_AT} as started_at, make_timestamp(b) as finished_at from byday"))
def split_overlaps_day(spark, sf):
    return split_overlaps(fx.staypoints(spark, sf)[1], "day").select("id", "started_at", "finished_at")


@query(with_sql("sp", f"{_HOURS} select id, {_AT} as started_at, make_timestamp(b) as finished_at from byhour"))
def split_overlaps_hour(spark, sf):
    return split_overlaps(split_overlaps(fx.staypoints(spark, sf)[1], "day"), "hour").select("id", "started_at", "finished_at")


_QUALITY = {
    "all": "select user_id, round((sum(t1 - t0) / 1e6) / ((max(t1) - min(t0)) / 1e6), 8) as quality from sp group by user_id",
    "day": f"{_DAYS} select user_id, cast({_AT} as date) as day, round(sum(b - a) / 1e6 / 86400, 8) as quality from byday group by 1, 2",
    "week": f"{_DAYS} select user_id, cast(cast(date_trunc('week', {_AT}) as date) + 6 as date) as week_monday, round(sum(b - a) / 1e6 / 604800, 8) as quality from byday group by 1, 2",
    "weekday": f"{_DAYS} select user_id, cast(isodow({_AT}) - 1 as int) as weekday, round(sum(b - a) / 1e6 / (86400 * (max(w) - min(w) + 1)), 8) as quality from (select *, (a // 86400000000 - (select min(a // 86400000000) from byday)) // 7 as w from byday) group by 1, 2",
    "hour": f"{_HOURS} select user_id, cast(hour({_AT}) as int) as hour, round(sum(b - a) / 1e6 / (3600 * (max(d) - min(d) + 1)), 8) as quality from (select *, a // 86400000000 as d from byhour) group by 1, 2",
}


def _quality(granularity: str):
    @query(with_sql("sp", _QUALITY[granularity]), f"tracking_quality_{granularity}")
    def run(spark, sf):
        q = temporal_tracking_quality(fx.staypoints(spark, sf)[1], granularity)
        return q.withColumn("quality", r6("quality", 8))


for _g in _QUALITY:
    _quality(_g)

_LABELLED = f", labelled as (select p.*, l.length, {MODE_SQL} as mode from tpl p join lengths l on l.tripleg_id = p.id)"
_NAMES = sorted(MODES.values())


def _split(name: str, value: str, key: str | None, digits: int, norm: bool = False, **options):
    cell = lambda m: f"coalesce(sum({value}) filter (mode = '{m}'), 0)"
    total = "(" + " + ".join(cell(m) for m in _NAMES) + ")"
    cols = ", ".join(f"round(cast({cell(m)}{' / ' + total if norm else ''} as double), {digits}) as {m}" for m in _NAMES)
    keys = f"{key}, " if key else ""
    group = " group by all" if key else ""

    @query(with_sql("tpl", f"{_LABELLED} select {keys}{cols} from labelled{group}"), name)
    def run(spark, sf):
        tpls = labelling.predict_transport_mode(fx.triplegs(spark, sf)[2], categories=MODES)
        out = calculate_modal_split(tpls, norm=norm, modes=_NAMES, **options)
        return out.select(*[c for c in out.columns if c not in _NAMES], *(F.round(F.col(m).cast("double"), digits).alias(m) for m in _NAMES))


_split("modal_split_count", "1", None, 0, metric="count")
_split("modal_split_distance", "length", "user_id", 3, metric="distance", per_user=True)
_split("modal_split_duration", "(tb - ta) / 1e6", "user_id", 3, metric="duration", per_user=True)
_split("modal_split_daily", "1", "date_trunc('day', started_at) as timestamp", 0, freq="D")


@query(with_sql("tpl", _LABELLED + " select user_id, cast(cast(date_trunc('week', cast(started_at as date) - 1) as date) + 7 as timestamp) as timestamp, " + ", ".join(f"round(coalesce(sum(length) filter (mode = '{m}'), 0) / sum(length), 8) as {m}" for m in _NAMES) + " from labelled group by 1, 2"))
def modal_split_weekly_norm(spark, sf):
    tpls = labelling.predict_transport_mode(fx.triplegs(spark, sf)[2], categories=MODES)
    out = calculate_modal_split(tpls, freq="W-MON", metric="distance", per_user=True, norm=True, modes=_NAMES)
    return out.select("user_id", "timestamp", *(r6(m, 8).alias(m) for m in _NAMES))


_FILTER = {"thresh_sp": 15, "thresh_loc": 3, "thresh_sp_at_loc": 5, "thresh_loc_time": "24h", "thresh_loc_period": "5D"}


def _filter_sql(level: str) -> str:
    by = "user_id, location_id" if level == "user" else "location_id"
    return f"""
    , here as (select *, {LOC} as location_id from sp), u as (select user_id, count(distinct started_at) >= 15 and count(distinct location_id) >= 3 as ok from here group by 1),
    l as (select {by}, count(*) >= 5 and sum(t1 - t0) >= 86400000000 and max(t1) - min(t0) >= 432000000000 as ok from here group by {by}),
    filtered as (select here.*, u.ok and l.ok as keep from here join u using (user_id) join l using ({by}))"""


@query(with_sql("sp", _filter_sql("user") + " select id, keep from filtered"))
def prefilter_user(spark, sf):
    return identify.pre_filter_locations(fx.located(fx.staypoints(spark, sf)[1]), **_FILTER).select("id", "keep")


@query(with_sql("sp", _filter_sql("dataset") + " select id, keep from filtered"))
def prefilter_dataset(spark, sf):
    return identify.pre_filter_locations(fx.located(fx.staypoints(spark, sf)[1]), agg_level="dataset", **_FILTER).select("id", "keep")


@query(with_sql("sp", _filter_sql("user") + """
    , ranked as (select user_id, location_id, row_number() over (partition by user_id order by sum(t1 - t0) desc, location_id) as r from filtered where keep group by 1, 2)
    select f.id, case when f.keep then case r.r when 1 then 'home' when 2 then 'work' end end as purpose from filtered f left join ranked r using (user_id, location_id)"""))  # fmt: skip
def identify_freq(spark, sf):
    return identify.location_identifier(fx.located(fx.staypoints(spark, sf)[1]), "FREQ", **_FILTER).select("id", "purpose")


@query(with_sql("sp", f"""
    , here as (select *, {LOC} as location_id, make_timestamp(t0 + (t1 - t0) // 2) as mid from sp),
    timed as (select *, case when isodow(mid) <= 5 and hour(mid) between 2 and 7 then (t1 - t0) * cast(0.739 as double) when isodow(mid) <= 5 and (hour(mid) < 2 or hour(mid) >= 19) then (t1 - t0) * cast(0.358 as double) end as h, case when isodow(mid) <= 5 and hour(mid) between 8 and 18 then cast(t1 - t0 as double) end as w from here),
    sums as (select user_id, location_id, sum(h) as h, sum(w) as w from timed group by 1, 2),
    homes as (select *, h is not null and row_number() over (partition by user_id order by coalesce(h, 0) desc, location_id) = 1 as home from sums),
    works as (select *, case when home then null else w end as w2 from homes),
    named as (select user_id, location_id, case when home then 'home' when w2 is not null and row_number() over (partition by user_id order by coalesce(w2, 0) desc, location_id) = 1 then 'work' end as purpose from works)
    select here.id, named.purpose from here left join named using (user_id, location_id)"""))  # fmt: skip
def identify_osna(spark, sf):
    return identify.location_identifier(fx.located(fx.staypoints(spark, sf)[1]), "OSNA", pre_filter=False).select("id", "purpose")


# -- space and time ----------------------------------------------------------------------------------------------------


_PLACES = ", places as materialized (select row_number() over (order by lon, lat) as id, lon, lat from (select distinct lon, lat from pfs))"


def _places(spark, sf):
    """All different places of the fixture, which are a few dozen whatever the number of fixes."""
    spots = fx.positionfixes(spark, sf).select("lon", "lat").distinct()
    return spots.withColumn("id", F.row_number().over(Window.orderBy("lon", "lat")).cast("bigint"))


@query(with_sql("pfs", f"{_PLACES} select a.id as i, b.id as j, round({hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 4) as distance from places a, places b"))
def distance_matrix_haversine(spark, sf):
    return distance_matrix(_places(spark, sf)).select("i", "j", r6("distance", 4).alias("distance"))


@query(with_sql("pfs", f"{_PLACES} select a.id as i, b.id as j, round(sqrt((b.lon - a.lon) * (b.lon - a.lon) + (b.lat - a.lat) * (b.lat - a.lat)), 9) as distance from places a, places b"))
def distance_matrix_euclidean(spark, sf):
    return distance_matrix(_places(spark, sf), dist_metric="euclidean").select("i", "j", r6("distance", 9).alias("distance"))


def _user_centres(spark, sf):
    """One row for each user: the mean of all its fixes, whose coordinates are whole ten-thousandths of a degree, so that sums are exact in any order."""
    mean = lambda c: F.sum(F.round(F.col(c) * 10000).cast("bigint")) / (F.count(F.lit(1)) * 10000)
    return fx.positionfixes(spark, sf).groupBy(F.col("user_id").alias("id")).agg(mean("lon").alias("lon"), mean("lat").alias("lat"))


@query()
def distance_matrix_haversine_users(spark, sf):
    """All users against all. No SQL: near 1, the last bit of a cosine moves the arc by centimetres; a test holds it against plain loops."""
    return distance_matrix(_user_centres(spark, sf)).select("i", "j", r6("distance", 4).alias("distance"))


@query(with_sql("pfs", """
    , centres as (select user_id as id, cast(sum(cast(round(lon * 10000) as bigint)) as double) / (count(*) * 10000) as lon, cast(sum(cast(round(lat * 10000) as bigint)) as double) / (count(*) * 10000) as lat from pfs group by 1)
    select a.id as i, b.id as j, round(sqrt((b.lon - a.lon) * (b.lon - a.lon) + (b.lat - a.lat) * (b.lat - a.lat)), 9) as distance from centres a, centres b"""))  # fmt: skip
def distance_matrix_euclidean_users(spark, sf):
    """All users against all."""
    return distance_matrix(_user_centres(spark, sf), dist_metric="euclidean").select("i", "j", r6("distance", 9).alias("distance"))


def _lines(metric: str):
    @query(None, f"distance_matrix_{metric}")
    def run(spark, sf):
        """Dynamic programmes over two lines; tests hold them against plain recursion."""
        return distance_matrix(fx.triplegs(spark, sf)[2], dist_metric=metric).select("i", "j", r6("distance", 9).alias("distance"))


_lines("dtw")
_lines("frechet")

#: A convex polygon, counter-clockwise and closed, whose edges miss the fixture's points.
AREA = [(8.50505, 47.29005), (8.52555, 47.29505), (8.53505, 47.31555), (8.51505, 47.32505), (8.50005, 47.31005), (8.50505, 47.29005)]
_SIDES = " and ".join(f"({x2 - x1!r}) * (lat - {y1}) - ({y2 - y1!r}) * (lon - {x1}) > 0" for (x1, y1), (x2, y2) in zip(AREA[:-1], AREA[1:], strict=True))


def _filtered(method: str):
    @query(with_sql("pfs", f"select id from pfs where {_SIDES}"), f"spatial_filter_{method}")
    def run(spark, sf):
        return spatial_filter(fx.positionfixes(spark, sf), [[AREA]], method).select("id")


_filtered("within")
_filtered("intersects")


@query(with_sql("tpl", f"select tripleg_id as id from tpfs where tripleg_id is not null group by 1 having bool_and({_SIDES})"))
def spatial_filter_lines_within(spark, sf):
    """A line between points of a convex area stays in it."""
    return spatial_filter(fx.triplegs(spark, sf)[2], [[AREA]], "within").select("id")


def _clipped() -> str:
    """Whether a step from (x0, y0) to (lon, lat) runs through the inside of the convex area: what its edges leave of it."""
    side = lambda x, y: [f"(({x2 - x1!r}) * ({y} - {y1}) - ({y2 - y1!r}) * ({x} - {x1}))" for (x1, y1), (x2, y2) in zip(AREA[:-1], AREA[1:], strict=True)]
    ends = list(zip(side("x0", "y0"), side("lon", "lat"), strict=True))
    low = ", ".join(f"case when {q} > {p} then -{p} / ({q} - {p}) else 0 end" for p, q in ends)
    high = ", ".join(f"case when {q} < {p} then {p} / ({p} - {q}) else 1 end" for p, q in ends)
    flat = " and ".join(f"({q} <> {p} or {p} > 0)" for p, q in ends)
    return f"(greatest(0, {low}) < least(1, {high}) and {flat})"


@query(with_sql("tpl", f"select tripleg_id as id from legs group by 1 having bool_or(x0 is not null and {_clipped()}) and not bool_and({_SIDES})"))
def spatial_filter_crosses(spark, sf):
    return spatial_filter(fx.triplegs(spark, sf)[2], [[AREA]], "crosses").select("id")


_LABELS = "labels_of as (select event_id as id, user_id, event_type as mode, epoch_us(ts) - 40000000000 as b0, epoch_us(ts) + 40000000000 as b1 from events)"


@query(with_sql("tpl", f"""
    , {_LABELS}, cand as (select p.id, l.id as label_id, l.mode, l.b0, l.b1, p.ta, p.tb, greatest(abs(p.ta // 1000000 - l.b0 // 1000000), abs(p.tb // 1000000 - l.b1 // 1000000)) as gap from tpl p join labels_of l using (user_id)),
    top as (select *, row_number() over (partition by label_id order by gap, id) as k from cand where gap <= 604800),
    scored as (select *, greatest(0, least(tb, b1) - greatest(ta, b0)) / (tb - ta) as ratio from top where k <= 20),
    best as (select id, arg_max(label_id, (ratio, label_id)) as label_id, arg_max(mode, (ratio, label_id)) as mode from scored where ratio >= 0.5 group by id)
    select p.id, b.label_id, b.mode from tpl p left join best b using (id)"""))  # fmt: skip
def temp_overlap_label_join(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    labels = events.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("mode"), F.expr("ts - interval 40000 seconds").alias("started_at"), F.expr("ts + interval 40000 seconds").alias("finished_at"))
    return add_modes_to_triplegs(fx.triplegs(spark, sf)[2], labels).select("id", "label_id", "mode")


from wayfarer.plans import catalog_io  # noqa: E402, F401  (adds its queries)
