"""Positionfixes derived from the events table, the same in Spark and in SQL, and thresholds that suit them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.functions.labelling import create_activity_flag
from wayfarer.operators.staypoints import generate_staypoints
from wayfarer.operators.triplegs import generate_triplegs

DIST, TIME, GAP = 100, 720, 2880  #: metres, minutes, minutes


def positionfixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place for each user and day, and a small shift for each event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value")
    day = F.expr("unix_micros(cast(ts as timestamp)) div 86400000000")
    place = F.pmod(F.col("user_id") + day * day, F.lit(4))
    return events.select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("tracked_at"), F.col("value").alias("elevation"),
        (F.lit(8.5) + F.lit(0.01) * place + F.lit(0.0001) * (F.col("event_id") % 5)).alias("lon"),
        (F.lit(47.3) + F.lit(0.01) * ((place * place) % 3) + F.lit(0.0001) * (F.col("event_id") % 3)).alias("lat"),
    )


def staypoints(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, DataFrame]:
    return generate_staypoints(positionfixes(spark, sf_dir), **{"dist_threshold": DIST, "time_threshold": TIME, "gap_threshold": GAP, **options})


def triplegs(spark: SparkSession, sf_dir: str, method: str = "between_staypoints") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(positionfixes, staypoints with is_activity, triplegs)."""
    pfs, sp = staypoints(spark, sf_dir)
    pfs, tpls = generate_triplegs(pfs, sp, method, GAP)
    return pfs, create_activity_flag(sp, time_threshold=1440.0), tpls


def located(sp: DataFrame) -> DataFrame:
    """A location for each staypoint: its place on a grid of a hundredth of a degree, for what only needs some location."""
    return sp.withColumn("location_id", (F.floor(F.col("lon") * 100 + 0.1) * 100000 + F.floor(F.col("lat") * 100 + 0.1)).cast("bigint"))


# -- the same in SQL ---------------------------------------------------------------------------------------------------


def hav(x1: str, y1: str, x2: str, y2: str) -> str:
    return (
        f"(case when {x1} is null or {y1} is null or {x2} is null or {y2} is null then null else 6371000.0 * acos(least(1.0, greatest(-1.0, "
        f"cos(radians({y2}) - radians({y1})) - cos(radians({y1})) * cos(radians({y2})) * (1.0 - cos(radians({x2}) - radians({x1})))))) end)"
    )


PFS = """
    days as (select event_id, user_id, ts, value, epoch_us(ts) // 86400000000 as day from events),
    placed as (select *, (user_id + day * day) % 4 as place from days),
    pfs as (
        select event_id as id, user_id, ts as tracked_at, value as elevation, epoch_us(ts) as t,
            cast(8.5 as double) + cast(0.01 as double) * place + cast(0.0001 as double) * (event_id % 5) as lon,
            cast(47.3 as double) + cast(0.01 as double) * ((place * place) % 3) + cast(0.0001 as double) * (event_id % 3) as lat
        from placed)"""

SP = f"""
    rows as materialized (select *, row_number() over (partition by user_id order by t, id) as rn from pfs),
    walk as (
        select user_id, rn, rn as start, cast(null as bigint) as e_first from rows where rn = 1
        union all
        select c.user_id, c.rn,
            case when c.t - p.t > {GAP * 60_000_000} or {hav('s.lon', 's.lat', 'c.lon', 'c.lat')} >= {DIST} then c.rn else w.start end,
            case when c.t - p.t <= {GAP * 60_000_000} and {hav('s.lon', 's.lat', 'c.lon', 'c.lat')} >= {DIST} and c.t - s.t >= {TIME * 60_000_000} then w.start end
        from walk w join rows c on c.user_id = w.user_id and c.rn = w.rn + 1 join rows p on p.user_id = w.user_id and p.rn = w.rn join rows s on s.user_id = w.user_id and s.rn = w.start),
    stays as materialized (select user_id, e_first as f, rn - 1 as l, rn as nxt from walk where e_first is not null),
    sp0 as materialized (select s.user_id, s.f, s.l, a.tracked_at as started_at, b.tracked_at as finished_at, row_number() over (order by s.user_id, a.t, s.f) - 1 as id
        from stays s join rows a on a.user_id = s.user_id and a.rn = s.f join rows b on b.user_id = s.user_id and b.rn = s.nxt),
    member as materialized (select r.*, s.id as staypoint_id from rows r left join sp0 s on s.user_id = r.user_id and r.rn between s.f and s.l),
    spots as (select distinct staypoint_id, lon, lat from member where staypoint_id is not null),
    mids as materialized (select staypoint_id, degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))) as lon, avg(lat) as lat from spots group by 1),
    sp as materialized (select s.id, s.user_id, s.started_at, s.finished_at, e.elevation, m.lon, m.lat, epoch_us(s.started_at) as t0, epoch_us(s.finished_at) as t1
        from sp0 s join mids m on m.staypoint_id = s.id join (select staypoint_id, median(elevation) as elevation from member group by 1) e on e.staypoint_id = s.id)"""

TPL = f"""
    marked as (select *, staypoint_id is null and (lag(id) over w is null or t - lag(t) over w > {GAP * 60_000_000} or lag(staypoint_id) over w is not null) as starts from member window w as (partition by user_id order by t, id)),
    runs as (select *, case when staypoint_id is null then sum(cast(starts as int)) over (partition by user_id order by t, id) end as run from marked),
    sized as materialized (select *, case when run is not null then count(*) over (partition by user_id, run) end as n from runs),
    tpl0 as (select user_id, run, min(t) as ta, max(t) as tb, min(tracked_at) as started_at, max(tracked_at) as finished_at, count(*) as n_points, count(distinct {{'x': lon, 'y': lat}}) as n_spots,
        row_number() over (order by user_id, min(t)) - 1 as id from sized where n >= 2 group by user_id, run),
    tpl as materialized (select * from tpl0 where n_spots >= 2),
    tpfs as materialized (select z.*, p.id as tripleg_id from sized z left join tpl p on p.user_id = z.user_id and p.run = z.run and z.n >= 2),
    legs as materialized (select tripleg_id, t, id, lon, lat, lag(lon) over w as x0, lag(lat) over w as y0, t - lag(t) over w as dt from tpfs where tripleg_id is not null window w as (partition by tripleg_id order by t, id)),
    lengths as materialized (select tripleg_id, sum({hav('x0', 'y0', 'lon', 'lat')}) as length, avg({hav('x0', 'y0', 'lon', 'lat')} / (dt / 1e6)) as pf_speed from legs group by 1)"""


def with_sql(parts: str, select: str) -> str:
    """parts: names of the steps above, in order."""
    chain = {"pfs": [PFS], "sp": [PFS, SP], "tpl": [PFS, SP, TPL]}[parts]
    return "with recursive" + ",".join(chain) + "\n" + select


LOC = "cast(floor(lon * 100 + 0.1) * 100000 + floor(lat * 100 + 0.1) as bigint)"
