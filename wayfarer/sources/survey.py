"""The Swiss travel survey: zipped csv tables of trips (wege), stages (etappen), people and checkpoints, and a shapefile of routes.

A survey is a few archives of bounded size (its households), so archives are opened on the driver; what is made of their tables is
Spark's."""

from __future__ import annotations

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfarer.operators.ids import dense_ids

#: Fixed by the survey: encoding, the mark of a missing checkpoint, how many there are, and what its columns are called here.
ENCODING, MISSING, CHECKPOINTS = "latin1", -997, 6
NAMES = {"HHNR": "user_id", "f51100time": "started_at", "f51400time": "finished_at"}
_LINE = "array<struct<x:double,y:double>>"


def _archive(spark: SparkSession, path: str, name: str) -> zipfile.ZipFile:
    """The one archive of a name below a folder, in any store; folders may be part of the file's name, as the survey's are."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{name}").load(path).select("content").take(1)
    if not found:
        raise FileNotFoundError(f"{name} below {path}")
    return zipfile.ZipFile(io.BytesIO(found[0]["content"]))


def _table(spark: SparkSession, archive: zipfile.ZipFile, name: str) -> DataFrame:
    with archive.open(name) as f:
        rows = pd.read_csv(f, encoding=ENCODING).rename(columns=NAMES)
    rows.insert(0, "_row", range(len(rows)))
    return spark.createDataFrame(rows.astype(object).where(rows.notna(), None), _schema(rows))


def _schema(rows: pd.DataFrame) -> str:
    kind = lambda k: "bigint" if k.kind in "iu" else "double" if k.kind == "f" else "boolean" if k.kind == "b" else "string"
    return ", ".join(f"`{c}` {kind(k)}" for c, k in rows.dtypes.items())


def _shapes(archive: zipfile.ZipFile) -> pd.DataFrame:
    """The records of a shapefile of lines: its fields, and geom, the points of all parts of a line (None where it has none)."""
    member = {n.rpartition(".")[2].lower(): n for n in archive.namelist()}
    dbf, shp = archive.read(member["dbf"]), archive.read(member["shp"])
    n, head, width = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 1
    for k in range(32, head - 1, 32):
        fields.append((dbf[k : k + 11].split(b"\0")[0].decode(), chr(dbf[k + 11]), at, dbf[k + 16]))
        at += dbf[k + 16]

    def value(record: bytes, kind: str, at: int, size: int):
        text = record[at : at + size].decode(ENCODING).strip()
        return (None if not text else float(text) if "." in text else int(text)) if kind in "NF" else text

    rows = [{name: value(dbf[head + k * width : head + (k + 1) * width], kind, at, size) for name, kind, at, size in fields} for k in range(n)]
    at = 100
    for row in rows:
        size = struct.unpack_from(">I", shp, at + 4)[0] * 2
        body = shp[at + 8 : at + 8 + size]
        at += 8 + size
        if struct.unpack_from("<I", body)[0] % 10 != 3:
            row["geom"] = None
            continue
        parts, points = struct.unpack_from("<II", body, 36)
        row["geom"] = [dict(zip("xy", struct.unpack_from("<2d", body, 44 + 4 * parts + 16 * k), strict=True)) for k in range(points)]
    return pd.DataFrame(rows)


def clock(column: str) -> Column:
    """A time of day on 1970-01-01; 24:00:00 is the day's last second."""
    part = lambda k: F.split(column, ":").getItem(k).cast("bigint")
    return F.timestamp_seconds(F.least(part(0) * 3600 + part(1) * 60 + part(2), F.lit(86_399)))


def _timed(df: DataFrame) -> DataFrame:
    """Times of day as instants; what ends before it starts ends on the next day."""
    df = df.withColumn("started_at", clock("started_at")).withColumn("finished_at", clock("finished_at"))
    return df.withColumn("finished_at", F.when(F.col("finished_at") < F.col("started_at"), F.col("finished_at") + F.expr("interval 1 day")).otherwise(F.col("finished_at")))


def _lines(points: DataFrame, x: str, y: str) -> Column:
    """The line through a group's points in order; none if a coordinate is missing or there are no two different points."""
    line = F.transform(F.sort_array(F.collect_list(F.struct("_k", F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("p")))), lambda r: r["p"])
    return F.when(F.forall(line, lambda p: p["x"].isNotNull() & p["y"].isNotNull()) & (F.size(F.array_distinct(line)) >= 2), line)


def checkpoints(vp: DataFrame, tpls: DataFrame) -> DataFrame:
    """(user_id, ETNR, VP_XY, VP_XY_CH1903): the line from a stage's start over its checkpoints to its end."""
    axes = ("X", "Y", "X_CH1903", "Y_CH1903")
    known = lambda c: F.when(F.col(c) != MISSING, F.col(c).cast("double"))
    ends = [tpls.select("user_id", "ETNR", F.lit(k).alias("_k"), *(F.col(f"{e}_{a}").cast("double").alias(a) for a in axes)) for e, k in (("S", 0), ("Z", CHECKPOINTS + 1))]
    some = F.explode(F.array(*(F.struct(F.lit(k).alias("_k"), *(known(f"R{k}_{a}").alias(a) for a in axes)) for k in range(1, CHECKPOINTS + 1))))
    middle = vp.select("user_id", "ETNR", some.alias("r")).select("user_id", "ETNR", "r.*").where(F.coalesce(*axes).isNotNull())
    points = ends[0].unionByName(middle).unionByName(ends[1])
    return points.groupBy("user_id", "ETNR").agg(_lines(points, "X", "Y").alias("VP_XY"), _lines(points, "X_CH1903", "Y_CH1903").alias("VP_XY_CH1903"))


def stays(tpls: DataFrame, people: DataFrame) -> DataFrame:
    """Staypoints: where each stage starts, and where a person's last one ends. A start is an activity where a trip begins; it lasts
    from the stage before. Purpose is home where a stay has the home's coordinates, else work where it has those of work or school."""
    w = Window.partitionBy("user_id").orderBy("ETNR")
    before = lambda c: F.lag(c).over(w)
    act = ~F.col("WEGNR").eqNullSafe(before("WEGNR")) | before("ETNR").isNull()
    shared = [c[2:] for c in tpls.columns if c.startswith("S_") and f"Z_{c[2:]}" in tpls.columns]
    own = ["user_id", "WEGNR", "ETNR", "W_X_CH1903", "W_Y_CH1903"]
    starts = tpls.withColumn("is_activity", act).withColumn("_before", before("trip_id")).withColumn("_left", before("finished_at")).withColumn("_why", before("f52900")).select(
        *own, *(F.col(f"S_{c}").alias(c) for c in shared), "is_activity", F.coalesce("_left", "started_at").alias("started_at"), F.col("started_at").alias("finished_at"),
        F.when(F.col("is_activity"), F.col("_before")).alias("prev_trip_id"), F.when(F.col("is_activity"), F.col("trip_id")).alias("next_trip_id"), F.when(~F.col("is_activity"), F.col("trip_id")).alias("trip_id"), F.col("_why").alias("purpose_tpls"),
    )
    last = tpls.withColumn("_last", F.lead("ETNR").over(w).isNull()).where("_last")
    ends = last.select(*own, *(F.col(f"Z_{c}").alias(c) for c in shared), F.lit(True).alias("is_activity"), F.col("finished_at").alias("started_at"), F.col("trip_id").alias("prev_trip_id"), F.col("f52900").alias("purpose_tpls"))
    n = starts.agg(F.count(F.lit(1)).alias("_n"))  # one row
    ends = dense_ids(ends, ["ETNR"]).join(F.broadcast(n)).withColumn("id", F.col("id") + F.col("_n")).drop("_n")
    sp = dense_ids(starts, ["ETNR"]).unionByName(ends, allowMissingColumns=True)
    sp = sp.join(people.select("user_id", "A_X_CH1903", "A_Y_CH1903", "AU_X_CH1903", "AU_Y_CH1903"), "user_id", "left")
    at = lambda p: (F.col(f"{p}_X_CH1903") == F.col("X_CH1903")) & (F.col(f"{p}_Y_CH1903") == F.col("Y_CH1903"))
    point = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    sp = sp.withColumn("purpose", F.when(at("W"), "home").when(at("A") | at("AU"), "work"))
    return sp.withColumn("XY_CH1903", point("X_CH1903", "Y_CH1903")).withColumn("lon", F.col("X").cast("double")).withColumn("lat", F.col("Y").cast("double"))


def read_mzmv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trips, staypoints, triplegs) of a survey's folder. Triplegs have geom, the routed line where there is one, and VP_XY and
    VP_XY_CH1903, the line over the checkpoints."""
    tables = _archive(spark, path, "CH_CSV.zip")
    trips = _timed(_table(spark, tables, "wege.csv").withColumnRenamed("_row", "id"))
    tpls = _timed(_table(spark, tables, "etappen.csv").withColumnRenamed("_row", "id")).join(trips.select("user_id", "WEGNR", F.col("id").alias("trip_id")), ["user_id", "WEGNR"])
    sp = stays(tpls, _table(spark, tables, "zielpersonen.csv"))
    routes = _shapes(_archive(spark, path, "CH_routen.zip"))[["HHNR", "ETNR", "geom"]]
    routes = spark.createDataFrame(routes.to_dict("records"), f"HHNR bigint, ETNR bigint, geom {_LINE}").withColumnRenamed("HHNR", "user_id")
    routes = routes.withColumn("geom", F.when(F.size(F.array_distinct("geom")) >= 2, F.col("geom")))
    tpls = tpls.join(routes, ["user_id", "ETNR"], "left").join(checkpoints(_table(spark, tables, "verifikationspunkte.csv"), tpls), ["user_id", "ETNR"], "left")
    to, origin = (sp.where(F.col(f"{k}_trip_id").isNotNull()).select(F.col(f"{k}_trip_id").alias("id"), F.col("id").alias(f"{e}_staypoint_id")) for k, e in (("prev", "destination"), ("next", "origin")))
    return trips.join(to, "id").join(origin, "id"), sp, tpls
