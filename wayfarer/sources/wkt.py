"""Well-known text and binary of the geometry columns."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def parse_point(text: Column) -> Column:
    """A point struct from POINT (x y); null if it is none."""
    part = lambda k: F.regexp_extract(text, rf"(?i)POINT\s*(?:Z\s*)?\(\s*({_NUMBER})\s+({_NUMBER})", k)
    return F.when(part(1) != "", F.struct(part(1).cast("double").alias("x"), part(2).cast("double").alias("y")))


def parse_points(text: Column) -> Column:
    """The points, in order, of a LINESTRING, MULTIPOINT, or of the outer ring of a POLYGON."""
    ring = F.regexp_extract(text, r"\(+([^()]*(?:\)\s*,\s*\([^()]*)*)", 1)
    ring = F.when(F.upper(F.ltrim(text)).startswith("POLYGON"), F.regexp_extract(text, r"\(+([^()]*)", 1)).otherwise(F.regexp_replace(ring, r"[()]", ""))
    pairs = F.filter(F.split(ring, ","), lambda p: F.trim(p) != "")
    xy = lambda p, k: F.element_at(F.split(F.trim(p), r"\s+"), k).cast("double")
    return F.when(text.isNotNull(), F.transform(pairs, lambda p: F.struct(xy(p, 1).alias("x"), xy(p, 2).alias("y"))))


def _pairs(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")


def format_point(point: Column) -> Column:
    return F.when(point.isNotNull(), F.concat(F.lit("POINT ("), F.concat_ws(" ", point["x"].cast("string"), point["y"].cast("string")), F.lit(")")))


def format_line(points: Column) -> Column:
    return F.when(points.isNotNull(), F.concat(F.lit("LINESTRING ("), _pairs(points), F.lit(")")))


def format_polygon(ring: Column) -> Column:
    return F.when(ring.isNotNull(), F.concat(F.lit("POLYGON (("), _pairs(ring), F.lit("))")))


def format_multipoint(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("MULTIPOINT ("), _pairs(F.array(start, end)), F.lit(")")))


def from_wkb(data: bytes | None) -> list[tuple[float, float]] | None:
    """The points of a WKB or EWKB point, line, polygon's outer ring, or several points."""
    if data is None:
        return None
    order = "<" if data[0] == 1 else ">"
    (kind,) = struct.unpack_from(f"{order}I", data, 1)
    at = 9 if kind & 0x20000000 else 5
    kind &= 0xFF
    if kind == 1:
        return [struct.unpack_from(f"{order}2d", data, at)]
    (n,) = struct.unpack_from(f"{order}I", data, at)
    at += 4
    if kind == 3:
        (n,) = struct.unpack_from(f"{order}I", data, at)
        at += 4
    if kind == 4:  # each point is a geometry of its own
        return [from_wkb(data[at + 21 * k : at + 21 * (k + 1)])[0] for k in range(n)]
    if kind not in (2, 3):
        raise ValueError(f"geometry type {kind} isn't read")
    return [struct.unpack_from(f"{order}2d", data, at + 16 * k) for k in range(n)]


def to_wkb(points: list[tuple[float, float]], kind: int, srid: int | None = None) -> bytes:
    """EWKB of a point (1), line (2), polygon of one ring (3) or several points (4)."""
    if kind == 4:
        return struct.pack("<BI", 1, 4 | (0x20000000 if srid else 0)) + (struct.pack("<I", srid) if srid else b"") + struct.pack("<I", len(points)) + b"".join(to_wkb([p], 1) for p in points)
    head = struct.pack("<BI", 1, kind | (0x20000000 if srid else 0)) + (struct.pack("<I", srid) if srid else b"")
    count = b"" if kind == 1 else struct.pack("<I", len(points)) if kind == 2 else struct.pack("<II", 1, len(points))
    return head + count + b"".join(struct.pack("<2d", *p) for p in points)


_POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


@F.pandas_udf(_POINTS)
def wkb_points(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else [{"x": x, "y": y} for x, y in from_wkb(bytes(b))])


def points_wkb(kind: int, srid: int | None = None):
    """A function that makes (E)WKB of a column of points (kind 1, a struct) or of arrays of points (2 a line, 3 a polygon's ring, 4 several
    points)."""

    @F.pandas_udf("binary")
    def lines(data: pd.Series) -> pd.Series:
        return data.map(lambda ps: None if ps is None else to_wkb([(p["x"], p["y"]) for p in ps], kind, srid))

    return (lambda c: lines(F.when(c.isNotNull(), F.array(c)))) if kind == 1 else lines
