"""Maps and modal splits as SVG files, without a plotting library.

A map has width x height cells. Points, and lines in steps of a cell, are counted by cell in Spark, so what comes to the driver is a
row for each cell that holds something, whatever the number of fixes. A modal split is drawn from one row for each period."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Colours of layers, and of modes in order.
LAYERS = {"positionfixes": "#5b8def", "triplegs": "#8a6fd1", "staypoints": "#e0803a", "locations": "#3a9a6e"}
COLOURS = ("#4c78a8", "#f58518", "#54a24b", "#e45756", "#72b7b2", "#b279a2", "#9d755d", "#bab0ac")


def save_fig(svg: str, path: str) -> None:
    """Writes a figure to a file, in any store that pyarrow reaches; a path without a scheme is local."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_output_stream(at) as f:
        f.write(svg.encode())


def _figure(width: int, height: int, body: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" width="{width}" height="{height}" font-family="sans-serif" font-size="11"><rect width="100%" height="100%" fill="white"/>{"".join(body)}</svg>'


def _spots(name: str, df: DataFrame) -> DataFrame:
    """The points (x, y) of a layer; lines keep theirs in an array."""
    if name == "triplegs":
        return df.select(F.col("geom").alias("line"))
    if name == "locations":
        return df.select(F.col("center.x").alias("x"), F.col("center.y").alias("y"))
    return df.select(F.col("lon").alias("x"), F.col("lat").alias("y"))


def calculate_bounds(layers: dict[str, DataFrame]) -> tuple[float, float, float, float]:
    """(west, east, south, north) of all layers."""
    ends = None
    for name, df in layers.items():
        pts = _spots(name, df)
        pts = pts.select(F.explode("line").alias("p")).select("p.*") if name == "triplegs" else pts
        own = pts.agg(F.min("x").alias("w"), F.max("x").alias("e"), F.min("y").alias("s"), F.max("y").alias("n"))  # one row
        ends = own if ends is None else ends.union(own)
    west, east, south, north = ends.agg(F.min("w"), F.max("e"), F.min("s"), F.max("n")).first()
    if west is None:
        raise ValueError("nothing to plot")
    return west, east, south, north


def _cells(name: str, df: DataFrame, bounds: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """(cx, cy, n): how many points, or steps of lines, each cell of the map holds."""
    west, east, south, north = bounds
    to = lambda c, low, high, size: (c - low) / ((high - low) or 1.0) * (size - 1)
    x, y = lambda c: to(c, west, east, width), lambda c: to(c, south, north, height)
    spots = _spots(name, df)
    if name == "triplegs":
        n = F.size("line")
        pairs = spots.select(F.explode(F.arrays_zip(F.slice("line", F.lit(1), n - 1).alias("a"), F.slice("line", F.lit(2), n - 1).alias("b"))).alias("s")).select("s.a", "s.b")
        ends = pairs.select(x(F.col("a.x")).alias("x0"), y(F.col("a.y")).alias("y0"), x(F.col("b.x")).alias("x1"), y(F.col("b.y")).alias("y1"))
        steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))))).cast("int")
        walk = ends.withColumn("k", steps).select("*", F.explode(F.sequence(F.lit(0), "k")).alias("j"))
        part: Column = F.col("j") / F.col("k")
        at = walk.select((F.col("x0") + (F.col("x1") - F.col("x0")) * part).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * part).alias("y"))
    else:
        at = spots.select(x(F.col("x")).alias("x"), y(F.col("y")).alias("y"))
    at = at.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    return at.groupBy(F.round("x").cast("int").alias("cx"), F.round("y").cast("int").alias("cy")).agg(F.count(F.lit(1)).alias("n"))


def plot(filename: str | None = None, positionfixes: DataFrame | None = None, triplegs: DataFrame | None = None, staypoints: DataFrame | None = None, locations: DataFrame | None = None, bounds: tuple[float, float, float, float] | None = None, width: int = 800, height: int = 600) -> str:
    """A map of the given tables, as SVG; written to filename if there is one. Fuller cells are darker."""
    layers = {k: v for k, v in {"positionfixes": positionfixes, "triplegs": triplegs, "staypoints": staypoints, "locations": locations}.items() if v is not None}
    if not layers:
        raise ValueError("nothing to plot")
    bounds = bounds or calculate_bounds(layers)
    body = []
    for name, df in layers.items():
        cells = _cells(name, df, bounds, width, height).collect()  # width * height rows at most
        most = max((r["n"] for r in cells), default=1)
        size = {"staypoints": 4, "locations": 6}.get(name, 1.2)
        marks = [f'<circle cx="{r["cx"]}" cy="{height - 1 - r["cy"]}" r="{size}" fill-opacity="{0.35 + 0.65 * r["n"] / most:.2f}"/>' for r in sorted(cells)]
        body.append(f'<g id="{name}" fill="{LAYERS[name]}">{"".join(marks)}</g>')
    svg = _figure(width, height, body)
    if filename:
        save_fig(svg, filename)
    return svg


def plot_modal_split(split: DataFrame, out_path: str | None = None, date_fmt: str = "%Y-%m-%d", title: str | None = None, x_label: str | None = None, y_label: str | None = None, width: int = 800, height: int = 400) -> str:
    """Stacked bars of a modal split over periods (calculate_modal_split with freq and not per user), as SVG."""
    if "user_id" in split.columns:
        raise ValueError("a modal split per user has more than one row for a period")
    if "timestamp" not in split.columns:
        raise ValueError("a modal split without freq has no periods")
    modes = [c for c in split.columns if c != "timestamp"]
    rows = split.orderBy("timestamp").collect()  # a row for each period
    top = max((sum(r[m] or 0 for m in modes) for r in rows), default=0) or 1
    left, low, tall = 60, height - 60, height - 110
    step = (width - left - 20) / max(1, len(rows))
    body = [f'<text x="{width / 2}" y="20" text-anchor="middle" font-size="14">{escape(title or "")}</text>', f'<text x="{width / 2}" y="{height - 28}" text-anchor="middle">{escape(x_label or "")}</text>', f'<text x="14" y="{height / 2}" transform="rotate(-90 14 {height / 2})" text-anchor="middle">{escape(y_label or "")}</text>']
    for k in range(5):
        body.append(f'<text x="{left - 6}" y="{low - tall * k / 4 + 4:.1f}" text-anchor="end">{top * k / 4:.3g}</text>')
    for k, r in enumerate(rows):
        at = low
        for m, mode in enumerate(modes):
            h = tall * (r[mode] or 0) / top
            at -= h
            body.append(f'<rect class="{escape(mode)}" x="{left + k * step + step * 0.1:.1f}" y="{at:.1f}" width="{step * 0.8:.1f}" height="{h:.1f}" fill="{COLOURS[m % len(COLOURS)]}"/>')
        body.append(f'<text x="{left + (k + 0.5) * step:.1f}" y="{low + 14}" text-anchor="middle">{r["timestamp"].strftime(date_fmt)}</text>')
    for m, mode in enumerate(modes):
        body.append(f'<rect x="{left + m * 150}" y="{height - 18}" width="10" height="10" fill="{COLOURS[m % len(COLOURS)]}"/><text x="{left + m * 150 + 14}" y="{height - 9}">{escape(mode)}</text>')
    svg = _figure(width, height, body)
    if out_path:
        save_fig(svg, out_path)
    return svg
