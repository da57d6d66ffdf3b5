"""Figures: well-formed, with a mark for each cell that holds something, and bars as tall as their shares."""

from datetime import datetime
from xml.etree import ElementTree

import pytest

from tests.test_mobility import fixes, stays
from wayfarer import viz

SVG = "{http://www.w3.org/2000/svg}"


def test_map(spark, tmp_path):
    pfs = fixes(spark, [("a", 0, 0, 0, 0), ("a", 1, 0, 10, 10), ("a", 2, 0, 10, 10)])
    sp = stays(spark, [(1, 0, 0, 10, 5, 5, 3)])
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    tpls = spark.createDataFrame([(0, line((0, 0), (10, 0)))], "id long, geom array<struct<x:double,y:double>>")
    svg = viz.plot(str(tmp_path / "map.svg"), pfs, tpls, sp, width=11, height=11)
    assert (tmp_path / "map.svg").read_text() == svg
    root = ElementTree.fromstring(svg)
    marks = {g.get("id"): sorted((int(c.get("cx")), int(c.get("cy"))) for c in g.iter(f"{SVG}circle")) for g in root.iter(f"{SVG}g")}
    assert marks == {"positionfixes": [(0, 10), (10, 0)], "triplegs": [(x, 10) for x in range(11)], "staypoints": [(5, 5)]}
    assert viz.calculate_bounds({"triplegs": tpls}) == (0.0, 10.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        viz.plot()
    with pytest.raises(ValueError):
        viz.plot(positionfixes=pfs.where("false"))


def test_modal_split(spark, tmp_path):
    rows = [(datetime(2024, 1, 2), 1.0, 1.0), (datetime(2024, 1, 1), 3.0, None)]
    split = spark.createDataFrame(rows, "timestamp timestamp, bus double, `a<b` double")
    svg = viz.plot_modal_split(split, f"file://{tmp_path}/split.svg", title="T", y_label="share")
    assert (tmp_path / "split.svg").read_text() == svg
    bars = [(r.get("class"), float(r.get("height"))) for r in ElementTree.fromstring(svg).iter(f"{SVG}rect") if r.get("class")]
    tall = max(h for _, h in bars)
    assert [(c, round(h / tall, 2)) for c, h in bars] == [("bus", 1.0), ("a<b", 0.0), ("bus", 0.33), ("a<b", 0.33)]
    with pytest.raises(ValueError):
        viz.plot_modal_split(split.drop("timestamp"))
    with pytest.raises(ValueError):
        viz.plot_modal_split(split.selectExpr("1 as user_id", "*"))
