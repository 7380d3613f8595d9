"""Points in polygons by a grid: polygons are cut into cells, points meet them by their cell.

A cell that no edge touches lies wholly inside or outside of a polygon, which its middle tells once for all points in
it; outside cells are dropped. Only points in border cells are tested against the edges. So the join is an equi-join on
cells, and the work per point is that of the few polygons whose cells it shares, not of all polygons.

``polygons``: (polygon, corners: array of (lat, lon), any number, concave too); ``points``: (point, lat, lon). A point
on an edge counts by the half-open rule of a ray towards larger longitudes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Cells along the longer side of an average polygon.
CELLS = 16
_EPS = 1e-9


def _edges(corners: Column) -> Column:
    """(lat1, lon1, lat2, lon2) of each side of a polygon."""
    following = F.concat(F.slice(corners, F.lit(2), F.size(corners)), F.slice(corners, 1, 1))
    return F.zip_with(corners, following, lambda a, b: F.struct(a["lat"].alias("lat1"), a["lon"].alias("lon1"), b["lat"].alias("lat2"), b["lon"].alias("lon2")))


def _inside(lat: Column, lon: Column, edges: Column) -> Column:
    """Whether a ray towards larger longitudes crosses an odd number of edges."""
    crosses = lambda e: ((e["lat1"] > lat) != (e["lat2"] > lat)) & (lon < (e["lon2"] - e["lon1"]) * (lat - e["lat1"]) / (e["lat2"] - e["lat1"]) + e["lon1"])
    return F.size(F.filter(edges, crosses)) % 2 == 1


def cells(polygons: DataFrame, step: float) -> DataFrame:
    """(polygon, x, y, border) for each grid cell that a polygon fills or touches."""
    rows = polygons.filter(F.size("corners") >= 3).withColumn("edges", _edges(F.col("corners")))
    at = lambda f, axis: F.floor(f(F.transform("corners", lambda p: p[axis])) / step)
    for axis, name in (("lat", "x"), ("lon", "y")):
        rows = rows.withColumn(name, F.explode(F.sequence(at(F.array_min, axis), at(F.array_max, axis))))
    low, high = {}, {}
    for axis, name in (("lat", "x"), ("lon", "y")):
        low[axis], high[axis] = F.col(name) * step - _EPS, (F.col(name) + 1) * step + _EPS
    near = lambda e, axis: (F.greatest(e[f"{axis}1"], e[f"{axis}2"]) >= low[axis]) & (F.least(e[f"{axis}1"], e[f"{axis}2"]) <= high[axis])
    border = F.exists("edges", lambda e: near(e, "lat") & near(e, "lon"))  # an edge's box may touch where the edge does not: tested, not lost
    rows = rows.withColumn("border", border).withColumn("full", _inside((F.col("x") + 0.5) * step, (F.col("y") + 0.5) * step, F.col("edges")))
    return rows.filter(F.col("border") | F.col("full")).select("polygon", "x", "y", "border")


def grid_step(polygons: DataFrame, count: int = CELLS) -> float:
    """A cell size that cuts an average polygon into ``count`` cells along its longer side."""
    wide = lambda axis: F.array_max(F.transform("corners", lambda p: p[axis])) - F.array_min(F.transform("corners", lambda p: p[axis]))
    mean = polygons.agg(F.avg(F.greatest(wide("lat"), wide("lon")))).first()[0]
    return (mean or 1.0) / count


def points_in_polygons(points: DataFrame, polygons: DataFrame, step: float | None = None) -> DataFrame:
    """(point, polygon) for each point and each polygon it lies in."""
    step = step or grid_step(polygons)
    grid = cells(polygons, step)
    placed = points.filter("lat IS NOT NULL AND lon IS NOT NULL").select("point", "lat", "lon", F.floor(F.col("lat") / step).alias("x"), F.floor(F.col("lon") / step).alias("y"))
    met = placed.join(grid, ["x", "y"])
    sure = met.filter(~F.col("border")).select("point", "polygon")
    tested = met.filter("border").join(polygons.select("polygon", _edges(F.col("corners")).alias("edges")), "polygon")
    return sure.union(tested.filter(_inside(F.col("lat"), F.col("lon"), F.col("edges"))).select("point", "polygon"))
