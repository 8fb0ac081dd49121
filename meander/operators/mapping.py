"""Sparse mappings (target_id, source, weight) between regular grids and target areas.

A regular axis has n cells from ``low`` with ``width``; cell (ix, iy) of a grid
with ``nx`` columns has the source number iy * nx + ix. Which cells a rectangle
or point touches is arithmetic, so mappings are built without comparing all pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.scan import X_NAMES, Y_NAMES, found_name
from .lookup import IntegrityError, require_unique, tasks_for

#: Fixed value: the sphere's radius in metres.
EARTH_RADIUS = 6371007.2


@dataclass(frozen=True)
class Axis:
    low: float
    width: float
    n: int
    period: float | None = None

    @classmethod
    def from_centers(cls, coordinates: DataFrame, column: str, period: float | None = None, rough: float = 1e-6) -> Axis:
        """The axis of a table's distinct cell centres; they must be evenly spaced (but for the share ``rough`` of a cell)."""
        x = coordinates.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL").distinct()
        low, high, n = x.agg(F.min("x"), F.max("x"), F.count("*")).first()
        if n < 2:
            raise IntegrityError(f"{column}: an axis needs two cells")
        width = (high - low) / (n - 1)
        place = (F.col("x") - low) / width
        if uneven := x.where(F.abs(place - F.round(place)) > rough).limit(5).collect():
            raise IntegrityError(f"{column} is not evenly spaced: {[r.x for r in uneven]}")
        return cls(low - width / 2, width, n, period)

    def close_to(self, other: Axis) -> bool:
        near = lambda a, b: abs(a - b) <= 1e-8 + 1e-5 * abs(b)
        return self.n == other.n and near(self.low, other.low) and near(self.high, other.high)

    @property
    def high(self) -> float:
        return self.low + self.width * self.n

    def wrapped(self, x: Column) -> Column:
        if self.period is None:
            return x
        return x - self.period * F.floor((x - self.low) / self.period)

    def index(self, x: Column, snap: float = 1e-10) -> Column:
        """The cell of a coordinate, null outside; points on the outer edges belong to the edge cells."""
        i = F.floor((self.wrapped(x) - self.low) / self.width)
        if self.period is not None and abs(self.width * self.n - self.period) < snap:
            return F.pmod(i, F.lit(self.n)).cast("int")
        slack = snap * max(1.0, abs(self.width))
        return F.when((x >= self.low - slack) & (x <= self.high + slack), F.least(F.greatest(i, F.lit(0)), F.lit(self.n - 1)).cast("int"))

    def edges(self, i: Column) -> tuple[Column, Column]:
        return self.low + i * self.width, self.low + (i + 1) * self.width


@dataclass(frozen=True)
class Grid:
    x: Axis
    y: Axis
    geographic: bool = False

    @classmethod
    def from_coordinates(cls, coordinates: DataFrame, x: str | None = None, y: str | None = None, geographic: bool | None = None) -> Grid:
        """The grid of a table of cell centres; x and y are found by name where not given (lon, lat, x, y and so on, in any case).

        Coordinates may be two-dimensional (columns ix, iy): then x must depend on ix alone, and y on iy.
        """
        x, y = x or found_name(coordinates.columns, X_NAMES), y or found_name(coordinates.columns, Y_NAMES)
        for index, column in (("ix", x), ("iy", y)):
            if {"ix", "iy"} <= set(coordinates.columns):
                spread = coordinates.groupBy(index).agg((F.max(column) - F.min(column)).alias("d"), F.max(F.abs(column)).alias("m"))
                if spread.where("d > 1e-8 + 1e-5 * m").limit(1).count():
                    raise IntegrityError(f"{column} is not an axis of a regular grid")
        if {"ix", "iy"} <= set(coordinates.columns):
            xs, ys = coordinates.groupBy("ix").agg(F.avg(x).alias(x)), coordinates.groupBy("iy").agg(F.avg(y).alias(y))
        else:
            xs = ys = coordinates
        on_globe = x.lower() in X_NAMES[:3] if geographic is None else geographic
        return cls(Axis.from_centers(xs, x, 360.0 if on_globe else None), Axis.from_centers(ys, y), on_globe)

    def frame(self, cells: DataFrame, ix: str, iy: str) -> DataFrame:
        """``cells`` with the rectangle (xmin, xmax, ymin, ymax) of each."""
        (a, b), (c, d) = self.x.edges(F.col(ix)), self.y.edges(F.col(iy))
        return cells.withColumns({"xmin": a, "xmax": b, "ymin": c, "ymax": d})

    def source(self, ix: Column, iy: Column) -> Column:
        return (iy * self.x.n + ix).cast("long")

    def cells(self, df: DataFrame, x: str, y: str, on_outside: str = "drop") -> DataFrame:
        """``df`` with ``source``, the cell of each point. on_outside: drop or error."""
        if on_outside not in ("drop", "error"):
            raise ValueError("on_outside is drop or error")
        at = self.source(self.x.index(F.col(x)), self.y.index(F.col(y)))
        if on_outside == "error":
            at = F.coalesce(at, F.raise_error(F.lit("a point is outside the grid")).cast("long"))
        return df.withColumn("source", at).where("source IS NOT NULL")

    def area(self, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
        if not self.geographic:
            return (x1 - x0) * (y1 - y0)
        return EARTH_RADIUS**2 * F.radians(x1 - x0) * (F.sin(F.radians(y1)) - F.sin(F.radians(y0)))


def rectangle_overlap(targets: DataFrame, grid: Grid, mode: str = "mean", least_coverage: float = 1 - 1e-6) -> DataFrame:
    """(target_id, source, weight, coverage) for rectangles (target_id, xmin, xmax, ymin, ymax).

    Weights are overlap areas, divided by their sum for ``mean``. A target of which less than ``least_coverage`` lies on
    the grid is an error.
    """
    clip = lambda axis, lo, hi: (F.greatest(F.floor((lo - axis.low) / axis.width), F.lit(0)), F.least(F.ceil((hi - axis.low) / axis.width) - 1, F.lit(axis.n - 1)))
    x0, x1, y0, y1 = map(F.col, ("xmin", "xmax", "ymin", "ymax"))
    (a, b), (c, d) = clip(grid.x, x0, x1), clip(grid.y, y0, y1)
    span = lambda lo, hi: F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))
    cells = targets.withColumn("_ix", F.explode_outer(span(a, b))).withColumn("_iy", F.explode_outer(span(c, d)))
    (l, r), (s, n) = grid.x.edges(F.col("_ix")), grid.y.edges(F.col("_iy"))
    left, right, south, north = F.greatest(x0, l), F.least(x1, r), F.greatest(y0, s), F.least(y1, n)
    hit = cells.withColumns({"weight": grid.area(left, right, south, north), "_plane": (right - left) * (north - south), "source": grid.source(F.col("_ix"), F.col("_iy"))})
    per = Window.partitionBy("target_id")
    whole = (x1 - x0) * (y1 - y0)
    hit = hit.withColumn("coverage", F.sum(F.coalesce("_plane", F.lit(0.0))).over(per) / whole)
    bad = F.concat(F.lit("a target is not wholly on the grid: "), F.col("target_id").cast("string"))
    hit = hit.withColumn("coverage", F.when(F.col("coverage") < least_coverage, F.raise_error(bad).cast("double")).otherwise(F.col("coverage"))).where("weight > 0")
    out = hit.select("target_id", "source", "weight", "coverage")
    return out if mode == "sum" else normalized(out)


def mask_targets(mask: DataFrame, grid: Grid, inside: Column, ix: str = "ix", iy: str = "iy", target_id: str | None = None) -> DataFrame:
    """(target_id, source, x, y, xmin, xmax, ymin, ymax): the cells of a mask (one row a cell) where ``inside`` is true, as targets with centre and bounds.

    ``target_id`` is a column of the mask, by default the cell's number. Cells off the grid and repeated cells or ids are errors.
    """
    cells = mask.where(inside)
    off = ~(F.col(ix).between(0, grid.x.n - 1) & F.col(iy).between(0, grid.y.n - 1))
    bad = F.raise_error(F.concat(F.lit("a mask cell is off the grid: "), F.concat_ws(", ", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (ix, iy)))))
    source = F.when(F.coalesce(off, F.lit(True)), bad.cast("long")).otherwise(grid.source(F.col(ix), F.col(iy)))
    (a, b), (c, d) = grid.x.edges(F.col(ix)), grid.y.edges(F.col(iy))
    out = cells.select((F.col(target_id) if target_id else source).cast("long").alias("target_id"), source.alias("source"), ((a + b) / 2).alias("x"), ((c + d) / 2).alias("y"), a.alias("xmin"), b.alias("xmax"), c.alias("ymin"), d.alias("ymax"))
    require_unique(out, "source")
    return require_unique(out, "target_id")


def point_targets(points: DataFrame, x: str, y: str, target_id: str, cell_size: float | tuple[float, float] | None = None) -> DataFrame:
    """(target_id, x, y), with ``cell_size`` (of both axes, or of each) also the bounds of a cell around each point; repeated ids are an error."""
    out = require_unique(points.select(F.col(target_id).cast("long").alias("target_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "target_id")
    if cell_size is None:
        return out
    dx, dy = cell_size if isinstance(cell_size, tuple) else (cell_size, cell_size)
    return out.withColumns({"xmin": F.col("x") - dx / 2, "xmax": F.col("x") + dx / 2, "ymin": F.col("y") - dy / 2, "ymax": F.col("y") + dy / 2})


def coalesced(mapping: DataFrame) -> DataFrame:
    """(target_id, source, weight) with one row for each pair: weights of repeated pairs are summed."""
    return mapping.groupBy("target_id", "source").agg(F.sum("weight").alias("weight"))


def normalized(mapping: DataFrame) -> DataFrame:
    """Weights divided by their sum per target; targets whose weights sum to 0 keep theirs."""
    total = F.sum("weight").over(Window.partitionBy("target_id"))
    return mapping.withColumn("weight", F.when(total != 0, F.col("weight") / total).otherwise(F.col("weight")))


def pixel_mapping(pixels: DataFrame, targets: DataFrame, grid: Grid) -> DataFrame:
    """(target_id, source, weight): the area of each target's pixels (pixel_target, x, y, area) by cell. Others are dropped."""
    known = pixels.join(targets.select(F.col("target_id").alias("pixel_target")).distinct(), "pixel_target")
    cells = grid.cells(known, "x", "y").select(F.col("pixel_target").alias("target_id"), "source", "area")
    return cells.repartition(tasks_for(pixels), "target_id", "source").groupBy("target_id", "source").agg(F.sum("area").alias("weight"))


def coverage(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("target_id").agg(F.sum("weight").alias("coverage"))


def apply_mapping(frames: DataFrame, mapping: DataFrame, time: str, source: str, value: str, targets: DataFrame | None = None) -> DataFrame:
    """(time, target_id, value): weighted sums of the source values (NaN and null as 0). With ``targets``: 0 for those without sources."""
    x = F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    out = frames.select(F.col(time), F.col(source).alias("source"), x.alias("_x")).join(mapping, "source").groupBy(time, "target_id").agg(F.sum(F.col("weight") * F.col("_x")).alias("value"))
    if targets is None:
        return out
    every = frames.select(time).distinct().crossJoin(targets.select("target_id").distinct())  # the dense result itself
    return every.join(out, [time, "target_id"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def local(mapping: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted targets (position, target_id) with weight, with their position."""
    return mapping.where("weight <> 0").join(wanted.select("position", "target_id"), "target_id")


def centers(mapping: DataFrame, grid: Grid) -> DataFrame:
    """(target_id, cx, cy): weighted mean cell, around the circle where x is periodic; rounded half to even."""
    ix, iy = F.col("source") % grid.x.n, F.expr(f"source div {grid.x.n}")
    w = F.when(F.sum("weight").over(Window.partitionBy("target_id")) != 0, F.col("weight")).otherwise(1.0)
    cells = mapping.withColumns({"_x": ix, "_y": iy, "_w": w})
    if grid.x.period is not None:
        turn = 2 * math.pi / grid.x.n
        angle = F.atan2(F.sum(F.col("_w") * F.sin(F.col("_x") * turn)), F.sum(F.col("_w") * F.cos(F.col("_x") * turn)))
        cx = F.pmod(F.bround(angle / turn), F.lit(float(grid.x.n)))
    else:
        cx = F.bround(F.sum(F.col("_w") * F.col("_x")) / F.sum("_w"))
    return cells.groupBy("target_id").agg(cx.cast("int").alias("cx"), F.bround(F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).cast("int").alias("cy"))


def with_source_mask(mapping: DataFrame, valid: DataFrame, grid: Grid, empty_targets: str = "nearest", keep_sums: bool = True) -> DataFrame:
    """The mapping on valid sources only; a target's weights keep their sum.

    empty_targets: what becomes of targets without valid source: ``nearest`` takes the valid cell in the nearest ring
    around the target's centre (in it, the nearest by distance, then by number), ``drop``, or ``error``. The mapping is written
    first, so that its size says among how many tasks its targets are dealt.
    """
    mapping = scratch.saved(mapping, "unmasked")
    mapping = mapping.repartition(tasks_for(mapping), "target_id")
    full = Window.partitionBy("target_id")
    marked = mapping.join(valid.select("source", F.lit(True).alias("_ok")), "source", "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    marked = marked.withColumns({"_all": F.sum("weight").over(full), "_good": F.sum(F.when(F.col("_ok"), F.col("weight"))).over(full)})
    scale = F.when(F.col("_good") != 0, F.col("_all") / F.col("_good")).otherwise(1.0) if keep_sums else F.lit(1.0)
    good = marked.where("_ok").select("target_id", "source", (F.col("weight") * scale).alias("weight"))
    if empty_targets == "drop":
        return good
    sums = mapping.groupBy("target_id").agg(F.sum("weight").alias("_all"))
    empty = mapping.join(good.select("target_id").distinct(), "target_id", "left_anti")
    if empty_targets == "error":
        stop = F.raise_error(F.concat(F.lit("no valid source for target "), F.col("target_id").cast("string"))).cast("double")
        return good.unionByName(empty.select("target_id", "source", stop.alias("weight")))
    return good.unionByName(nearest_cells(centers(empty, grid), valid, grid).join(sums, "target_id").select("target_id", "source", F.col("_all").alias("weight")))


def nearest_cells(points: DataFrame, valid: DataFrame, grid: Grid) -> DataFrame:
    """(target_id, source): for each (target_id, cx, cy) the valid cell in the nearest square ring, and in it the nearest by distance.

    Of cells at one distance the first in ring order is taken: the row below, then the row above, then the column to the left
    and the one to the right, each by growing coordinates. Rings are looked at in growing bands by an equality join; only
    targets without a hit go on, so most look at few cells. Each band's results are written.
    """
    valid = valid.select("source").distinct()
    inside = F.pmod(F.col("cx"), F.lit(grid.x.n)) if grid.x.period is not None else F.least(F.greatest(F.col("cx"), F.lit(0)), F.lit(grid.x.n - 1))
    left = points.select("target_id", inside.alias("cx"), F.least(F.greatest(F.col("cy"), F.lit(0)), F.lit(grid.y.n - 1)).alias("cy"))
    found, reach, seen, biggest = None, 1, 0, max(grid.x.n, grid.y.n)
    while True:
        span = lambda a, b: F.sequence(F.lit(a), F.lit(b))
        ends = F.concat(span(-reach, -seen), span(seen, reach)) if seen else span(-reach, reach)
        near = left.withColumn("_dy", F.explode(span(-reach, reach)))
        near = near.withColumn("_dx", F.explode(F.when(F.abs("_dy") >= seen, span(-reach, reach)).otherwise(ends)))
        x, y = F.col("cx") + F.col("_dx"), F.col("cy") + F.col("_dy")
        x = F.pmod(x, F.lit(grid.x.n)) if grid.x.period is not None else F.when((x >= 0) & (x < grid.x.n), x)
        near = near.withColumn("source", grid.source(x, F.when((y >= 0) & (y < grid.y.n), y))).join(valid, "source")
        ring, far = F.greatest(F.abs("_dx"), F.abs("_dy")), F.abs("_dx")
        far = F.least(far, F.lit(grid.x.n) - far) if grid.x.period is not None else far
        row = F.abs("_dy") == ring
        side = F.when(row, F.when(F.col("_dy") <= 0, 0).otherwise(1)).otherwise(F.when(F.col("_dx") < 0, 2).otherwise(3))
        rank = F.struct(ring.alias("r"), (far * far + F.col("_dy") ** 2).alias("d"), side.alias("s"), F.when(row, F.col("_dx")).otherwise(F.col("_dy")).alias("p"), F.col("source"))
        hits = scratch.saved(near.groupBy("target_id").agg(F.min(rank).alias("x")).select("target_id", F.col("x.source").alias("source")), "nearest")
        found = hits if found is None else found.unionByName(hits)
        if reach >= biggest:
            return found
        left = scratch.saved(left.join(hits.select("target_id"), "target_id", "left_anti"), "farther")
        if left.isEmpty():
            return found
        reach, seen = min(reach * 4, biggest), reach + 1


def point_mapping(points: DataFrame, grid: Grid, method: str = "overlap", size: float | None = None) -> DataFrame:
    """(target_id, source, weight) of target cells given by their centres (target_id, x, y): ``nearest``, or by ``overlap`` of squares of ``size``."""
    if method == "nearest":
        return grid.cells(points, "x", "y", on_outside="error").select("target_id", "source", F.lit(1.0).alias("weight"))
    if method != "overlap":
        raise ValueError("method is nearest or overlap")
    if size is None:
        raise IntegrityError("overlap needs the size of the target cells")
    half = size / 2
    squares = points.select("target_id", *[(F.col(c) + sign * half).alias(f"{c}{end}") for c in "xy" for sign, end in ((-1, "min"), (1, "max"))])
    return rectangle_overlap(squares, grid).drop("coverage")


def first_frame_valid(frames: DataFrame, time: str, source: str, value: str) -> DataFrame:
    """(source): the sources that have a value in the first frame."""
    first = frames.agg(F.min(time)).first()[0]
    return frames.where((F.col(time) == F.lit(first)) & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(source).alias("source")).distinct()


def generated(pixels: DataFrame, targets: DataFrame, grid: Grid, missing: str = "keep", valid: DataFrame | None = None) -> DataFrame:
    """(target_id, source, weight) from pixels, specialised to the valid sources: ``keep`` all, ``drop`` the others, or ``nearest``: drop them and repair emptied targets."""
    if missing not in ("keep", "drop", "nearest"):
        raise ValueError("missing is keep, drop or nearest")
    mapping = pixel_mapping(pixels, targets, grid)
    if missing == "keep":
        return mapping
    if valid is None:
        raise IntegrityError(f"{missing} needs the valid sources")
    return with_source_mask(mapping, valid, grid, missing)


def local_for(mapping: DataFrame, mapped: Grid, data: Grid, wanted: DataFrame) -> DataFrame:
    """The wanted targets' rows of a mapping, if the data's grid is the one it was made for."""
    if not (mapped.x.close_to(data.x) and mapped.y.close_to(data.y)):
        raise IntegrityError("the data's coordinates are not those of the mapping; make the mapping anew")
    parts = tasks_for(mapping)
    mapping, wanted = mapping.repartition(parts, "target_id"), wanted.repartition(parts, "target_id")
    if found := wanted.join(mapping.select("target_id"), "target_id", "left_anti").limit(5).collect():
        raise IntegrityError(f"targets that the mapping lacks: {[r.target_id for r in found]}")
    return local(mapping, wanted)


def mapped_variables(frames: DataFrame, mapping: DataFrame, time: str, source: str, values: list[str]) -> DataFrame:
    """(time, target_id, a column per value): several variables through one mapping, in one join (NaN and null as 0)."""
    x = [F.coalesce(F.nanvl(F.col(v).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_{v}") for v in values]
    joined = frames.select(F.col(time), F.col(source).alias("source"), *x).join(mapping, "source")
    return joined.groupBy(time, "target_id").agg(*[F.sum(F.col("weight") * F.col(f"_{v}")).alias(v) for v in values])


def tile_pixels(pixels: DataFrame, tiles: DataFrame, west: float, east: float, south: float, north: float, nx: int, ny: int, shift: tuple[int, int] = (0, 0)) -> DataFrame:
    """(pixel_target, area, x, y): the pixels of tiles inside a region that belong to one of its cells.

    tiles (tile, tile_west, tile_north, size, nix, niy); pixels (tile, ix, iy, cx, cy, area), counted from a tile's north-west
    corner; cx, cy: the low-resolution cell, counted from 1, none below 1. ``shift``: cells that the region begins after.
    The target is x * ny + y.
    """
    w, n, size = F.col("tile_west"), F.col("tile_north"), F.col("size")
    cut = lambda length, count: F.least(F.greatest(F.bround(length / size), F.lit(0)), count)
    crop = tiles.select("tile", "tile_west", "tile_north", "size", cut(west - w, F.col("nix")).alias("_x0"), cut(east - w, F.col("nix")).alias("_x1"), cut(n - north, F.col("niy")).alias("_y0"), cut(n - south, F.col("niy")).alias("_y1"))
    held = pixels.join(crop.where("_x0 < _x1 AND _y0 < _y1"), "tile").where("ix >= _x0 AND ix < _x1 AND iy >= _y0 AND iy < _y1 AND cx > 0")
    vx, vy = F.col("cx") - 1 - shift[0], F.col("cy") - 1 - shift[1]
    inside = held.where((vx >= 0) & (vx < nx) & (vy >= 0) & (vy < ny))
    return inside.select((vx * ny + vy).cast("long").alias("pixel_target"), "area", (w + (F.col("ix") + 0.5) * size).alias("x"), (n - (F.col("iy") + 0.5) * size).alias("y"))
