"""Plane and sphere geometry over point columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    r = F.radians
    a = F.pow(F.sin((r(lat2) - r(lat1)) / 2), F.lit(2)) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin((r(lon2) - r(lon1)) / 2), F.lit(2))
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def shoelace(ring: DataFrame, g: str, idx: str, x: str, y: str) -> DataFrame:
    """g, area (signed): of rings given by ordered corners."""
    o, every = W.partitionBy(g).orderBy(idx), W.partitionBy(g).orderBy(idx).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(o), F.first(c).over(every)) for c in (x, y))
    return ring.select(g, (F.col(x) * ny - nx * F.col(y)).alias("c")).groupBy(g).agg((F.sum("c") / 2).alias("area"))


def bounding_box(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return points.groupBy(*by).agg(F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"), F.avg(x).alias("centroid_x"), F.avg(y).alias("centroid_y"))


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Winding-number rule for a polygon given by its corners."""
    wind = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
        side = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        wind = wind + F.when((F.lit(ay) <= y) & (F.lit(by) > y) & (side > 0), 1).when((F.lit(ay) > y) & (F.lit(by) <= y) & (side < 0), -1).otherwise(0)
    return wind != 0


def within_distance(points: DataFrame, radius: float, id_: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """a, b, distance of all pairs a < b at most radius apart: points meet by cells as wide as the radius."""
    cell = lambda c: F.floor(F.col(c) / radius)
    p = points.select(F.col(id_).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay"), cell(x).alias("cx"), cell(y).alias("cy"))
    around = F.sequence(F.lit(-1), F.lit(1))
    q = points.select(F.col(id_).alias("b"), F.col(x).alias("bx"), F.col(y).alias("by"), cell(x).alias("x0"), cell(y).alias("y0"))
    q = q.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).select("b", "bx", "by", (F.col("x0") + F.col("dx")).alias("cx"), (F.col("y0") + F.col("dy")).alias("cy"))
    apart = F.sqrt(F.pow(F.col("ax") - F.col("bx"), F.lit(2)) + F.pow(F.col("ay") - F.col("by"), F.lit(2)))
    return p.join(q, ["cx", "cy"]).where("a < b").select("a", "b", apart.alias("distance")).where(F.col("distance") <= radius)


def convex_hull(points: DataFrame, g: str = "g", x: str = "x", y: str = "y") -> DataFrame:
    """g, idx, x, y: corners against the clock. Hulls of parts are found first, and only their corners meet."""

    def hull(p):
        import pandas as pd

        pts = sorted(set(zip(p["x"], p["y"])))
        halves = []
        for order in (pts, pts[::-1]):
            h: list = []
            for q in order:
                while len(h) > 1 and (h[-1][0] - h[-2][0]) * (q[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (q[0] - h[-2][0]) <= 0:
                    h.pop()
                h.append(q)
            halves.append(h[:-1])
        out = halves[0] + halves[1] or pts
        return pd.DataFrame({"g": p["g"].iloc[0], "part": 0, "idx": range(len(out)), "x": [q[0] for q in out], "y": [q[1] for q in out]})

    schema = "g long, part int, idx int, x double, y double"
    rows = points.select(F.col(g).cast("long").alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.pmod(F.xxhash64(x, y), F.lit(64)).cast("int").alias("part"))
    parts = rows.groupBy("g", "part").applyInPandas(hull, schema)
    return parts.groupBy("g").applyInPandas(hull, schema).drop("part")


def distance_to_line(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Of a point to the line through a and b; if they are one point, to that."""
    length = F.hypot(bx - ax, by - ay)
    return F.when(length == 0, F.hypot(px - ax, py - ay)).otherwise(F.abs((bx - ax) * (ay - py) - (ax - px) * (by - ay)) / length)


def distance_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    square = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.coalesce(F.try_divide((px - ax) * (bx - ax) + (py - ay) * (by - ay), square), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))


def segments_meet(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Struct of x and y where the segments ab and cd cross; null where they don't, or are parallel."""
    turn = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = F.try_divide((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), turn)
    u = F.try_divide((cx - ax) * (by - ay) - (cy - ay) * (bx - ax), turn)
    return F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), F.struct((ax + t * (bx - ax)).alias("x"), (ay + t * (by - ay)).alias("y")))


def boxes_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Boxes as (min x, min y, max x, max y); edges count."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def circles_overlap(x1: Column, y1: Column, r1: Column, x2: Column, y2: Column, r2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) <= (r1 + r2) * (r1 + r2)


def tetrahedron_volume(a: tuple[Column, ...], b: tuple[Column, ...], c: tuple[Column, ...], d: tuple[Column, ...]) -> Column:
    (ux, uy, uz), (vx, vy, vz), (wx, wy, wz) = (tuple(p[k] - a[k] for k in range(3)) for p in (b, c, d))
    return F.abs(ux * (vy * wz - vz * wy) - uy * (vx * wz - vz * wx) + uz * (vx * wy - vy * wx)) / 6


def catmull_rom(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    """A coordinate of the curve from p1 to p2."""
    return 0.5 * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t * t + (3 * p1 - p0 - 3 * p2 + p3) * t * t * t)


def hermite_curve(p0: Column, m0: Column, p1: Column, m1: Column, t: Column) -> Column:
    """A coordinate of the curve from p0 to p1 with slopes m0 and m1."""
    s = t * t * t
    return (2 * s - 3 * t * t + 1) * p0 + (s - 2 * t * t + t) * m0 + (3 * t * t - 2 * s) * p1 + (s - t * t) * m1


def perimeter(ring: DataFrame, g: str, idx: str, x: str, y: str) -> DataFrame:
    """g, perimeter: of rings given by ordered corners."""
    o, every = W.partitionBy(g).orderBy(idx), W.partitionBy(g).orderBy(idx).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(o), F.first(c).over(every)) for c in (x, y))
    return ring.select(g, F.hypot(nx - F.col(x), ny - F.col(y)).alias("d")).groupBy(g).agg(F.sum("d").alias("perimeter"))
