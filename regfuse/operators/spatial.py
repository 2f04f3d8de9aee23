"""Points near other points or inside regions: a range join on Morton codes, refined exactly.

Discs and regions are covered by cells of about their own size, neighbouring cells on the curve are merged into
code ranges, and a point matches where its code lies in a range. Ranges end at the borders of larger *blocks*, so
the range join is an equi-join on the block with a between-condition: no cross join, and a block that holds a
third of all points is split by adaptive execution, as each point meets the ranges of its block only. The ranges
are broadcast only if they were counted and are few; else both sides are shuffled by block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regfuse.functions.cells import BITS, EARTH_KM, grid, haversine_km, morton, point_code
from regfuse.session import maybe_broadcast

#: Levels between a covering cell and the block that is the equi-join key.
BLOCK_LEVELS = 3


def disc_level(radius_km: float) -> int:
    """The finest level whose cells are at least as high as the radius: a disc then covers three rows of cells or fewer."""
    return max(1, min(BITS, int(math.log2(180.0 / max(math.degrees(radius_km / EARTH_KM), 1e-7)))))


def _ranges(boxes: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Boxes (south, north, west, east) as merged code ranges: ``keys, block, lo, hi``."""
    n = 1 << level
    y0, y1 = grid(F.col("south"), -90.0, 180.0, level), grid(F.col("north"), -90.0, 180.0, level)
    x0 = F.floor((F.col("west") + 180.0) / 360.0 * n).cast("bigint")
    x1 = F.least(F.floor((F.col("east") + 180.0) / 360.0 * n).cast("bigint"), x0 + n - 1)
    cells = (
        boxes.withColumn("_y", F.explode(F.sequence(y0, y1)))
        .withColumn("_x", F.explode(F.sequence(x0, x1)))
        .select(*keys, morton(F.pmod("_x", F.lit(n)), F.col("_y")).alias("_c"))
        .distinct()
    )
    w = W.partitionBy(*keys, "_b").orderBy("_c")
    runs = cells.withColumn("_b", F.shiftright("_c", 2 * BLOCK_LEVELS)).withColumn("_run", F.col("_c") - F.row_number().over(w))
    up = 2 * (BITS - level)
    return runs.groupBy(*keys, F.col("_b").alias("block"), "_run").agg(
        F.shiftleft(F.min("_c"), up).alias("lo"), (F.shiftleft(F.max("_c") + 1, up) - 1).alias("hi")
    ).drop("_run")


def disc_ranges(centres: DataFrame, keys: list[str], lat: str, lon: str, radius_km: float) -> DataFrame:
    """Each centre's disc as code ranges: ``keys, block, lo, hi``. Discs may cross the date line or hold a pole."""
    d = math.degrees(radius_km / EARTH_KM) * (1 + 1e-9)
    y, x = F.col(lat), F.pmod(F.col(lon) + 180.0, F.lit(360.0)) - 180.0
    # the widest half-width of a disc in longitude; all longitudes where it holds a pole
    ratio = F.sin(F.lit(math.radians(d))) / F.cos(F.radians(y))
    half = F.when((F.abs(y) + d >= 90) | (ratio >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9))
    boxes = centres.select(*keys, F.greatest(y - d, F.lit(-90.0)).alias("south"), F.least(y + d, F.lit(90.0)).alias("north"), (x - half).alias("west"), (x + half).alias("east"))
    return _ranges(boxes, keys, disc_level(radius_km))


def _usable(lat: Column, lon: Column) -> Column:
    ok = ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 540)
    return F.coalesce(ok, F.lit(False))


def points_near(points: DataFrame, centres: DataFrame, radius_km: float, point_id: str = "row_id", point_lat: str = "lat", point_lon: str = "lon", centre_id: str = "bus", centre_lat: str = "y", centre_lon: str = "x") -> DataFrame:
    """Every pair of a point and a centre at most ``radius_km`` apart: ``point_id, centre_id, distance_km``.

    Both sides may be large. Null, NaN or impossible coordinates match nothing; equal rows of one id and position
    give one pair; an empty side gives no rows. Only ids and coordinates are read, so the two tables may share
    column names. ``points`` should have had stand-in positions removed by the caller."""
    level = disc_level(radius_km)
    p = points.select(F.col(point_id).alias("_p"), F.col(point_lat).cast("double").alias("_plat"), F.col(point_lon).cast("double").alias("_plon")).filter(_usable(F.col("_plat"), F.col("_plon")))
    c = centres.select(F.col(centre_id).alias("_c_id"), F.col(centre_lat).cast("double").alias("_clat"), F.col(centre_lon).cast("double").alias("_clon")).filter(_usable(F.col("_clat"), F.col("_clon"))).distinct()
    cover = disc_ranges(c, ["_c_id", "_clat", "_clon"], "_clat", "_clon", radius_km)
    coded = p.withColumn("_code", point_code(F.col("_plat"), F.col("_plon"))).withColumn("block", F.shiftright("_code", 2 * (BITS - level + BLOCK_LEVELS)))
    right = maybe_broadcast(cover, cover.count())
    dist = haversine_km(F.col("_plat"), F.col("_plon"), F.col("_clat"), F.col("_clon"))
    # in this order, so that the distance is computed for pairs in range only
    hits = coded.join(right, (coded["block"] == right["block"]) & (F.col("_code") >= F.col("lo")) & (F.col("_code") <= F.col("hi")) & (dist <= radius_km))
    return hits.select(F.col("_p").alias(point_id), F.col("_c_id").alias(centre_id), dist.alias("distance_km"))


def inside(lat: Column, lon: Column, ring: Column) -> Column:
    """Ray casting: whether a position lies in a ring, an array of structs ``lat, lon`` (open or closed)."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    edges = F.arrays_zip(F.slice(closed, 1, F.size(ring)).alias("a"), F.slice(closed, 2, F.size(ring)).alias("b"))
    crosses = F.aggregate(
        edges,
        F.lit(0),
        lambda n, e: n
        + F.when(
            ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat))
            & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"]),
            1,
        ).otherwise(0),
    )
    return crosses % 2 == 1


def points_in_regions(points: DataFrame, regions: DataFrame, point_id: str = "row_id", point_lat: str = "lat", point_lon: str = "lon", region_id: str = "region", ring: str = "ring", level: int = 9) -> DataFrame:
    """Every pair of a point and a region that contains it: ``point_id, region_id``.

    A region is a ring: an array of structs ``lat, lon`` that doesn't cross the date line. Points on a border
    belong to one of the sides as ray casting has it. Null rings, rings of under three corners and unusable
    positions match nothing. ``level`` sets the covering cells (9: 0.35 by 0.7 degrees)."""
    r = regions.select(F.col(region_id).alias("_r"), F.col(ring).alias("_ring")).filter(F.size("_ring") >= 3)
    boxes = r.select("_r", F.array_min("_ring.lat").alias("south"), F.array_max("_ring.lat").alias("north"), F.array_min("_ring.lon").alias("west"), F.array_max("_ring.lon").alias("east"))
    cover = _ranges(boxes, ["_r"], level)
    p = points.select(F.col(point_id).alias("_p"), F.col(point_lat).cast("double").alias("_plat"), F.col(point_lon).cast("double").alias("_plon")).filter(_usable(F.col("_plat"), F.col("_plon")))
    coded = p.withColumn("_code", point_code(F.col("_plat"), F.col("_plon"))).withColumn("block", F.shiftright("_code", 2 * (BITS - level + BLOCK_LEVELS)))
    right = maybe_broadcast(cover, cover.count())
    hits = coded.join(right, (coded["block"] == right["block"]) & F.col("_code").between(F.col("lo"), F.col("hi"))).select("_p", "_plat", "_plon", "_r").distinct()
    rings = maybe_broadcast(r, r.count(), 10_000)
    return hits.join(rings, "_r").filter(inside(F.col("_plat"), F.col("_plon"), F.col("_ring"))).select(F.col("_p").alias(point_id), F.col("_r").alias(region_id)).distinct()
