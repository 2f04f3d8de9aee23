"""Queries of the general training-data operators (problems 4, 5 and 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regfuse.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regfuse.operators.packed import split_packed

    plants = table(spark, sf_dir, "powerplants").select("row_id", "projectid", "eic")
    return split_packed(plants, "row_id", ["projectid", "eic"], only_multiple=True)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from regfuse.functions.missing import lat_missing, lon_missing
    from regfuse.operators.spatial import points_near

    plants = table(spark, sf_dir, "powerplants").select("row_id", "lat", "lon").filter(~lat_missing() & ~lon_missing())
    buses = table(spark, sf_dir, "buses").select("bus", "x", "y").filter(~lat_missing("y") & ~lon_missing("y", "x"))
    return points_near(plants, buses, 5.0).select("row_id", F.col("bus"))


def p5_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filled value with how it was filled."""
    from pyspark.sql import functions as F

    from regfuse.operators.impute import fill_plants

    done = fill_plants(table(spark, sf_dir, "powerplants"))
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value"), F.col(f + "_how").alias("how")) for f in ("lat", "lon", "datein")])).alias("x")
    return done.filter("lat_filled or lon_filled or datein_filled").select("row_id", rows).select("row_id", "x.*").filter(F.col("how").isNotNull() & F.col("value").isNotNull())


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_filled(spark, sf_dir).select("row_id", "field_name")


QUERIES = {"p4_found": p4_found, "p5_found": p5_found, "p5_filled": p5_filled, "p7_found": p7_found}

SQL: dict[str, str] = {
    "p5_found": """
SELECT row_id, field_name FROM (
  SELECT row_id, 'lat' AS field_name FROM powerplants WHERE NOT coalesce(lat BETWEEN 27 AND 82, false)
  UNION ALL
  SELECT row_id, 'lon' FROM powerplants
  WHERE NOT coalesce(lon BETWEEN -32 AND 70, false) OR (lon = 0 AND NOT coalesce(lat BETWEEN 27 AND 82, false))
  UNION ALL
  SELECT row_id, 'datein' FROM powerplants WHERE NOT coalesce(datein BETWEEN 1850 AND 2035, false))
""",
    "p7_found": """
SELECT p.row_id, b.bus
FROM (SELECT row_id, lat, lon FROM powerplants WHERE lat BETWEEN 27 AND 82 AND lon BETWEEN -32 AND 70) p
JOIN (SELECT bus, x, y FROM buses WHERE y BETWEEN 27 AND 82 AND x BETWEEN -32 AND 70) b
  ON abs(p.lat - b.y) <= 0.05
 AND 2 * 6371 * asin(sqrt(pow(sin(radians(b.y - p.lat) / 2), 2)
     + cos(radians(p.lat)) * cos(radians(b.y)) * pow(sin(radians(b.x - p.lon) / 2), 2))) <= 5
""",
}
