"""Estimates: missing years, durations, rescaling to statistics, net ratings, cohorts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regfuse.schema import FUEL_TO_LIFETIME


def _filled_by_means(df: DataFrame, column: str, levels: list[list[str]]) -> DataFrame:
    """Missing values from the mean of the first level that has one; later means see what was filled before."""
    for keys in levels:
        df = df.withColumn(column, F.coalesce(column, F.avg(column).over(W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1)))))
    return df


def fill_missing_commissioning_years(df: DataFrame) -> DataFrame:
    """DateIn from the mean of fuel, technology and country; of fuel and country; of fuel. Then DateRetrofit from DateIn.

    Groups with a null key are no groups. Means are joined as small tables, aggregated before the shuffle."""
    for keys in (["Fueltype", "Technology", "Country"], ["Fueltype", "Country"], ["Fueltype"]):
        means = df.dropna(subset=keys).groupBy(*keys).agg(F.avg("DateIn").alias("_m"))
        df = df.join(means, keys, "left").withColumn("DateIn", F.coalesce("DateIn", "_m")).drop("_m")
    return df.withColumn("DateRetrofit", F.coalesce("DateRetrofit", "DateIn"))


def fill_missing_decommissioning_years(df: DataFrame, lifetimes: dict[str, float] | None = None) -> DataFrame:
    """DateOut as the later of DateIn and DateRetrofit plus the lifetime of the fuel, after filling those."""
    years = F.create_map(*[F.lit(x) for kv in (lifetimes or FUEL_TO_LIFETIME).items() for x in (kv[0], float(kv[1]))])
    df = fill_missing_commissioning_years(df)
    return df.withColumn("DateOut", F.coalesce("DateOut", F.greatest("DateIn", "DateRetrofit") + F.try_element_at(years, F.col("Fueltype"))))


fill_missing_decommyears, fill_missing_commyears = fill_missing_decommissioning_years, fill_missing_commissioning_years


def fill_missing_duration(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Duration of stores set to the mean of their fuel, for all of them unless ``only_missing``."""
    store = F.coalesce(F.col("Set").isin("Store", "Storage"), F.lit(False))
    means = df.filter(store).dropna(subset=["Fueltype"]).groupBy("Fueltype").agg(F.avg("Duration").alias("_m"))
    new = F.coalesce("Duration", "_m") if only_missing else F.col("_m")
    return df.join(F.broadcast(means), "Fueltype", "left").withColumn("Duration", F.when(store, new).otherwise(F.col("Duration"))).select(*df.columns)


def rescale_to_totals(df: DataFrame, statistics: DataFrame, fueltypes: list[str] | None = None) -> DataFrame:
    """``df`` with ``Scaled Capacity``: capacities times the ratio of the statistics' and own totals of country and fuel;
    1 where either has none."""
    own = df.dropna(subset=["Country", "Fueltype"]).groupBy("Country", "Fueltype").agg(F.sum("Capacity").alias("_own"))
    stats = statistics.dropna(subset=["Country", "Fueltype"]).groupBy("Country", "Fueltype").agg(F.sum("Capacity").alias("_stat"))
    ratio = own.join(stats, ["Country", "Fueltype"]).select("Country", "Fueltype", F.try_divide("_stat", "_own").alias("_r"))
    if fueltypes:
        ratio = ratio.filter(F.col("Fueltype").isin(fueltypes))
    return df.join(ratio, ["Country", "Fueltype"], "left").withColumn("Scaled Capacity", F.col("Capacity") * F.coalesce(F.when(F.col("_r") > 0, F.col("_r")), F.lit(1.0))).drop("_r")


def gross_to_net_factors(df: DataFrame, gross: str = "energy_capacity_gross", net: str = "energy_capacity_net", aggfunc: str = "mean") -> DataFrame:
    """Ratio of net to gross by fuel and technology, of rows where it is at most 1: ``Fueltype, Technology, factor``."""
    aggs = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5)), "min": F.min, "max": F.max}
    ratio = df.withColumn("_r", F.try_divide(F.col(net), F.col(gross))).filter("_r <= 1")
    return ratio.dropna(subset=["Fueltype", "Technology"]).groupBy("Fueltype", "Technology").agg(aggs[aggfunc]("_r").alias("factor"))


def scale_to_net_capacities(df: DataFrame, factors: DataFrame, is_net: bool = False) -> DataFrame:
    """Gross capacities scaled to net by fuel and technology, by the mean factor of the fuel for other technologies."""
    if is_net:
        return df
    rest = factors.groupBy("Fueltype").agg(F.avg("factor").alias("_f2"))
    out = df.join(F.broadcast(factors.withColumnRenamed("factor", "_f1")), ["Fueltype", "Technology"], "left").join(F.broadcast(rest), "Fueltype", "left")
    return out.withColumn("Capacity", F.col("Capacity") * F.coalesce("_f1", "_f2", F.lit(1.0))).select(*df.columns)


def vre_by_commissioning_year(df: DataFrame, fuels: list[str] | None = None, geo: str | None = None) -> DataFrame:
    """Cohorts of weather-driven plants: capacity by country, year, fuel and technology. ``geo`` adds positions: 'mean'
    or 'wm' (weighted by capacity, over rows that have both)."""
    df = fill_missing_commissioning_years(df.filter(F.col("Fueltype").isin(fuels or ["Wind", "Solar", "Biogas", "Solid Biomass"])))
    aggs = [F.sum("Capacity").alias("Capacity")]
    if geo == "mean":
        aggs += [F.avg(c).alias(c) for c in ("lat", "lon")]
    elif geo == "wm":
        ok = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("Capacity").isNotNull()
        aggs += [F.try_divide(F.sum(F.when(ok, F.col(c) * F.col("Capacity"))), F.sum(F.when(ok, F.col("Capacity")))).alias(c) for c in ("lat", "lon")]
    keys = ["Country", "DateIn", "Fueltype", "Technology"]
    return df.withColumn("Technology", F.coalesce("Technology", F.lit(""))).dropna(subset=["Country", "DateIn", "Fueltype"]).groupBy(*keys).agg(*aggs).withColumns({"Technology": F.nullif("Technology", F.lit("")), "Set": F.lit("PP"), "DateRetrofit": F.col("DateIn")})


def vintage_cohorts(statistics: DataFrame, lifetimes: dict[str, float] | None = None) -> DataFrame:
    """Cohorts behind yearly totals (``Country, Fueltype, Year, Capacity``): what a year adds over the last, what was
    built a lifetime ago being replaced; a fall retires the oldest first. One small group (country, fuel) a task:
    ``Country, Fueltype, DateIn, Capacity``."""
    years = {**FUEL_TO_LIFETIME, **(lifetimes or {})}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["Year", "Capacity"]).sort_values("Year")
        life = years.get(pdf["Fueltype"].iloc[0] if len(pdf) else "", 25)
        cohorts: dict[int, float] = {}
        for year, total in zip(pdf["Year"].astype(int), pdf["Capacity"]):
            cohorts = {y: c for y, c in cohorts.items() if y + life > year}
            gap = total - sum(cohorts.values())
            if gap > 0:
                cohorts[year] = cohorts.get(year, 0.0) + gap
            for y in sorted(cohorts):
                if gap >= 0:
                    break
                cut = min(cohorts[y], -gap)
                cohorts[y] -= cut
                gap += cut
        rows = [(y, c) for y, c in cohorts.items() if c > 0]
        return pd.DataFrame({"Country": pdf["Country"].iloc[0] if len(pdf) else None, "Fueltype": pdf["Fueltype"].iloc[0] if len(pdf) else None, "DateIn": [float(y) for y, _ in rows], "Capacity": [c for _, c in rows]}, columns=["Country", "Fueltype", "DateIn", "Capacity"])

    return statistics.dropna(subset=["Country", "Fueltype"]).groupBy("Country", "Fueltype").applyInPandas(run, "Country string, Fueltype string, DateIn double, Capacity double")


def extend_by_vre(df: DataFrame, vre: DataFrame) -> DataFrame:
    """``df`` with the rows of ``vre`` that are not Hydro."""
    return df.unionByName(vre.filter(F.coalesce(F.col("Fueltype") != "Hydro", F.lit(True))), allowMissingColumns=True)


def uncommon_fuels_to_other(df: DataFrame, rare: list[str] | None = None) -> DataFrame:
    """Rare fuels and missing ones become Other."""
    # The rare fuels.
    rare = rare or ["Mixed fuel types", "Electro-mechanical"]
    return df.withColumn("Fueltype", F.when(F.col("Fueltype").isin(rare), "Other").otherwise(F.coalesce("Fueltype", F.lit("Other"))))


def denmark_regions(df: DataFrame, border: float = 10.96) -> DataFrame:
    """Danish rows as DKE or DKW by longitude, three places by their names; other Danish rows are split evenly over both."""
    dk = F.col("Country") == "Denmark"
    # Places whose region their name tells, in any country.
    named = {"Fellinggard": "DKW", "Jetsmark": "DKW", "Jegerspris": "DKE"}
    region = None
    for place, name in named.items():
        hit = F.coalesce(F.contains(F.lower("Name"), F.lit(place.lower())), F.lit(False))
        one = F.array(F.struct(F.lit(name).alias("r"), F.lit(1.0).alias("s")))
        region = F.when(hit, one) if region is None else region.when(hit, one)
    region = region.when(~dk | dk.isNull(), F.array(F.struct(F.lit(None).cast("string").alias("r"), F.lit(1.0).alias("s"))))
    region = region.when(F.col("lon").isNull(), F.array(F.struct(F.lit("DKE").alias("r"), F.lit(0.5).alias("s")), F.struct(F.lit("DKW").alias("r"), F.lit(0.5).alias("s"))))
    region = region.otherwise(F.array(F.struct(F.when(F.col("lon") >= border, "DKE").otherwise("DKW").alias("r"), F.lit(1.0).alias("s"))))
    return df.withColumn("_r", F.explode(region)).withColumns({"Region": F.col("_r.r"), "Capacity": F.col("Capacity") * F.col("_r.s")}).drop("_r")


def known_retire_years(df: DataFrame) -> DataFrame:
    """``df`` with ``YearRetire`` of German nuclear plants whose end is fixed, where the name holds that of the plant (a later one
    of the list wins); an own value stays otherwise."""
    # The years of those plants.
    years = {"Grafenrheinfeld": 2015, "Philippsburg": 2019, "Brokdorf": 2021, "Grohnde": 2021, "Gundremmingen": 2021, "Emsland": 2022, "Isar": 2022, "Neckarwestheim": 2022}
    out = F.col("YearRetire").cast("double") if "YearRetire" in df.columns else F.lit(None).cast("double")
    for place, year in years.items():
        hit = F.contains(F.lower("Name"), F.lit(place.lower())) & (F.col("Fueltype") == "Nuclear") & (F.col("Country") == "Germany")
        out = F.when(F.coalesce(hit, F.lit(False)), F.lit(float(year))).otherwise(out)
    return df.withColumn("YearRetire", out)


def with_position(df: DataFrame) -> DataFrame:
    """Rows that have both coordinates."""
    return df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def bounding_box(df: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Rows inside a box, and those without a position."""
    inside = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    return df.filter(F.coalesce(inside, F.lit(True)))
