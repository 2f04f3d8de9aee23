"""Assigning plants to network buses and tables for energy models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regfuse.session import BROADCAST_ROWS, Cut


def nearest_bus(df: DataFrame, buses: DataFrame, by_country: bool = False, cell: float = 1.0) -> DataFrame:
    """``df`` with ``bus``: the nearest by straight distance in degrees, ties to the smallest; null without a position or
    without a bus (in the country). Repeated rows stay.

    The distinct positions are looked up and joined back. Few buses (counted, at most 200,000) are broadcast into growing
    rings of grid cells: a position meets the buses of the nine cells around it, and only those whose nearest one there may
    be beaten from outside meet a wider ring; the last one is a single cell for all buses. Many buses go the same way by
    shuffled joins."""
    good = lambda *c: F.lit(True) if not c else good(*c[1:]) & F.col(c[0]).isNotNull() & ~F.isnan(c[0])
    area = ["_country"] if by_country else []
    b = buses.filter(good("x", "y")).select("bus", F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"), *[F.col("country").alias(c) for c in area])
    few = b.count() <= BROADCAST_ROWS
    hint = F.broadcast if few else (lambda x: x)
    keep = ["_lat", "_lon", *(["_c"] if by_country else [])]
    todo = df.filter(good("lat", "lon")).select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), *([F.col("Country").alias("_c")] if by_country else [])).distinct()
    parts: list[DataFrame] = []
    for size in (cell, 4 * cell, 16 * cell, None):
        whole = size is None
        place = lambda c: F.lit(0).cast("bigint") if whole else F.floor(F.col(c) / size)  # noqa: E731, B023
        steps = (0,) if whole else (-1, 0, 1)
        near = F.explode(F.array(*[F.struct((place("_lat") + i).alias("i"), (place("_lon") + j).alias("j")) for i in steps for j in steps])).alias("_n")
        cells = b.withColumns({"_i": place("_y"), "_j": place("_x")})
        # a cell's buses as one list, if they are few in all
        lists = cells.groupBy("_i", "_j", *area).agg(F.collect_list(F.struct("bus", "_x", "_y")).alias("_list")) if few else cells.withColumn("_list", F.array(F.struct("bus", "_x", "_y")))
        on = (F.col("_n.i") == F.col("_i")) & (F.col("_n.j") == F.col("_j"))
        if by_country:
            on = on & (F.col("_c") == F.col("_country"))
        best = F.array_min(F.transform("_list", lambda z: F.struct(((z["_x"] - F.col("_lon")) * (z["_x"] - F.col("_lon")) + (z["_y"] - F.col("_lat")) * (z["_y"] - F.col("_lat"))).alias("d"), z["bus"].alias("bus"))))
        met = todo.select("*", near).join(hint(lists), on, "left")
        # each ring is written, so that the next does not repeat it
        found = Cut(met.groupBy(*keep).agg(F.min(best).alias("_best")), "ring").df
        sure = F.lit(True)
        if not whole:
            # nothing outside the nine cells is nearer than the border of the middle one's ring
            edge = F.least(F.pmod(F.col("_lat"), F.lit(size)), size - F.pmod(F.col("_lat"), F.lit(size)), F.pmod(F.col("_lon"), F.lit(size)), size - F.pmod(F.col("_lon"), F.lit(size))) + size
            sure = F.coalesce(F.col("_best.d") <= edge * edge, F.lit(False))
        parts.append(found.filter(sure).select(*keep, F.col("_best.bus").alias("bus")))
        todo = found.filter(~sure).select(*keep)
        if todo.limit(1).count() == 0:
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    same = (df["lat"] == F.col("_lat")) & (df["lon"] == F.col("_lon"))
    if by_country:
        same = same & df["Country"].eqNullSafe(F.col("_c"))
    return df.join(out, same, "left").select(*[df[c] for c in df.columns], "bus")


def network_parts(df: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Stores and generators aggregated by bus, fuel and set, CHP counted as PP: capacity summed, duration weighted by it.
    Rows without a duration count in the weights, as if theirs were 0; missing capacities count as 0."""
    keys = keys or ["bus", "Fueltype", "Set"]
    df = df.withColumn("Set", F.when(F.col("Set") == "CHP", "PP").otherwise(F.col("Set"))).dropna(subset=keys)
    capacity = F.coalesce(F.sum("Capacity"), F.lit(0.0))
    aggs = [capacity.alias("Capacity")]
    if "Duration" in df.columns:
        aggs.append(F.try_divide(F.coalesce(F.sum(F.col("Duration") * F.col("Capacity")), F.lit(0.0)), capacity).alias("Duration"))
    named = model_names(df.groupBy(*keys).agg(*aggs))
    store = F.col("component").isin("Store", "Storage")
    return named.filter(store), named.filter(~store)


def model_names(df: DataFrame) -> DataFrame:
    """Columns in the vocabulary of network models, carriers in lower case."""
    # The model's names of the fields.
    names = {"Fueltype": "carrier", "Capacity": "p_nom", "Duration": "max_hours", "Set": "component"}
    out = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    return out.withColumn("carrier", F.lower("carrier"))


# Short names of fuels.
FUEL_ABBREVIATIONS = {
    "Solid Biomass": "BIO", "Biogas": "BIG", "Geothermal": "GEO", "Hard Coal": "COA", "Hydro": "HYD", "Lignite": "LIG", "Natural Gas": "NG", "Nuclear": "NUC", "Oil": "OIL", "Other": "OTH", "Solar": "", "Waste": "WST", "Wind": "WO",
}


# Years a type of plant runs; a CHP plant lives as long as a plant of its kind without heat.
TIMES_LIFE = {
    "COA": 45, "LIG": 45, "NG-OCGT": 40, "NG-ST": 40, "NG-CCGT": 40, "OIL": 40, "NUC": 50, "BIO": 25, "HYD-ROR": 200, "HYD-STO": 200, "HYD-PST": 200, "WON": 25, "WOF": 25,
    "SPV": 30, "CSP": 30, "WST": 30, "SYN": 5, "CAES": 40, "GEO": 30, "OTH": 5,
}
#: Kinds that exist with heat too.
TIMES_HEAT = ["COA", "LIG", "NG-OCGT", "NG-ST", "NG-CCGT", "OIL", "BIO", "WST", "SYN", "GEO", "OTH"]


def times_types(df: DataFrame) -> DataFrame:
    """``df`` with ``TimesType``: ConELC, CHP or PP, the fuel's short name and for some fuels what its technology tells; null
    for fuels without a short name. ``Life`` is the type's lifetime and ``YearRetire`` the later of DateRetrofit and DateIn
    plus it; known years of German nuclear plants replace it."""
    from regfuse.operators.heuristics import known_retire_years

    has = lambda t: F.contains(F.lower(F.coalesce("Technology", F.lit(""))), F.lit(t))
    detail = {
        "Wind": F.when(has("offshore"), "F").otherwise("N"),
        "Solar": F.when(has("csp"), "CSP").otherwise("SPV"),
        "Natural Gas": F.when(has("ccgt"), "-CCGT").when(has("ocgt"), "-OCGT").otherwise("-ST"),
        "Hydro": F.when(has("pumped storage"), "-PST").when(has("run-of-river"), "-ROR").otherwise("-STO"),
    }
    more = F.lit("")
    for fuel, x in detail.items():
        more = F.when(F.col("Fueltype") == fuel, x).otherwise(more)
    short = F.try_element_at(F.create_map(*[F.lit(x) for kv in FUEL_ABBREVIATIONS.items() for x in kv]), F.col("Fueltype"))
    heat = F.contains(F.coalesce("Set", F.lit("")), F.lit("CHP"))
    kind = F.concat(short, more)
    lives = F.create_map(*[F.lit(x) for kv in TIMES_LIFE.items() for x in (kv[0], float(kv[1]))])
    out = df.withColumns({"TimesType": F.concat(F.when(heat, "ConELC-CHP_").otherwise("ConELC-PP_"), kind), "Life": F.when(~heat | kind.isin(TIMES_HEAT), F.try_element_at(lives, kind))})
    return known_retire_years(out.withColumn("YearRetire", F.coalesce("DateRetrofit", "DateIn") + F.col("Life")))


def times_stock(df: DataFrame, first: int = 2015, last: int = 2050, step: int = 5) -> DataFrame:
    """Capacity in service by ``TimesType, Region`` and every ``step`` years: plants built by the base year that have not
    retired. Regions are country codes, Denmark in two."""
    from regfuse.functions.vocab import country_code
    from regfuse.operators.heuristics import denmark_regions

    base = df.filter(F.coalesce(F.col("DateIn") <= first, F.lit(True)))
    named = times_types(denmark_regions(base)).withColumn("Region", F.coalesce("Region", country_code("Country"))).dropna(subset=["TimesType", "Region"])
    years = named.withColumn("Year", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step)))).filter(F.col("YearRetire") > F.col("Year"))
    return years.groupBy("TimesType", "Region", "Year").agg(F.sum("Capacity").alias("Capacity"))


def stock_by_year(df: DataFrame, lifetimes: dict[str, float], first: int, last: int, step: int = 5) -> DataFrame:
    """Capacity in service every ``step`` years by fuel, a column for each country (long: ``Year, Fueltype, Country,
    Capacity``). A plant serves from DateIn until DateOut, else for its fuel's lifetime after DateIn or DateRetrofit."""
    years = F.create_map(*[F.lit(x) for kv in lifetimes.items() for x in (kv[0], float(kv[1]))])
    end = F.coalesce("DateOut", F.greatest("DateIn", "DateRetrofit") + F.try_element_at(years, F.col("Fueltype")))
    live = df.dropna(subset=["DateIn", "Country", "Fueltype"]).withColumn("_end", end).withColumn("Year", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))))
    live = live.filter((F.col("DateIn") <= F.col("Year")) & F.coalesce(F.col("_end") > F.col("Year"), F.lit(True)))
    return live.groupBy("Year", "Fueltype", "Country").agg(F.round(F.sum("Capacity"), 3).alias("Capacity"))


def plausible_stock(stock: DataFrame) -> DataFrame:
    """Country and fuel pairs whose stock grows from one year to a later one though nothing may be built: ``Fueltype, Country, Year``."""
    w = W.partitionBy("Fueltype", "Country").orderBy("Year")
    return stock.withColumn("_last", F.lag("Capacity").over(w)).filter(F.col("Capacity") > F.col("_last")).select("Fueltype", "Country", "Year")


def active_in(df: DataFrame, year: int) -> DataFrame:
    """Plants in service in a year; a missing date contradicts nothing."""
    from regfuse.plans.predicates import compile_query

    return df.filter(compile_query("(DateIn <= @y or DateIn != DateIn) and (DateOut >= @y or DateOut != DateOut)", {"y": float(year)}))


def coverage(df: DataFrame, statistics: DataFrame, keys: list[str]) -> DataFrame:
    """Own and stated totals by key, their difference (limited to ±1 GW) and the share covered."""
    own, stat = (x.dropna(subset=keys).groupBy(*keys).agg(F.sum("Capacity").alias(n)) for x, n in ((df, "own"), (statistics, "stated")))
    both = own.join(stat, keys, "full_outer").fillna(0.0, ["own", "stated"])
    diff = F.greatest(F.least(F.col("own") - F.col("stated"), F.lit(1000.0)), F.lit(-1000.0))
    return both.select(*keys, F.round("own", 3).alias("own"), F.round("stated", 3).alias("stated"), F.round(diff, 3).alias("difference"), F.round(F.try_divide("own", "stated"), 6).alias("share"))
