"""Importers of register families as declarations over the generic one; raw files are the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfuse.functions.text import classify
from regfuse.functions.vocab import country_name
from regfuse.operators.fuse import first_by
from regfuse.plans.predicates import compile_query
from regfuse.schema import TARGET_FUELTYPES, TARGET_SETS, TARGET_TECHNOLOGIES
from regfuse.sources.registry import Source, register_source


def year(c: str):
    """A year from the first four characters of a text; none before 1901."""
    y = F.expr(f"try_cast(substring(`{c}`, 1, 4) as double)")
    return F.when(y > 1900, y)


def percent(c: str):
    """A percentage as a share."""
    return F.expr(f"try_cast(replace(`{c}`, '%', '') as double)") / 100


def number(c: str):
    return F.expr(f"try_cast(`{c}` as double)")


def positive(c):
    return F.when(c > 0, c)


def units_and_plants(units: DataFrame, plants: DataFrame, key: str = "projectID", suffix: str = "_ppl") -> DataFrame:
    """Units with their plant's fields, and the plants that have no unit."""
    named = plants.select(F.col(key), *[F.col(c).alias(c + suffix if c in units.columns else c) for c in plants.columns if c != key])
    joined = units.join(named, key, "left")
    alone = plants.join(units.select(key).distinct(), key, "left_anti")
    return joined.unionByName(alone, allowMissingColumns=True)


def apportion_storage(storage: DataFrame, units: DataFrame, volume: str = "NutzbareSpeicherkapazitaet", links: str = "VerknuepfteEinheit", key: str = "projectID") -> DataFrame:
    """Units with ``StorageCapacity``: each storage's volume shared evenly by the units its comma-separated text names."""
    ids = F.filter(F.transform(F.split(links, ","), lambda x: F.trim(x)), lambda x: x != "")
    shares = storage.withColumn("_ids", ids).filter(F.size("_ids") > 0).select(F.explode("_ids").alias(key), (F.col(volume) / F.size("_ids")).alias("_v"))
    return units.join(shares.groupBy(key).agg(F.sum("_v").alias("StorageCapacity")), key, "left")


def fill_from_postcodes(df: DataFrame, postcodes: DataFrame, key: str = "Postleitzahl") -> DataFrame:
    """Missing positions from those of the postcode (padded to five digits)."""
    places = postcodes.select(F.lpad(F.col("PLZ").cast("string"), 5, "0").alias("_plz"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).dropDuplicates(["_plz"])
    out = df.join(F.broadcast(places), F.lpad(F.col(key).cast("string"), 5, "0") == F.col("_plz"), "left")
    return out.withColumns({"lat": F.coalesce("lat", "_lat"), "lon": F.coalesce("lon", "_lon")}).drop("_plz", "_lat", "_lon")


def postcode_to_position(postcodes: DataFrame) -> DataFrame:
    return postcodes.select("PLZ", "lat", "lon").dropDuplicates(["PLZ"])


_TEXT = ["Name", "Fueltype", "Technology"]


def _gathered(df: DataFrame, search: list[str] | None = None) -> DataFrame:
    cols = [c for c in (search or _TEXT) if c in df.columns]
    return df.withColumns({"Fueltype": classify(cols, TARGET_FUELTYPES), "Technology": classify(cols, TARGET_TECHNOLOGIES), "Set": classify(cols, TARGET_SETS)})


def _two_regions(eu: DataFrame, de: DataFrame) -> DataFrame:
    """A European list without the German rows, and a German one. Rows of the European list whose name is an identifier of
    the German one are left out, as they are in it in the right form. The European years count as retrofits too."""
    eu = eu.withColumnsRenamed({"name": "Name", "energy_source": "Fueltype", "technology": "Technology", "country": "Country", "capacity": "Capacity", "eic_code": "EIC", "commissioned": "DateIn"})
    eu = eu.filter(compile_query("Country != 'DE' and not Name.str.startswith('BNA')")).withColumn("DateRetrofit", F.col("DateIn"))
    de = de.withColumn("Name", F.coalesce("name_bnetza", "name_uba")).withColumn("Fueltype", F.coalesce("energy_source", "fuel")).withColumnsRenamed({"technology": "Technology", "country_code": "Country", "capacity_net_bnetza": "Capacity", "id": "projectID", "commissioned": "DateIn", "shutdown": "DateOut"})
    return _gathered(eu.unionByName(de, allowMissingColumns=True)).withColumn("Country", country_name("Country"))


def _without_other_lists(df: DataFrame) -> DataFrame:
    """A world-wide list without the rows it took from lists that are sources of their own."""
    # How it names those.
    others = ["GEODB", "Open Power System Data", "ENTSOE"]
    if "source" in df.columns:
        df = df.filter(~F.coalesce(F.col("source").isin(others), F.lit(False)))
    return _gathered(df.withColumnsRenamed({"name": "Name", "primary_fuel": "Fueltype"}))


def _planned(df: DataFrame, year: int = 2027) -> DataFrame:
    """Plants under construction ("In Bau") with the year they are expected in."""
    if "Status" not in df.columns:
        return df
    return df.withColumn("DateIn", F.when(F.coalesce(F.contains("Status", F.lit("In Bau")), F.lit(False)), F.lit(float(year))).otherwise(number("DateIn")))


def _observatory(units: DataFrame, plants: DataFrame) -> DataFrame:
    df = units_and_plants(units, plants)
    out = df.withColumns({"DateIn": year("DateIn"), "Capacity": number("Capacity")})
    if "Efficiency" in out.columns:
        out = out.withColumn("Efficiency", percent("Efficiency"))
    return _gathered(out)


def _hydro_list(df: DataFrame) -> DataFrame:
    """Hydro plants: durations from storage, pumped ones are stores, huge Spanish ones reservoirs."""
    cap, volume = positive(number("installed_capacity_MW")), positive(number("storage_capacity_MWh"))
    kind = F.col("type")
    tech = F.when((F.col("country_code") == "ES") & (volume > 50_000) & (kind == "HROR"), "HDAM").otherwise(kind)
    named = F.when(tech == "HDAM", "Reservoir").when(tech == "HROR", "Run-Of-River").when(tech == "HPHS", "Pumped Storage")
    return df.withColumns({"Capacity": cap, "StorageCapacity_MWh": volume, "Duration": F.try_divide(volume, cap), "Technology": named, "Fueltype": F.lit("Hydro"), "Set": F.when(tech.isin("HPHS", "HDAM"), "Store").otherwise("PP"), "Country": country_name("country_code"), "DamHeight_m": positive(number("dam_height_m")), "Volume_Mm3": positive(number("volume_Mm3"))})


def _tracker(df: DataFrame) -> DataFrame:
    """A tracker's sheets: status words, retirement from the first of three columns, heat rate to efficiency."""
    have = set(df.columns)
    retire = F.coalesce(*[number(c) for c in ("RETIRED", "Planned Retire", "Retired year") if c in have], F.lit(None).cast("double"))
    rate = F.try_divide(F.lit(3412.14), number("Heat rate (Btu per kWh)")) if "Heat rate (Btu per kWh)" in have else F.lit(None).cast("double")
    name = F.concat_ws(" ", F.col("Plant name"), F.col("Unit name")) if {"Plant name", "Unit name"} <= have else F.col("Project Name") if "Project Name" in have else F.col("Name")
    return _gathered(df.withColumns({"Name": name, "DateOut": retire, "Efficiency": rate}), ["Name", "Fueltype", "Technology"]).withColumn("Country", F.coalesce(country_name("Country"), F.col("Country")))


def _unit_register(df: DataFrame) -> DataFrame:
    """A national register of units in kW: names from the first of three fields, ends of service by status, CHP by
    its thermal power, durations of stores."""
    have = set(df.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    cap = number("Nettonennleistung") / 1000
    chp = F.coalesce(get("KwkMastrNummer").isNotNull() | (F.try_to_number(get("ThermischeNutzleistung"), F.lit("999999999D999")) > 0), F.lit(False))
    volume = (number("StorageCapacity") / 1000) if "StorageCapacity" in have else F.lit(None).cast("double")
    done = F.coalesce(F.year(F.try_to_timestamp(get("DatumEndgueltigeStilllegung"))), F.when(get("EinheitBetriebsstatus") == "VoruebergehendStillgelegt", F.year(F.try_to_timestamp(get("DatumBeginnVoruebergehendeStilllegung")))))
    out = df.withColumns({"Name": F.coalesce(get("NameKraftwerk"), get("NameWindpark"), get("NameStromerzeugungseinheit")), "Capacity": cap, "DateIn": F.year(F.try_to_timestamp(get("Inbetriebnahmedatum"))).cast("double"), "DateOut": done.cast("double"), "StorageCapacity_MWh": volume, "Duration": F.try_divide(volume, cap), "Country": F.lit("Germany")})
    out = out.withColumns({"Fueltype": F.coalesce(get("Energietraeger"), get("Hauptbrennstoff")), "Technology": F.coalesce(get("Technologie"), get("ArtDerWasserkraftanlage"), get("Lage"))})
    fuel = F.when(F.col("Fueltype").rlike("(?iu)solar"), "Solar").when(F.col("Fueltype").rlike("(?iu)wind"), "Wind").when(F.col("Fueltype").rlike("(?iu)speicher"), "Battery").when(F.col("Fueltype").rlike("(?iu)biomasse"), "Solid Biomass")
    return _gathered(out).withColumns({"Fueltype": F.coalesce(fuel, "Fueltype"), "Set": F.when(fuel == "Battery", "Store").when(chp, "CHP").otherwise(F.col("Set"))})


def _storage_projects(df: DataFrame) -> DataFrame:
    """Storage projects from nested JSON: the technology's parent tells the fuel."""
    parent = F.col("technology_parentName")
    fuel = F.when(parent.rlike("(?i)electro-?chemical"), "Battery").when(parent.rlike("(?i)hydro|pumped"), "Hydro").when(parent.rlike("(?i)thermal"), "Heat Storage").when(parent.rlike("(?i)hydrogen|chemical"), "Hydrogen Storage").when(parent.rlike("(?i)mechanical"), "Mechanical Storage")
    power = number("power")
    return df.withColumns({"Capacity": power, "StorageCapacity_MWh": number("capacity"), "Duration": F.try_divide(number("capacity"), power), "Fueltype": fuel, "Technology": F.col("technology_name"), "Set": F.lit("Store"), "Country": F.coalesce(country_name("facility_country"), F.col("facility_country"))})


def _statistics(df: DataFrame) -> DataFrame:
    return df.withColumn("Fueltype", classify(["Fueltype"], TARGET_FUELTYPES)).filter("Fueltype <> 'Other'").withColumn("Country", F.coalesce(country_name("Country"), F.col("Country")))


def _prefix_countries(df: DataFrame) -> DataFrame:
    """A transparency platform's list: one row per identifier, the country from its first two letters."""
    one = first_by(df, ["projectID"], [F.col("Name").asc_nulls_last()])
    return _gathered(one.withColumn("Country", F.coalesce(country_name(F.substring("Country", 1, 2)), country_name("Country"))))


def _lakes(df: DataFrame) -> DataFrame:
    """Reservoirs: the plant's name before a dash, else the dam's; cubic kilometres to millions of cubic metres."""
    name = F.coalesce(F.trim(F.element_at(F.split("plant_name", " - "), 1)), F.col("dam_name"))
    return df.withColumns({"Name": name, "Volume_Mm3": number("volume_km3") * 1000, "Fueltype": F.lit("Hydro"), "Technology": F.lit("Reservoir"), "Set": F.lit("Store")})


# Declared sources: the raw layouts they expect are the renames and the columns their preparation reads.
for _s in [
    Source("OPSD", prepare=_two_regions, drop_null=["Capacity"], reliability=5),
    Source("GEO", prepare=_observatory, reliability=3),
    Source("JRC", prepare=_hydro_list, rename={"id": "projectID", "name": "Name"}, reliability=4),
    Source("GPD", prepare=_without_other_lists, rename={"gppd_idnr": "projectID", "country_long": "Country", "capacity_mw": "Capacity", "latitude": "lat", "longitude": "lon", "commissioning_year": "DateIn"}, reliability=3),
    Source("ENTSOE", prepare=_prefix_countries, query="Capacity > 0", reliability=5),
    Source("ENTSOE_EIC", rename={"EicCode": "EIC", "EicDisplayName": "Name", "MarketParticipantIsoCountryCode": "Country"}, clean_names=False, reliability=1),
    Source("CARMA", rename={"Geoid": "projectID", "Company": "Company"}, reliability=1),
    Source("BEYONDCOAL", prepare=_tracker, status=("status", ["open", "retired"]), reliability=6),
    Source("WIKIPEDIA", prepare=_planned, assign={"Fueltype": "'Nuclear'", "Technology": "'Steam Turbine'", "Set": "'PP'"}, reliability=4),
    Source("OSM", prepare=_gathered, reliability=3),
    Source("MASTR", prepare=_unit_register, reliability=7),
    Source("EESI", prepare=_storage_projects, rename={"id": "projectID", "title": "Name", "facility_latitude": "lat", "facility_longitude": "lon"}, status=("status", ["Operational", "Under Construction"]), reliability=5),
    Source("GND", rename={"Latitude": "lat", "Longitude": "lon"}, assign={"Fueltype": "'Nuclear'"}, reliability=4),
    Source("GHR", prepare=_lakes, reliability=3),
    Source("IRENASTAT", prepare=_statistics, clean_names=False, reliability=1),
    Source("CAPACITY_STATS", prepare=_statistics, clean_names=False, reliability=1),
    *[Source(n, prepare=_tracker, status=("Status", ["operating", "construction", "retired", "mothballed"]), rename={"Latitude": "lat", "Longitude": "lon", "Capacity (MW)": "Capacity", "Start year": "DateIn", "GEM location ID": "projectID"}, reliability=6) for n in ("GBPT", "GNPT", "GCPT", "GGTPT", "GWPT", "GSPT", "GGPT", "GHPT", "GEM")],
    Source("OPSD_VRE", assign={"DateIn": "try_cast(substring(commissioning_date, 1, 4) as double)", "Set": "'PP'"}, rename={"electrical_capacity": "Capacity", "energy_source_level_2": "Fueltype", "technology": "Technology"}, reliability=2),
    Source("EXTERNAL_DATABASE", reliability=1),
]:
    register_source(_s)
