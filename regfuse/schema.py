"""The common schema of all registers and the vocabularies its fields are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The target columns and their types.
COLUMNS = {
    "Name": "string", "Fueltype": "string", "Technology": "string", "Set": "string", "Country": "string", "Capacity": "double", "Efficiency": "double",
    "DateIn": "double", "DateRetrofit": "double", "DateOut": "double", "lat": "double", "lon": "double", "Duration": "double", "Volume_Mm3": "double",
    "DamHeight_m": "double", "StorageCapacity_MWh": "double", "EIC": "string", "projectID": "string",
}
PLANT_SCHEMA = T.StructType([T.StructField(c, T.DoubleType() if t == "double" else T.StringType()) for c, t in COLUMNS.items()])

# Fuel classes with the words that tell them; later entries win. "" stands for the class name itself.
TARGET_FUELTYPES: dict[str, str | list[str]] = {
    "Other": ".*",
    "Solid Biomass": ["biological", "bioenergy", "agricultural", "biomass", "feste biomasse", "biomasa", "biomassa", "feste biogene stoffe", "pellets", "stroh", "straw"],
    "Biogas": ["biogas", "biogaz", "biomethan", "gasförmige biomasse"],
    "Nuclear": ["nuclear", "kernkraft", "atomkraft", "nucléaire", "atomowa", "jądrowa", "kjernekraft", "atoom"],
    "Natural Gas": ["ccgt", "gas", "natural gas", "ocgt", "lng", "combined cycle", "fossil gas", "mixed fossil fuels", "erdgas", "andere gase", "gaz", "gaz naturel", "gas natural", "naturgass", "gaz ziemny", "gass", "aardgas", "flüssiggas"],
    "Hydro": ["run-off", "run off", "run of river", "run-of-river", "ror", "hydro", "hidro", "hydraulique", "hydroelectric", "wasserkraft", "waterkracht", "wasser", "vannkraft", "vattenkraft", "wodna", "idroelettrica", "idraulica"],
    "Hard Coal": ["coal", "coke", "steinkohle", "houille", "charbon dur", "hulla", "carbón duro", "carbone duro", "antracite", "steinkul", "węgiel kamienny", "steenkool"],
    "Lignite": ["brown coal", "lignite", "peat", "braunkohle", "ligni.*", "brunatny", "brunkul", "bruinkool"],
    "Oil": ["oil", "diesel", "biodiesel", "methanol", "heizöl", "ethanol", "mineralölprodukte", "öl", "fioul", "mazout", "petrol", "olio", "olej", "carburante", "olie"],
    "Geothermal": "",
    "Solar": "",
    "Waste": ["abfall.*", "waste", "mva", "müll", "afval", "affald", "energy recovery", "incineration", "reststoffe", "refuse", "déchets", "ordures", "residuos", "basura", "rifiuti", "scarti", "odpady", "śmieci", "abfälle"],
    "Wind": "",
    "Battery": ["Electro-chemical", "battery"],
    "Mechanical Storage": "",
    "Heat Storage": "",
    "Hydrogen Storage": "",
}
# Kinds of use. The storage class is called Store throughout; Storage is its alias.
TARGET_SETS: dict[str, str | list[str]] = {
    "PP": ".*",
    "CHP": ["heizkraftwerk", "hkw", "kwk", "fhkw", "gud", "hp", "bhkw", "cogeneration", "power and heat", "heat and power", "chp", "cogen", "heat & power", "power & heat", "cogeneración", "cogenerazione", "kogeneracja", "combinada calor y electricidad", "kraftvarmeverk", "kraftvarmeværk", "samproduktion", "samproduksjon", "kvv", "wkk", "warmtekrachtkoppeling", "warmte-krachtcentrale"],
    "Store": ["battery", "storage", "store", "speicher", "pumped"],
}
# Technologies.
TARGET_TECHNOLOGIES: dict[str, str | list[str]] = {
    "CCGT": ["ccgt", "gas", "natural gas", "gasturbinen mit abhitzekessel"],
    "OCGT": ["ocgt", "gasturbinen ohne abhitzekessel"],
    "Steam Turbine": ["steam", "turbine", "kondensationsmaschine", "gegendruckmaschine", "dampfmotor"],
    "Combustion Engine": ["combustion engine", "verbrennungsmotor", "stirlingmotor"],
    "Run-Of-River": ["run-off", "run off", "run of river", "run-of-river", "ror", "laufwasseranlage", "laufwasser", "abwasserkraft", "trinkwassersystem", "brauchwassersystem", "pasada", "przepływowa", "fluente", "elvekraft", "doorstroom", "älvkraft"],
    "Reservoir": ["reservoir", "réservoir", "impoundment", "talsperre", "stausee", "speicherwasseranlage", "speicherwasser", "barrage", "embalse", "bacino", "zbiornik", "magasinverk", "damkraftverk", "reguleringsmagasin"],
    "Pumped Storage": ["pumped hydro", "pumped", "kavernen", "bombeo", "reversible", "reversibel", "oberbecken", "unterbecken", "pompage", "pompaggio", "pompowa", "pumpekraftverk"],
    "Marine": "",
    "PV": ["pv", "photo-voltaic", "photo voltaic"],
    "CSP": "",
    "Onshore": ["onshore", "an land", "terrestre", "landvind", "på land", "op land", "lądowy", "su terra", "en tierra", "à terre"],
    "Offshore": ["offshore", "nearshore", "auf see", "en mer", "marino", "en mar", "in mare", "morski", "havvind", "til havs", "på havet", "op zee", "zeewind"],
}
# Years a plant of a fuel runs.
FUEL_TO_LIFETIME = {
    "Solid Biomass": 20, "Biogas": 20, "Geothermal": 15, "Hard Coal": 45, "Hydro": 100, "Lignite": 45, "Natural Gas": 40, "Nuclear": 50, "Oil": 40, "Other": 5, "Solar": 25, "Waste": 25, "Wind": 25,
}
MAIN_QUERY = "Name != '' and (lat >= 30 or lat != lat)"


def conform(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``df`` in the target schema: missing columns null, extra ones dropped but for those in ``keep``; NaN becomes null."""
    have = {c.lower(): c for c in df.columns}
    cols: list[Column] = []
    for c, t in COLUMNS.items():
        if c.lower() not in have:
            cols.append(F.lit(None).cast(t).alias(c))
            continue
        src = F.col(f"`{have[c.lower()]}`")
        kind = dict(df.dtypes)[have[c.lower()]]
        if kind.startswith(("array", "map")):
            cols.append(src.alias(c))
        else:
            v = src.cast(t) if kind == t else F.expr(f"try_cast(`{have[c.lower()]}` as {t})")
            cols.append((F.when(~F.isnan(v), v) if t == "double" else v).alias(c))
    return df.select(*[F.col(f"`{k}`") for k in keep or []], *cols)


def from_table(df: DataFrame) -> DataFrame:
    """The stacked test table in the target schema, with ``row_id`` and ``source`` (the register) in front."""
    return conform(df.withColumnsRenamed({"set_type": "Set", "source_name": "source"}), keep=["row_id", "source"])
