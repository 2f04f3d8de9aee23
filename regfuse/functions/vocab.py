"""Controlled vocabularies: countries and fuels in their many spellings."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The countries of the target area as (ISO 2, ISO 3, short name).
COUNTRIES = [
    ("AL", "ALB", "Albania"), ("AT", "AUT", "Austria"), ("BA", "BIH", "Bosnia and Herzegovina"), ("BE", "BEL", "Belgium"),
    ("BG", "BGR", "Bulgaria"), ("CH", "CHE", "Switzerland"), ("CZ", "CZE", "Czechia"), ("DE", "DEU", "Germany"),
    ("DK", "DNK", "Denmark"), ("EE", "EST", "Estonia"), ("ES", "ESP", "Spain"), ("FI", "FIN", "Finland"),
    ("FR", "FRA", "France"), ("GB", "GBR", "United Kingdom"), ("GR", "GRC", "Greece"), ("HR", "HRV", "Croatia"),
    ("HU", "HUN", "Hungary"), ("IE", "IRL", "Ireland"), ("IT", "ITA", "Italy"), ("LT", "LTU", "Lithuania"),
    ("LU", "LUX", "Luxembourg"), ("LV", "LVA", "Latvia"), ("MD", "MDA", "Moldova"), ("ME", "MNE", "Montenegro"),
    ("MK", "MKD", "North Macedonia"), ("NL", "NLD", "Netherlands"), ("NO", "NOR", "Norway"), ("PL", "POL", "Poland"),
    ("PT", "PRT", "Portugal"), ("RO", "ROU", "Romania"), ("RS", "SRB", "Serbia"), ("SE", "SWE", "Sweden"),
    ("SI", "SVN", "Slovenia"), ("SK", "SVK", "Slovakia"), ("UA", "UKR", "Ukraine"), ("XK", "XKX", "Kosovo"),
]
# Other names of countries, in lower case.
COUNTRY_ALIASES = {
    "el": "GR", "uk": "GB", "great britain": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "northern ireland": "GB",
    "deutschland": "DE", "allemagne": "DE", "alemania": "DE", "germania": "DE", "tyskland": "DE", "niemcy": "DE",
    "frankreich": "FR", "francia": "FR", "españa": "ES", "espana": "ES", "spanien": "ES", "espagne": "ES",
    "italia": "IT", "italien": "IT", "italie": "IT", "polska": "PL", "polen": "PL", "pologne": "PL",
    "österreich": "AT", "osterreich": "AT", "oesterreich": "AT", "autriche": "AT", "schweiz": "CH", "suisse": "CH", "svizzera": "CH",
    "sverige": "SE", "schweden": "SE", "suède": "SE", "norge": "NO", "noreg": "NO", "norwegen": "NO", "norvège": "NO",
    "danmark": "DK", "dänemark": "DK", "suomi": "FI", "finnland": "FI", "hellas": "GR", "ellada": "GR", "griechenland": "GR", "ελλάδα": "GR",
    "the netherlands": "NL", "nederland": "NL", "holland": "NL", "niederlande": "NL", "pays-bas": "NL",
    "belgique": "BE", "belgië": "BE", "belgie": "BE", "belgien": "BE", "czech republic": "CZ", "česko": "CZ", "cesko": "CZ", "česká republika": "CZ", "tschechien": "CZ",
    "slovensko": "SK", "slowakei": "SK", "slovak republic": "SK", "slovenija": "SI", "slowenien": "SI", "hrvatska": "HR", "kroatien": "HR",
    "srbija": "RS", "србија": "RS", "serbien": "RS", "bosna i hercegovina": "BA", "bosnia": "BA", "bosnia & herzegovina": "BA", "bosnia-herzegovina": "BA",
    "magyarország": "HU", "magyarorszag": "HU", "ungarn": "HU", "românia": "RO", "rumänien": "RO", "roumanie": "RO",
    "българия": "BG", "balgariya": "BG", "bulgarien": "BG", "україна": "UA", "ukraina": "UA", "éire": "IE", "eire": "IE", "irland": "IE", "republic of ireland": "IE",
    "eesti": "EE", "estland": "EE", "latvija": "LV", "lettland": "LV", "lietuva": "LT", "litauen": "LT", "shqipëria": "AL", "shqiperia": "AL", "albanien": "AL",
    "macedonia": "MK", "makedonija": "MK", "severna makedonija": "MK", "fyrom": "MK", "crna gora": "ME", "republic of moldova": "MD", "moldavia": "MD",
    "luxemburg": "LU", "lëtzebuerg": "LU", "kosova": "XK", "kosovë": "XK",
}

# Fuel classes and words that name them, in lower case.
FUEL_WORDS = {
    "Hydro": ["hydro", "hidro", "wasserkraft", "run of river", "run-of-river", "hydropower", "water", "wasser", "hydraulique", "hydroelectric", "idroelettrico", "vattenkraft", "reservoir", "pumped storage", "ror"],
    "Solar": ["solar", "solaire", "solar pv", "photovoltaik", "photovoltaic", "pv", "solare", "sonne", "fotovoltaica", "sol", "csp"],
    "Wind": ["wind", "windkraft", "éolien", "eolien", "eólica", "eolica", "eolico", "onshore", "offshore", "vind", "wiatr"],
    "Natural Gas": ["natural gas", "natural-gas", "gas", "erdgas", "gaz naturel", "gas natural", "gaz", "ccgt", "ocgt", "naturgas", "metano"],
    "Solid Biomass": ["solid biomass", "biomass", "feste biomasse", "biomasse", "biomasa", "biomassa", "wood", "holz"],
    "Biogas": ["biogas", "biogaz", "landfill gas", "sewage gas", "klärgas", "biogás"],
    "Hard Coal": ["hard coal", "coal", "steinkohle", "houille", "kohle", "charbon", "carbon", "carbón", "hulla", "kol"],
    "Lignite": ["lignite", "braunkohle", "brown coal", "lignito"],
    "Oil": ["oil", "fioul", "heizöl", "heizol", "petroleum", "diesel", "fuel oil", "olja", "mazut"],
    "Waste": ["waste", "abfall", "rifiuti", "déchets", "dechets", "residuos", "müll", "avfall"],
    "Nuclear": ["nuclear", "kernkraft", "nucléaire", "nucleaire", "uranium", "kärnkraft"],
    "Battery": ["battery", "batterie", "batteriespeicher", "bateria", "batteri", "li", "storage"],
    "Geothermal": ["geothermal", "geothermie", "géothermie", "geotermia"],
}
# The fuel class a technology implies where it implies one.
TECHNOLOGY_FUELS = {"pv": "Solar", "csp": "Solar", "onshore": "Wind", "offshore": "Wind", "pumped storage": "Hydro", "reservoir": "Hydro", "run-of-river": "Hydro", "ccgt": "Natural Gas", "ocgt": "Natural Gas", "li": "Battery"}


def _lookup(values: dict[str, str], c: Column) -> Column:
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.try_element_at(m, c)


def _clean(c: str | Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[\s ]+", " ")))


def country_code(c: str | Column) -> Column:
    """ISO 2 code of a country in any of its spellings; null for unknown ones."""
    names = {x.lower(): a for a, b, n in COUNTRIES for x in (a, b, n)}
    return _lookup(COUNTRY_ALIASES | names, _clean(c))


def country_name(c: str | Column) -> Column:
    """Short name of a country in any of its spellings; null for unknown ones."""
    return _lookup({a: n for a, _, n in COUNTRIES}, country_code(c))


def fuel_class(fuel: str | Column, technology: str | Column | None = None) -> Column:
    """Fuel class of a raw fuel text, else the one the technology implies; null if neither tells."""
    own = _lookup({w: k for k, words in FUEL_WORDS.items() for w in words}, _clean(fuel))
    return own if technology is None else F.coalesce(own, _lookup(TECHNOLOGY_FUELS, _clean(technology)))
