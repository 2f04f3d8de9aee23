"""What counts as missing in register fields: nulls, NaN, blanks and stand-in values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of "not known" in text fields, compared in lower case without blanks around.
UNKNOWN_TEXT = [
    "", "-", "--", "---", "?", "??", "???", ".", "..", "...", "*", "_", "/", "#n/a", "#na", "0",
    "n/a", "na", "n.a.", "n.a", "n/k", "n.k.", "nan", "none", "null", "nil", "tbd", "tba", "tbc", "t.b.d.",
    "unknown", "not known", "not available", "not specified", "unspecified", "undefined", "missing", "no data",
    "unbekannt", "unbek.", "k.a.", "k. a.", "keine angabe", "inconnu", "inconnue", "desconocido", "desconocida",
    "sconosciuto", "desconhecido", "nieznany", "nieznane", "okänd", "okänt", "ukjent", "ukendt", "onbekend", "xxx", "x",
]

#: Bounds of what a position or year of a European plant can be.
LAT_RANGE = (27.0, 82.0)
LON_RANGE = (-32.0, 70.0)
YEAR_RANGE = (1850.0, 2035.0)
# Capacities that stand for "not known".
CAPACITY_STAND_INS = [99999.0, 999999.0, 9999999.0, 99999999.0, 999999999.0, 88888.0, 888888.0]


def text_missing(c: str | Column) -> Column:
    """True for null, blank or "not known" text; never null."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.lower(F.trim(F.regexp_replace(c, r"[\s\u00a0]+", " ")))
    return F.coalesce(t.isin(UNKNOWN_TEXT), F.lit(True))


def _out(c: Column, low: float, high: float) -> Column:
    return F.coalesce(F.isnan(c) | (c < low) | (c > high), F.lit(True))


def lat_missing(lat: str | Column = "lat") -> Column:
    """True where the latitude is null, NaN or outside Europe (0, ±999, ±9999 and the like); never null."""
    return _out(F.col(lat) if isinstance(lat, str) else lat, *LAT_RANGE)


def lon_missing(lat: str | Column = "lat", lon: str | Column = "lon") -> Column:
    """True where the longitude is null, NaN or outside Europe, or 0 beside a missing latitude (the point 0, 0).

    Longitude 0 beside a true latitude is the Greenwich meridian and stays."""
    x = F.col(lon) if isinstance(lon, str) else lon
    return _out(x, *LON_RANGE) | ((x == 0) & lat_missing(lat))


def year_missing(c: str | Column) -> Column:
    """True where a year is null, NaN or no year a plant can have (-1, 0, 1, 99, 2999, 9999 and the like)."""
    return _out(F.col(c) if isinstance(c, str) else c, *YEAR_RANGE)


def capacity_missing(c: str | Column = "capacity") -> Column:
    """True where a capacity is null, NaN, infinite, not positive or a stand-in. A wrong unit is no stand-in."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.isnan(c) | (c <= 0) | (c > 1e12) | c.isin(CAPACITY_STAND_INS), F.lit(True))


def field_missing(name: str) -> Column:
    """The rule for one of the register's fields by its name."""
    rules = {
        "lat": lambda: lat_missing(),
        "lon": lambda: lon_missing(),
        "capacity": lambda: capacity_missing(),
        "datein": lambda: year_missing("datein"),
        "dateretrofit": lambda: year_missing("dateretrofit"),
        "dateout": lambda: year_missing("dateout"),
    }
    return rules[name]() if name in rules else text_missing(name)
