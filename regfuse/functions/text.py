"""Cleaning names and classifying free text into vocabularies, as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regfuse.schema import TARGET_FUELTYPES, TARGET_SETS, TARGET_TECHNOLOGIES

# Latin letters with a stroke or without a dot, which do not decompose.
STROKES = {"Ł": "L", "ł": "l", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "Ŧ": "T", "ŧ": "t", "ı": "i"}
#: Accented Latin letters up to U+024F and the plain ones they decompose to.
_PAIRS = [(chr(k), unicodedata.normalize("NFKD", chr(k))[0]) for k in range(0xC0, 0x250)]
_PAIRS = [(a, b) for a, b in _PAIRS if b.isascii() and b.isalpha() and a != b] + list(STROKES.items())
ACCENTED, PLAIN = ("".join(x) for x in zip(*_PAIRS))
# Letters written as two.
DIGRAPHS = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th"}
# Roman numbers of blocks.
ROMAN = {"I": "1", "II": "2", "III": "3", "IV": "4", "V": "5", "VI": "6", "VII": "7", "VIII": "8", "IX": "9", "X": "10", "XI": "11"}
# Words removed from names.
NAME_WORDS = [
    "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "parque", "grupo", "station", "power", "plant", "unit", "block", "kraftwerk", "kernkraftwerk", "wehrkraftwerk",
    "rheinkraftwerk", "gemeinschaftskernkraftwerk", "kernkw", "kw", "hkw", "nuclear", "hydro", "thermal", "heizkraftwerk", "eolico", "project", "hydroelectric", "hydropower", "hydroelectrique",
    "hydraulique", "embassament", "pumped", "storage", "france", "austria", "sweden", "serbia", "ukraine", "switzerland", "slovakia", "croatia", "poland", "slovenia", "portugal", "bosnia", "and",
    "herzegovina", "bulgaria", "generating", "romania", "macedonia", "latvia", "lithuania", "hungary",
]
FUELS_WITH_BLOCKS = ["Nuclear"]


def transliterate(c: Column) -> Column:
    """Latin letters without accents."""
    for k, v in DIGRAPHS.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.translate(c, ACCENTED, PLAIN)


def title(c: Column) -> Column:
    """Words with a capital first letter, a word being a run of letters: ``b2b`` becomes ``B2B``."""
    marked = F.regexp_replace(F.lower(c), r"(?<![a-z])([a-z])", "\u0001$1")
    parts = F.split(marked, "\u0001")
    return F.concat_ws("", F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x))))))


def cleaned_name(name: str | Column = "Name", fuel: str | Column = "Fueltype", words: list[str] | None = None, keep_blocks: list[str] | None = None, remove_duplicated_words: bool = True) -> Column:
    """A name without non-letters, words that say nothing and single letters; names of ``keep_blocks`` fuels keep
    digits and single letters. Null becomes the empty string."""
    words = NAME_WORDS if words is None else words
    keep_blocks = FUELS_WITH_BLOCKS if keep_blocks is None else keep_blocks
    n = transliterate(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    for roman, arabic in ROMAN.items():
        n = F.regexp_replace(n, rf"\b{roman}\b", arabic)
    fuel = F.col(fuel) if isinstance(fuel, str) else fuel
    kept = F.coalesce(fuel.isin(keep_blocks), F.lit(False)) if keep_blocks else F.lit(False)
    drop = "|".join(rf"\b{w}\b" for w in words)
    plain = F.regexp_replace(F.regexp_replace(n, "[^a-zA-Z]", " "), rf"(?i){drop}|\b\w\b", "")
    block = F.regexp_replace(F.regexp_replace(n, "[^a-zA-Z0-9]", " "), f"(?i){drop}", "")
    n = F.when(kept, block).otherwise(plain)
    twice = r"(?i)\b(\w+)(?:\W\1\b)+"
    if remove_duplicated_words:
        n = F.regexp_replace(n, twice, "$1")
    n = title(F.regexp_replace(F.trim(n), " +", " "))
    return F.regexp_replace(n, twice, "$1") if remove_duplicated_words else n


def clean_name(df: DataFrame, remove_common_words: bool = False, common: int = 20, **options) -> DataFrame:
    """``df`` with ``Name`` cleaned. ``remove_common_words`` also drops words found at least ``common`` times in all names."""
    words = list(NAME_WORDS)
    if remove_common_words:
        seen = df.select(F.explode(F.split(transliterate(F.coalesce("Name", F.lit(""))), r"\s+")).alias("w")).filter(F.col("w").rlike("^[A-Za-z]+$")).groupBy("w").count()
        words += [r.w for r in seen.filter(F.col("count") >= common).collect()]
    return df.withColumn("Name", cleaned_name(words=words, **options))


def pattern_of(key: str, pattern: str | list[str]) -> str:
    """A vocabulary entry as a regular expression: "" is the key as a word, a list any of its words, a string itself."""
    if pattern == "":
        return rf"(?iUu)\b{key}\b"
    if isinstance(pattern, list):
        return "(?iUu)" + "|".join(rf"\b{p}\b" for p in pattern)
    return "(?U)" + pattern


def classify(columns: list[str], mapping: dict[str, str | list[str]]) -> Column:
    """The last entry of ``mapping`` whose pattern is found in any of the text ``columns``; null if none is."""
    cases = []
    for key, p in reversed(mapping.items()):
        if p == ".*":
            cases.append(F.lit(key))
            continue
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.col(c).rlike(pattern_of(key, p)), F.lit(False))
        cases.append(F.when(hit, F.lit(key)))
    return F.coalesce(*cases) if cases else F.lit(None).cast("string")


def gather_and_replace(df: DataFrame, mapping: dict[str, str | list[str]], columns: list[str] | None = None, out: str = "gathered") -> DataFrame:
    """``df`` with the class found in its text columns as ``out``."""
    columns = columns or [c for c, t in df.dtypes if t == "string"]
    return df.withColumn(out, classify(columns, mapping))


def gather_specifications(df: DataFrame, search: list[str] | None = None) -> DataFrame:
    """Fueltype, Technology and Set classified from the original text columns; none sees the others' results."""
    search = search or [c for c in ("Name", "Fueltype", "Technology", "Set") if c.lower() in map(str.lower, df.columns)]
    return df.withColumns({"Fueltype": classify(search, TARGET_FUELTYPES), "Technology": classify(search, TARGET_TECHNOLOGIES), "Set": classify(search, TARGET_SETS)})


def gather_fueltype_info(df: DataFrame, search: list[str] | None = None) -> DataFrame:
    return df.withColumn("Fueltype", classify(search or ["Fueltype"], TARGET_FUELTYPES))


def gather_technology_info(df: DataFrame, search: list[str] | None = None) -> DataFrame:
    return df.withColumn("Technology", classify(search or ["Technology", "Fueltype"], TARGET_TECHNOLOGIES))


def gather_set_info(df: DataFrame, search: list[str] | None = None) -> DataFrame:
    return df.withColumn("Set", classify(search or ["Name", "Fueltype", "Technology"], TARGET_SETS))


def cleaned_technology(c: str | Column = "Technology", generalize_hydros: bool = False) -> Column:
    """One claim of a technology text, its parts sorted; null stays null."""
    t = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(F.regexp_replace(t, " and ", ", "), " Power Plant|Battery", "")
    rules = []
    if generalize_hydros:
        rules += [("pump", "Pumped Storage"), ("reservoir|lake", "Reservoir"), ("run-of-river|weir|water", "Run-Of-River"), ("dam", "Reservoir")]
    rules += [("^Gas turbine$", "OCGT"), ("combined cycle|combustion", "CCGT"), ("steam turbine|critical thermal", "Steam Turbine"), ("ocgt|open cycle", "OCGT")]
    # each rule sees the one before it: the whole text is replaced where the rule's words are found
    for p, v in rules:
        case = "" if p.startswith("^") else "(?is)"
        t = F.regexp_replace(t, f"{case}^.*(?:{p}).*$" if not p.startswith("^") else p, v)
    parts = F.array_sort(F.array_distinct(F.split(title(t), ", ")))
    t = F.array_join(F.transform(parts, lambda x: F.trim(x)), ", ")
    # Abbreviations spelled in their own way.
    own = {"Ccgt": "CCGT", "Ocgt": "OCGT", "Pv": "PV", "Nas": "NaS", "Nicd": "NiCd", "Nanicl": "NaNiCl", "Caes": "CAES"}
    for k, v in own.items():
        t = F.regexp_replace(t, f"^{k}$", v)
    return F.when((F.col(c) if isinstance(c, str) else c).isNotNull(), t)


def clean_technology(df: DataFrame, generalize_hydros: bool = False) -> DataFrame:
    return df.withColumn("Technology", cleaned_technology(generalize_hydros=generalize_hydros))
