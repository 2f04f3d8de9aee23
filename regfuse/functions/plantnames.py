"""Names of plants taken apart: place words, site qualifier, kind of plant; block and type words fall away."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regfuse.session import maybe_broadcast

# Letters that Unicode does not decompose.
LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ħ": "h", "ŋ": "n"}

# Words that name a kind of plant, without accents, by the fuel class they tell ("" tells none).
TYPE_WORDS = {
    "Wind": "wind windpark windfarm vindpark eolico eolica eolien eolienne wiatrowa windkraft windkraftanlage wf wp windp vindkraft vindkraftverk fw eol wpk",
    "Solar": "solar solarpark solarfarm solpark solaire solare sloneczna photovoltaikanlage photovoltaique fotovoltaica fotovoltaico zonnepark pv pva psf solarp zp sf solarkraftwerk",
    "Hydro": "hydro hydroelectric hydroelectrique hidroelectrica idroelettrica wasserkraftwerk laufwasserkraftwerk laufkraftwerk vattenkraftverk wodna barrage embalse hpp hep hps wkw lwk wasserkr wmd dam reservoir pumpspeicherwerk",
    "Nuclear": "nuclear nucleaire kernkraftwerk karnkraftverk npp nps kkw akw",
    "Battery": "battery batteriespeicher bess batt speicher",
    "Biogas": "biogasanlage biogas bga",
    "Waste": "mullheizkraftwerk mhkw mullverbrennung",
    "": "power station plant farm park generating parc parque parco kraftwerk kraftverk heizkraftwerk kraftvarmeverk kraftstation farma elektrownia elektrocieplownia central centrale thermique termica termico termoelettrica termoelectrica impianto planta warmtekrachtcentrale storage anlage usine usina installation "
    "stn vp ps kvv plt gs pp pe pwr gen cle centr ct krv kraftw kv kw hkw heizkw ew el sp ec pl ch cn wkc wk st chp bhkw ltd gmbh ag spa sa se ab as plc inc co the",
}
# Words before the number of a block, and words that join.
BLOCK_WORDS = "block bl blok unit units einheit grupo gruppo gr groupe tranche unidad unita turbine generator aggregat g no nr".split()
FILLERS = "am de an der du del di da do la le les von van den na nad upon on of im in".split()
# Site qualifiers without accents, by their sense.
QUALIFIERS = {
    "N": "north nord norra norte norr noord polnoc northern", "S": "south sud sued sodra sur zuid southern", "E": "east ost est este ostra oost eastern",
    "W": "west ouest oeste vastra vast ovest western", "U": "upper ober obere oberes ovre amont alto superior haut superieur", "L": "lower unter untere unteres nedre aval bajo inferior bas",
    "OLD": "old alt alte altes vieux viejo gamla vecchio stary", "NEW": "new neu neue neues nouveau nuevo nya nuovo nowy",
}

_TYPE = {w: fuel for fuel, words in TYPE_WORDS.items() for w in words.split()}
_QUAL = {w: q for q, words in QUALIFIERS.items() for w in words.split()}
_BLOCK, _FILL = frozenset(BLOCK_WORDS), frozenset(FILLERS)
_ROMAN = re.compile(r"^(?:x{0,2}(?:ix|iv|v?i{0,3}))$")
_UNIT = re.compile(r"^(?:u|bl|gr|kw|g)?(?:\d{1,3}|x{0,2}(?:ix|iv|v?i{0,3})|[a-h])$")
_INITIALS = re.compile(r"\b(?:[^\W\d_]\.\s?){2,}")
_WORD = re.compile(r"[^\W_]+\.?")


class _Folded(dict):
    """What each letter becomes, found when it is first met: its base letters without marks."""

    def __missing__(self, code: int) -> str:
        ch = LETTERS.get(chr(code), chr(code))
        self[code] = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        return self[code]


_FOLDED = _Folded()


def fold(text: str) -> str:
    """Lower case without accents, ä as a, ß as ss."""
    return text.lower() if text.isascii() else text.lower().translate(_FOLDED)


def _deletes(w: str) -> set[str]:
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}


_NEAR: dict[str, set[str]] = {}
for _w in [*_TYPE, *(x for x in _QUAL if len(x) >= 5)]:
    if len(_w) >= 5:
        for _d in _deletes(_w):
            _NEAR.setdefault(_d, set()).add(_w)
_NEAR_KEYS = frozenset(_NEAR)
_ENDS = {end for _w in [*_TYPE, *_QUAL] if len(_w) >= 5 for k in (-1, 0, 1) for end in ((_w[:2], len(_w) + k), (_w[-2:], -len(_w) - k))}


def one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


@lru_cache(maxsize=500_000)
def word(w: str) -> tuple[str, str]:
    """A folded word as (role, value): type, qual or place; misread digits and single typos of type words are mended."""
    if not w.isdigit() and any(ch.isdigit() for ch in w) and len(w) >= 4:
        w = w.replace("0", "o").replace("1", "l").replace("5", "s")
    tries = [w] + ([w.replace("rn", "m")] if "rn" in w else []) + ([w.replace("m", "in"), w.replace("m", "rn")] if "m" in w and len(w) >= 5 else []) + ([re.sub("([aou])e", r"\1", w)] if re.search("[aou]e", w) else [])
    for t in tries:
        if t in _QUAL:
            return "qual", _QUAL[t]
        if t in _TYPE:
            return "type", _TYPE[t]
    if len(w) >= 4:
        for t in tries:
            # one edit leaves the first two letters or the last two as they are
            found = ((t[:2], len(t)) in _ENDS or (t[-2:], -len(t)) in _ENDS) and _deletes(t) & _NEAR_KEYS
            near = found and sorted({x for d in found for x in _NEAR[d] if one_edit(t, x)}, key=lambda x: (abs(len(x) - len(t)), x))
            if near:
                x = near[0]
                if x in _QUAL:
                    return "qual", _QUAL[x]
                return "type", _TYPE[x]
    return "place", re.sub("([aou])e", r"\1", w)


@lru_cache(maxsize=500_000)
def token(raw: str) -> tuple[str, str, bool, str, str, int]:
    """A folded word with its full stop, if any, as (the word; block, fill, number or ""; may it number a block; role and
    value of :func:`word`; 1 if the full stop marks an abbreviation, 2 if it does unless it ends the name)."""
    w = raw.rstrip(".")
    unit = bool(_UNIT.match(w))
    if w in _BLOCK:
        return w, "block", unit, "", "", 0
    if w in _FILL:
        return w, "fill", unit, "", "", 0
    if len(w) == 1 or w.isdigit() or (len(w) <= 5 and unit) or (len(w) <= 4 and _ROMAN.match(w)):
        return w, "number", w.isdigit() or unit, "", "", 0
    role, value = word(w)
    return w, "", unit, role, value, (1 if len(value) <= 4 else 2 if len(value) <= 6 else 0) if raw[-1] == "." else 0


def parse(name: str | None, drop: frozenset[str] = frozenset()) -> tuple[list[str], str, str, bool]:
    """A name as (place words in order, qualifiers joined, fuel class told by type words, a block is named).

    ``drop`` holds further words that name no place (operators, found by :func:`company_words`). Abbreviated place
    words keep their full stop. Null and empty names give no words."""
    if not name:
        return [], "", "", False
    text = _INITIALS.sub(lambda m: re.sub(r"[.\s]", "", m.group()) + " ", name) if "." in name else name
    places: list[str] = []
    quals: set[str] = set()
    fuel, block, after_block = "", False, False
    words = _WORD.findall(fold(text))
    for raw in words:
        w, kind, unit, role, value, short = token(raw)
        if kind == "block":
            block = after_block = True
            continue
        if after_block:
            after_block = False
            if unit:
                continue
        if kind == "fill" or w in drop:
            continue
        if kind == "number":
            block = block or unit
        elif role == "type":
            fuel = fuel or value
        elif role == "qual":
            quals.add(value)
        elif value and value not in drop:
            places.append(value + "." if short and (short == 1 or raw != words[-1]) else value)
    return places, ",".join(sorted(quals)), fuel, block


PARSED = "struct<places:array<string>,qual:string,kind:string>"


def parsed(name: str | Column, drop: frozenset[str] = frozenset()) -> Column:
    """Column of :func:`parse`: a struct of place words, qualifiers and the fuel class the name tells."""

    @F.pandas_udf(PARSED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cached = lru_cache(maxsize=100_000)(lambda n: parse(n, drop))
        for s in batches:
            rows = [cached(n if isinstance(n, str) else None) for n in s]
            yield pd.DataFrame({"places": [r[0] for r in rows], "qual": [r[1] for r in rows], "kind": [r[2] for r in rows]})

    return run(F.col(name) if isinstance(name, str) else name)


def parsed_text(name: str | Column) -> Column:
    """:func:`parsed` with the place words in one string, a blank between them."""

    @F.pandas_udf("struct<places:string,qual:string,kind:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [parse(n) for n in s]
            yield pd.DataFrame({"places": [" ".join(r[0]) for r in rows], "qual": [r[1] for r in rows], "kind": [r[2] for r in rows]})

    return run(F.col(name) if isinstance(name, str) else name)


def company_words(places: DataFrame, min_rows: int = 8, spread: float = 1.2) -> frozenset[str]:
    """Words of names that belong to companies: they stand beside ever different other words.

    ``places`` has one column ``places``, an array of place words. A company's name stands beside two or more words, so
    only words found in ``min_rows`` rows of three or more words are looked at (the least evidence, whatever the size
    of the table); for those, all rows are counted. A word is a company's if its distinct companions are at least
    ``spread`` times its rows, which no place reaches, however many units it has. Companies are few: the result is a
    set of words in the driver, everything before it stays in the cluster."""
    listed = places.select(F.array_distinct("places").alias("places"))
    often = listed.filter(F.size("places") >= 3).select(F.explode("places").alias("w")).groupBy("w").count().filter(F.col("count") >= min_rows).select("w")
    beside = listed.select(F.explode("places").alias("w"), "places").join(maybe_broadcast(often, often.count()), "w", "left_semi")
    pairs = beside.select("w", F.explode("places").alias("o")).groupBy("w", "o").count()
    # a word stands beside itself in each of its rows
    sums = pairs.groupBy("w").agg(F.sum(F.when(F.col("w") == F.col("o"), F.col("count"))).alias("n"), (F.count(F.lit(1)) - 1).alias("d"))
    return frozenset(r.w for r in sums.filter(F.col("d") >= spread * F.col("n")).toLocalIterator())
