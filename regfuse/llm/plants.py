"""Rows of registers prepared for matching, keys under which rows of one plant meet, and the exact comparison of two.

*Keys.* Two names of one plant share a place word, or agree in half of each of two words. The index therefore holds
every place word whole, and for every two words of a name what is left if of each all but its first two or all but its
last four letters are deleted: an edit, abbreviation, short form or misread letter leaves one of the two as it is, so
that both sides keep the same. Where an edit can touch both, in words of up to six letters, and for names of one word the
index of one register's rows holds what single deleted letters leave, too. A name that runs two words together is indexed under its beginning and each
two letters that can begin its second word. Keys carry what must be equal (qualifier, country); a
row of unknown country is indexed under its words and their heads in every country.

*Join.* What cannot be one plant by country, fuel or position is dropped in the join itself, so a bucket's pairs never
leave its task unless they may match; adaptive execution splits hot buckets. Keys depend on the two rows only: the same
pairs meet whatever the number of rows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regfuse.functions.missing import capacity_missing, lat_missing, lon_missing
from regfuse.functions.plantnames import company_words, one_edit, parsed_text
from regfuse.functions.vocab import COUNTRIES, FUEL_WORDS, country_code, fuel_class
from regfuse.session import Cut

#: Names that only may be one are taken for one at so many kilometres.
CLOSE_KM = 3.0
#: Records of one plant lie no farther apart (blocks, other entrances, coarse coordinates).
PLANT_KM = 6.0
#: Letters of a word's head and tail.
HEAD, TAIL = 2, 4


def prepare(plants: DataFrame) -> tuple[Cut, DataFrame]:
    """The registers' rows as ``id, source, name, cc, fuel, qual, places, lat, lon, cap``, written once; ``places`` is a
    text of the name's place words. ``name`` is a hash; an unknown country, fuel, capacity or position is null."""
    known = ~lat_missing() & ~lon_missing()
    clean = plants.select(
        F.col("row_id").alias("id"),
        F.coalesce("source_name", F.lit("")).alias("source"),
        F.xxhash64("name").alias("name"),
        country_code("country").alias("cc"),
        fuel_class("fueltype", "technology").alias("fuel"),
        F.when(known, F.col("lat")).alias("lat"),
        F.when(known, F.col("lon")).alias("lon"),
        F.when(~capacity_missing(), F.col("capacity")).alias("cap"),
        parsed_text("name").alias("n"),
    )
    kind = F.nullif("n.kind", F.lit(""))
    kept = Cut(clean.select("*", "n.places", "n.qual", F.coalesce("fuel", kind).alias("_fuel")).drop("n", "fuel").withColumnRenamed("_fuel", "fuel"), "plants")
    words = F.split("places", " ")
    rows = kept.df
    drop = company_words(rows.select(words.alias("places")))
    if drop:
        rows = rows.withColumn("places", F.array_join(F.filter(words, lambda x: ~x.isin(sorted(drop))), " "))
    return kept, rows.filter("places <> ''")


# Numbers of countries and fuel classes, from 1; 0 is unknown.
_CC = {a: i + 1 for i, (a, _, _) in enumerate(COUNTRIES)}
_FUELS = {f: i + 1 for i, f in enumerate(FUEL_WORDS)}
#: Kilometres a degree of latitude has, and steps of packed positions a kilometre; the corner they count from.
DEGREE_KM, STEPS, SOUTH, WEST = 111.195, 100, 27.0, -32.0
#: What every row has under its keys, besides its source where sources must differ.
PAYLOAD = ("id", "info", "w1", "w2", "rest")


def _number(values: dict[str, int], c: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(c)), F.lit(0)).cast("bigint")


def packed_info() -> Column:
    """A row in one number, from the low end: longitude (21 bits) and latitude (20) in steps of 10 m at the equator from
    the corner, 0 if unknown; whether the name has two whole words (1); fuel (5) and country (6), 0 if unknown. A key adds its kind (2): the name's
    first word, its second, or another."""
    at = lambda c, low: F.coalesce(F.round((F.col(c) - low) * (DEGREE_KM * STEPS)).cast("bigint") + 1, F.lit(0))
    plain = (F.col("w1") != "") & (F.col("w2") != "") & (F.col("rest") == "") & ~F.contains("places", F.lit("."))
    return at("lon", WEST) + F.shiftleft(at("lat", SOUTH), 21) + F.shiftleft(plain.cast("bigint"), 41) + F.shiftleft(_number(_FUELS, "fuel"), 42) + F.shiftleft(_number(_CC, "cc"), 47)


def _bits(p: str, at: int, bits: int) -> Column:
    return F.shiftright(F.col(p + "info"), at).bitwiseAND(F.lit((1 << bits) - 1))


def _km2() -> Column:
    """The square of the distance of two rows (flat, as they are near); without meaning if a position is unknown."""
    y1, y2 = _bits("a_", 21, 20), _bits("b_", 21, 20)
    dx = (_bits("a_", 0, 21) - _bits("b_", 0, 21)) * F.cos((y1 + y2) * (0.5 / STEPS / DEGREE_KM * pi / 180) + SOUTH * pi / 180)
    return ((y1 - y2) * (y1 - y2) + dx * dx) * (1.0 / STEPS / STEPS)


def _placed() -> Column:
    return (_bits("a_", 0, 41) > 0) & (_bits("b_", 0, 41) > 0)


def _without(w: Column, k: Column | int) -> Column:
    """A word without its letter number ``k``."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.concat(w.substr(F.lit(1), k - 1), w.substr(k + 1, F.length(w)))


def all_deleted(w: Column) -> Column:
    """A word and all that deleting one of its letters leaves: two words within one edit share one of these."""
    return F.array_distinct(F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: _without(w, k))))


def deleted(w: Column) -> Column:
    """Those of :func:`all_deleted`, marked, that two words of four letters or more within one edit need to share
    one where neither their first two letters nor their last four are the same.

    In words of seven letters and more an edit leaves one of these halves whole. In one of six only a swap of its second
    and third letter touches both: without either of them both spellings leave the same two words, of which the smaller
    is kept. In shorter ones the edit stands in the first three letters."""
    mark = lambda *ws: F.transform(F.array(*ws), lambda x: F.concat(F.lit("d"), x))
    size = F.length(w)
    return F.when(size < 6, mark(w, *[_without(w, k) for k in (1, 2, 3)])).when(size == 6, mark(F.least(_without(w, 2), _without(w, 3)))).otherwise(F.array().cast("array<string>"))


def index_keys(rows: DataFrame, same_source: bool, extra: dict[str, Column]) -> DataFrame:
    """Rows under their keys: ``key``, those of PAYLOAD, the ``source`` unless it is to be the same, and those of ``extra``.

    Within a source (``same_source``) the keys hold the delete index too: see :func:`deleted`."""
    own = [F.col("qual"), *([F.col("source")] if same_source else [])]
    bare = F.col("bare")
    none = F.array().cast("array<struct<key:bigint,kind:int>>")
    head = lambda w: F.substring(w, 1, HEAD)
    tail = lambda w: F.substring(w, -TAIL, TAIL)

    def key(name: str, kind: int, country: Column, *parts: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(name), country, *own, *parts).alias("key"), F.lit(kind).alias("kind"))

    def heads(x: Column, y: Column, country: Column) -> Column:
        return key("heads", 2, country, F.least(x, y), F.greatest(x, y))

    def two(x: Column, y: Column, cc: Column) -> list[Column]:
        """Keys of the heads and tails of two words, in either order alike."""
        tails = key("tails", 2, cc, F.least(tail(x), tail(y)), F.greatest(tail(x), tail(y)))
        return [heads(head(x), head(y), cc), tails, key("mixed", 2, cc, head(x), tail(y)), key("mixed", 2, cc, head(y), tail(x))]

    def crossed(x: Column, y: Column, cc: Column) -> Column:
        """Keys of two words of which one or both have letters deleted, in either order alike."""
        halves = lambda w: F.array(F.concat(F.lit("h"), head(w)), F.concat(F.lit("t"), tail(w)))
        pairs = lambda ps, qs: F.flatten(F.transform(ps, lambda p: F.transform(qs, lambda q: key("deleted", 2, cc, F.least(p, q), F.greatest(p, q)))))
        gone_x, gone_y = deleted(x), deleted(y)
        none_gone = (F.length(x) > 6) & (F.length(y) > 6)
        return F.when(none_gone, none).otherwise(F.concat(pairs(gone_x, F.concat(halves(y), gone_y)), pairs(halves(x), gone_y)))

    def glued(country: Column) -> Column:
        """Heads of the words that a single one may run together."""
        w = F.element_at(bare, 1)
        starts = F.sequence(F.lit(4), F.length(w) - 1)
        return F.when((F.size(bare) == 1) & (F.length(w) >= 7), F.transform(starts, lambda k: heads(head(w), w.substr(k, F.lit(HEAD)), country))).otherwise(none)

    def every_two(keys) -> Column:
        return F.flatten(F.transform(bare, lambda x, i: F.flatten(F.transform(bare, lambda y, j: F.when(i < j, keys(x, y)).otherwise(none)))))

    listed = F.split("places", " ")
    at = lambda i: F.coalesce(F.try_element_at(listed, F.lit(i)), F.lit(""))
    rest = F.when(F.size(listed) > 2, F.array_join(F.slice(listed, 3, F.size(listed)), " ")).otherwise(F.lit(""))
    words = rows.withColumns({"w1": at(1), "w2": at(2), "rest": rest, "bare": F.split(F.replace(F.col("places"), F.lit("."), F.lit("")), " ")})
    # once a row: beside the explosion it would be computed for every key
    words = words.withColumn("_info", packed_info())
    cc, n = F.col("cc"), F.size(bare)
    first, second = F.element_at(bare, 1), F.try_element_at(bare, F.lit(2))
    single = [key("word", 0, cc, first), key("head", 2, cc, F.substring(first, 1, HEAD + 1)), key("tail", 2, cc, tail(first))]
    double = F.array(key("word", 0, cc, first), key("word", 1, cc, second), *two(first, second, cc))
    # lists of three and more words are rare: every two of them
    several = F.concat(F.transform(bare, lambda w: key("word", 0, cc, w)), every_two(lambda x, y: F.array(*two(x, y, cc))))
    if same_source:
        single_gone = F.transform(all_deleted(first), lambda d: key("gone", 2, cc, d))
        double, several = F.concat(double, crossed(first, second, cc)), F.concat(several, every_two(lambda x, y: crossed(x, y, cc)))
    else:
        single_gone = none
    # a row of unknown country: words and heads under every country, and under none for others of that kind
    countries = F.array(*[F.lit(c) for c in [*_CC, ""]])
    wholes = F.flatten(F.transform(bare, lambda w: F.transform(countries, lambda c: key("word", 2, c, w))))
    anywhere = F.concat(wholes, every_two(lambda x, y: F.transform(countries, lambda c: heads(head(x), head(y), c))), F.flatten(F.transform(countries, glued)))
    keys = F.when(cc.isNull(), anywhere).when(n == 2, double).when(n == 1, F.concat(F.array(*single), single_gone, glued(cc))).otherwise(several)
    payload = ["id", "w1", "w2", "rest", *([] if same_source else ["source"]), *[c.alias(k) for k, c in extra.items()]]
    out = words.select(*payload, "_info", F.explode(keys).alias("_k"))
    info = F.col("_info") + F.shiftleft(F.col("_k.kind").cast("bigint"), 53)
    return out.select("_k.key", info.alias("info"), *[c for c in out.columns if c not in ("_info", "_k")])


def meeting(keys: DataFrame, same_source: bool, extra: list[str], apart_share: int = 0) -> DataFrame:
    """Pairs of rows that share a key and may be one plant: ``one`` < ``other``, the columns of PAYLOAD and ``extra`` under
    the prefixes ``a_`` and ``b_``, for :func:`compared`. A pair with an equal word comes once, others once for each key
    they share.

    With ``apart_share`` (a power of two) one in so many of the pairs that lie too far apart comes too (as known
    strangers). The condition is kept small, as code over 8,000 bytes would not be compiled."""
    columns = ("key", *PAYLOAD, *([] if same_source else ["source"]), *extra)
    sides = [keys.select([F.col(c).alias(p + c) for c in columns]) for p in ("a_", "b_")]
    either = lambda at, bits: (_bits("a_", at, bits) == _bits("b_", at, bits)) | (_bits("a_", at, bits) == 0) | (_bits("b_", at, bits) == 0)
    near = _km2() <= PLANT_KM**2
    if apart_share:
        mixed = F.col("a_id").bitwiseXOR(F.shiftright("b_id", 3)).bitwiseXOR(F.col("b_id"))
        near = near | (mixed.bitwiseAND(apart_share - 1) == 0)
    # what costs least first
    on = (F.col("a_key") == F.col("b_key")) & (F.col("a_id") < F.col("b_id")) & either(42, 5) & either(47, 6)
    if not same_source:
        on = on & (F.col("a_source") != F.col("b_source"))
    met = sides[0].join(sides[1], on & (~_placed() | near) & ~_met_before() & may_agree())
    return met.select(F.col("a_id").alias("one"), F.col("b_id").alias("other"), *[p + c for p in ("a_", "b_") for c in (*PAYLOAD[1:], *extra)])


def compared(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Agreement of the place words of pairs from :func:`meeting`, and their distance in km (NaN: unknown)."""
    lists = [[(u, v, *r.split()) if v else (u,) for u, v, r in zip(pdf[p + "w1"], pdf[p + "w2"], pdf[p + "rest"])] for p in ("a_", "b_")]
    agreement = np.array([1.0 if x == y else places_match(x, y) for x, y in zip(*lists)], dtype=float)
    a, b = (pdf[p + "info"].to_numpy(np.int64) & ((1 << 41) - 1) for p in ("a_", "b_"))
    y1, y2, x1, x2 = a >> 21, b >> 21, a & ((1 << 21) - 1), b & ((1 << 21) - 1)
    dx = (x1 - x2) * np.cos(np.radians((y1 + y2) * (0.5 / STEPS / DEGREE_KM) + SOUTH))
    return agreement, np.where((a > 0) & (b > 0), np.sqrt((y1 - y2) ** 2 + dx**2) / STEPS, np.nan)


def _met_before() -> Column:
    """Whether two names of two whole words also meet under an equal word that comes before this key."""
    kind = _bits("a_", 53, 2)
    equal = lambda w: (F.col(w) == F.col("b_w1")) | (F.col(w) == F.col("b_w2"))
    # rows of unknown country have their words under other kinds
    sure = (_bits("a_", 41, 1) == 1) & (_bits("b_", 41, 1) == 1) & (_bits("a_", 47, 6) > 0) & (_bits("b_", 47, 6) > 0)
    return sure & (kind >= 1) & (equal("a_w1") | ((kind == 2) & equal("a_w2")))


def may_agree() -> Column:
    """A cheap condition that all pairs with agreeing place words fulfil: they lie close together, or two names of two
    whole words each have an order in which both words begin alike or are within four edits (two swaps of letters)."""
    a1, a2, b1, b2 = (F.col(c) for c in ("a_w1", "a_w2", "b_w1", "b_w2"))
    like = lambda v, w: (F.substring(v, 1, 3) == F.substring(w, 1, 3)) | (F.levenshtein(v, w, 4) >= 0)
    plain = _bits("a_", 41, 1).bitwiseAND(_bits("b_", 41, 1)) == 1
    return ~plain | (_km2() <= CLOSE_KM**2) | (like(a1, b1) & like(a2, b2)) | (like(a1, b2) & like(a2, b1))


@lru_cache(maxsize=500_000)
def _letters(w: str) -> int:
    out = 0
    for ch in w:
        out |= 1 << (ord(ch) & 63)
    return out


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or ``most`` + 1 if it is larger.

    What both begin and end with is left out; a column of the table is two numbers, whose bits tell where it goes up and
    down (Hyyrö)."""
    x, y = _letters(a), _letters(b)
    # an edit changes the set of letters by one on each side at most
    if abs(len(a) - len(b)) > most or (x & ~y).bit_count() > most or (y & ~x).bit_count() > most:
        return most + 1
    n, m = len(a), len(b)
    while n and m and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    start = 0
    while start < n and start < m and a[start] == b[start]:
        start += 1
    a, b = a[start:n], b[start:m]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, zero, before, distance, left = full, 0, 0, 0, len(a), len(b)
    for ch in b:
        match = at.get(ch, 0)
        swapped = ((~zero & match) << 1) & before
        zero = (((match & up) + up) ^ up) | match | down | swapped
        right, back = down | ~(zero | up) & full, zero & up
        left -= 1
        if right & last:
            distance += 1
        elif back & last:
            distance -= 1
        # each letter that is left lowers it by one at most
        if distance - left > most:
            return most + 1
        right = (right << 1 | 1) & full
        up, down, before = (back << 1 | ~(zero | right)) & full, right & zero, match
    return distance


@lru_cache(maxsize=500_000)
def word_match(x: str, y: str) -> float:
    """How well two place words agree: 1 equal, 0.9 abbreviation or one edit, 0.7 two edits in long words or the
    same stem with another ending (short forms), 0 else."""
    if x == y:
        return 1.0
    a, b = x.rstrip("."), y.rstrip(".")
    if x.endswith(".") or y.endswith("."):
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if long.startswith(short):
            return 0.9
        if len(short) >= 4 and one_edit(short, long[: len(short)]):
            return 0.7
        return 0.0
    if a == b:
        return 1.0
    if min(len(a), len(b)) >= 4 and one_edit(a, b):
        return 0.9
    if min(len(a), len(b)) >= 7 and osa(a, b, 2) <= 2:
        return 0.7
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if k >= 4 and k * 2 >= max(len(a), len(b)) - 2 and max(len(a), len(b)) - k <= 6:
        return 0.6
    return 0.0


# Letters that scanners take for others.
SCAN = [("rn", "m"), ("in", "m"), ("nn", "m"), ("cl", "d"), ("vv", "w"), ("c", "e")]


@lru_cache(maxsize=500_000)
def _scanned(w: str) -> str:
    for bad, good in SCAN:
        w = w.replace(bad, good)
    return w


@lru_cache(maxsize=500_000)
def soft_match(x: str, y: str) -> float:
    """:func:`word_match`, or 0.5 for words that may still be one if all else agrees: misread letters, several edits,
    the same beginning."""
    s = word_match(x, y)
    if s:
        return s
    a, b = x.rstrip("."), y.rstrip(".")
    if not a or not b:
        return 0.0
    if a[:3] == b[:3] and len(a) >= 4 and len(b) >= 4:
        return 0.5
    u, v = _scanned(a), _scanned(b)
    if u == v or one_edit(u, v):
        return 0.6
    if x.endswith(".") or y.endswith("."):
        n = min(len(a), len(b))
        return 0.5 if n >= 4 and osa(a[:n], b[:n], 2) <= 2 else 0.45 * (n >= 3 and a[0] == b[0])
    if min(len(a), len(b)) >= 5 and osa(u, v, 3) <= max(2, min(3, max(len(u), len(v)) // 3)):
        return 0.5
    return 0.45 if a[0] == b[0] and len(a) >= 3 and len(b) >= 3 else 0.0


def _glued(g: str, words: tuple[str, ...]) -> float:
    """A word that runs two others together, one of them perhaps cut short: 0.8 and more, or 0.5 if only like it."""
    best = 0.0
    for x, y in permutations(words, 2):
        x, y = x.rstrip("."), y.rstrip(".")
        if g.startswith(x) and len(g) >= len(x) + 2 and y.startswith(g[len(x) :]):
            return 0.9
        if g.endswith(y) and len(g) >= len(y) + 2 and x.startswith(g[: -len(y)]):
            return 0.9
        whole = (x + y)[: len(g)]
        if len(g) >= len(x) + 2 and (one_edit(g, whole) or one_edit(g, (x + y)[: len(g) + 1]) or one_edit(g, (x + y)[: len(g) - 1])):
            best = max(best, 0.8)
        if len(g) >= 7 and ((g[:4] == x[:4] and y[:3] in g[3:]) or (g[:3] == x[:3] and y[:4] in g[3:])):
            best = max(best, 0.5)
    return best


def _worth(scores: list[float], whole: bool) -> float:
    """The agreement of two lists whose aligned words have these scores; ``whole``: none is left over."""
    scores = sorted(scores)
    if scores[0] < 0.45 or (scores[0] < 0.5 and scores[1] < 0.9):
        return 0.0
    if scores[0] < 0.6 or (scores[0] < 0.9 and scores[1] < 0.9):
        return 0.5 if scores[-1] >= 0.9 else 0.45
    return sum(scores) / len(scores) * (1.0 if whole else 0.9)


def assignment(score: list[list[float]]) -> list[int]:
    """The column of each row in the assignment of rows to different columns with the largest total (Hungarian method
    with potentials); not more rows than columns."""
    n, m = len(score), len(score[0])
    u, v, row_of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, before, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            done[j0] = True
            i0, step, j1 = row_of[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not done[j]:
                    cost = -score[i0 - 1][j - 1] - u[i0] - v[j]
                    if cost < least[j]:
                        least[j], before[j] = cost, j0
                    if least[j] < step:
                        step, j1 = least[j], j
            for j in range(m + 1):
                if done[j]:
                    u[row_of[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            j0 = j1
            if not row_of[j0]:
                break
        while j0:
            row_of[j0] = row_of[before[j0]]
            j0 = before[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


@lru_cache(maxsize=500_000)
def places_match(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Agreement of two lists of place words by their best assignment, in any order; 0 if they name other places.

    Above 0.5: the lists name one place. The shorter one is then matched whole; a list of one word may be two run
    together; at most one word agrees weakly (stem or two edits). Up to 0.5: they may name one place, if the rows
    lie close together: one word agrees well or both somewhat. Lists of any length are compared whole."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        if len(b) == 1:
            s = soft_match(a[0], b[0])
            return s if s >= 0.9 or (s >= 0.7 and len(a[0]) >= 9) else 0.5 * (s >= 0.5 and len(a[0]) >= 7)
        return _glued(a[0].rstrip("."), b)
    if len(a) == 2 == len(b):
        best = 0.0
        for p, q in ((0, 1), (1, 0)):
            s = soft_match(a[0], b[p])
            if s >= 0.45:
                best = max(best, _worth([s, soft_match(a[1], b[q])], True))
                if best >= 0.9:
                    break
        return best
    score = [[soft_match(x, y) for y in b] for x in a]
    if len(b) <= 4:
        return max(_worth([score[i][j] for i, j in enumerate(p)], len(a) == len(b)) for p in permutations(range(len(b)), len(a)))
    # below 0.45 a word is not matched at all
    at = assignment([[s if s >= 0.45 else -10.0 for s in row] for row in score])
    return _worth([score[i][j] for i, j in enumerate(at)], len(a) == len(b))
