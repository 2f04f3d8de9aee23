"""Variant spellings of names: a delete index on place words, then assignment of words.

Within a register rows meet by the keys of :mod:`regfuse.llm.plants`: a whole place word, or what is left of two words
when the same half of each is deleted on both sides. Pairs that cannot be one plant by qualifier, fuel, country or
position are dropped in the join itself; the names of the others are aligned by optimal assignment of words, allowing for
initials, abbreviations, short forms and words in another order.

No list of rows is gathered: pairs come out of an equi-join whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfuse.llm.plants import CLOSE_KM, compared, index_keys, meeting, prepare


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        score, km = compared(pdf)
        same = (score > 0.5) | ((score > 0) & (km <= CLOSE_KM))
        yield pd.DataFrame({"row_id_one": pdf["one"][same], "row_id_two": pdf["other"][same], "score": score[same]})


def find_variants(plants: DataFrame) -> DataFrame:
    """Pairs of rows of one register whose names are different spellings of one plant's: ``row_id_one, row_id_two, score``.

    The smaller id first, no pair twice. Rows with a null, blank or placeless name pair with none; identical strings
    are no pair; blocks and units of a plant belong to it, whatever their numbers. A missing fuel, country or position
    contradicts nothing. Needs the columns ``row_id, source_name, name, fueltype, technology, country, capacity, lat,
    lon``; others are not read. An empty table gives no rows."""
    _, rows = prepare(plants)
    met = meeting(index_keys(rows, True, {"name": F.hash("name")}), True, ["name"]).filter("a_name <> b_name")
    return met.mapInPandas(_aligned, "row_id_one bigint, row_id_two bigint, score double").distinct()
