"""Best representative of each duplicate group: iterative truth discovery, field by field.

Sources vote for the values they deliver. A vote weighs as much as its source is reliable; a source is as reliable
as its values agree with the values that win. Both are estimated in turn until they settle. Numbers agree within a
tolerance, other values if they are equal after normalisation.

The recency rule for :func:`latest_survivors` is separate: see there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regfuse.functions.missing import field_missing
from regfuse.session import Cut

ITERATIONS, TOLERANCE = 20, 1e-3
#: Agreements a source is credited with in advance, and the trials these count as.
PRIOR_HITS, PRIOR_TRIALS = 8.0, 10.0
MAX_SOURCES = 100_000


def _claims(df: DataFrame, group: str, id_col: str, source: str, fields: list[str], missing: dict[str, Column], match: dict[str, Column], order: Column | None) -> DataFrame:
    recent = order if order is not None else F.lit(None).cast("timestamp")
    parts = [F.when(~missing[f], F.struct(F.lit(f).alias("field_name"), match.get(f, F.lower(F.trim(F.col(f).cast("string")))).cast("string").alias("key"), F.col(f).cast("string").alias("value"))) for f in fields]
    return (
        df.filter(F.col(group).isNotNull())
        .select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"), recent.alias("at"), F.explode(F.array(*parts)).alias("c"))
        .filter(F.col("c").isNotNull())
        .select("g", "id", "s", "at", "c.*")
    )


def discover_truth(df: DataFrame, group: str = "grouped", id_col: str = "row_id", source: str = "source_name", fields: list[str] | None = None, missing: dict[str, Column] | None = None, match: dict[str, Column] | None = None, order: Column | None = None, iterations: int = ITERATIONS) -> tuple[DataFrame, dict[tuple[str, str], float]]:
    """For each group and field the best supported value: ``g, field_name, value, row_id, support, votes``.

    ``missing`` says when a field has no value (default: the register's rules), ``match`` maps a field to the
    normalised form in which values are compared. Of the rows with the winning value the latest by ``order``, ties to
    the smallest id, gives value and ``row_id``; ``support`` is the winner's share of all weight. Ties between values
    go to the later one, then to the smaller id. Fields missing in all rows give no row; a null group is ignored; a
    null source is one source. Returns the frame and the reliability of each (source, field).

    Votes are summed per (group, field, value, source) before anything else, so a group that holds a third of all rows
    is pre-aggregated on the map side. Only reliabilities reach the driver, one number a source and field; more than
    100,000 of them are refused."""
    fields = fields or ["capacity", "datein", "fueltype", "lat"]
    missing = {f: (missing or {}).get(f, field_missing(f)) for f in fields}
    claims = _claims(df, group, id_col, source, fields, missing, match or {}, order)
    first = F.max(F.struct(F.col("at"), (-F.col("id")).alias("neg"), F.col("id").alias("id"), F.col("value").alias("value"))).alias("pick")
    votes = Cut(claims.groupBy("g", "field_name", "key", "s").agg(F.count(F.lit(1)).alias("n"), first), "votes")
    trust: dict[tuple[str, str], float] = {}
    for _ in range(iterations):
        new = _reliability(votes.df, trust)
        if len(new) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources and fields")
        moved = max((abs(new[k] - trust.get(k, PRIOR_HITS / PRIOR_TRIALS)) for k in new), default=0.0)
        trust = new
        if moved < TOLERANCE:
            break
    support = _support(votes.df, trust)
    best = support.groupBy("g", "field_name").agg(F.max(F.struct(F.round("w", 9).alias("w"), "pick.at", "pick.neg", "pick.id", "pick.value")).alias("b"), F.sum("w").alias("all"), F.sum("n").alias("votes"))
    out = best.select("g", "field_name", F.col("b.value").alias("value"), F.col("b.id").alias(id_col), (F.col("b.w") / F.col("all")).alias("support"), "votes")
    return out, trust


def _weight(trust: dict[tuple[str, str], float]) -> Column:
    """log odds of a source's reliability in a field; the same for all before the first estimate."""
    if not trust:
        return F.lit(1.0)
    odds = {f"{s}\x00{f}": math.log(max(min(t, 0.999), 0.501) / (1 - max(min(t, 0.999), 0.501))) for (s, f), t in trust.items()}
    m = F.create_map(*[F.lit(x) for kv in odds.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.concat_ws("\x00", "s", "field_name")), F.lit(math.log(4.0)))


def _support(votes: DataFrame, trust: dict[tuple[str, str], float]) -> DataFrame:
    # a source that repeats itself is one voice, a little louder
    w = _weight(trust) * (1 + F.log(F.col("n").cast("double")))
    return votes.groupBy("g", "field_name", "key").agg(F.sum(w).alias("w"), F.sum("n").alias("n"), F.max("pick").alias("pick"))


def _reliability(votes: DataFrame, trust: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
    support = _support(votes, trust)
    share = support.groupBy("g", "field_name").agg(F.sum("w").alias("all"))
    scored = votes.join(support.select("g", "field_name", "key", "w"), ["g", "field_name", "key"]).join(share, ["g", "field_name"])
    rates = scored.groupBy("s", "field_name").agg(F.sum(F.col("n") * F.col("w") / F.col("all")).alias("hit"), F.sum("n").alias("n")).collect()
    return {(r.s, r.field_name): (r.hit + PRIOR_HITS) / (r.n + PRIOR_TRIALS) for r in rates}


def latest_survivors(df: DataFrame, group: str = "grouped", id_col: str = "row_id", fields: list[str] | None = None, order: str = "updated_at", missing: dict[str, Column] | None = None) -> DataFrame:
    """For each group of two or more rows and each field the row whose value survives: ``group, field_name, id_col``.

    Of the rows where the field is not missing, the latest by ``order`` (null: earliest), ties to the smallest id.
    This is the limit of weighted votes when a later state outweighs all earlier ones together; source reliability
    has then no say, so nothing is iterated. One aggregation with map-side combining: a group that holds a third of
    all rows costs one small row a task. Fields missing in all rows give none; null groups are ignored."""
    fields = fields or ["capacity", "datein", "fueltype", "lat"]
    missing = {f: (missing or {}).get(f, field_missing(f)) for f in fields}
    last = lambda f: F.max(F.when(~missing[f], F.struct(F.col(order), -F.col(id_col), F.col(id_col).alias("id")))).alias(f)
    one = df.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"), *[last(f) for f in fields]).filter("_n >= 2")
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f)["id"].alias("id")) for f in fields])).alias("x")
    return one.select("_g", rows).filter("x.id is not null").select(F.col("_g").alias(group), F.col("x.field_name").alias("field_name"), F.col("x.id").alias(id_col))
