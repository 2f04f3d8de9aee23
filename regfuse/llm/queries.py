"""Queries of the operators in this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regfuse.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regfuse.llm.truth import latest_survivors

    return latest_survivors(table(spark, sf_dir, "powerplants"))


def p1_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth discovery by votes: the best supported value of each field of each group."""
    from regfuse.functions.vocab import fuel_class
    from regfuse.llm.truth import discover_truth

    plants = table(spark, sf_dir, "powerplants")
    match = {
        "capacity": F.round(F.log10(F.greatest(F.col("capacity"), F.lit(1e-3))) * 40),
        "datein": F.col("datein").cast("int"),
        "lat": F.round(F.col("lat"), 1),
        "fueltype": F.coalesce(fuel_class("fueltype"), F.lower("fueltype")),
    }
    # the sources of a group are the deliveries of one register: reliability is kept per register and year of delivery
    out, _ = discover_truth(plants.withColumn("_delivery", F.concat_ws("/", "source_name", F.year("loaded_at"))), source="_delivery", match=match, order=F.col("updated_at"))
    return out.select(F.col("g").alias("grouped"), "field_name", "value", "row_id", F.round("support", 6).alias("support"), "votes")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regfuse.llm.components import match_groups

    return match_groups(table(spark, sf_dir, "matches"))


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with confidence and cosine."""
    from regfuse.llm.entities import find_matches

    out = find_matches(table(spark, sf_dir, "powerplants"))
    return out.select("row_id_one", "row_id_two", F.round("confidence", 4).alias("confidence"), F.round("cosine", 4).alias("cosine"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_matches(spark, sf_dir).select("row_id_one", "row_id_two")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regfuse.llm.variants import find_variants

    return find_variants(table(spark, sf_dir, "powerplants")).select("row_id_one", "row_id_two")


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regfuse.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def p8_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the bound no packing can go under, and how full they are."""
    from regfuse.llm.packing import certificate

    return certificate(p8_pack(spark, sf_dir)).withColumn("filled", F.round("filled", 6))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regfuse.llm.leakage import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "bench_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regfuse.llm.residue import find_residue

    return find_residue(table(spark, sf_dir, "documents")).select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_truth": p1_truth, "p2_found": p2_found, "p3_found": p3_found, "p3_matches": p3_matches, "p6_found": p6_found, "p8_pack": p8_pack, "p8_certificate": p8_certificate, "p9_found": p9_found, "p10_found": p10_found}

_PRESENT = {
    "capacity": "capacity > 0 AND NOT isnan(capacity) AND capacity <= 1e12 AND capacity NOT IN (99999, 999999, 9999999, 99999999, 999999999, 88888, 888888)",
    "datein": "datein BETWEEN 1850 AND 2035",
    "fueltype": "lower(trim(fueltype)) NOT IN ('', '-', '?', 'n/a', 'na', 'tbd', 'unknown', 'unbekannt', 'none', 'null', 'nan', '--', 'x', '0')",
    "lat": "lat BETWEEN 27 AND 82",
}

SQL: dict[str, str] = {
    "p1_found": "WITH p AS (SELECT * FROM powerplants WHERE grouped IN (SELECT grouped FROM powerplants WHERE grouped IS NOT NULL GROUP BY grouped HAVING count(*) >= 2))\n"
    + "\nUNION ALL\n".join(
        f"SELECT grouped, '{f}' AS field_name, row_id FROM (SELECT grouped, row_id, row_number() OVER (PARTITION BY grouped ORDER BY updated_at DESC NULLS LAST, row_id) AS rn FROM p WHERE {cond}) WHERE rn = 1"
        for f, cond in _PRESENT.items()
    ),
    "p2_found": r"""
WITH RECURSIVE links AS (
  SELECT trim(projectid, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS a, trim(other_projectid, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS b
  FROM matches WHERE projectid IS NOT NULL AND other_projectid IS NOT NULL),
e AS (SELECT a, b FROM links WHERE a <> '' AND b <> '' UNION SELECT b, a FROM links WHERE a <> '' AND b <> ''),
reach AS (SELECT a AS x, a AS y FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a)
SELECT x AS projectid, min(y) AS group_projectid FROM reach GROUP BY x
""",
}
